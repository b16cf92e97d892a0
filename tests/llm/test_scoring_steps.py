"""Steps of the language model that do less work give what the plain ones give."""

import numpy as np
import pyarrow as pa

from waypost.llm import attention as model, scoring, words


def _plain(column):
    seen = words.word_chunks(column, lower=True, limit=1 << 20)
    return np.concatenate([words.word_hashes(chunk) for chunk in seen])


def test_hashes_do_not_depend_on_where_sums_begin(monkeypatch):
    column = pa.array(["Some words, one " + "x" * 70 + " long ", None, "", " ", "some words"] * 3)
    whole = _plain(column)
    for size in (1, 16, 64):
        monkeypatch.setattr(words, "_HASHED_BYTES", size)
        assert np.array_equal(_plain(column), whole)
    assert whole[0] == whole[5]


def test_words_on_one_slot_keep_their_pieces(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(f"word{k}x" for k in rng.integers(0, 60, 40)) for _ in range(6)] + [None, ""]
    vocabulary = open(scoring.PIECES, "rb").read()

    def cut():
        own = scoring.Segmenter(vocabulary)
        return [part.tolist() for text in texts for chunk in words.word_chunks(pa.array([text], pa.string()))
                for part in own.pieces(chunk, words.word_hashes(chunk))]

    wide = cut()
    plain = scoring.Segmenter(vocabulary)._pieces
    want = [i for word in texts[0].split() for i in plain.encode(word)]
    assert wide[0] == want and wide[1] == [len(want)]
    monkeypatch.setattr(scoring, "_SLOTS", 4)
    assert cut() == wide
    monkeypatch.setattr(scoring, "TABLE", 10)
    assert cut() == wide


def test_head_finds_its_words_and_no_others(monkeypatch):
    rng = np.random.default_rng(1)
    for slots in (4, 64, 1 << 20):
        monkeypatch.setattr(scoring, "_SLOTS", slots)
        for number in (0, 1, 50):
            keys = np.unique(rng.integers(0, 1 << 64, number, dtype=np.uint64))
            hashes = np.concatenate([keys, keys ^ np.uint64(1 << 40), np.array([0, 3, (1 << 64) - 1], np.uint64)])
            near, there = scoring.Head(keys).find(hashes)
            assert np.array_equal(there, np.isin(hashes, keys))
            assert np.array_equal(keys[near[there]], hashes[there])


def test_rows_without_their_maximum_are_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    q, k = rng.standard_normal((2, 5, model.WINDOW, model.WIDTH)).astype(np.float32)
    for places in (model.WINDOW, model.STRIDE):
        own = q[:, model.WINDOW - places:]
        scores, shares = model._attend(own, k)
        with monkeypatch.context() as changed:
            changed.setattr(model, "_MILD", (2.0, 1.0))
            other, parts = model._attend(own, k)
        assert not np.allclose(scores, other) and np.allclose(scores * shares, other * parts, atol=1e-6)
        large, parts = model._attend(own * 1000, k)
        assert np.isfinite(large).all() and np.allclose((large * parts).sum(axis=2), 1, atol=1e-5)


def test_ids_are_one_value_a_row(spark):
    rows = [(1, False, "Some words and others"), (2, True, None), (3, False, "")] * 3
    found = scoring.segmented(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string"))
    assert dict(found.dtypes)["ids"] == "binary"
    column = pa.array([row.ids for row in found.orderBy("doc_id").collect()], pa.binary())
    plain = scoring.Segmenter(open(scoring.PIECES, "rb").read())._pieces
    want = [i for word in "some words and others".split() for i in plain.encode(word)]
    for size in (32_000, 1 << 17):
        kind = scoring._id_type(size)
        lists = pa.array([np.frombuffer(value, "<u2").tolist() for value in column.to_pylist()], pa.list_(pa.int32()))
        bytes_of = pa.array([np.array(ids, kind).tobytes() for ids in lists.to_pylist()], pa.binary())
        for part in (slice(0, 9), slice(1, 5), slice(4, 9), slice(0, 0)):
            ids, number = scoring._lists(bytes_of[part], size)
            other, numbers = scoring._lists(lists[part], size)
            assert ids.tolist() == other.tolist() and number.tolist() == numbers.tolist()
        assert ids.tolist() == [] and scoring._lists(bytes_of, size)[0][:len(want)].tolist() == want


def test_counts_of_chunks_are_added_up(spark):
    rows = [(k, False, text) for k, text in enumerate(["a b a", "b c", "", None, "a " * 50] * 4)]
    docs = scoring.segmented(spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").coalesce(1))
    want = sorted(scoring.counts(docs, 32_000).collect())
    parts = [(np.array([1, 5]), np.array([2, 3])), (np.array([0, 5, 7]), np.array([1, 1, 4])), (np.zeros(0, int),) * 2]
    keys, n = scoring._added(parts)
    assert keys.tolist() == [0, 1, 5, 7] and n.tolist() == [1, 2, 4, 4]
    assert [len(part) for part in scoring._added(parts[2:] * 2)] == [0, 0]
    assert sum(row.n for row in want if row.kind == 0) == 4 * (3 + 2 + 50)
    assert [row.n for row in want if row.kind == 2] == [20]
    assert [row.n for row in want if row.kind == 1 and row.key == 32_000 * (scoring._PAIR + 1)] == [8]
