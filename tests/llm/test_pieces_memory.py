"""Encoding and decoding hold a few rows at a time, not what becomes of a whole batch."""

import tracemalloc

import numpy as np
import pyarrow as pa

from waypost.llm import pieces


def test_a_batch_is_encoded_and_decoded_in_bounded_memory():
    voc = pieces.vocabulary(pieces.zipf(pieces.read_pieces()))
    words = np.array(["mapa", "red", "site", "plans", "old", "pages"])
    rng = np.random.default_rng(0)
    texts = [" ".join(words[rng.integers(0, len(words), 20_000)]) for _ in range(120)] + [None, ""]
    column = pa.array(texts, pa.string())
    encoder, decoder = pieces.Encoder(voc), pieces.Decoder(voc)
    encoder.encode([texts[0].encode()])
    tracemalloc.start()
    rows = bytes_of = 0
    for lists in encoder.arrays(column):
        for shown in decoder.arrays(lists):
            assert shown.to_pylist() == [text or "" for text in texts[rows:rows + len(shown)]]
            rows += len(shown)
        bytes_of = max(bytes_of, lists.values.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(texts) and bytes_of <= 4 * pieces.CHUNK
    # 4 MB of text at once, as before, take 87 MB.
    assert peak < 60e6


def test_slices_and_rows_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 40)
    voc = pieces.vocabulary(pieces.zipf(pieces.read_pieces()))
    texts = ["x", None, "a much longer text than one chunk has room for, in one row", "", "two words", "end"]
    column = pa.array(["before"] + texts, pa.string())[1:]
    lists = list(pieces.Encoder(voc).arrays(column))
    assert sum(len(some) for some in lists) == len(texts) and len(lists) > 1
    found = [text for some in lists for part in pieces.Decoder(voc).arrays(some) for text in part.to_pylist()]
    assert found == [text or "" for text in texts]
    docs = spark.createDataFrame([(k, text) for k, text in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = pieces.decode(pieces.encode(docs)).orderBy("doc_id").collect()
    assert [row.decoded for row in got] == [text or "" for text in texts]
