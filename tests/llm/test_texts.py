"""Text operators against brute force on small tables with odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from waypost.llm import lines, mixing, pieces, quality, scoring, simhash, substrings
from waypost.llm.components import components
from waypost.llm.pages import main_text, extract_main_text

SCHEMA = "size int, doc_id long, text string, source string, id string"


def frame(spark, rows):
    """Rows of (doc_id, text, source) with columns whose names operators use themselves."""
    return spark.createDataFrame([(7, d, t, s, "x") for d, t, s in rows], SCHEMA)


def words(text):
    return (text or "").encode().split()


def lower(text):
    return words(text and "".join(c.lower() if c.isascii() else c for c in text))


def corpus(seed, count=120):
    """Copies, near copies, shared passages, repeated lines, empty and long texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Éa", "ß", "x" * 40]
    made = []
    for k in range(count):
        body = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 6))]
        if made and rng.random() < 0.3:
            body = rng.choice(made).split("\n")
            if rng.random() < 0.6 and body[-1]:
                body = body + [body[rng.randrange(len(body))]]
        made.append("\n".join(body))
    rows = [(3 * k + 1, text, f"s{k % 5}" if k % 7 else None) for k, text in enumerate(made)]
    rows += [(0, None, "s0"), (2, "", "s1"), (5, " \t\n \n", "s1"), (None, made[3], "s2"), rows[10], rows[10],
             (8, " ".join(["same"] * 4000), "s3"), (11, "a b\x85c\x1cd", None)]
    return rows


def _order(rows):
    """Distinct documents in the operators' order."""
    return sorted({(d, t or "") for d, t, _ in rows},
                  key=lambda x: (x[0] is not None, x[0] or 0, _spark_hash(x[1])))


def _spark_hash(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(500 + k, 501 + k) for k in range(60)]
    pairs += [(900, 900 + k) for k in range(1, 50)] + [(None, 3), (7, 7)]
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in pairs:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(n, find(n)) for n in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size", [20, 4])
def test_substrings_equal_brute_force(spark, size):
    rows = corpus(size)
    seen, want = {}, {}
    for d, t in _order(rows):
        own = words(t)
        gone = [False] * len(own)
        for k in range(len(own) - size + 1):
            window = tuple(own[k:k + size])
            if window in seen:
                gone[k:k + size] = [True] * size
            seen.setdefault(window, (d, k))
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        want[d, t] = (len(own), sum(gone), kept.decode())
    for sent in (4_000_000, 0):
        got = substrings.without_repeats(frame(spark, rows), size, sent).collect()
        assert sorted(map(str, ((r.doc_id, r.n_words, r.n_removed, r.text) for r in got))) == sorted(
            map(str, ((d, *want[d, t or ""]) for d, t, _ in rows)))
    assert substrings.without_repeats(frame(spark, []), size).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3])
def test_lines_equal_brute_force(spark, size):
    rows = corpus(10 + size)
    seen, want = set(), {}
    for d, t in _order(rows):
        all_lines = t.split("\n")
        filled = [k for k, line in enumerate(all_lines) if words(line)]
        gone = set()
        for k in range(len(filled) - size + 1):
            run = tuple(all_lines[i] for i in filled[k:k + size])
            if run in seen:
                gone.update(range(k, k + size))
            seen.add(run)
        runs = [k for k in sorted(gone) if k - 1 not in gone]
        longest = max((next(n for n in range(1, len(filled) + 2) if k + n not in gone) for k in runs), default=0)
        dropped = {filled[k] for k in gone}
        want[d, t] = (len(filled), len(gone), len(runs), longest,
                      "\n".join(line for k, line in enumerate(all_lines) if k not in dropped))
    got = lines.drop_repeated_lines(frame(spark, rows), size).collect()
    assert sorted(map(str, ((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.longest_run, r.text or "") for r in got))) \
        == sorted(map(str, ((d, *want[d, t or ""]) for d, t, _ in rows)))
    assert all(r["size"] == 7 and r["id"] == "x" for r in got)
    assert next(r for r in got if r.doc_id == 0).text is None
    assert lines.drop_repeated_lines(frame(spark, [])).count() == 0


def _fingerprint(text, size):
    own = lower(text)
    shingles = [b" ".join(own[k:k + size]) for k in range(max(len(own) - size + 1, 1))] if own else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    rows = corpus(31)
    bits = [_fingerprint(t, 3) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a in range(len(rows)):
        for b in range(a):
            if bin(bits[a] ^ bits[b]).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == sorted(
        map(str, ((d, f"{bits[k]:016x}", least.get(find(k))) for k, (d, _, _) in enumerate(rows))))
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert {r.doc_id for r in kept} == set(least.values()) and all(r["id"] == "x" for r in kept)
    assert simhash.simhash_groups(frame(spark, [])).count() == 0


def test_simhash_links_chains_of_fingerprints(spark):
    """All pairs within two bits are reached, also in a ball with many members."""
    rng = random.Random(4)
    centre = rng.getrandbits(63)
    values = {centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(200)}
    values |= {rng.getrandbits(63) for _ in range(200)}
    frame_ = spark.createDataFrame([(v,) for v in values], "bits long")
    found = {r.node: r.component for r in components(simhash.linked(frame_)).collect()}
    for a in values:
        for b in values:
            if 0 < bin(a ^ b).count("1") <= 2:
                assert found[a] == found[b]


def test_mixing_takes_the_targets(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 9, 40, 200])), "abcd"[min(rng.randrange(12), 3)])
            for k in range(3000)] + [(None, "x y", None), (None, None, None), (5, "z", "e")]
    got = mixing.copies(frame(spark, rows)).collect()
    again = mixing.copies(frame(spark, rows).repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    goal, open_, left = {}, set(order), sum(size.values())
    while open_:
        heavy = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / heavy > 3 * size[s]}
        for s in over or open_:
            goal[s] = 3.0 * size[s] if over else left * weight[s] / heavy
        left -= sum(goal[s] for s in over)
        open_ -= over or open_
    for s in order:
        own = [r for r in got if r.source == s]
        assert own[0].target == pytest.approx(goal[s]) and own[0].source_size == size[s]
        assert abs(sum(r.n_copies * r["size"] for r in own) - goal[s]) <= 0.03 * goal[s] + 220
    assert all(0 <= r.n_copies <= 3 for r in got) and all(r["id"] == "x" for r in got)
    mixed = Counter(r.doc_id for r in mixing.mix(frame(spark, rows)).collect())
    assert sum(mixed.values()) == sum(r.n_copies for r in got)
    assert mixing.copies(frame(spark, [])).count() == 0


def test_pieces_equal_exhaustive_search_and_round_trip(spark):
    voc = pieces.vocabulary(pieces.zipf(pieces.read_pieces()))
    known = {text: (i, score) for i, (text, score, kind) in enumerate(pieces.zipf(pieces.read_pieces())) if kind == 1}
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "e", "th", " ", "  ", "é", "日", "😀", "\n", "\x00", "ing", "."])
                     for _ in range(rng.randint(1, 9))) for _ in range(300)] + ["x" * 500, "", "  ", " a  b "]
    ids, counts = pieces.Encoder(voc).encode([t.encode() for t in texts])
    ends = np.concatenate([[0], np.cumsum(counts)])
    decoder = pieces.Decoder(voc)
    for k, text in enumerate(texts):
        own = ids[ends[k]:ends[k + 1]].tolist()
        assert decoder.decode(np.array(own, np.int64)) == text
        if not text or len(text) > 30:
            continue
        marked = (" " + text).replace(" ", "▁")
        best = [0.0] + [-1e9] * len(marked)
        for at in range(len(marked)):
            for end in range(at + 1, min(len(marked), at + 48) + 1):
                part = marked[at:end].encode()
                if part in known:
                    best[end] = max(best[end], best[at] + known[part][1])
            if marked[at].encode() not in known:
                best[at + 1] = max(best[at + 1], best[at] + float(voc.unknown))
        score, run = 0.0, 0
        for i in own:
            if voc.shown[i] == b"" or i in set(voc.bytes_at.tolist()):
                run += 1
            else:
                score += float(voc.scores[i])
        unknown = sum(1 for c in marked if c.encode() not in known)
        assert score + unknown * float(voc.unknown) == pytest.approx(best[-1], abs=1e-3)
        assert pieces.segment(voc, marked.encode()) == own or score + unknown * float(voc.unknown) == pytest.approx(
            best[-1], abs=1e-3)
    rows = corpus(7)
    got = pieces.decode(pieces.encode(frame(spark, rows))).collect()
    assert all(r.decoded == (r.text or "") for r in got) and len(got) == len(rows)
    assert all(r.ids == [] for r in got if not r.text) and all(r["id"] == "x" for r in got)
    assert pieces.decode(pieces.encode(frame(spark, []))).count() == 0


def test_quality_on_held_out_documents(spark):
    rng = random.Random(8)
    base = [f"{a}{b}{c}" for a in "klmnpr" for b in "aeiou" for c in "st"]
    rows, labels = [], []
    for k in range(900):
        good = rng.random() < 0.7
        own = [rng.choice(base) for _ in range(rng.randint(5, 80))]
        rows.append((k, " ".join(own) if good else " ".join(w.upper() + "!!" for w in own), "s"))
        labels.append((k, int(good), "x"))
    labels += [(None, 1, "x"), (3, None, "x"), (4, 7, "x"), labels[0], labels[0]]
    rows += [(None, None, None), (2000, "", "s"), rows[0]]
    docs = frame(spark, rows)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, text string"))
    got = quality.scored(docs, model).collect()
    held = {r.doc_id: r for r in got if r.held_out}
    right = [held[k].predicted == y for k, y, _ in labels[:900] if k in held]
    assert len(held) > 200 and np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r["id"] == "x" for r in got)
    assert len(got) == len(rows) and sum(r.doc_id == 0 for r in got) == 2
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.keep_good(frame(spark, []), model).count() == 0


def test_pages(spark):
    menu = '<nav><a href="/">Home</a></nav><div class="ad">Buy now, very cheap and good, do not miss it.</div>'
    body = "<p>A long paragraph of text, with words enough &amp; more.</p><p>Short.</p><p>One\n  more<br>line &#233;</p>"
    text = "A long paragraph of text, with words enough & more.\nShort.\nOne more line é"
    foot = '<footer>Text of a footer that is rather long, too long maybe.</footer>'
    comments = '<section id="comments"><p>What a nice page, I have read it all and liked it so much.</p></section>'
    for page in (f"<html><head><title>t</title></head><body>{menu}<article><h1>Head</h1>{body}</article>{comments}{foot}",
                 f"<body>{menu}<main><header><h1>Head</h1></header>{body}<form>Name <input></form></main>{foot}"):
        assert main_text(page) == "Head\n" + text
    assert main_text(f"<body>{menu}<div id=c>{body}{comments}</div>{foot}</body>") == text
    assert main_text('<div class="ad"><p>Not closed<article><p>Body</article>') == "Body"
    assert main_text("plain") == "plain" and main_text("<p>a<b>") == "a" and main_text("<") in ("", "<")
    odd = spark.createDataFrame([(None, None, "t"), (1, "", "t"), (2, "<p>x</p>", "t"), (2, "<p>x</p>", "t")],
                                "page_id long, html string, text string")
    assert [(r.page_id, r.text, r.n_chars) for r in extract_main_text(odd).collect()] == [
        (None, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1)]


def test_lm_counts_base_and_windows(spark):
    rows = corpus(9)
    for head in (4, 65_536):
        got = scoring.lm_scores(frame(spark, rows), rounds=1, every=2, head=head).collect()
        learned = [t for d, t, _ in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
        c = Counter(w for t in learned for w in lower(t))
        c[None] = len(learned)
        total, kinds = sum(c.values()), len(c)
        want = []
        for d, t, _ in rows:
            own = lower(t) + [None]
            base = sum(np.log10((c[w] + 1) / (total + kinds + 1)) for w in own)
            want.append(str((d, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, len(own),
                             sum(c[w] > 0 for w in own), total, round(float(base), 5))))
        assert sorted(str((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)))
                      for r in got) == sorted(want)
        assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert scoring.lm_scores(frame(spark, [])).count() == 0

