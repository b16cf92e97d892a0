"""Suffix-array repetition against brute force over windows."""

import random
import re
from collections import Counter

import pytest

from waypost.llm import repeats

SCHEMA = "n_words string, doc_id long, text string, kept int, id string"


def brute(text, min_run=repeats.MIN_RUN, max_covered=repeats.MAX_COVERED_PERCENT, max_run=repeats.MAX_RUN):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)

    def twice(size):
        at = {}
        for p in range(n - size + 1):
            at.setdefault(tuple(words[p:p + size]), []).append(p)
        return [p for places in at.values() if len(places) > 1 for p in places]

    def spans(size):
        return len({p + k for p in twice(size) for k in range(size)})

    longest = 0
    while longest < n and twice(longest + 1):
        longest += 1
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    counts = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
              sum(c - 1 for c in Counter(lines).values()), spans(3), spans(min_run), longest)
    failed = n < 50 or 100 * counts[4] > 50 * n
    return (*counts, failed, not failed and 100 * counts[5] <= max_covered * n and longest <= max_run)


def texts(seed):
    rng = random.Random(seed)
    for k in range(90):
        vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 5, 60, 400]))] + ["é#", "<b>", "日本|"]
        lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 9))]
        for _ in range(rng.randint(0, 4)):
            if lines:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice(lines))
        yield rng.choice(["\n", "\n\n", " \n"]).join(lines)
    block = " ".join(f"v{i}" for i in range(230))
    yield block + " between " + block
    yield " ".join(f"u{i}" for i in range(1500)) + " " + block + " x " + block
    yield "same " * 300
    yield "a b " * 200


def rows_of(frame):
    names = (*repeats.COUNTS, "base_failed", "kept")
    return {(r.doc_id, r.text): tuple(r[name] for name in names) for r in frame.collect()}


def test_counts_and_verdict(spark):
    made = [("x", k, text, 1, "y") for k, text in enumerate(texts(3))]
    made += [("x", 900, None, 0, None), ("x", 901, "", 0, ""), ("x", None, " \n\t", 0, ""), made[5], made[5]]
    frame = spark.createDataFrame(made, SCHEMA)
    rated = repeats.rated(frame.repartition(3))
    assert rated.columns == ["doc_id", "text", "id", *repeats.COUNTS, "base_failed", "kept"]
    got = rows_of(rated)
    assert rated.count() == len(made)
    for _, doc_id, text, _, _ in made:
        assert got[doc_id, text] == brute(text), (doc_id, text)
    kept = repeats.keep_varied(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(
        (d, t) for _, d, t, _, _ in made if brute(t)[-1])


@pytest.mark.parametrize("min_run, max_covered, max_run", [(4, 10, 6), (12, 60, 1000)])
def test_limits_are_parameters(spark, min_run, max_covered, max_run):
    made = [("", k, text, 1, "") for k, text in enumerate(texts(11))]
    got = rows_of(repeats.rated(spark.createDataFrame(made, SCHEMA), min_run, max_covered, max_run))
    for _, doc_id, text, _, _ in made:
        assert got[doc_id, text] == brute(text, min_run, max_covered, max_run)


def test_long_text_and_empty_table(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(3000)}" for _ in range(60_000)]
    words += words[100:5_000]
    text = " ".join(words)
    found = repeats.rated(spark.createDataFrame([("", 1, text, 1, "")], SCHEMA)).first()
    assert found.n_words == 64_900 and found.longest_repeat == 4_900 and not found.kept
    assert found.n_covered_words == 9_800
    assert repeats.rated(spark.createDataFrame([], SCHEMA)).count() == 0
