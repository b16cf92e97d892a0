import math
import random
import re
from collections import Counter

import pytest

from waypost.operators.cosine import build_cosine_index, match_cosine


def terms_of(text):
    words = re.findall(r"\w{2,}", text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(source, target, threshold, max_features=None):
    docs = {i: Counter(terms_of(text)) for i, text in target}
    df, total = Counter(), Counter()
    for counts in docs.values():
        df.update(counts.keys())
        total.update(counts)
    kept = sorted((t for t in df if df[t] <= 0.9 * len(docs)), key=lambda t: (-total[t], t))
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in kept[:max_features]}

    def vector(counts):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    targets = {i: vector(c) for i, c in docs.items()}
    best = {}
    for i, text in source:
        v = vector(Counter(terms_of(text)))
        scored = [(round(sum(w * t.get(k, 0) for k, w in v.items()), 9), -j)
                  for j, t in targets.items()]
        score, j = max(scored)
        if score >= threshold:
            best[i] = (-j, score)
    return best


def run(spark, source, target, **params):
    features = params.pop("max_features", None)
    frames = [spark.createDataFrame(rows, "page_id long, match_text string")
              for rows in (source, target)]
    index = build_cosine_index(frames[1], features)
    rows = match_cosine(frames[0], index, **params).collect()
    return {r.page_id: (r.target_page_id, r.score) for r in rows}


def corpus(seed, n_source=60, n_target=80):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["été", "x1"]

    def text():
        # A hot word in a third of the texts, many exact copies.
        if rng.random() < 0.3:
            return "common shared page"
        chosen = rng.choices(words, k=rng.randint(1, 8))
        return " ".join(chosen + (["common"] if rng.random() < 0.4 else []))

    return ([(i, text()) for i in range(n_source)], [(1000 + i, text()) for i in range(n_target)])


@pytest.mark.parametrize("threshold", [0.30, 0.55])
def test_same_as_all_pairs(spark, threshold):
    source, target = corpus(5)
    want = brute_force(source, target, threshold)
    got = run(spark, source, target, threshold=threshold)
    assert want and got.keys() == want.keys()
    for page, (target_id, score) in want.items():
        assert got[page][0] == target_id and got[page][1] == pytest.approx(score, abs=2e-9)


def test_small_blocks_change_nothing(spark):
    source, target = corpus(6)
    whole = run(spark, source, target)
    assert run(spark, source, target, block_rows=8) == run(spark, source, target, block_rows=64) == whole


def test_vocabulary_cap_on_request(spark):
    source, target = corpus(7)
    want = brute_force(source, target, 0.3, max_features=15)
    got = run(spark, source, target, max_features=15)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_copies_resolve_to_the_lowest_target(spark):
    got = run(spark, [(1, "alpha beta")], [(7, "alpha beta"), (5, "alpha beta"), (6, "gamma"),
                                           (8, "delta")])
    assert got == {1: (5, 1.0)}


def test_single_target_has_no_vocabulary(spark):
    assert run(spark, [(1, "alpha beta")], [(2, "alpha beta")]) == {}
