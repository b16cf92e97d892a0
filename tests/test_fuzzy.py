import random

import pandas as pd
import pytest

from waypost.functions.similarity import token_set_ratio
from waypost.operators import fuzzy
from waypost.operators.fuzzy import length_bands, match_fuzzy


def brute_force(sources, targets, threshold):
    best = {}
    for path in set(sources):
        scored = [(-token_set_ratio(path, t), first) for t, first in targets
                  if token_set_ratio(path, t) >= threshold]
        if scored:
            best[path] = (min(scored)[1], -min(scored)[0])
    return best


def run(spark, sources, targets, **params):
    source = spark.createDataFrame([(p,) for p in sources], "path string")
    target = spark.createDataFrame(targets, "path string, first_id long")
    rows = match_fuzzy(source, target, **params).collect()
    assert len(rows) == len({r.path for r in rows})
    return {r.path: (r.first_id, r.score) for r in rows}


def paths(seed, n, alphabet="abcde/-", longest=90):
    rng = random.Random(seed)
    found = set()
    while len(found) < n:
        if found and rng.random() < 0.6:
            base = list(rng.choice(sorted(found)))
            for _ in range(rng.randint(1, max(1, len(base) // 6))):
                at = rng.randrange(len(base))
                base[at:at + rng.randint(0, 1)] = rng.choice(alphabet)
            found.add("".join(base))
        else:
            found.add("/" + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))))
    return sorted(found)


@pytest.mark.parametrize("threshold", [60, 80, 95])
def test_same_as_all_pairs(spark, threshold):
    all_paths = paths(threshold, 160)
    sources, targets = all_paths[::2], [(p, 500 - i) for i, p in enumerate(all_paths[1::2])]
    want = brute_force(sources, targets, threshold)
    assert want
    assert run(spark, sources, targets, threshold=threshold) == want
    assert run(spark, sources, targets, threshold=threshold, block_rows=64) == want


def test_paths_with_blanks_use_the_token_set(spark):
    all_paths = paths(9, 120, alphabet="abc /", longest=25)
    all_paths = sorted({" ".join(p.split()) for p in all_paths})
    sources, targets = all_paths[::2], [(p, i) for i, p in enumerate(all_paths[1::2])]
    want = brute_force(sources, targets, 80)
    assert any(" " in p for p in want)
    assert run(spark, sources, targets, threshold=80) == want


def test_accents_and_ties(spark):
    got = run(spark, ["/été/robot", "/abcd1"],
              [("/ete/robot", 1), ("/été/robots", 2), ("/abcd2", 9), ("/abcd3", 4)])
    assert got["/été/robot"][0] == 2
    assert got["/abcd1"][0] == 4


def test_one_word_in_a_third_of_the_paths(spark):
    sources = [f"/shop/item-{i}" for i in range(150)]
    targets = [(f"/shop/items-{i}", i) for i in range(150)]
    assert run(spark, sources, targets, block_rows=64) == brute_force(sources, targets, 80)


def test_threshold_must_be_positive(spark):
    with pytest.raises(ValueError):
        run(spark, ["/a"], [("/a", 1)], threshold=0)


def test_pairs_sharing_a_word_are_scored_by_words_only(spark):
    source = spark.createDataFrame([("c ca bca",)], "path string")
    target = spark.createDataFrame([("cca ca", 1)], "path string, first_id long")
    assert match_fuzzy(source, target, threshold=75).count() == 0
    found = match_fuzzy(source, target, threshold=70).collect()
    assert [round(r.score, 2) for r in found] == [71.43]


@pytest.mark.parametrize("threshold", [55, 80, 100])
def test_partners_meet_in_a_band(threshold):
    t = threshold / 100
    for n in range(0, 400):
        (own, shortest), = length_bands(n, t, own=True)
        for m in range(0, 400):
            if 2 * min(n, m) >= t * (n + m):
                partner = dict(length_bands(m, t, own=False))
                assert own in partner and partner[own] <= max(n, 1) + 1e-9 and shortest <= m + 1e-9


@pytest.mark.parametrize("blank", [False, True])
def test_a_block_holds_some_pairs_at_a_time(monkeypatch, blank):
    sep = " " if blank else "-"
    left = pd.DataFrame({"path": [f"/shop{sep}red{sep}vase{sep}{i:03d}" for i in range(60)], "key": 1})
    right = pd.DataFrame({"path": [f"/shop{sep}red{sep}vases{sep}{i:03d}" for i in range(50)],
                          "first_id": range(50), "key": 1})
    left, right = (pd.concat([side, side.assign(key=2)], ignore_index=True) for side in (left, right))
    make = fuzzy._best_sharing_words if blank else fuzzy.best_in_block
    whole = make(80.0)(left.copy(), right.copy())
    sizes, name = [], "WordBlock" if blank else "PathBlock"
    scores = getattr(fuzzy, name).scores
    monkeypatch.setattr(getattr(fuzzy, name), "scores",
                        lambda self, i, *rest: sizes.append(len(i)) or scores(self, i, *rest))
    monkeypatch.setattr(fuzzy, "PART_PAIRS", 200)
    parts = make(80.0)(left.copy(), right.copy())
    assert len(whole) == 60 and max(sizes) <= 200
    assert whole.sort_values("path").reset_index(drop=True).equals(parts.sort_values("path").reset_index(drop=True))
