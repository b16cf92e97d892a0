import random
from collections import Counter

import numpy as np
import pytest

from waypost.functions.similarity import PathBlock, WordBlock, common_length, ratio, token_set_ratio


def table_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            row[j + 1], diagonal = (diagonal + 1 if x == y else max(row[j + 1], row[j])), row[j + 1]
    return row[-1]


def test_block_scores_and_bounds_match_the_table_method():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab/-é𝄞") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130, 200])))
             for _ in range(24)]
    block = PathBlock(texts, texts[::-1])
    i, j = map(np.ravel, np.meshgrid(range(24), range(24), indexing="ij"))
    scores = block.scores(i, j, batch=100)
    for k in range(len(i)):
        a, b = texts[i[k]], texts[::-1][j[k]]
        assert common_length(a, b) == table_lcs(a, b)
        assert scores[k] == ratio(len(a) + len(b), table_lcs(a, b))
    shared = block.characters().rows(slice(None))
    pairs = block.bigrams().rows(slice(None))
    for k in range(len(i)):
        a, b = texts[i[k]], texts[::-1][j[k]]
        length, common = len(a) + len(b), table_lcs(a, b)
        assert shared[i[k], j[k]] == sum((Counter(a) & Counter(b)).values()) >= common
        exact = Counter(zip("<" + a, a + ">")) & Counter(zip("<" + b, b + ">"))
        assert pairs[i[k], j[k]] >= sum(exact.values()) >= 3 * common - length + 1


@pytest.mark.parametrize("a, b, score", [
    ("/en/825", "/en/25", 92.31), ("/en/825", "/fr/825", 71.43), ("/en/825", "/en/176.html", 42.11),
    ("/accessoires/disque-ondule-mini-plus", "/accessories/mini-plus-wavy-disc", 61.76),
    ("/a b", "/a b c", 100.0), ("/a", "b /a", 100.0), ("", "/a", 0.0),
])
def test_token_set_ratio(a, b, score):
    assert round(token_set_ratio(a, b), 2) == score


def test_token_set_ratio_with_shared_and_own_words():
    # Shared "/shop"; leftovers "red" and "reed": 8 common letters of 10 + 11 with the shared word.
    assert round(token_set_ratio("/shop red", "reed /shop"), 2) == round(100 - 100 * 1 / 19, 2)


def test_word_block_equals_pair_scores():
    rng = random.Random(8)
    words = ["red", "reed", "/shop", "été", "a", "ring", "rings", "𝄞x", "b" * 70]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    i, j = map(np.ravel, np.meshgrid(range(40), range(40), indexing="ij"))
    scores = WordBlock(texts, texts[::-1]).scores(i, j, 0.0, batch=333)
    cut = WordBlock(texts, texts[::-1]).scores(i, j, 75.0)
    for k in range(len(i)):
        want = token_set_ratio(texts[i[k]], texts[::-1][j[k]])
        assert scores[k] == pytest.approx(want, abs=1e-12)
        assert (cut[k] >= 75) == (want >= 75) and (want < 75 or cut[k] == want)
