import tracemalloc

import numpy as np
import pandas as pd

from waypost.operators import cosine


def side(name, n, terms, seed):
    rng = np.random.default_rng(seed)
    rows = [rng.random(terms) for _ in range(n)]
    return pd.DataFrame({name: np.arange(n), "term_ids": [np.arange(terms)] * n,
                         "weights": [w / np.sqrt(w @ w) for w in rows]})


def test_a_block_of_shared_terms_is_held_in_parts(monkeypatch):
    """All rows share all terms: postings met are left rows x right rows x terms."""
    left, right = side("source_id", 60, 40, 1), side("target_id", 3000, 40, 2)
    tracemalloc.start()
    got = cosine.best_in_block(0.3)(left, right)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6   # 7.2 million postings at once are about 400 MB
    product = (np.vstack(left["weights"]) @ np.vstack(right["weights"]).T).round(cosine.SCORE_DIGITS)
    assert got["target_id"].tolist() == product.argmax(axis=1).tolist()
    assert np.allclose(got["score"], product.max(axis=1), atol=1e-9) and got["source_id"].tolist() == list(range(60))
    monkeypatch.setattr(cosine, "PART_ENTRIES", 1)
    pd.testing.assert_frame_equal(cosine.best_in_block(0.3)(left, right), got)


def test_parts_cover_all_rows_once():
    hits = np.array([0, 5, 0, 100, 3, 3, 3, 0])
    for n_right in (1, 4, 1000):
        ranges = list(cosine._parts(hits, n_right))
        assert [i for a, b in ranges for i in range(a, b)] == list(range(len(hits)))
