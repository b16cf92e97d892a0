"""Vector operators against brute force."""

import numpy as np
import pytest

from waypost.llm.caps import near_vectors
from waypost.llm.neighbours import nearest

SCHEMA = "label int, extra string, vec_id long, embedding array<float>"


def _brute(rows, similarity=0.93):
    """(vec_id, n_links, component_id) by comparing all pairs."""
    good = []
    for number, (label, _, vec, x) in enumerate(rows):
        if label is None or vec is None or x is None or not x or any(v is None or not np.isfinite(v) for v in x):
            continue
        if any(x):
            x = np.array(x, np.float64)
            good.append((number, label, x / np.linalg.norm(x)))
    links, root = {n: set() for n in range(len(rows))}, list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for k, (a, label, x) in enumerate(good):
        for b, other, y in good[:k]:
            if label == other and len(x) == len(y) and x @ y >= similarity:
                links[a].add(b)
                links[b].add(a)
                root[find(a)] = find(b)
    least = {}
    for n, row in enumerate(rows):
        if row[2] is not None:
            least[find(n)] = min(least.get(find(n), row[2]), row[2])
    return sorted((row[2] if row[2] is not None else -1, len(links[n]), least.get(find(n), -1))
                  for n, row in enumerate(rows))


def _clustered(rng, count, dim=64):
    base = rng.standard_normal((count, dim))
    rows = []
    for k, x in enumerate(base):
        for c in range(int(rng.choice([1, 1, 2, 3, 20]))):
            y = x / np.linalg.norm(x) + (0 if c % 3 == 0 else 0.3) * rng.standard_normal(dim) / np.sqrt(dim)
            rows.append((int(k % 3), "x", len(rows), [float(v) for v in y.astype(np.float32)]))
    return rows


def test_near_vectors_equal_brute_force(spark):
    rows = _clustered(np.random.default_rng(1), 150)
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == _brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_vectors_in_a_group_of_many_blocks(spark, monkeypatch):
    from waypost.llm import caps
    monkeypatch.setattr(caps, "BLOCK", 8)
    rng = np.random.default_rng(2)
    x = rng.standard_normal(64)
    rows = [(1, "x", n, [float(v) for v in (x + 0.2 * rng.standard_normal(64)).astype(np.float32)]) for n in range(90)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == _brute(rows)


def test_near_vectors_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    x, y = [1.0, 2.0, 3.0], [1.0, 2.0, 3.01]
    rows = [(1, "", 1, x), (1, "", 1, x), (1, "", 2, y), (2, "", 3, x), (None, "", 4, x), (1, "", None, x),
            (1, "", 5, None), (1, "", 6, []), (1, "", 7, [0.0] * 3), (1, "", 8, [nan, 1.0, 1.0]),
            (1, "", 9, [inf, 1.0, 1.0]), (1, "", 10, [1.0, 2.0]), (1, "", 11, [None, 2.0, 3.0]),
            (1, "", 12, [2.0, 4.0, 6.0])]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, -1 if r.component_id is None else r.component_id)
                  for r in got) == _brute(rows)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def _nearest(rows, every, k):
    good = sorted((v, x) for _, _, v, x in rows if v is not None and x and all(
        c is not None and np.isfinite(c) for c in x) and any(x))
    ids, matrix = np.array([v for v, _ in good]), np.array([x for _, x in good], np.float64)
    found = {}
    for n, v in enumerate(ids):
        if v % every == 0:
            order = sorted((-(matrix[n] @ matrix[m]), ids[m]) for m in range(len(ids)) if m != n)[:k]
            found[int(v)] = [int(v) for _, v in order]
    return found


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    rows = [(1, "", n, [float(v) for v in (centres[n % 40] + 0.4 * rng.standard_normal(32)) * (1 + n % 5)])
            for n in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    got = nearest(frame, every=20, k=10).collect()
    want = _nearest(rows, 20, 10)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert r.score == pytest.approx(float(np.dot(rows[r.query_id][3], rows[r.vec_id][3])), rel=1e-12)
    assert found.keys() == want.keys() and all(len(v) == 10 for v in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_nearest_with_ties_and_odd_rows(spark, monkeypatch):
    from waypost.llm import neighbours
    monkeypatch.setattr(neighbours, "ROWS_BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    rows = [(1, "", n, [1.0, 2.0]) for n in range(100)] + [
        (1, "", 100, None), (1, "", 120, [0.0, 0.0]), (1, "", None, [1.0, 1.0]), (1, "", 140, [float("nan"), 1.0]),
        (1, "", 160, [1.0, 2.0, 3.0])]
    got = nearest(spark.createDataFrame(rows, SCHEMA), every=20, k=5).collect()
    want = {q: [v for v in range(6) if v != q][:5] for q in range(0, 100, 20)}
    assert {(r.query_id, r["rank"]): r.vec_id for r in got} == {
        (q, k + 1): v for q, own in want.items() for k, v in enumerate(own)}
    few = nearest(spark.createDataFrame(rows[:3], SCHEMA), every=2, k=5).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2), (2, 0), (2, 1)]
    assert nearest(spark.createDataFrame([], SCHEMA)).count() == 0
