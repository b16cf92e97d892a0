"""K-Means on tables against the same rounds in numpy."""

import numpy as np
import pytest

from waypost.operators.clusters import _Vectors, kmeans

SCHEMA = "page_id long, term_ids array<bigint>, weights array<double>"


def sparse(rows):
    return [(i, [int(t) for t in np.flatnonzero(x)] or None, [float(w) for w in x[x != 0]] or None)
            for i, x in enumerate(rows)]


def lloyd(x, centres):
    """Rounds from given centres until nothing moves."""
    last = None
    while True:
        apart = np.round(((x[:, None] - centres[None]) ** 2).sum(axis=2), 9)
        own = apart.argmin(axis=1)
        if last is not None and (own == last).all():
            return own, apart.min(axis=1).sum()
        last = own
        centres = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])


def test_fixed_point_and_cost(spark):
    rng = np.random.default_rng(3)
    x = rng.random((150, 40)) * (rng.random((150, 40)) < 0.2)
    x[7] = 0
    found = kmeans(spark.createDataFrame(sparse(x), SCHEMA).repartition(3), 4, tol=0.0)
    own = {r.page_id: r.prediction for r in found.pages.collect()}
    assert found.converged and len(own) == 150
    labels = np.array([own[i] for i in range(150)])
    means = np.array([x[labels == c].mean(axis=0) for c in range(4)])
    again, cost = lloyd(x, means)
    assert (again == labels).all() and found.cost == pytest.approx(cost, abs=1e-6)
    centres = np.zeros((4, 40))
    for r in found.centres.collect():
        centres[:, r.term_idx] = r.centre
    assert np.abs(centres - means).max() < 1e-9
    other = kmeans(spark.createDataFrame(sparse(x)[::-1], SCHEMA), 4, tol=0.0)
    assert {r.page_id: r.prediction for r in other.pages.collect()} == own


def test_separate_groups_are_found(spark):
    x = np.zeros((60, 9))
    for i in range(60):
        x[i, 3 * (i % 3)] = 1
        x[i, 3 * (i % 3) + 1] = 0.1 * (i % 5)
    found = kmeans(spark.createDataFrame(sparse(x), SCHEMA), 3)
    groups = {}
    for r in found.pages.collect():
        groups.setdefault(r.page_id % 3, set()).add(r.prediction)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)]


def test_fewer_vectors_than_clusters_and_round_limit(spark):
    x = np.array([[1.0, 0], [1.0, 0], [0, 1.0], [0, 1.0], [0, 0]])
    found = kmeans(spark.createDataFrame(sparse(x), SCHEMA), 5)
    assert found.cost == 0 and len({r.prediction for r in found.pages.collect()}) == 3
    rng = np.random.default_rng(1)
    short = kmeans(spark.createDataFrame(sparse(rng.random((80, 30))), SCHEMA), 6, max_iter=1)
    assert short.rounds == 1 and not short.converged


def test_blocks_change_nothing_and_bound_a_round(spark):
    rng = np.random.default_rng(5)
    x = rng.random((200, 60)) * (rng.random((200, 60)) < 0.2)
    x[3] = 0
    frame = spark.createDataFrame(sparse(x), SCHEMA).repartition(4)
    whole = kmeans(frame, 4, tol=0.0)
    parts = kmeans(frame, 4, tol=0.0, block_entries=300)
    assert sorted(map(tuple, whole.pages.collect())) == sorted(map(tuple, parts.pages.collect()))
    assert parts.rounds == whole.rounds and parts.cost == pytest.approx(whole.cost, abs=1e-6)
    # A round sends a block each of its terms once, not once for every page that holds it.
    vectors = _Vectors(frame, 300)
    asked = vectors.asked.selectExpr("sum(size(blocks))").first()[0]
    blocks = vectors.blocks.select("block").distinct().count()
    assert blocks > 4 and asked <= blocks * 60 < np.count_nonzero(x)
    vectors.release()
