"""Whitening against a library eigenvalue routine and exact integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waypost.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n string, label int"


def scaled(v):
    return tuple(math.floor(256 * float(np.float32(c))) for c in v)


def expected(rows, k=4):
    """By length: fit list, sums, leading eigenvalues and vectors, trace."""
    found = {}
    for size in {len(v) for _, v in rows}:
        x = sorted({scaled(v) for _, v in rows if len(v) == size})
        n, sums = len(x), [sum(c) for c in zip(*x)]
        centred = np.array(x, float) - np.array([s / n for s in sums])
        cov = centred.T @ centred / n
        values, axes = np.linalg.eigh(cov)
        found[size] = n, sums, values[::-1][:k], axes[:, ::-1][:, :k], np.trace(cov)
    return found


@pytest.mark.parametrize("size", [1, 2, 9, 64, 150])
@pytest.mark.parametrize("kind", range(5))
def test_spectrum(size, kind):
    rng = np.random.default_rng(size)
    q, _ = np.linalg.qr(rng.standard_normal((size, size)))
    e = [rng.random(size), 10.0 ** -np.arange(size), np.full(size, 2.0), np.round(3 * rng.random(size)),
         np.r_[1e6, rng.random(size - 1)]][kind]
    a = q * e @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.spectrum(a)
    scale = np.linalg.norm(a) + 1e-300
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-13 * scale
    assert np.linalg.norm(a @ vectors - vectors * values) < 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-13


def test_polar_of_symmetric():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    values, axes = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - axes * np.sign(values) @ axes.T).max() < 1e-13


def test_rows(spark):
    rng = random.Random(9)
    good = [(k, [rng.gauss(m, s) for m, s in zip((1, 0, -2, 5, 0, 0), (3, 2, 1.4, 0.9, 0.5, 0.1))]) for k in range(300)]
    good += [(k, [rng.gauss(0, 1 + i) for i in range(3)]) for k in range(300, 340)]
    good += [(400, [7.0, 7.0])]                                    # alone: nothing varies
    good += [good[3], good[3], (None, good[3][1]), (4, good[5][1]), (341, [0.0, 0.0, 0.0])]
    good += [(k, [v + 1e-5 for v in good[k][1]]) for k in range(100)]   # often equal once scaled
    bad = [(500, None), (501, [1.0, None, 2.0]), (502, [float("nan")] * 6), (503, [float("inf"), 0.0, 0.0]),
           (504, [3e38, 0.0, 0.0])]
    frame = spark.createDataFrame([(d, v, "x", 1) for d, v in good + bad + [(505, [])]], SCHEMA).repartition(3)
    models = whitening.fit(frame)
    rows = whitening.whitened(frame, models)
    assert rows.columns[:3] == ["vec_id", "embedding", "label"]
    rows = rows.collect()
    assert len(rows) == len(good) + 1
    want = expected(good)
    signs = {}
    for r in rows:
        if r.vec_id == 505:
            assert r.n is None and r.whitened is None
            continue
        n, sums, values, axes, trace = want[len(r.embedding)]
        x = scaled(r.embedding)
        assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        if len(r.embedding) == 2:
            assert r.whitened == [] and r.deviation == 0
            continue
        assert len(r.whitened) == min(4, len(x)) and r.identity_error < 1e-9
        mine = (np.array(x) - np.array([s / n for s in sums])) @ axes / np.sqrt(values)
        for c, (a, b) in enumerate(zip(r.whitened, mine)):
            sign = signs.setdefault((len(x), c), 1 if abs(a - b) < abs(a + b) else -1)
            assert abs(a - sign * b) < 1e-8 * max(1, abs(b))
            assert abs(r.explained[c] - values[c] / trace) < 1e-9


def test_nothing_to_fit_and_large_numbers(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.fit(empty) == {} and whitening.whitened(empty, {}).count() == 0
    rows = [(k, [float(k * 10 ** 12), float(-k)]) for k in range(40)]
    frame = spark.createDataFrame([(d, v, "", 1) for d, v in rows], "vec_id long, embedding array<double>, n string, label int")
    models = whitening.fit(frame)
    for r in whitening.whitened(frame, models).collect():
        x = [int(256 * c) for c in r.embedding]
        exact = sum((40 * a - s) ** 2 for a, s in zip(x, models[2].sums))
        assert r.deviation == (exact if exact < 1 << 63 else None)
        assert abs(r.whitened[0]) < 2


def test_query_has_a_row_for_each_component(spark):
    rows = whitening.query(spark, "/root/testdata/sf0.001")
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    assert rows.count() == 4 * vectors.where(whitening.usable()).count()
    ends = rows.groupBy("component").agg(F.avg("explained").alias("e")).orderBy("component").collect()
    assert [r.component for r in ends] == [1, 2, 3, 4] and all(a.e >= b.e for a, b in zip(ends, ends[1:]))
