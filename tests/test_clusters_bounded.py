"""What a worker and the shared folder hold while K-Means runs."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from waypost.operators import clusters
from waypost.session import shared_dir

SCHEMA = "page_id long, term_ids array<bigint>, weights array<double>"


def sparse(rows):
    return [(i, [int(t) for t in np.flatnonzero(x)] or None, [float(w) for w in x[x != 0]] or None)
            for i, x in enumerate(rows)]


def test_a_worker_computes_a_row_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(clusters, "ROW_ENTRIES", 2_000)
    rng = np.random.default_rng(2)
    x = rng.random((1200, 90)) * (rng.random((1200, 90)) < 0.8)
    vectors = clusters._Vectors(spark.createDataFrame(sparse(x), SCHEMA).repartition(3), 10**9)
    rows = vectors.blocks.toArrow()
    vectors.release()
    entries = np.count_nonzero(x)
    centres = pa.table({"term_idx": np.arange(90)[::-1], "c0": x[0][::-1], "c1": x[1][::-1]})
    tracemalloc.start()
    found = clusters._Block(rows, centres, 2).nearest([float((x[0] ** 2).sum()), float((x[1] ** 2).sum())])
    near = {}
    for page_id, cluster, *_ in found:
        near.update(zip(page_id.tolist(), cluster.tolist()))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6 * entries   # before, copies of all weights, terms and places: over 32 bytes each
    apart = ((x[:, None] - x[None, :2]) ** 2).sum(axis=2).round(9)
    assert near == dict(enumerate(apart.argmin(axis=1).tolist()))


def test_blocks_are_even_and_lie_in_a_partition_each(spark):
    rng = np.random.default_rng(4)
    x = rng.random((800, 40)) * (rng.random((800, 40)) < 0.5)
    vectors = clusters._Vectors(spark.createDataFrame(sparse(x), SCHEMA).repartition(2), 2_000)
    found = vectors.blocks.groupBy(F.spark_partition_id().alias("at")).agg(
        F.countDistinct("block").alias("blocks"), F.sum(F.length("weights") / 8).alias("n")).collect()
    vectors.release()
    assert len(found) >= 8 and {row.blocks for row in found} == {1}
    assert sum(row.n for row in found) == np.count_nonzero(x)
    assert max(row.n for row in found) <= 2 * 2_000


def test_tables_of_rounds_go(spark):
    def tables():
        folder = f"{shared_dir(spark).removeprefix('file:')}/waypost"
        return {name for name in os.listdir(folder) if name.startswith(("kmeans-round", "kmeans-first", "kmeans-centres"))}

    rng = np.random.default_rng(8)
    frame = spark.createDataFrame(sparse(rng.random((90, 12)) * (rng.random((90, 12)) < 0.4)), SCHEMA)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), set(tables())
    found = clusters.kmeans(frame, 3, tol=0.0)
    assert found.rounds > 2 and len(tables() - before[1]) == 1   # the one its centres are read from
    assert found.centres.count() > 0 and found.pages.count() == 90
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) != "true"


def test_a_cluster_without_pages_keeps_its_centre(spark, monkeypatch):
    def first(vectors, k, seed):
        rows = [(0, 1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0), (7, 0.0, 0.0, 50.0)]
        return spark.createDataFrame(rows, "term_idx long, c0 double, c1 double, c2 double"), [1.0, 1.0, 2500.0]

    monkeypatch.setattr(clusters, "_first_centres", first)
    monkeypatch.setattr(clusters, "drop", lambda held: None)
    x = np.array([[1.0, 0.1 * i, 0] for i in range(4)] + [[0.1 * i, 1.0, 0] for i in range(4)])
    found = clusters.kmeans(spark.createDataFrame(sparse(x), SCHEMA), 3, tol=0.0)
    centres = {row.term_idx: row.centre for row in found.centres.collect()}
    assert found.converged and centres[7] == [0.0, 0.0, 50.0]
    assert [row.prediction for row in found.pages.orderBy("page_id").collect()] == [0] * 4 + [1] * 4
    assert np.allclose(centres[0][:2], [1.0, 0.15]) and np.allclose(centres[1][:2], [0.15, 1.0])
