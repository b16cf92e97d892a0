"""Approximate nearest neighbours by balanced posting lists.

The largest inner product becomes the smallest distance by one more component: with ``m`` the
largest norm, a row x gets sqrt(m^2 - |x|^2) and a query gets zero. Centroids come from balanced
k-means over a bounded sample; every row is indexed. A row goes to the list of its nearest
centroid and to further lists nearly as near, unless a list chosen before is nearer to that
centroid than the row is. Centroids are found by a walk over their neighbour graph, held by each
worker. A query reads the lists whose centroid is within a ratio of the nearest one's distance.

Lists and their queries are cut into blocks, so that a list with a third of all rows is searched
by many tasks; each returns its best rows per query, and the best of all are ranked at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from waypost.llm.caps import usable
from waypost.session import hold

K = 20
#: Rows that centroids are fitted on at most, sample rows for each list, and lists at most.
SAMPLE_ROWS, LIST_ROWS, LISTS = 16_384, 64, 128
#: A row is replicated to lists within this ratio of its nearest centroid's distance, to so many at most,
#: unless a list chosen before is nearer to the new centroid than this share of the row's distance.
CLOSURE, COPIES, COVER = 1.1, 4, 0.6
#: A query reads lists within this ratio of the nearest centroid's distance. High-dimensional vectors
#: without clusters lie almost equally far from all centroids, so the ratio decides the recall.
RATIO = 1.25
#: Lists that a query reads however near the first one is: among near copies the ratio alone stops at them.
LEAST_LISTS = 64
#: Neighbours of a centroid in the graph, and candidates a walk keeps.
DEGREE, BEAM = 16, 112
ROWS_BLOCK, QUERY_BLOCK = 4096, 1024


@dataclass(frozen=True)
class Index:
    """Centroids, their neighbour graph, where walks start, and the largest norm."""

    centroids: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    norm: float


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """k-means in which a centroid that holds more than its share costs more."""
    rng = np.random.default_rng(seed)
    lists = min(lists, len(x))
    centroids = x[rng.choice(len(x), lists, replace=False)]
    penalty = np.zeros(lists)
    for _ in range(rounds):
        distance = ((x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1))
        near = (distance + penalty).argmin(axis=1)
        counts = np.bincount(near, minlength=lists)
        spread = max(float(np.median(distance[np.arange(len(x)), near])), 1e-12)
        penalty += 0.1 * spread * (counts / max(1.0, len(x) / lists) - 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled][:, None]
    return centroids


def build_index(sample: np.ndarray, norm: float, lists: int = LISTS, seed: int = 42) -> Index:
    """An index for vectors of norm up to ``norm`` from a sample of them."""
    extra = np.sqrt(np.maximum(norm * norm - (sample * sample).sum(axis=1), 0))
    centroids = balanced_centroids(np.column_stack([sample, extra]), lists, seed=seed)
    distance = ((centroids[:, None] - centroids[None]) ** 2).sum(axis=2)
    order = np.argsort(distance, axis=1, kind="stable")
    near = order[:, 1:DEGREE + 1] if len(centroids) > 1 else order
    # A few far links keep the graph in one piece.
    rng = np.random.default_rng(seed)
    far = np.column_stack([rng.permutation(len(centroids)) for _ in range(4)])
    ring = np.roll(np.arange(len(centroids)), 1)[:, None]
    return Index(centroids, np.column_stack([near, far, ring]).astype(np.int64),
                 np.unique(np.linspace(0, len(centroids) - 1, 8).astype(int)), norm)


def walk(index: Index, points: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(list, distance): the ``beam`` nearest centroids a best-first walk finds for each point, nearest
    first. All points walk in step; a walk ends when every candidate it keeps has been expanded."""
    lists, n = len(index.centroids), len(points)
    beam = min(beam, lists)
    rows = np.arange(n)
    squares = (points * points).sum(axis=1)
    own = (index.centroids * index.centroids).sum(axis=1)
    known = np.full((n, lists), np.inf)
    expanded = np.zeros((n, lists), bool)
    entries = index.entries
    known[:, entries] = squares[:, None] - 2 * points @ index.centroids[entries].T + own[entries]
    going = rows
    while len(going):
        held = known[going]
        bound = np.partition(held, beam - 1, axis=1)[:, beam - 1]
        open_ = np.where(expanded[going], np.inf, held)
        best = open_.argmin(axis=1)
        value = open_[np.arange(len(going)), best]
        more = np.isfinite(value) & (value <= bound)
        going, best = going[more], best[more]
        if not len(going):
            break
        expanded[going, best] = True
        near = index.graph[best]
        found = (squares[going][:, None] - 2 * np.einsum("nd,nkd->nk", points[going], index.centroids[near])
                 + own[near])
        known[going[:, None], near] = found
    order = np.argsort(known, axis=1, kind="stable")[:, :beam]
    return order, np.sqrt(np.maximum(np.take_along_axis(known, order, axis=1), 0))


def lists_of_rows(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists that each row is replicated to."""
    extra = np.sqrt(np.maximum(index.norm ** 2 - (x * x).sum(axis=1), 0))
    order, distance = walk(index, np.column_stack([x, extra]), beam=24)
    rows, lists = [np.arange(len(x))], [order[:, 0]]
    chosen = [order[:, 0]]
    number = np.ones(len(x), np.int64)
    for step in range(1, order.shape[1]):
        new = order[:, step]
        fits = (distance[:, step] <= CLOSURE * distance[:, 0]) & (number < COPIES) & np.isfinite(distance[:, step])
        for before in chosen:
            # A list nearer to this centroid than the row is covers it; -1 marks no list.
            gap = np.sqrt(((index.centroids[new] - index.centroids[before]) ** 2).sum(axis=1))
            fits &= (before < 0) | (gap > COVER * distance[:, step])
        number += fits
        rows.append(np.flatnonzero(fits))
        lists.append(new[fits])
        if fits.any():
            chosen.append(np.where(fits, new, -1))
    return np.concatenate(rows), np.concatenate(lists)


def lists_of_queries(index: Index, x: np.ndarray, ratio: float = RATIO) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists that each query reads."""
    order, distance = walk(index, np.column_stack([x, np.zeros(len(x))]))
    near = (distance <= ratio * distance[:, :1]) | (np.arange(distance.shape[1]) < LEAST_LISTS)
    rows, at = np.nonzero(near & np.isfinite(distance))
    return rows, order[rows, at]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _assigned(rows: DataFrame, sent, dim: int, queries: bool) -> DataFrame:
    """(id, embedding, list), a row for each list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 2048):
                some = batch.slice(first, 2048)
                x = _matrix(some.column(1), dim)
                at, lists = (lists_of_queries if queries else lists_of_rows)(sent.value, x)
                taken = some.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(lists.astype(np.int32))], names=["id", "embedding", "list"])

    return rows.select(F.col("vec_id").alias("id"), "embedding").mapInArrow(
        run, "id long, embedding array<double>, list int")


def _searched(groups: DataFrame, dim: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best ``k`` rows of each query of each group. Rows are sorted by
    group; a group may go over the end of a batch."""
    def best(table: pa.Table) -> pa.RecordBatch | None:
        ids, side = table.column("id").to_numpy(), table.column("side").to_numpy()
        x = _matrix(table.column("embedding").combine_chunks(), dim)
        asked, there = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        if not len(asked) or not len(there):
            return None
        there = there[np.argsort(ids[there], kind="stable")]
        found = []
        for first in range(0, len(asked), 256):
            some = asked[first:first + 256]
            scores = x[some] @ x[there].T
            scores[ids[some][:, None] == ids[there][None]] = -np.inf
            order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            found.append((np.repeat(ids[some], order.shape[1]), ids[there][order].ravel(),
                          np.take_along_axis(scores, order, axis=1).ravel()))
        query, vec, score = (np.concatenate(part) for part in zip(*found))
        real = np.isfinite(score)
        return pa.RecordBatch.from_arrays(
            [pa.array(query[real]), pa.array(vec[real]), pa.array(score[real])], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
            if not table.num_rows:
                continue
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for key in ("list", "rb", "qb"):
                values = table.column(key).to_numpy()
                change[1:] |= values[1:] != values[:-1]
            begins = np.flatnonzero(change).tolist()
            for a, b in zip(begins, begins[1:]):
                if (found := best(table.slice(a, b - a))) is not None:
                    yield found
            kept = table.slice(begins[-1])
        if kept is not None and kept.num_rows and (found := best(kept)) is not None:
            yield found

    return groups.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = K, sample_rows: int = SAMPLE_ROWS,
            lists: int = LISTS, seed: int = 42) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose vec_id is divisible by ``every``, its ``k``
    nearest other rows by inner product in double precision, ties to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    without vec_id or vectors of another length than most of the sample. Rows that repeat a vec_id
    count once, with the vector that sorts first. With fewer other rows than ``k`` all are returned.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = hold(rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")
    sample = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id")).limit(sample_rows).select("embedding").toArrow()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample.num_rows:
        return empty
    sizes = sample.column(0).combine_chunks().value_lengths().to_numpy()
    dim = int(np.bincount(sizes).argmax())
    fitted = np.array([x for x in sample.column(0).to_pylist() if len(x) == dim])
    rows = rows.where(F.size("embedding") == dim)
    square = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x * x)
    norm = float(np.sqrt(rows.agg(F.max(square)).first()[0]))
    sent = spark.sparkContext.broadcast(build_index(
        fitted, norm, max(1, min(lists, len(fitted) // LIST_ROWS)), seed))
    posted = hold(_assigned(rows, sent, dim, queries=False), "posted")
    asked = hold(_assigned(rows.where(F.col("vec_id") % every == 0), sent, dim, queries=True), "asked")
    blocks = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / ROWS_BLOCK).cast("int").alias("rbs")).join(
        asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("qbs")), "list")
    # One row per list, so at most as many as the index has lists.
    blocks = F.broadcast(blocks)

    def dealt(df: DataFrame, side: int, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        return df.join(blocks, "list").select(
            "list", F.pmod(F.xxhash64("id"), F.col(own_blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.col(other_blocks) - 1)).alias(other),
            F.lit(side).alias("side"), "id", "embedding")

    groups = dealt(posted, 0, "rb", "rbs", "qb", "qbs").unionByName(dealt(asked, 1, "qb", "qbs", "rb", "rbs"))
    groups = groups.repartition("list", "rb", "qb").sortWithinPartitions("list", "rb", "qb").select(
        "list", "rb", "qb", "side", "id", "embedding")
    found = _searched(groups, dim, k)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
