"""Embedding near-dedup with spherical-cap filters.

Filters are directions of a structured random product code: after a random rotation the
dimensions fall into blocks, each block has its own list of random directions, and a filter is one
direction of each block. A vector passes every filter whose inner product with it exceeds a
threshold. Because the code is a product, the filters a vector passes are decoded block by
block, leaving a combination as soon as the best rest cannot reach the threshold; the millions of
filters are never listed. Two near vectors pass common filters almost surely. Vectors are joined
on filters, and every pair that meets is verified by its cosine.

Equal vectors are folded first and count by their number. A filter that many vectors pass is cut
into blocks, and pairs of blocks are compared in separate groups of bounded size. A pair counts
only in the smallest filter its vectors share, and a group returns a count and a link for each
vector, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waypost.llm.components import components
from waypost.session import hold

SIMILARITY = 0.93
#: Codes with rotations of their own, blocks of dimensions, directions in each block, and the threshold
#: in standard deviations of the inner product of a random unit vector with a filter. In one of these
#: codes, two random vectors of cosine 0.93 in 64 dimensions miss each other with probability 0.27, in
#: all of them with 2.4e-5, and ever less as they come nearer.
CODES, PARTS, DIRECTIONS, THRESHOLD = 8, 2, 512, 3.7
LEAST_DIM = 64
#: Vectors of one filter that are compared with each other in one group, at most twice as many.
BLOCK = 512
#: Groups up to this size are compared together.
_SMALL = 12


@dataclass(frozen=True)
class Filters:
    """A rotation of the dimensions and the directions of each block."""

    rotation: np.ndarray
    cuts: tuple[int, ...]
    codes: tuple[np.ndarray, ...]
    threshold: float


def filters(dim: int, parts: int = PARTS, directions: int = DIRECTIONS, threshold: float = THRESHOLD,
            seed: int = 42) -> Filters:
    """A product code for vectors of ``dim`` dimensions. Short vectors are turned into a space of
    ``LEAST_DIM`` dimensions, where the threshold means the same."""
    rng = np.random.default_rng(seed)
    wide = max(dim, LEAST_DIM)
    rotation, _ = np.linalg.qr(rng.standard_normal((wide, wide)))
    cuts = tuple(np.linspace(0, wide, parts + 1).astype(int))
    codes = []
    for begin, end in zip(cuts, cuts[1:]):
        code = rng.standard_normal((directions, end - begin))
        codes.append(code / np.linalg.norm(code, axis=1)[:, None] * np.sqrt((end - begin) / wide))
    return Filters(rotation[:dim], cuts, tuple(codes), threshold / np.sqrt(wide))


def passed(own: Filters, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter): every filter that each unit vector passes, by row and then filter."""
    turned = unit @ own.rotation
    scores = [turned[:, begin:end] @ code.T for begin, end, code in zip(own.cuts, own.cuts[1:], own.codes)]
    tops = [score.max(axis=1) for score in scores]
    rows, total = np.arange(len(unit)), np.zeros(len(unit))
    number = np.zeros(len(unit), np.int64)
    for k, score in enumerate(scores):
        rest = sum(tops[k + 1:], np.zeros(len(unit)))
        sums = total[:, None] + score[rows]
        keep, code = np.nonzero(sums + rest[rows][:, None] > own.threshold)
        total, number = sums[keep, code], number[keep] * score.shape[1] + code
        rows = rows[keep]
    return rows, number


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def usable(vector: str = "embedding"):
    """The rows whose vector is not null, not zero and holds only finite components."""
    x = F.col(vector)
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                      & F.exists(x, lambda v: v != 0), F.lit(False))


def _units(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither tiny nor huge components vanish in the squares.
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _decoded(rows: DataFrame, seed: int) -> DataFrame:
    """(label, rep, dim, filters) of folded vectors; the filters of all codes in ascending order."""
    made: dict[int, list[Filters]] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                codes = made.setdefault(dim, [filters(dim, seed=seed + k) for k in range(CODES)])
                chosen = np.flatnonzero(sizes == dim)
                for first in range(0, len(chosen), 256):
                    some = batch.take(pa.array(chosen[first:first + 256]))
                    unit = _units(_matrix(some.column(2)))
                    found = [passed(own, unit) for own in codes]
                    at = np.concatenate([rows for rows, _ in found])
                    number = np.concatenate([filter + k * DIRECTIONS ** PARTS for k, (_, filter) in enumerate(found)])
                    order = np.lexsort((number, at))
                    counts = np.bincount(at, minlength=len(some))
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([
                        *some.columns[:2], pa.array(np.full(len(some), dim, np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(number[order]))],
                        names=["label", "rep", "dim", "filters"])

    return rows.select("label", "rep", "embedding").mapInArrow(
        run, "label int, rep long, dim int, filters array<long>")


def _own_in_small(keys: np.ndarray, values: np.ndarray, offsets: np.ndarray, span: int,
                  own: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs whose rows share no filter below ``own``: row i's smaller filters are looked up among row
    j's. ``keys`` holds row * span + filter of all rows, ascending."""
    found = np.ones(len(i), bool)
    for first in range(0, len(i), 8192):
        a, b = i[first:first + 8192], j[first:first + 8192]
        below = np.searchsorted(keys, a * span + own[a]) - offsets[a]
        pair = np.repeat(np.arange(len(a)), below)
        index = np.arange(len(pair)) - np.repeat(np.cumsum(below) - below - offsets[a], below)
        wanted = b[pair] * span + values[index]
        at = np.searchsorted(keys, wanted)
        at[at == len(keys)] = 0
        found[first + pair[keys[at] == wanted]] = False
    return found


def _own_in_large(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The same for many pairs of few rows, from products of row-by-filter matrices. ``lists`` has
    each row's smaller filters."""
    sizes = np.array([len(x) for x in lists])
    values, column, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(lists)), sizes)
    often = times > 1
    keep = often[column]
    row, column = row[keep], (np.cumsum(often) - 1)[column[keep]]
    shared = np.zeros((len(lists), len(lists)), bool)
    for first in range(0, int(often.sum()), 2048):
        part = (column >= first) & (column < first + 2048)
        has = np.zeros((len(lists), 2048), np.float32)
        has[row[part], column[part] - first] = 1
        shared |= has @ has.T > 0
    return ~shared[i, j]


def _results(table: pa.Table, begins: np.ndarray, similarity: float) -> pa.RecordBatch:
    """(rep, n, least) of the linked rows of the groups that ``begins`` bounds: links counted here and
    the smallest rep reached within the group."""
    table = table.slice(0, int(begins[-1])).combine_chunks()
    rep, weight, side, own = (table.column(name).to_numpy() for name in ("rep", "weight", "side", "filter"))
    dims = table.column("dim").to_numpy()
    alone = table.column("bi").to_numpy() == table.column("bj").to_numpy()
    vectors = table.column("embedding").combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(dims)])
    sizes = np.diff(begins)
    group = np.repeat(np.arange(len(sizes)), sizes)
    small = sizes <= _SMALL
    pairs_i, pairs_j = [], []
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        unit = np.zeros((len(rep), dim)) if len(rows) < len(rep) else None
        matrix = _units(flat[(starts[:-1][rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim))
        if unit is None:
            unit = matrix
        else:
            unit[rows] = matrix
        for apart in range(1, _SMALL):
            at = np.flatnonzero((group[apart:] == group[:-apart]) & small[group[apart:]] & (dims[:-apart] == dim)
                                & (alone[apart:] | (side[apart:] != side[:-apart])))
            near = np.einsum("nd,nd->n", unit[at], unit[at + apart]) >= similarity
            pairs_i.append(at[near])
            pairs_j.append(at[near] + apart)
    i, j = np.concatenate(pairs_i), np.concatenate(pairs_j)
    lists = table.column("filters").combine_chunks()
    values = lists.flatten().to_numpy()
    offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    span = int(values.max()) + 2 if len(values) else 1
    keys = np.repeat(np.arange(len(rep)), np.diff(offsets)) * span + values
    mine = _own_in_small(keys, values, offsets, span, own, i, j)
    all_i, all_j, owned = [i], [j], [mine]
    for g in np.flatnonzero(~small).tolist():
        rows = np.arange(begins[g], begins[g + 1])
        dim = int(dims[rows[0]])
        unit = _units(flat[starts[rows[0]]:starts[rows[-1] + 1]].reshape(-1, dim))
        left, right = np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1)
        if not alone[rows[0]]:
            x, y = np.nonzero(unit[left] @ unit[right].T >= similarity)
            x, y = left[x], right[y]
        else:
            x, y = np.nonzero(np.triu(unit @ unit.T, 1) >= similarity)
        if not len(x):
            continue
        linked, where = np.unique(np.concatenate([x, y]), return_inverse=True)
        f = own[rows[0]]
        below = [values[offsets[r]:offsets[r + 1]] for r in rows[linked].tolist()]
        mine = _own_in_large([v[:np.searchsorted(v, f)] for v in below], where[:len(x)], where[len(x):])
        all_i.append(rows[x])
        all_j.append(rows[y])
        owned.append(mine)
    i, j, mine = (np.concatenate(x) for x in (all_i, all_j, owned))
    count, least = np.zeros(len(rep), np.int64), rep.copy()
    np.add.at(count, i[mine], weight[j[mine]])
    np.add.at(count, j[mine], weight[i[mine]])
    before = None
    while len(i) and (before is None or (least != before).any()):
        before = least.copy()
        np.minimum.at(least, i, before[j])
        np.minimum.at(least, j, before[i])
    seen = (count > 0) | (least != rep)
    return pa.RecordBatch.from_arrays(
        [pa.array(rep[seen]), pa.array(count[seen]), pa.array(least[seen])], names=["rep", "n", "least"])


def _compared(groups: DataFrame, similarity: float) -> DataFrame:
    """(rep, n, least) from rows sorted by group; a group may go over the end of a batch."""
    keys = ["label", "dim", "filter", "bi", "bj"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            if not table.num_rows:
                continue
            change = np.zeros(table.num_rows, bool)
            change[0] = True
            for key in keys:
                values = table.column(key).to_numpy()
                change[1:] |= values[1:] != values[:-1]
            begins = np.flatnonzero(change)
            if len(begins) > 1:
                yield _results(table, begins, similarity)
            kept = table.slice(int(begins[-1]))
        if kept is not None and kept.num_rows:
            yield _results(kept, np.array([0, kept.num_rows]), similarity)

    return groups.mapInArrow(run, "rep long, n long, least long")


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, seed: int = 42) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Vectors link if their labels are equal and not null, their lengths are equal, and their cosine
    in double precision is at least ``similarity``. Vectors that are null, zero or hold null or
    non-finite components link with nothing, and rows without vec_id too. Rows that repeat a vec_id
    are separate vectors with one id: they count as links of each other if their vectors link, and
    each comes back. Other columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding",
                          F.col("label").cast("int").alias("label"))
    good = rows.where(usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    folded = hold(good.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vectors")
    # vec_ids may repeat, so folded vectors get a number of their own.
    names = hold(folded.withColumn("name", F.monotonically_increasing_id()), "names")
    listed = hold(_decoded(names.select("label", F.col("name").alias("rep"), "embedding"), seed), "filters")
    met = listed.select("label", "dim", "rep", F.explode("filters").alias("filter"))
    shared = met.groupBy("label", "dim", "filter").count().where("count > 1")
    shared = shared.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = met.join(shared, ["label", "dim", "filter"]).withColumn("own", own)
    # Block b meets every block: as the first of a pair with those after it, else as the second.
    pairs = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with")).select(
        "label", "dim", "filter", "rep", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"),
        (F.col("own") > F.col("with")).cast("int").alias("side"))
    vectors = names.select(F.col("name").alias("rep"), "embedding", "weight").join(
        listed.select("rep", "filters"), "rep")
    full = pairs.join(vectors, "rep")
    keys = ["label", "dim", "filter", "bi", "bj"]
    groups = full.repartition(*keys).sortWithinPartitions(*keys).select(
        *keys, "side", "rep", "weight", "filters", "embedding")
    found = hold(_compared(groups, similarity), "links")
    reached = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    per_name = names.select("name", "rep", "label", "embedding", "weight").join(
        counts.withColumnRenamed("rep", "_name"), F.col("name") == F.col("_name"), "left").join(
        reached, F.col("name") == F.col("node"), "left").select(
        "label", "embedding", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "name").alias("component"))
    per_name = hold(per_name, "members")
    smallest = per_name.groupBy("component").agg(F.min("rep").alias("component_id"))
    member = per_name.join(smallest, "component").select(
        F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "n_links", "component_id")
    linked = rows.withColumn("_good", usable() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    return linked.join(member, F.col("_good") & (F.col("label") == F.col("_label")) & (
        F.col("embedding") == F.col("_embedding")), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
