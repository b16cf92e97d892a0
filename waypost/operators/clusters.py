"""K-Means over sparse vectors whose centres are a table.

Vectors lie in blocks of pages, centres are rows (term, a weight for each cluster). A block is sent the rows of
the terms that its own pages hold, and answers with one row for each of them: the sum of its pages'
weights in every cluster. So a round shuffles one row a block and term, not one for every entry of
every page, and the vectors stay where they are. Nothing as large as the vocabulary is ever held by the
driver or by a task. A worker holds one block's rows of bytes as they came and the centres of its terms, and
computes a row at a time. The first centres are pages drawn with odds of their squared distance from those drawn
before, by a race of hash-drawn exponentials, so the draw needs no order of rows and a rerun agrees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from waypost.session import configured, drop, hold

BLOCK_ENTRIES = 1 << 21   # weights of a block, about
ROW_ENTRIES = 1 << 18     # weights of one of its rows
_COUNTS, _COST, _STATE = -1, -2, -3   # a round's totals, in place of a term
#: A worker is handed a few rows of a block at a time, and a step's shuffle files go when it ends.
_LEAN = {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
         "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@dataclass(frozen=True)
class Clusters:
    """``pages`` is (page_id, prediction); ``centres`` is (term_idx, centre: array<double>)."""

    pages: DataFrame
    centres: DataFrame
    cost: float        # sum of squared distances to the centres
    rounds: int
    converged: bool


#: ``terms`` are a row's different terms in order, ``at`` the place among them of each of its weights.
_PACKED = {"page_id": np.int64, "sizes": np.int64, "weights": np.float64, "at": np.int32, "terms": np.int64}


def _pack(row_entries: int, labels: list[int]):
    """Vectors of many pages as one row of bytes for each ``row_entries`` entries or so, so that a round copies
    them as they are. Rows are dealt to the blocks in turn."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealt = TaskContext.get().partitionId() * 7919
        for pages in batches:
            lists = {name: pages.column(name) for name in ("term_ids", "weights")}
            sizes = pc.fill_null(pc.list_value_length(lists["term_ids"]), 0).to_numpy(zero_copy_only=False).astype(
                np.int64)
            ids, weights = (own.flatten().to_numpy(zero_copy_only=False) for own in lists.values())
            page_id = pages.column("page_id").to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.flatnonzero(np.diff(ends[:-1] // row_entries, prepend=-1))   # first page of each row
            for first, last in zip(cuts, [*cuts[1:], len(sizes)]):
                part = slice(ends[first], ends[last])
                terms, at = np.unique(ids[part], return_inverse=True)
                row = {"page_id": page_id[first:last], "sizes": sizes[first:last], "weights": weights[part],
                       "at": at, "terms": terms}
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([labels[dealt % len(labels)]], pa.int32()),
                     **{name: pa.array([row[name].astype(dtype, copy=False).tobytes()], pa.binary())
                        for name, dtype in _PACKED.items()}})
                dealt += 1

    return pack


def _unpacked(rows: pa.Table, name: str) -> list[np.ndarray]:
    """A column of every row, not copied."""
    return [np.frombuffer(part.as_buffer(), _PACKED[name]) for chunk in rows[name].chunks for part in chunk]


def _terms(rows: pa.Table) -> pa.Table:
    """(term_idx, block): the different terms of a block."""
    terms = np.unique(np.concatenate(_unpacked(rows, "terms")))
    return pa.table({"term_idx": terms, "block": pa.array(np.full(len(terms), rows["block"][0].as_py(), np.int32))})


class _Block:
    """The rows of a block and the centres of its terms as arrays."""

    def __init__(self, packed: pa.Table, centres: pa.Table, k: int):
        self.rows = list(zip(*(_unpacked(packed, name) for name in _PACKED)))
        order = np.argsort(centres["term_idx"].to_numpy())
        self.terms = centres["term_idx"].to_numpy()[order]
        # A place past the last stands for terms that are not sent.
        self.known = np.append(self.terms, -1)
        self.centre = [np.append(pc.fill_null(centres[f"c{c}"], 0.0).to_numpy()[order], 0.0) for c in range(k)]

    def nearest(self, squares: list[float]) -> Iterator[tuple]:
        """For each row its pages, their clusters and squared distances, and its weights: values, pages,
        places and terms. Rounded, so that sums in another order don't decide ties; ties go to the lower
        number."""
        for page_id, sizes, weight, at, terms in self.rows:
            n = len(page_id)
            row = np.repeat(np.arange(n), sizes)
            place = np.searchsorted(self.terms, terms)
            held = self.known[place] == terms   # other terms weigh nothing in every centre
            own = np.bincount(row, weight ** 2, n)
            apart = np.empty((len(squares), n))
            for c, square in enumerate(squares):
                centre = np.where(held, self.centre[c][place], 0.0)
                apart[c] = np.round(own + square - 2 * np.bincount(row, weight * centre[at], n), 9)
            cluster = apart.argmin(axis=0)
            yield page_id, cluster, np.maximum(apart[cluster, np.arange(n)], 0.0), (weight, row, at, place)


def _mixed(page_id: np.ndarray, cluster: np.ndarray) -> int:
    """Tells one choice of clusters from another; small enough that doubles add it exactly."""
    mixed = (page_id.astype(np.uint64) * np.uint64(8191) + cluster.astype(np.uint64) + np.uint64(1)) * np.uint64(
        0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return int((mixed ^ (mixed >> np.uint64(32))).sum() & np.uint64((1 << 32) - 1))


def _labels(vectors: DataFrame, blocks: int) -> list[int]:
    """Names of blocks that the shuffle deals to a partition each."""
    spread = vectors.sparkSession.range(64 * blocks).select(F.col("id").cast("int").alias("label"))
    found = dict(spread.groupBy(F.pmod(F.hash("label"), F.lit(blocks)).alias("at")).agg(F.min("label")).collect())
    return [found.get(at, at) for at in range(blocks)]


class _Vectors:
    """The vectors in their blocks, and for each term the blocks that ask for it."""

    def __init__(self, vectors: DataFrame, block_entries: int):
        stored = hold(vectors.select("page_id", "term_ids", "weights"), "kmeans-vectors")
        entries = stored.agg(F.sum(F.coalesce(F.size("term_ids"), F.lit(0)) + 1)).first()[0] or 0
        # Small tables still get a block for every core.
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        blocks = max(1, -(-entries // block_entries), min(cores, -(-entries // (block_entries // 16))))
        partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.stored = stored
        row_entries = max(1, min(ROW_ENTRIES, entries // (4 * blocks)))
        self.blocks = stored.mapInArrow(
            _pack(row_entries, _labels(vectors, blocks)),
            "block int, " + ", ".join(f"{name} binary" for name in _PACKED)).repartition(
            blocks, "block").persist(StorageLevel.MEMORY_AND_DISK)
        self.asked = self.blocks.select("block", "terms").groupBy("block").applyInArrow(
            _terms, "term_idx long, block int").repartition(partitions, "term_idx").groupBy("term_idx").agg(
            F.collect_list("block").alias("blocks")).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.blocks.unpersist()
        self.asked.unpersist()

    def _run(self, centres: DataFrame, squares: list[float], schema: str,
             kernel: Callable[[_Block], pa.Table], how: str) -> DataFrame:
        k = len(squares)
        sent = self.asked.join(centres, "term_idx", how).select(
            F.explode("blocks").alias("block"), "term_idx", *[f"c{c}" for c in range(k)])

        def run(rows: pa.Table, own: pa.Table) -> pa.Table:
            return kernel(_Block(rows, own, k))

        return self.blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(run, schema)

    def nearest(self, centres: DataFrame, squares: list[float]) -> DataFrame:
        """(page_id, cluster, apart): the nearest centre of every page and its squared distance. Pages
        without terms are at the origin."""
        def kernel(block: _Block) -> pa.Table:
            page_id, cluster, apart, _ = zip(*block.nearest(squares))
            return pa.table({"page_id": np.concatenate(page_id), "cluster": np.concatenate(cluster).astype(np.int32),
                             "apart": np.concatenate(apart)})

        # A block is sent the terms that a centre holds; the first centres hold few.
        return self._run(centres, squares, "page_id long, cluster int, apart double", kernel, "inner")

    def round(self, centres: DataFrame, squares: list[float]) -> DataFrame:
        """(term_idx, s0, s1, ...): every term's weights added up by nearest centre, and the totals."""
        k = len(squares)

        def kernel(block: _Block) -> pa.Table:
            sums, totals, state = np.zeros((len(block.terms), k)), np.zeros((3, k)), 0
            for page_id, cluster, apart, (weight, row, at, place) in block.nearest(squares):
                totals[0] += np.bincount(cluster, minlength=k)
                totals[1, 0] += apart.sum()
                state += _mixed(page_id, cluster)
                # Terms of a row are different ones, so each place is added to once.
                sums[place] += np.bincount(at * np.int64(k) + cluster[row], weight, len(place) * k).reshape(-1, k)
            totals[2, 0] = state & (1 << 32) - 1
            return pa.table({
                "term_idx": np.concatenate([block.terms, [_COUNTS, _COST, _STATE]]).astype(np.int64),
                **{f"s{c}": np.concatenate([sums[:, c], totals[:, c]]) for c in range(k)}})

        schema = "term_idx long, " + ", ".join(f"s{c} double" for c in range(k))
        # A block is sent all of its terms, and answers with them.
        return self._run(centres, squares, schema, kernel, "left").groupBy("term_idx").agg(
            *[F.sum(f"s{c}").alias(f"s{c}") for c in range(k)])


def _first_centres(vectors: _Vectors, k: int, seed: int) -> tuple[DataFrame, list[float]]:
    """The vectors of up to ``k`` pages as centres (term_idx, c0, c1, ...), and their squared lengths; fewer
    if there are fewer different vectors."""
    # A hash as a number between zero and one, never either.
    draw = (F.pmod(F.xxhash64(F.lit(seed), "page_id"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    race = -F.log(draw)
    chosen = [vectors.stored.orderBy(race, "page_id").select("page_id").first()["page_id"]]
    while True:
        # As many rows as k pages have terms.
        own = vectors.stored.where(F.col("page_id").isin(chosen)).select(
            "page_id", F.explode(F.arrays_zip("term_ids", "weights")).alias("t")).select("page_id", "t.*")
        centres = hold(own.groupBy(F.col("term_ids").alias("term_idx")).agg(*[
            F.sum(F.when(F.col("page_id") == page, F.col("weights")).otherwise(0.0)).alias(f"c{c}")
            for c, page in enumerate(chosen)]), "kmeans-first")
        squares = list(centres.agg(*[F.coalesce(F.sum(F.col(f"c{c}") * F.col(f"c{c}")), F.lit(0.0))
                                     for c in range(len(chosen))]).first())
        if len(chosen) == k:
            return centres, squares
        far = vectors.nearest(centres, squares).where("apart > 0")
        following = far.orderBy(race / F.col("apart"), "page_id").select("page_id").first()
        if following is None:
            return centres, squares
        drop(centres)
        chosen.append(following["page_id"])


def _totals(done: DataFrame, k: int) -> tuple[list[float], float, float, list[float]]:
    """Pages of each cluster, the cost, the state, and each cluster's squared sums, of a round."""
    def at(term: int, c: int) -> Column:
        return F.sum(F.when(F.col("term_idx") == term, F.col(f"s{c}")))

    row = done.agg(at(_COST, 0), at(_STATE, 0), *[at(_COUNTS, c) for c in range(k)], *[
        F.coalesce(F.sum(F.when(F.col("term_idx") >= 0, F.col(f"s{c}") * F.col(f"s{c}"))), F.lit(0.0))
        for c in range(k)]).first()
    return list(row[2:2 + k]), row[0], row[1], list(row[2 + k:])


def kmeans(vectors: DataFrame, k: int, *, seed: int = 42, max_iter: int = 200, tol: float = 1e-4,
           block_entries: int = BLOCK_ENTRIES) -> Clusters:
    """Cluster ``vectors``: (page_id, term_ids, weights), one row per page; null arrays are the origin.

    Rounds go on until no page moves, or the cost falls by less than the ``tol`` part of it, or
    ``max_iter`` are done; ``converged`` tells the last from the others. Clusters that lose all their
    pages keep their centre. Fewer clusters come out where there are fewer different vectors.
    """
    with configured(vectors.sparkSession, _LEAN):
        return _kmeans(_Vectors(vectors, block_entries), k, seed, max_iter, tol)


def _kmeans(blocked: _Vectors, k: int, seed: int, max_iter: int, tol: float) -> Clusters:
    centres, squares = _first_centres(blocked, k, seed)
    k, table = len(squares), centres   # the table that centres are read from
    state, cost, rounds, converged = None, None, 0, False
    while True:
        done = hold(blocked.round(centres, squares), "kmeans-round")
        counts, now_cost, now_state, sums = _totals(done, k)
        rounds += 1
        converged = now_state == state or cost is not None and cost - now_cost <= tol * cost
        state, cost = now_state, now_cost
        if converged or rounds >= max_iter:
            drop(done)
            found = hold(blocked.nearest(centres, squares).select("page_id", F.col("cluster").alias("prediction")),
                         "kmeans-pages")
            blocked.release()
            return Clusters(found, centres.select("term_idx", F.array(*[f"c{c}" for c in range(k)]).alias("centre")),
                            cost, rounds, converged)

        def share(c: int) -> Column:
            return F.col(f"s{c}") / counts[c] if counts[c] else F.lit(0.0)

        moved = done.where("term_idx >= 0").select("term_idx", *[share(c).alias(f"c{c}") for c in range(k)])
        # A cluster without pages keeps its old centre; that is rare, so only then is it joined again.
        if not all(counts):
            old = centres.select("term_idx", *[F.col(f"c{c}").alias(f"o{c}") for c in range(k)])
            moved = hold(moved.join(old, "term_idx", "full").select("term_idx", *[
                F.coalesce(f"c{c}" if counts[c] else f"o{c}", F.lit(0.0)).alias(f"c{c}") for c in range(k)]),
                "kmeans-centres")
            drop(done)
            done = moved
        squares = [total / n ** 2 if n else old for total, n, old in zip(sums, counts, squares)]
        drop(table)
        centres, table = moved, done
