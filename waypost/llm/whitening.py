"""Whitening of embeddings by spectral divide and conquer on their covariance.

Spark sums what the covariance needs, in two passes over the distinct vectors: exact integer sums, then
products of centred values. Only one matrix per vector length reaches the driver. There the matrix is
split without an eigenvalue routine: the polar factor of the covariance minus a shift, found by the
dynamically weighted Halley iteration (QDWH), is plus one on the eigenvectors above the shift and minus
one below, so half of it plus the identity is a spectral projector. An orthonormal basis of its range
and of the complement gives two smaller matrices, split again until they are single numbers. The
leading components are then sent to the tasks, which whiten all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waypost.llm.store import steps
from waypost.session import hold

SCALE = 256.0
COMPONENTS = 4
_EPS = np.finfo(float).eps
#: Entries from here up would not fit a long once scaled.
_LARGEST = float(1 << 54)


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QDWH.

    At most seven weighted steps raise every singular value above machine precision to one; the
    first ones solve by QR, as their systems are badly conditioned.
    """
    k = len(a)
    x, low = a / np.linalg.norm(a), _EPS
    for _ in range(20):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        first = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        second = (first - 1) ** 2 / 4
        third = first + second - 1
        share = second / third
        if third > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(third) * x, np.eye(k)]))
            new = share * x + (first - share) / np.sqrt(third) * (q[:k] @ q[k:].T)
        else:
            new = share * x + (first - share) * np.linalg.solve(np.eye(k) + third * (x.T @ x), x.T).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (first + second * square) / (1 + third * square), 1.0)
        if 1 - low < 4 * _EPS and moved < np.cbrt(4 * _EPS):
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of two invariant subspaces, the one above some shift first; nothing if all
    eigenvalues are one number within rounding."""
    k = len(a)
    mean = np.trace(a) / k
    width = np.linalg.norm(a - mean * np.eye(k))
    if width <= 4 * k * _EPS * scale:
        return None
    # The mean lies between the least and the largest eigenvalue; others follow in case one is too near.
    nudges = width / np.sqrt(k) * np.array([0.0, 0.11, -0.13, 0.029, -0.031, 0.23, -0.27, 0.0071, -0.0073])
    start, best = np.random.default_rng(k).standard_normal((k, k)), None
    for shift in (float(np.median(np.diag(a))), *(mean + nudges)):
        shifted = a - shift * np.eye(k)
        if not np.any(shifted):
            continue
        projector = (polar(shifted) + np.eye(k)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < k:
            continue
        basis, _ = np.linalg.qr(projector @ start[:, :rank])
        basis, _ = np.linalg.qr(projector @ basis, mode="complete")
        above, below = basis[:, :rank], basis[:, rank:]
        left = np.linalg.norm(below.T @ a @ above)
        if best is None or left < best[0]:
            best = left, above, below
        if left <= 8 * np.sqrt(k) * _EPS * scale:
            break
    return best and best[1:]


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = np.linalg.norm(a)
    values, vectors, todo = [], [], [((a + a.T) / 2, np.eye(len(a)))]
    while todo:
        part, basis = todo.pop()
        pair = _split(part, scale) if len(part) > 1 else None
        if pair is None:
            values += list(np.diag(part))
            vectors += list(basis.T)
            continue
        for side in pair:
            inner = side.T @ part @ side
            todo.append(((inner + inner.T) / 2, basis @ side))
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], np.array(vectors).reshape(len(a), len(a))[order].T


@dataclass(frozen=True)
class Model:
    """The fit for vectors of one length. ``components`` has a row each, ``values`` their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([total / self.n for total in self.sums])


def usable(column: str = "embedding") -> Column:
    """Vectors without null or non-finite entries whose scaled entries fit a long."""
    def sound(c: Column) -> Column:
        return F.coalesce(F.abs(c.cast("double")) < _LARGEST, F.lit(False))

    return F.col(column).isNotNull() & F.forall(column, sound)


def scaled(column: str = "embedding") -> Column:
    """array<long>: each entry times ``SCALE``, rounded down."""
    return F.transform(column, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer matrix of the vectors of each length in each batch."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            yield rows, flat[starts[rows][:, None] + np.arange(size)]


def _exact_sums(x: np.ndarray) -> list[int]:
    if x.size and int(np.abs(x).max()) * len(x) >= 1 << 62:
        return [int(value) for value in x.astype(object).sum(axis=0)]
    return x.sum(axis=0).tolist()


def _totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By length: how many vectors ``fit`` has, and the exact sum of each entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for rows, x in _by_length(batches):
            n, sums = found.get(x.shape[1], (0, [0] * x.shape[1]))
            found[x.shape[1]] = n + len(rows), [a + b for a, b in zip(sums, _exact_sums(x))]
        for size, (n, sums) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()),
                 pa.array([n] * size, pa.int64()), pa.array(map(str, sums), pa.string())],
                names=["size", "place", "n", "total"])

    partial = fit.select("x").mapInArrow(run, "size int, place int, n long, total string")
    rows = partial.groupBy("size", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    found = {}
    for row in sorted(rows, key=lambda row: (row["size"], row["place"])):   # as many as a vector is long
        found.setdefault(row["size"], (row["n"], []))[1].append(int(row["total"]))
    return found


def _products(fit: DataFrame, spark: SparkSession, shift: dict[int, np.ndarray],
              onto: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """By length: the sum of outer products of the vectors minus ``shift``, or of what these are
    ``onto`` some directions.

    A task adds up its rows and returns one matrix; matrices are added row by row.
    """
    sent = spark.sparkContext.broadcast((shift, onto))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, onto = sent.value
        found: dict[int, np.ndarray] = {}
        for _, x in _by_length(batches):
            size = x.shape[1]
            if size not in shift:
                continue
            centred = x - shift[size]
            if onto is not None:
                centred = centred @ onto[size]
            found[size] = found.get(size, 0) + centred.T @ centred
        for size, matrix in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([size] * len(matrix), pa.int32()), pa.array(range(len(matrix)), pa.int32()),
                 pa.array(list(matrix), pa.list_(pa.float64()))], names=["size", "place", "line"])

    def added(table: pa.Table) -> pa.Table:
        lines = table.column("line").combine_chunks()
        total = lines.flatten().to_numpy().reshape(len(lines), -1).sum(axis=0)
        return pa.table({"size": table.column("size")[:1], "place": table.column("place")[:1],
                         "line": pa.array([total], pa.list_(pa.float64()))})

    kind = "size int, place int, line array<double>"
    lines = fit.select("x").mapInArrow(run, kind).groupBy("size", "place").applyInArrow(added, kind)
    found: dict[int, list] = {}
    for row in sorted(lines.collect(), key=lambda row: (row["size"], row["place"])):   # as many as a vector is long
        found.setdefault(row["size"], []).append(row["line"])
    return {size: np.array(matrix) for size, matrix in found.items()}


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> dict[int, Model]:
    """A model for each length of the usable vectors of ``vectors``, fitted on each distinct scaled
    vector once. The driver holds a matrix of each length's size."""
    spark = vectors.sparkSession
    with steps(spark):
        listed = hold(vectors.where(usable(column)).select(scaled(column).alias("x")).where(
            F.size("x") > 0).distinct(), "whitening")
        totals = _totals(listed)
        means = {size: np.array([total / n for total in sums]) for size, (n, sums) in totals.items()}
        found, onto = {}, {}
        for size, matrix in _products(listed, spark, means).items():
            covariance = matrix / totals[size][0]
            values, axes = spectrum(covariance)
            # Directions in which the vectors don't vary can't be whitened.
            some = [i for i in range(min(components, size)) if values[i] > size * _EPS * values[0]]
            onto[size] = axes[:, some] / np.sqrt(values[some])
            found[size] = values[some], axes[:, some].T, values[some] / np.trace(covariance)
        errors = {size: float(np.abs(matrix / totals[size][0] - np.eye(len(matrix))).max()) for size, matrix in
                  _products(listed, spark, means, onto).items() if len(matrix)}
    return {size: Model(totals[size][0], tuple(totals[size][1]), *found[size], errors.get(size, 0.0))
            for size in found}


def _deviations(model: Model, x: np.ndarray) -> list[int | None]:
    """Of each row the sum of squares of n times x minus the sums, exact; null if no long holds it."""
    most = int(np.abs(x).max(initial=0)) * model.n + max(map(abs, model.sums), default=0)
    if most * most * max(x.shape[1], 1) < 1 << 63:
        return ((model.n * x - np.array(model.sums, np.int64)) ** 2).sum(axis=1).tolist()
    found = ((model.n * x.astype(object) - np.array(model.sums, object)) ** 2).sum(axis=1)
    return [int(value) if value < 1 << 63 else None for value in found]


def whitened(vectors: DataFrame, models: dict[int, Model], column: str = "embedding") -> DataFrame:
    """The rows of ``vectors`` with a usable vector, with all columns and n, deviation, whitened,
    explained and identity_error (replacing columns named so).

    whitened and explained are arrays, a value for each component of the model for the vector's
    length: vectors of different lengths are separate sets. Rows are dropped if the vector is null, holds
    null or non-finite entries or entries too large to scale into a long. Empty vectors have no model
    and come out with null values, as do those of a length that was not fitted. Fewer components than
    asked for exist where vectors vary in fewer directions (one distinct vector: none, an empty
    array). deviation is null beyond the range of a long. Repeated rows and vec_ids and null vec_ids
    are rows like any other.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(models)
    kind = pa.struct([("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64())),
                      ("explained", pa.list_(pa.float64())), ("identity_error", pa.float64())])

    def run(column: pa.Array) -> pa.Array:
        made: list[dict | None] = [None] * len(column)
        for rows, x in _by_length(iter([pa.RecordBatch.from_arrays([column], names=["x"])])):
            model = sent.value.get(x.shape[1])
            if model is None:
                continue
            projected = (x - model.mean) @ model.components.T / np.sqrt(model.values)
            for row, deviation, values in zip(rows.tolist(), _deviations(model, x), projected.tolist()):
                made[row] = {"n": model.n, "deviation": deviation, "whitened": values,
                             "explained": model.explained.tolist(), "identity_error": model.identity_error}
        return pa.array(made, kind)

    result = F.arrow_udf(run, "struct<n: long, deviation: long, whitened: array<double>, "
                              "explained: array<double>, identity_error: double>")
    added = [field.name for field in kind]
    own = [name for name in vectors.columns if name not in added]
    rows = vectors.where(usable(column)).select(*own, result(scaled(column)).alias("_found"))
    return rows.select(*own, *[F.col("_found")[name].alias(name) for name in added])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each usable vector and component."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    rows = whitened(vectors, fit(vectors)).select(
        "vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias(
            "place", "of"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation",
                       F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")
