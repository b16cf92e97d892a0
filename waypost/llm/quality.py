"""Quality scores from compressed sizes.

Two zstandard dictionaries are built, one from texts labelled good, one from texts labelled bad. A
text is compressed block by block with either; it looks like the side whose dictionary makes it
smaller. The difference of the two sizes, divided by the text's size, and how far the text
compresses at all are turned into a probability by logistic regression on labelled texts that no
dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Labelled rows of each class used for fitting at most, chosen by a hash of doc_id, and the size
#: up to which a text is used for fitting. Scores have no such bounds.
SAMPLE_ROWS = 4_000
SAMPLE_BYTES = 16_384
BLOCK = 4_096
DICTIONARY = 1 << 18
LEVEL = 6
#: Share of the sample that goes into dictionaries; the rest calibrates.
SHARE = 0.5


@dataclass(frozen=True)
class Model:
    """Dictionaries (empty if a class had no text) and the calibration."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


def _blocks(text: bytes) -> list[bytes]:
    return [text[i:i + BLOCK] for i in range(0, len(text), BLOCK)]


def _dictionary(texts: Sequence[bytes]) -> bytes:
    """A trained dictionary, or the plain end of all texts where there are too few to train on."""
    blocks = [block for text in texts for block in _blocks(text)]
    try:
        return zstandard.train_dictionary(DICTIONARY, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:]


class Sizer:
    """Compresses with both dictionaries; one for each worker and model."""

    def __init__(self, model: Model):
        self.sides = []
        for data in (model.good, model.bad):
            loaded = zstandard.ZstdCompressionDict(data) if data else None
            if loaded is not None:
                loaded.precompute_compress(level=LEVEL)
            self.sides.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=loaded, write_content_size=False, write_dict_id=False))

    def features(self, text: bytes) -> tuple[float, float, float]:
        """Difference and sum of the sizes by text size, and how short the text is."""
        if not text:
            return 0.0, 0.0, 0.0
        blocks = _blocks(text)
        good, bad = (sum(len(side.compress(block)) for block in blocks) for side in self.sides)
        return (bad - good) / len(text), (bad + good) / (2 * len(text)), len(text) ** -0.5


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights by Newton's method, the last one for the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * len(x) * np.append(w[:-1], 0) * 1e-2
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_texts(good: Sequence[bytes], bad: Sequence[bytes], share: float = SHARE) -> Model:
    """A model of labelled texts. Without texts of both classes every score is the same."""
    if not good or not bad:
        rate = 1.0 if good else 0.0 if bad else 0.5
        constant = float(np.log((rate + 0.01) / (1.01 - rate)))
        return Model(b"", b"", (0.0, 0.0, 0.0, constant), (0.0,) * 3, (1.0,) * 3)
    cuts = [max(1, int(len(side) * share)) for side in (good, bad)]
    model = Model(_dictionary(good[:cuts[0]]), _dictionary(bad[:cuts[1]]), (), (), ())
    sizer = Sizer(model)
    rest = [(text, 1.0) for text in good[cuts[0]:]] + [(text, 0.0) for text in bad[cuts[1]:]]
    if len({label for _, label in rest}) < 2:
        rest = [(text, 1.0) for text in good] + [(text, 0.0) for text in bad]
    x = np.array([sizer.features(text) for text, _ in rest])
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    weights = _logistic((x - centre) / scale, np.array([label for _, label in rest]))
    return Model(model.good, model.bad, tuple(weights), tuple(centre), tuple(scale))


def held_out(column: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; a row without doc_id has no label."""
    return F.coalesce(F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of the labelled rows that are not held out.

    Labels other than 0 and 1, null keys and null texts are left out; repeated labels count once.
    The sample keeps the share of the two classes.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out()).select(
        F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality")).distinct()
    texts = docs.where(F.octet_length("text") <= max_bytes).select(
        F.col("doc_id").cast("long").alias("id"), "text")
    chosen = known.join(texts.select("id").distinct(), "id", "left_semi").orderBy(
        F.xxhash64("id"), "quality").limit(2 * rows)
    found = texts.join(F.broadcast(chosen), "id").select("id", "quality", "text").toArrow().to_pylist()
    found.sort(key=lambda row: (hash_of(row["id"]), row["text"]))
    sides = [[row["text"].encode() for row in found if row["quality"] == side] for side in (1, 0)]
    return fit_texts(*sides)


def hash_of(number: int) -> int:
    """An order of ids that does not follow the table's."""
    return (number * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & ((1 << 64) - 1)


def score(spark: SparkSession, model: Model, text: Column) -> Column:
    """The probability that a text is good; null counts as empty."""
    sent = spark.sparkContext.broadcast(model)
    sizers: dict[str, Sizer] = {}

    def run(column: pa.Array) -> pa.Array:
        model = sent.value
        if "own" not in sizers:
            sizers["own"] = Sizer(model)
        column = pc.fill_null(column, "")
        x = np.array([sizers["own"].features(value.as_buffer().to_pybytes()) for value in column]).reshape(-1, 3)
        logit = (x - np.array(model.centre)) / np.array(model.scale) @ np.array(model.weights[:-1]) + model.weights[-1]
        return pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    return F.arrow_udf(run, "double")(text)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row and column of ``docs`` with held_out, score and predicted (replacing columns named
    so). Only the text makes the score; equal texts have equal scores."""
    rows = docs.drop(*[name for name in ("held_out", "score", "predicted") if name in docs.columns])
    return rows.select("*", held_out().alias("held_out"),
                       score(docs.sparkSession, model, F.col("text").cast("string")).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model takes for good, all columns unchanged."""
    return docs.where(score(docs.sparkSession, model, F.col("text").cast("string")) >= 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")
