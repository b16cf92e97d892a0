"""Mix sources to target weights by systematic sampling.

Every source gets a share of all words by weight, held to ``most`` times its own size. A document
of a source with target T and size S is expected T / S times. The expected copies are summed along
the source, one random offset is added, and a document is emitted once per integer boundary that
the running sum crosses on it.

Documents run in order of their size class (an eighth of a power of two), so equal shares of short
and long documents are taken and the words taken come near the target. The running sum is the
rate times the document's place. Places come in two steps, so no source meets in one task: counts
per (source, size class, shard) are added up first, then each shard numbers its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from waypost.session import hold

WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
SHARDS = 64
_WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Bit length and the next three bits: classes at most an eighth wide."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.call_function("shiftright", size, F.greatest(bits - 4, F.lit(0))).cast("int")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST,
            share: float = 1.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources run by code point, null last, and take the weights in turn. The words to share are
    ``share`` of all. Where a target would pass ``most`` times its source's size it stops there,
    and the excess goes to the others by weight until none is above. In closed form: sources
    sorted by the level size / weight at which they stop are held in that order as long as the
    rest, shared by weight, would lift the next one above its own level.

    Only the table of sources is sorted in one task, one row each.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    rows = sizes.withColumn("weight", F.get(cycle, F.pmod(place - 1, F.lit(len(weights)))))
    rows = rows.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "left": F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
                - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "heavy": F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.withColumn("above", F.col("left") * F.col("weight") >= F.col("cap") * F.col("heavy"))
    # The first source that stays below its level sets the common level of all after it.
    rows = rows.withColumn("level", F.first(
        F.when(~F.col("above"), F.col("left") / F.col("heavy")), ignorenulls=True).over(
        by_level.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select("source", "source_size", F.coalesce(
        F.col("level") * F.col("weight"), F.col("cap")).alias("target"))


def copies(docs: DataFrame, seed: int = 42, weights: Sequence[float] = WEIGHTS, most: float = MOST,
           share: float = 1.0) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target and n_copies; other columns stay.

    Null and empty texts have size zero. A source of size zero has target zero and is never
    taken. Rows without doc_id or source take part; a null source is one source, last in order.
    Repeated rows are separate documents. Needs ``most`` of at least 1 to reach ``share`` 1.
    Columns of ``docs`` named like those added are replaced.
    """
    added = ("size", "source_size", "target", "n_copies")
    docs = docs.drop(*[name for name in added if name in docs.columns])
    narrow = docs.select("*", words_in(F.col("text")).alias("size"))
    plain = F.col("doc_id").cast("long")
    keyed = narrow.withColumns({
        "_class": size_class(F.col("size")),
        "_shard": F.pmod(F.coalesce(plain, F.lit(0)), F.lit(SHARDS)).cast("int"),
        "_tie": F.xxhash64("text")})
    counts = hold(keyed.groupBy("source", "_class", "_shard").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix")
    goal = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most, share)
    # One row per source, class and shard at most: bounded per source by classes times shards.
    order = Window.partitionBy("source").orderBy("_class", "_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n", "words")
    starts = starts.join(goal, starts["source"].eqNullSafe(goal["source"])).select(
        starts["source"].alias("_source"), F.col("_class").alias("_c"), F.col("_shard").alias("_s"),
        "start", "source_size", "target")
    within = F.row_number().over(Window.partitionBy("source", "_class", "_shard").orderBy(
        F.col("doc_id"), F.col("_tie")))
    rows = keyed.withColumn("_within", within).join(starts, F.col("source").eqNullSafe(F.col("_source")) & (
        F.col("_class") == F.col("_c")) & (F.col("_shard") == F.col("_s")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 8),
                    16, 10).cast("double") / F.lit(4294967296.0)
    place = F.col("start") + F.col("_within")
    crossed = F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)
    return rows.withColumn("n_copies", F.least(crossed, F.lit(int(most)))).select(
        *[F.col(name) for name in docs.columns], *added)


def mix(docs: DataFrame, seed: int = 42, weights: Sequence[float] = WEIGHTS, most: float = MOST,
        share: float = 1.0) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it is taken, with its own columns."""
    taken = copies(docs, seed, weights, most, share).where("n_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("n_copies")))).select(
        *docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return copies(docs).select("doc_id", "size", "source_size", "target",
                               (F.col("n_copies") * F.col("size")).alias("taken"))
