"""Block join: a similarity join whose tasks have a bounded size and emit one row per item.

Both sides list *keys* per item such that every pair worth scoring shares a key (the
operators choose keys by prefix filtering). Rows meet in blocks:

* a key held by few rows on both sides is packed with other light keys into one block, kept
  small because rows of different keys meet there for nothing;
* a hot key is spread over a grid of blocks, left chunks by right chunks, so no task sees
  more than about ``rows`` rows of a side however many rows share the key.

A task scores its block with numpy and returns only the best partner of each left row.
Candidate pairs are therefore never shuffled or written, and nothing is capped. The block
plan is a table with one row per key, joined like any other; only its totals reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from waypost.session import hold

PACK = 8   # packed blocks are this many times smaller than the chunks of a hot key


def key_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(key, n_left, n_right)`` for keys present on both sides, one row per key."""
    def side(df: DataFrame, is_left: int) -> DataFrame:
        return df.select(F.explode_outer("keys").alias("key"), F.lit(is_left).alias("l"))

    counts = side(left, 1).unionAll(side(right, 0)).groupBy("key").agg(
        F.sum("l").alias("n_left"), F.sum(1 - F.col("l")).alias("n_right")
    )
    return counts.where(F.col("key").isNotNull() & (F.col("n_left") > 0) & (F.col("n_right") > 0))


def plan_blocks(counts: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``(key, pack, left_chunks, right_chunks)`` and about how many blocks that makes.

    Keys with ``pack`` share its block; a hot key has none and a grid of its own.
    """
    packed = max(rows // PACK, 1)

    def chunks(name: str):
        return F.ceil(F.col(name) / rows)

    busier = F.greatest("n_left", "n_right")
    light = busier <= packed
    totals = counts.agg(
        F.coalesce(F.sum(F.when(light, busier)), F.lit(0)).alias("light"),
        F.coalesce(F.sum(F.when(~light, chunks("n_left") * chunks("n_right"))), F.lit(0)).alias("grid"),
    ).first()
    packs = -(-int(totals["light"]) // packed)
    pack = F.when(light, F.pmod(F.xxhash64("key"), F.lit(max(packs, 1)))).alias("pack")
    return counts.select("key", pack, chunks("n_left").alias("left_chunks"),
                         chunks("n_right").alias("right_chunks")), packs + int(totals["grid"])


def block_join(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, rows: int,
               schema: str, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]
               ) -> DataFrame:
    """Run ``kernel`` over every block of ``left`` x ``right``.

    Each side has an id, ``keys`` (an array) and its payload.
    """
    spark = left.sparkSession
    plan, n_blocks = plan_blocks(hold(key_counts(left, right), "keys"), rows)
    if not n_blocks:
        return spark.createDataFrame([], schema)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(shuffle, n_blocks // 4)
    block = ["pack", "hot", "i", "j"]

    def routed(df: DataFrame, row_id: str, own: str, other: str, is_left: bool) -> DataFrame:
        chunk = F.pmod(F.xxhash64(row_id), F.col(own))
        # Fresh aliases: both sides may come from one stored table.
        names = [name for name in df.columns if name != "keys"]
        placed = df.select(*[F.col(name).alias(name) for name in names],
                           F.explode_outer("keys").alias("key")).join(plan, "key")
        across = F.explode_outer(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("across")
        placed = placed.select("key", *names, F.col("pack").alias("pack"), chunk.alias("chunk"), across)
        own_place, other_place = ("i", "j") if is_left else ("j", "i")
        return placed.select(
            F.col("key").alias("key"), *names, F.col("pack").alias("pack"),
            F.when(F.col("pack").isNull(), F.col("key")).alias("hot"),
            F.col("chunk").alias(own_place), F.col("across").alias(other_place),
        ).repartition(partitions, *block)

    blocks_left = routed(left, left_id, "left_chunks", "right_chunks", True)
    blocks_right = routed(right, right_id, "right_chunks", "left_chunks", False)
    return (
        blocks_left.groupBy(*block).cogroup(blocks_right.groupBy(*block))
        .applyInPandas(kernel, schema)
    )
