"""Connected components of a link table by alternating star steps.

Every round replaces the links of a node by links to the smallest node near it, first for larger
neighbours, then for smaller ones; the number of rounds grows with the logarithm of the largest
component. Only (node, node) rows move. The links of a hub are never gathered: its smallest
neighbour is a partially aggregated minimum, joined back where adaptive execution may split it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waypost.session import hold


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node each linked node reaches, itself included.

    Null ends and self-links are ignored. Nodes without a link don't appear.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges, state = hold(edges, "star"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # Here every link leads to a smaller node.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = hold(small.where("u != v").distinct(), "star")
    found = edges.groupBy("u").agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("u")).distinct().join(found, "u", "left_anti")
    return found.unionByName(roots.withColumn("component", F.col("u"))).withColumnRenamed("u", "node")
