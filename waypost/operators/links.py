"""Discovery over a stored link graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, functions as F

from waypost.session import hold

MAX_DEPTH: int | None = None


def reachable(seeds: DataFrame, edges: DataFrame, *, max_depth: int | None = MAX_DEPTH,
              max_pages: int | None = None) -> DataFrame:
    """``(url, depth)``: breadth-first from ``seeds(url)`` along ``edges(src_url, dst_url)``.

    One join per level. New URLs are made distinct before they are compared with the visited
    ones, and every level is stored, so the plan does not grow. Without ``max_depth`` levels go on
    until none is new. With ``max_pages`` the first pages by depth, then URL, are kept.
    """
    level = hold(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "level")
    visited = level
    total = level.count() if max_pages is not None else 0
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        if max_pages is not None and total >= max_pages:
            break
        fresh = (
            edges.join(level.select(F.col("url").alias("src_url")), "src_url", "left_semi")
            .select(F.col("dst_url").alias("url")).distinct()
            .join(visited, "url", "left_anti").withColumn("depth", F.lit(depth))
        )
        level = hold(fresh, "level")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
        total += level.count() if max_pages is not None else 0
    if max_pages is not None:
        visited = visited.orderBy("depth", "url").limit(max_pages)
    return visited
