"""Path-based phases: the target path table, exact match and ancestor match."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waypost.functions.urls import ancestor_paths

# Scores of the ancestor levels.
HIERARCHY_SCORES = {
    "hierarchical_L1": 40.0,
    "hierarchical_L2": 25.0,
    "hierarchical_L3": 15.0,
    "hierarchical_root": 5.0,
    "fallback": 0.0,
}


def target_path_table(target: DataFrame) -> DataFrame:
    """One row per target path: ``(path, url_hash, target_page_id, target_url, first_id)``.

    Several pages may share a path; the page with the highest id gives the URL and the
    lowest id gives the order. Partial aggregation folds a hot path before the shuffle.
    """
    extra = [name for name in ("intention",) if name in target.columns]
    last = F.max_by(F.struct("page_id", "url", *extra), F.col("page_id"))
    return target.groupBy("path").agg(
        last.alias("last"), F.min("page_id").alias("first_id")
    ).select(
        "path", F.md5("path").alias("url_hash"), F.col("last.page_id").alias("target_page_id"),
        F.col("last.url").alias("target_url"), "first_id",
        *[F.col(f"last.{name}").alias(f"target_{name}") for name in extra],
    )


def match_exact(source: DataFrame, target_paths: DataFrame) -> DataFrame:
    """Source pages whose canonical path exists on the target side; score 100."""
    found = source.join(target_paths.select("url_hash", "target_page_id", "target_url"),
                        "url_hash")
    return found.select(
        "page_id", F.col("url").alias("source_url"), "target_page_id", "target_url",
        F.lit("exact").alias("match_type"), F.lit(100.0).alias("score"),
    )


def nearest_ancestors(source: DataFrame, target_paths: DataFrame) -> DataFrame:
    """``(page_id, level, ...target columns)`` for sources with an ancestor on the target side.

    Ancestors repeat heavily between sources, so the existing ones are found on their
    distinct paths; the source rows then meet at most one row per ancestor, and a hot
    ancestor is a one-sided skew that adaptive execution splits.
    """
    climbed = source.select(
        "page_id", F.explode_outer(ancestor_paths(F.col("segments"))).alias("up")
    ).where(F.col("up").isNotNull()).select("page_id", "up.level", "up.path")
    targets = [name for name in target_paths.columns if name not in ("url_hash", "first_id", "path")]
    hits = climbed.join(target_paths.select("path", *targets), "path")
    nearest = F.min_by(F.struct("level", *targets), F.col("level"))
    return hits.groupBy("page_id").agg(nearest.alias("near")).select(
        "page_id", "near.level", *[f"near.{name}" for name in targets]
    )


def climb(source: DataFrame, target_paths: DataFrame, fallback_url: str = "/") -> DataFrame:
    """``source`` with its target, match type and score: nearest of three ancestors, then the
    target root, then ``fallback_url``. Every source row gets one.

    The root is at most one row of the path table, so it is broadcast.
    """
    targets = [name for name in target_paths.columns if name not in ("url_hash", "first_id", "path")]
    root = target_paths.where(F.col("path") == "/").select(
        F.lit(1).alias("_root"), *[F.col(name).alias(f"root_{name}") for name in targets])
    near = nearest_ancestors(source, target_paths)
    joined = (
        source.join(near, "page_id", "left")
        .withColumn("_root", F.lit(1)).join(F.broadcast(root), "_root", "left")
    )
    has_near, has_root = F.col("level").isNotNull(), F.col("root_target_url").isNotNull()
    kind = (
        F.when(has_near, F.concat(F.lit("hierarchical_L"), F.col("level").cast("string")))
        .when(has_root, F.lit("hierarchical_root")).otherwise(F.lit("fallback"))
    )
    chosen = {
        name: F.when(has_near, F.col(name)).otherwise(F.col(f"root_{name}")) for name in targets
    }
    chosen["target_url"] = F.coalesce(chosen["target_url"], F.lit(fallback_url))
    score = F.lit(0.0)
    for name, value in HIERARCHY_SCORES.items():
        score = F.when(F.col("match_type") == name, F.lit(value)).otherwise(score)
    return joined.select(
        *source.columns, *[column.alias(name) for name, column in chosen.items()],
        kind.alias("match_type"),
    ).withColumn("score", score)


def match_hierarchical(source: DataFrame, target_paths: DataFrame,
                       fallback_url: str = "/") -> DataFrame:
    return climb(source, target_paths, fallback_url).select(
        "page_id", F.col("url").alias("source_url"), "target_page_id", "target_url",
        "match_type", "score")
