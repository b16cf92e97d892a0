"""Counts over pages, classifications and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Phases in display order.
PHASES = (
    "exact", "cosine", "fuzzy", "hierarchical_L1", "hierarchical_L2", "hierarchical_L3",
    "hierarchical_root", "fallback", "intent_adjusted",
)


def plan_stats(redirects: DataFrame) -> DataFrame:
    """Redirects by match type and confidence."""
    return redirects.groupBy("match_type", "confidence").agg(
        F.count(F.lit(1)).alias("cnt")).orderBy("match_type", "confidence")


def phase_counters(redirects: DataFrame) -> DataFrame:
    """``(phase, position, cnt)`` for every phase, zero included.

    ``intent_adjusted`` counts redirects after the exact phase whose confidence changed.
    """
    changed = (F.col("match_type") != "exact") & (F.col("confidence") != F.col("raw_confidence"))
    tests = {name: F.col("match_type") == name for name in PHASES[:-1]}
    tests["intent_adjusted"] = changed
    totals = redirects.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    rows = F.array(*[
        F.struct(F.lit(name).alias("phase"), F.lit(at).alias("position"), F.col(name).alias("cnt"))
        for at, name in enumerate(PHASES)
    ])
    return totals.select(F.inline(rows)).orderBy("position")


def project_stats(pages: DataFrame, classifications: DataFrame, redirects: DataFrame) -> DataFrame:
    """One row: pages per side, classified pages, redirects in total and by confidence."""
    def tier(name: str) -> Column:
        return F.count_if(F.col("confidence") == name).alias(name)

    page_counts = pages.agg(F.count_if(F.col("site") == "source").alias("source_pages"),
                            F.count_if(F.col("site") == "target").alias("target_pages"))
    classified = classifications.agg(F.count(F.lit(1)).alias("classified"))
    redirect_counts = redirects.agg(F.count(F.lit(1)).alias("redirects"),
                                    tier("high"), tier("medium"), tier("low"))
    # Three one-row tables side by side.
    one = F.lit(1)
    return (
        page_counts.withColumn("_one", one)
        .join(F.broadcast(classified.withColumn("_one", one)), "_one")
        .join(F.broadcast(redirect_counts.withColumn("_one", one)), "_one").drop("_one")
    )


def pages_per_site(pages: DataFrame) -> DataFrame:
    return pages.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))


def intent_summary(classifications: DataFrame) -> DataFrame:
    return classifications.groupBy("intention").agg(
        F.count(F.lit(1)).alias("pages")).orderBy(F.desc("pages"), "intention")


def content_duplicates(pages: DataFrame) -> DataFrame:
    """Groups of pages of a site with the same body: size and first page."""
    return pages.groupBy("site", "content_hash").agg(
        F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page_id")
    ).where(F.col("pages") > 1)


def filter_redirects(redirects: DataFrame, *, confidence: str | None = None,
                     match_type: str | None = None) -> DataFrame:
    if confidence is not None:
        redirects = redirects.where(F.col("confidence") == confidence)
    if match_type is not None:
        redirects = redirects.where(F.col("match_type") == match_type)
    return redirects


def needs_classification(pages: DataFrame, classifications: DataFrame) -> bool:
    """True while fewer than half of the pages have a label."""
    return classifications.count() < 0.5 * pages.count()
