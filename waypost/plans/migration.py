"""A whole migration: extract both sites, classify, match, export."""

from __future__ import annotations

from pyspark.sql import DataFrame

from waypost.operators.intent import classify_intent
from waypost.operators.rows import dedupe_pages
from waypost.plans.match import match_sites
from waypost.plans.page_table import page_table, stamped
from waypost.plans.render import write_plan
from waypost.plans.stats import needs_classification
from waypost.session import scratch_tables


def ensure_classified(pages: DataFrame, classifications: DataFrame | None = None,
                      **params) -> DataFrame:
    """The given labels, or new ones while fewer than half of the pages have one."""
    if classifications is None or needs_classification(pages, classifications):
        return classify_intent(pages, **params)
    return classifications


def run_migration(old_raw: DataFrame, new_raw: DataFrame, output: str, *,
                  formats: tuple[str, ...] = ("csv",), mode: str = "parser",
                  source_domain: str = "", target_domain: str = "", vhost: bool = False,
                  generated_at: str = "", classify: dict | None = None,
                  content_types: tuple[str, ...] = ("text/html",), min_length: int = 0,
                  dedupe_rules: bool = False, hierarchical_rank: int = 99,
                  **match_params) -> DataFrame:
    """Run every step and return the stored redirects.

    Each step writes a table below ``output`` and the next one reads it, so a step can be
    repeated by itself. Pages are partitioned by site; ids must be unique over both sites. Pages of a
    ``content_type`` that is not allowed are left out. With ``generated_at`` the tables carry it as
    ``crawled_at``, ``classified_at`` and ``created_at``.
    """
    spark = old_raw.sparkSession
    at = generated_at or None

    def side(raw: DataFrame, site: str) -> DataFrame:
        return page_table(raw, site, mode=mode, content_types=content_types, min_length=min_length,
                          crawled_at=at)

    pages = side(old_raw, "source").unionByName(side(new_raw, "target"))
    pages.write.mode("overwrite").partitionBy("site").parquet(f"{output}/pages_raw")
    raw_pages = spark.read.parquet(f"{output}/pages_raw")
    dedupe_pages(raw_pages).write.mode("overwrite").partitionBy("site").parquet(f"{output}/pages")
    pages = spark.read.parquet(f"{output}/pages")

    with scratch_tables(spark):
        stamped(ensure_classified(pages, **(classify or {})), "classified_at", at).write.mode(
            "overwrite").parquet(f"{output}/classifications")
    labels = spark.read.parquet(f"{output}/classifications")

    with scratch_tables(spark):
        plan = match_sites(pages.where("site = 'source'"), pages.where("site = 'target'"), labels,
                           **match_params)
        stamped(plan, "created_at", at).write.mode("overwrite").parquet(f"{output}/redirects")
    redirects = spark.read.parquet(f"{output}/redirects")
    write_plan(redirects, output, formats, source_domain=source_domain,
               target_domain=target_domain, vhost=vhost, generated_at=generated_at,
               dedupe_rules=dedupe_rules, hierarchical_rank=hierarchical_rank)
    return redirects
