"""URL discovery: seeds, sitemaps, robots rules and the stored link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waypost.functions.urls import origin
from waypost.operators.links import MAX_DEPTH, reachable
from waypost.operators.rows import distinct_in_order
from waypost.session import hold
from waypost.sources.robots import discover_sitemaps, robots_filter
from waypost.sources.sitemaps import expand_sitemaps

MAX_PAGES: int | None = None


def merge_seeds(seeds: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Seeds, then sitemap URLs, each URL at its first place: ``(url, ord)``.

    ``ord`` orders seeds by their own position; sitemap URLs follow after them.
    """
    later = sitemap_urls.select("url", F.lit(9_223_372_036_854_775_807).alias("ord"))
    return distinct_in_order(seeds.select("url", F.col("ord").cast("long").alias("ord"))
                             .unionByName(later))


def seed_sitemaps(seeds: DataFrame, robots: DataFrame) -> DataFrame:
    """``(origin, sitemap_url)`` once per seed origin, with or without a robots document."""
    origins = seeds.select(origin(F.col("url")).alias("origin")).distinct()
    return discover_sitemaps(origins.join(robots, "origin", "left"))


def discover_urls(seeds: DataFrame, edges: DataFrame, *, robots: DataFrame | None = None,
                  sitemaps: DataFrame | None = None, follow_links: bool = True,
                  max_depth: int | None = MAX_DEPTH, max_pages: int | None = MAX_PAGES) -> DataFrame:
    """``(url, depth)`` of every page discovery reaches from ``seeds(url, ord)``."""
    if sitemaps is not None:
        documents = robots if robots is not None else seeds.sparkSession.createDataFrame(
            [], "origin string, robots_txt string")
        roots = seed_sitemaps(seeds, documents).select("sitemap_url")
        seeds = merge_seeds(seeds, expand_sitemaps(roots, sitemaps))
    if robots is not None:
        seeds = robots_filter(seeds, robots)
        edges = robots_filter(edges.withColumnRenamed("dst_url", "url"), robots
                              ).withColumnRenamed("url", "dst_url")
    if follow_links:
        # Every level reads the edges; links still to be extracted would be extracted again.
        edges = hold(edges.select("src_url", "dst_url"), "edges")
        return reachable(seeds, edges, max_depth=max_depth, max_pages=max_pages)
    listed = seeds.groupBy("url").agg(F.min("ord").alias("ord"))
    if max_pages is not None:
        listed = listed.orderBy("ord", "url").limit(max_pages)
    return listed.select("url", F.lit(0).alias("depth"))
