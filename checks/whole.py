"""Queries that run operators without the limits that their SQL counterparts need.

SQL walks to a fixed depth and has no cosine or fuzzy phase over whole tables, so these have no SQL;
tests compare with brute force.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from checks import queries as q, tables as t
from waypost.operators import links
from waypost.operators.extract import extract_links
from waypost.plans import discover, match


def link_bfs_whole(spark, d):
    """From all suppliers, to any depth."""
    seeds = t.read(spark, d, "supplier").select(
        F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string")).alias("url"))
    found = links.reachable(seeds, t.order_links(spark, d))
    return found.withColumn("depth", F.col("depth").cast("long"))


def discover_urls_whole(spark, d):
    """From seeds and sitemaps, to any depth. robots.txt names the roots of the sitemap documents."""
    pages = t.read(spark, d, "pages")
    seeds = pages.select("url", F.col("page_id").alias("ord"))
    roots = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(pages.agg(F.max("page_id")).first()[0] // 2_500)),
                                     lambda n: F.concat(F.lit("\nSitemap: map:high-"), n.cast("string"))), "")
    robots = t.robots_documents(spark, d).withColumn("robots_txt", F.concat("robots_txt", roots))
    found = discover.discover_urls(seeds, extract_links(pages), robots=robots,
                                   sitemaps=t.sitemap_documents(spark, d))
    return found.withColumn("depth", F.col("depth").cast("long"))


def whole_plan(spark, d):
    """The catalogue's plan with all phases at their default thresholds."""
    source, target = t.catalogue(spark, d)
    return match.match_sites(source, target, fallback_url="https://new.example/home")


#: Queries over the catalogue's plan.
OF_PLAN = """waterfall_structural plan_stats phase_counters project_stats redirect_filter plan_csv_order
plan_csv plan_json plan_json_header htaccess_rules htaccess_vhost
htaccess_deduped nginx_map nginx_map_vhost""".split()
QUERIES = {"link_bfs_whole": link_bfs_whole, "discover_urls_whole": discover_urls_whole} | {
    f"{name}_whole": partial(q.QUERIES[name], plan=whole_plan) for name in OF_PLAN}
