"""Sitemap documents ``(sitemap_url, xml)``: page URLs, with indexes followed."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from waypost.session import hold

# Fixed value: the namespace of the sitemap format.
_NAMESPACE = "{http://www.sitemaps.org/schemas/sitemap/0.9}"


def _locations(xml: str) -> tuple[bool, list[str]]:
    try:
        root = ElementTree.fromstring(xml)
    except (ElementTree.ParseError, TypeError, ValueError):
        return False, []
    found = [(node.text or "").strip() for node in root.iter(f"{_NAMESPACE}loc")]
    return root.tag == f"{_NAMESPACE}sitemapindex", [url for url in found if url]


def sitemap_locations(sitemaps: DataFrame) -> DataFrame:
    """``(sitemap_url, is_index, position, loc)``; malformed documents give no rows.

    The built-in ``xpath`` fails the query on malformed XML, hence the parser in batches.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parsed = [_locations(xml) for xml in batch["xml"]]
            yield pd.DataFrame({"sitemap_url": batch["sitemap_url"],
                                "is_index": [index for index, _ in parsed],
                                "locs": [locs for _, locs in parsed]})

    rows = sitemaps.select("sitemap_url", "xml").mapInPandas(
        parse, "sitemap_url string, is_index boolean, locs array<string>")
    return rows.select("sitemap_url", "is_index", F.posexplode("locs").alias("position", "loc"))


def expand_sitemaps(roots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Distinct page URLs below ``roots(sitemap_url)``: ``(url)``.

    Indexes are followed level by level; a document is visited once, so cycles end.
    """
    parsed = hold(sitemap_locations(sitemaps), "sitemap-locations")
    children = parsed.where("is_index").select("sitemap_url", F.col("loc").alias("child"))
    level = hold(roots.select("sitemap_url").distinct(), "sitemap-level")
    visited = level
    while not level.isEmpty():
        fresh = (
            children.join(level, "sitemap_url", "left_semi")
            .select(F.col("child").alias("sitemap_url")).distinct()
            .join(visited, "sitemap_url", "left_anti")
        )
        level = hold(fresh, "sitemap-level")
        visited = visited.unionByName(level)
    pages = parsed.where(~F.col("is_index")).join(visited, "sitemap_url", "left_semi")
    return pages.select(F.col("loc").alias("url")).distinct()
