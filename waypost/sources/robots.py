"""robots.txt tables ``(origin, robots_txt)``: disallow rules and sitemap addresses.

A document is read inside its own row with pattern functions: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waypost.functions.urls import origin, raw_path, strip

_LINE_BREAK = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _lines(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _LINE_BREAK, "\n")


def disallowed_prefixes(text: Column) -> Column:
    """``Disallow`` values below ``User-agent: *`` lines; empty values and ``/`` are ignored.

    Each agent line opens a section, so consecutive agent lines do not share their rules.
    """
    sections = F.split(_lines(text), r"(?im)^[ \t]*user-agent:")
    # The text before the first agent line has number 0 and is never a section.
    ruled = F.filter(sections, lambda section, at: (at > 0) & (
        strip(F.substring_index(section, "\n", 1)) == "*"))
    found = F.flatten(F.transform(ruled, lambda section: F.regexp_extract_all(
        section, F.lit(r"(?im)^[ \t]*disallow:([^\n]*)$"), F.lit(1))))
    return F.filter(F.transform(found, strip), lambda rule: ~rule.isin("", "/"))


def robots_rules(robots: DataFrame) -> DataFrame:
    """``(origin, rules)``, the rules of a document in one array."""
    return robots.select("origin", disallowed_prefixes(F.col("robots_txt")).alias("rules"))


def robots_filter(urls: DataFrame, robots: DataFrame) -> DataFrame:
    """Drop URLs whose path starts with a rule of their own origin, hosts in any case.

    A rule is a row keyed by origin and prefix, and a URL asks for its path's prefixes of the lengths that its
    origin's rules have, at most one a length. So both sides meet by equality, neither a long rule list nor
    the URLs of a busy origin are one join key, and no pairs of URL and rule that don't match are
    ever produced. Equal URLs ask once.
    """
    rules = robots_rules(robots).select(F.lower("origin").alias("_origin"), F.explode("rules").alias("_prefix")).distinct()
    # Bounded by the longest rule of an origin.
    lengths = rules.groupBy("_origin").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    asked = urls.select(F.col("url").alias("_url"), origin(F.col("url")).alias("_origin"),
                        raw_path(F.col("url")).alias("_path")).distinct()
    fitting = F.filter("_lengths", lambda n: n <= F.length("_path"))
    prefixes = asked.join(lengths, "_origin").select("_url", "_origin", F.explode(F.transform(
        fitting, lambda n: F.substring(F.col("_path"), F.lit(1), n))).alias("_prefix"))
    blocked = prefixes.join(rules, ["_origin", "_prefix"], "left_semi").select("_url").distinct()
    return urls.join(blocked, F.col("url") == F.col("_url"), "left_anti")


def discover_sitemaps(robots: DataFrame) -> DataFrame:
    """``(origin, sitemap_url)``: ``Sitemap:`` lines, or ``origin/sitemap.xml`` without any."""
    found = F.regexp_extract_all(_lines(F.col("robots_txt")),
                                 F.lit(r"(?im)^Sitemap:\s*([^\n]+)$"), F.lit(1))
    default = F.array(F.concat(F.col("origin"), F.lit("/sitemap.xml")))
    listed = robots.select("origin", F.transform(found, strip).alias("found"))
    return listed.select("origin", F.explode(
        F.when(F.size("found") > 0, F.col("found")).otherwise(default)).alias("sitemap_url"))
