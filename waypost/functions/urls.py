"""URL columns. All are built-in expressions and stay inside whole-stage codegen.

Spark's own ``parse_url`` is not used: with ANSI mode it fails on spaces and bars, and it
keeps path parameters, while redirect matching needs every stored URL to yield a path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_NETLOC = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_PARAMS = r";[^/]*$"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def tidy(url: Column) -> Column:
    """Trimmed, lower-cased, without the control characters URL parsers ignore."""
    return F.translate(F.lower(strip(url)), "\t\r\n", "")


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, _SCHEME, 1)


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _NETLOC, 1)


def origin(url: Column) -> Column:
    """``scheme://host`` of a URL in lower case, as neither tells cases apart."""
    return F.lower(F.concat(scheme(url), F.lit("://"), netloc(url)))


def raw_path(url: Column) -> Column:
    """Path with its case and trailing slash, without query, fragment or last parameters."""
    return F.regexp_replace(F.regexp_extract(url, _PATH, 1), _PARAMS, "")


def _canonical(raw: Column) -> Column:
    trimmed = F.rtrim(raw, F.lit("/"))
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("/"))


def path(url: Column) -> Column:
    """Canonical path: lower case, no trailing slash, ``/`` when nothing is left."""
    return _canonical(raw_path(tidy(url)))


def _rebuilt(head: Column, host: Column, tail: Column) -> Column:
    """A URL put back together from its scheme, host and path columns."""
    slash = F.when((host != "") & ~tail.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    double = (host != "") | tail.startswith("//") | (
        head.isin("http", "https") & tail.startswith("/"))
    return F.concat(
        F.when(head != "", F.concat(head, F.lit(":"))).otherwise(F.lit("")),
        F.when(double, F.lit("//")).otherwise(F.lit("")), host, slash, tail,
    )


def _without_dots(full: Column) -> Column:
    """A path with its ``.`` and ``..`` parts resolved; ``..`` at the root goes nowhere."""
    parts = F.split(full, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, part: F.when(part == "..", F.slice(acc, F.lit(1), F.greatest(
            F.size(acc) - 1, F.least(F.size(acc), F.lit(1)))))
        .when(part == ".", acc).otherwise(F.concat(acc, F.array(part))))
    folder = F.when(full.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.rtrim(F.array_join(kept, "/"), F.when(folder == "/", F.lit("/"))
                            .otherwise(F.lit(""))), folder)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute URL of a link on page ``base``; NULL for other schemes than http(s)."""
    head = F.lower(scheme(href))
    bare = F.regexp_extract(href, r"^([^?#]*)", 1)
    here = raw_path(base)
    folder = F.concat(F.lit("/"), F.ltrim(F.regexp_extract(here, r"^(.*/)", 1), F.lit("/")))
    joined = F.when(bare == "", here).when(bare.startswith("/"), bare).otherwise(
        F.regexp_replace(F.concat(folder, bare), "/+", "/"))
    settled = F.when(joined.contains("/."), _without_dots(joined)).otherwise(joined)
    return (
        F.when(head.isin("http", "https"), href)
        .when(head != "", F.lit(None))
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .otherwise(F.concat(origin(base), settled))
    )


def path_segments(url: Column) -> Column:
    """Non-empty path parts, in lower case; a trailing blank stays in the last part."""
    left = F.ltrim(url, F.lit(WHITESPACE))
    parts = F.split(F.lower(F.translate(raw_path(left), "\t\r\n", "")), "/")
    return F.filter(parts, lambda part: part != "")


def parent_path(segments: Column) -> Column:
    above = F.slice(segments, 1, F.greatest(F.size(segments) - 1, F.lit(0)))
    return F.when(F.size(segments) > 1, F.concat(F.lit("/"), F.array_join(above, "/")))


def level_one_path(segments: Column) -> Column:
    return F.when(F.size(segments) > 0, F.concat(F.lit("/"), F.get(segments, 0)))


def ancestor_paths(segments: Column, levels: int = 3) -> Column:
    """Up to ``levels`` ``(level, path)`` pairs: the parent first, never the root."""
    depth = F.least(F.lit(levels), F.size(segments) - 1)
    steps = F.when(depth > 0, F.sequence(F.lit(1), F.greatest(depth, F.lit(1))))
    climb = F.transform(
        steps,
        lambda up: F.struct(
            up.alias("level"),
            F.concat(
                F.lit("/"), F.array_join(F.slice(segments, F.lit(1), F.size(segments) - up), "/")
            ).alias("path"),
        ),
    )
    return F.coalesce(climb, F.array().cast("array<struct<level:int,path:string>>"))


def match_text(title: Column, h1: Column, description: Column, url: Column) -> Column:
    """Text compared by the cosine phase; the URL is split into words at ``/ - _``."""
    words = F.translate(url, "/-_", "   ")
    blank = F.lit("")
    return F.concat_ws(
        " ",
        strip(F.coalesce(title, blank)), strip(F.coalesce(h1, blank)),
        strip(F.coalesce(description, blank)), F.coalesce(words, blank),
    )


def build_page_index(pages: DataFrame) -> DataFrame:
    """Add the derived URL columns to a page table; one narrow projection, no shuffle."""
    def text(name: str) -> Column:
        return F.col(name) if name in pages.columns else F.lit("")

    # Each step reads columns of the step before, so every pattern runs once per row.
    return (
        pages.withColumn("_clean", tidy(F.col("url")))
        .withColumns({
            "_scheme": scheme(F.col("_clean")),
            "_host": netloc(F.col("_clean")),
            "path": _canonical(raw_path(F.col("_clean"))),
            "segments": path_segments(F.col("url")),
        })
        .withColumns({
            "normalized_url": _rebuilt(F.col("_scheme"), F.col("_host"), F.col("path")),
            "url_hash": F.md5(F.col("path")),
        })
        .withColumn("match_text", match_text(text("title"), text("h1"), text("description"),
                                             F.col("normalized_url")))
        .drop("_clean", "_scheme", "_host")
    )
