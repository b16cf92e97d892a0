"""Row rules of the page tables: first wins, resume, upsert, caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_SALTS = 64
ADDRESS = ("url", "site")   # what makes two rows the same page, unless a caller names other columns


def pages_of_site(pages: DataFrame, site: str) -> DataFrame:
    return pages.where(F.col("site") == site)


def dedupe_pages(pages: DataFrame, keys: tuple[str, ...] = ADDRESS) -> DataFrame:
    """One row per ``keys``: the lowest ``page_id``, then the lowest row fingerprint.

    Only keys are aggregated, so copies of a hot URL fold before the shuffle; the wide rows
    then meet their own key, and rows equal throughout are folded last.
    """
    marked = pages.withColumn("_row", F.xxhash64(*pages.columns))
    rest = [name for name in ("page_id", "_row") if name not in keys]
    first = marked.groupBy(*keys).agg(F.min(F.struct("page_id", "_row")).alias("k")).select(
        *keys, *[f"k.{name}" for name in rest])
    whole = [*keys, *rest]
    return marked.join(first, whole, "left_semi").dropDuplicates(whole).drop("_row")


def insert_or_ignore(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ADDRESS) -> DataFrame:
    """Rows of ``incoming`` to append: unseen ``keys``, first wins."""
    return dedupe_pages(not_stored(stored, incoming, keys), keys)


def not_stored(stored: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ADDRESS) -> DataFrame:
    """Resume: drop rows whose ``keys`` are stored already."""
    return incoming.join(stored.select(*keys), [*keys], "left_anti")


def upsert_classifications(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` replaces stored rows with the same ``page_id``; of several incoming rows of one
    page the greatest counts."""
    incoming = incoming.groupBy("page_id").agg(F.max(F.struct(
        *[name for name in incoming.columns if name != "page_id"])).alias("row")).select(
        *["page_id" if name == "page_id" else f"row.{name}" for name in incoming.columns])
    kept = stored.join(incoming.select("page_id"), "page_id", "left_anti")
    return kept.unionByName(incoming)


def first_per_site(pages: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    """The first ``limit`` rows of each site in ``order``.

    Rows are ranked inside salted slices first. The site-wide ranking then sees at most
    ``limit`` rows of each slice, however large the site is.
    """
    keys = [F.col(item) if isinstance(item, str) else item for item in order]
    slices = pages.withColumn("_slice", F.pmod(F.xxhash64("page_id"), F.lit(_SALTS)))
    within = Window.partitionBy("site", "_slice").orderBy(*keys)
    overall = Window.partitionBy("site").orderBy(*keys)
    return (
        slices.withColumn("_rank", F.row_number().over(within)).where(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(overall)).where(F.col("_rank") <= limit)
        .drop("_rank", "_slice")
    )


def distinct_in_order(urls: DataFrame) -> DataFrame:
    """``(url, ord)``: distinct URLs with the position of their first occurrence."""
    return urls.groupBy("url").agg(F.min("ord").alias("ord"))
