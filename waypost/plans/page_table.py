"""The stored page table: extracted pages with their URL columns, in folders by site and address.

A page's bucket is a hash of its address. Looking for known addresses therefore reads the buckets of
the incoming pages alone, however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from waypost.functions.urls import build_page_index
from waypost.operators.extract import admitted, extract_pages, with_structured_data
from waypost.operators.rows import ADDRESS, dedupe_pages, insert_or_ignore

BUCKETS = 64


def page_table(raw: DataFrame, site: str | Column, *, mode: str = "parser",
               content_types: tuple[str, ...] = ("text/html",), min_length: int = 0,
               crawled_at: str | Column | None = None) -> DataFrame:
    """Rows of the page table from ``raw(page_id, url, html[, status_code, depth, content_type])``.

    Inadmissible pages are left out. The address gives ``normalized_url``, ``url_hash`` and
    ``path_segments``; ``structured_data`` is JSON, ``{}`` where ``mode`` does not collect it. With
    ``crawled_at`` rows carry that time. One narrow pass, no shuffle.
    """
    pages = extract_pages(admitted(raw, content_types, min_length), site, mode=mode)
    if "json_ld" in pages.columns:
        pages = with_structured_data(pages).withColumn("structured_data", F.to_json("structured_data"))
    else:
        pages = pages.withColumn("structured_data", F.lit("{}"))
    # The table keeps the columns of the address only; matching derives the rest again.
    pages = build_page_index(pages).withColumn("path_segments", F.to_json("segments")).drop(
        "path", "segments", "match_text")
    return stamped(pages, "crawled_at", crawled_at)


def stamped(rows: DataFrame, name: str, at: str | Column | None) -> DataFrame:
    """``rows`` with the time ``at`` as column ``name``, unchanged without one."""
    return rows if at is None else rows.withColumn(name, F.lit(at) if isinstance(at, str) else at)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _bucket_count(spark: SparkSession, path: str, buckets: int) -> int:
    """The number the table was begun with. Readers of the table skip names with an underscore."""
    layout = f"{path}/_layout"
    if not _exists(spark, layout):
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("ignore").parquet(layout)
    return spark.read.parquet(layout).first().buckets


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def known_addresses(pages: DataFrame, path: str, keys: tuple[str, ...] = ADDRESS) -> DataFrame | None:
    """``keys`` of the stored rows in the buckets of ``pages``; none before the first insert.

    The sites and buckets asked for are at most BUCKETS for each site and become partition filters.
    """
    asked = [(row.site, row.bucket) for row in pages.select("site", "bucket").distinct().collect()]
    spark = pages.sparkSession
    sites = sorted({site for site, _ in asked})
    if not any(_exists(spark, f"{path}/site={site}") for site in sites):
        return None
    wanted = F.lit(False)
    for site in sites:
        numbers = sorted(number for name, number in asked if name == site)
        wanted = wanted | ((F.col("site") == site) & F.col("bucket").isin(numbers))
    return spark.read.parquet(path).where(wanted).select(*keys)


def insert_pages(pages: DataFrame, path: str, buckets: int = BUCKETS,
                 keys: tuple[str, ...] = ADDRESS) -> int:
    """Append the pages whose ``keys`` are not stored yet, the first of each; returns how many.

    The table itself is the state: inserting the same pages again adds nothing. ``keys`` hold url and site,
    which give the bucket; with page_id as a third, pages that share an address are all kept.
    """
    if not {*ADDRESS} <= {*keys}:
        raise ValueError("keys of the page table hold url and site")
    count = _bucket_count(pages.sparkSession, path, buckets)
    pages = pages.withColumn("bucket", F.pmod(F.xxhash64("url"), F.lit(count)).cast("int")).persist()
    try:
        known = known_addresses(pages, path, keys)
        fresh = dedupe_pages(pages, keys) if known is None else insert_or_ignore(known, pages, keys)
        added = Observation()
        # One file a bucket and insert, sorted so that a task has one file open at a time. Counted last:
        # a plan found empty at run time loses what is below its shuffles, a count there with it.
        fresh.repartition("site", "bucket").sortWithinPartitions("site", "bucket").observe(
            added, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("site", "bucket").parquet(path)
        return added.get["n"]
    finally:
        pages.unpersist()
