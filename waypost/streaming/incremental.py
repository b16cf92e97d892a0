"""Incremental intake and matching with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from waypost.operators.rows import ADDRESS
from waypost.plans.match import TargetIndex, match_against
from waypost.plans.page_table import BUCKETS, insert_pages, page_table
from waypost.session import scratch_tables


def page_intake(raw: DataFrame, site: str, pages_path: str, *, mode: str = "parser",
                buckets: int = BUCKETS, keys: tuple[str, ...] = ADDRESS, **page_params) -> DataStreamWriter:
    """Stream raw pages into the page table, skipping ``keys`` already stored.

    The stored table is the state: a batch that is run again after a failure finds its own
    rows there and adds nothing, and no unbounded stream state is kept. A batch reads the buckets of
    its own addresses. ``page_params`` go to ``page_table``.
    """
    def append(batch: DataFrame, _: int) -> None:
        insert_pages(page_table(batch, site, mode=mode, **page_params), pages_path, buckets, keys)

    return raw.writeStream.foreachBatch(append)


def redirect_stream(source: DataFrame, index_path: str, redirects_path: str,
                    **match_params) -> DataStreamWriter:
    """Match new source pages against a saved target index, batch by batch.

    Every batch writes its own folder, so a repeated batch replaces its first attempt.
    """
    def match(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch_tables(spark):
            index = TargetIndex.load(spark, index_path)
            match_against(batch, index, **match_params).write.mode("overwrite").parquet(
                f"{redirects_path}/batch={batch_id}")

    return source.writeStream.foreachBatch(match)
