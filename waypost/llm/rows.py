"""The key by which operators recognise a document.

Documents are ordered by doc_id, null first; rows that share a doc_id but not their text are
ordered by a hash of the text. Rows equal in both are one document, and each of them gets its
result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from waypost.session import hold

NO_ID = -(1 << 63)


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def text_key(column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """(id, th, text) of every row; ``id`` and ``th`` are never null."""
    return docs.select(id_key().alias("id"), text_key().alias("th"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shown_id() -> Column:
    """The doc_id again, null where there was none."""
    return F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")


def first_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One row of ``docs`` for each component that ``grouped`` gives to a stored table of (row, doc_id,
    text) as (row, component); all columns stay.

    It is the row of the smallest doc_id; of rows that share it the one of the smallest text hash, of
    rows equal in both any one. A row without doc_id stays only where no row of its group has one.
    """
    # Columns get other names meanwhile, and row numbers hold only once they are stored.
    names = {name: f"c{at}" for at, name in enumerate(docs.columns)}
    stored = hold(docs.select(*[F.col(name).alias(other) for name, other in names.items()],
                              F.monotonically_increasing_id().alias("row")), "rows", scratch=False)
    rows = stored.select("row", F.col(names["doc_id"]).cast("long").alias("doc_id"),
                         F.col(names["text"]).cast("string").alias("text"))
    keys = rows.select("row", "doc_id", text_key().alias("th"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "row")
    kept = hold(grouped(rows).join(keys, "row").groupBy("component").agg(F.min(first).alias("first")).select(
        "first.row"), "kept", scratch=False)
    return stored.join(kept, "row", "left_semi").select(
        *[F.col(other).alias(name) for name, other in names.items()])
