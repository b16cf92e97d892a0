"""Steps of an operator that leave nothing behind but their result."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from waypost.session import scratch_tables

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def steps(spark: SparkSession, rows: int | None = None) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, and tables that ``hold`` writes go with the
    block unless written with ``scratch=False``. Results must be held before the block ends. ``rows``
    is how many rows a worker takes at once inside the block."""
    inside = {_CLEAN: "true"} | ({_ROWS: str(rows)} if rows else {})
    before = {name: spark.conf.get(name, None) for name in inside}
    try:
        for name, value in inside.items():
            spark.conf.set(name, value)
        with scratch_tables(spark):
            yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
