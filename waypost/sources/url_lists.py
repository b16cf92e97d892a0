"""URL lists: CSV with a known column, or text with one URL per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waypost.functions.urls import strip

# URL column names in the order they are tried, and cells read as missing.
URL_COLUMNS = ("url", "URL", "Url", "address", "Address", "Adresse")
_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def read_url_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(url)`` from the first known column, else the first column; missing cells dropped."""
    # The header as written: the reader renames columns that differ only in case.
    header = spark.read.csv(path, escape='"', encoding="UTF-8").first()
    rows = spark.read.csv(path, header=True, escape='"', encoding="UTF-8")
    names = [(name or "").lstrip("\ufeff") for name in header or rows.columns]
    at = next((names.index(name) for name in URL_COLUMNS if name in names), 0)
    # By position, for the same reason.
    rows = rows.toDF(*[f"c{i}" for i in range(len(names))])
    url = F.col(f"c{at}")
    return rows.where(url.isNotNull() & ~url.isin(*_MISSING)).select(url.alias("url"))


def read_url_text(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).select(strip(F.col("value")).alias("url"))
    return lines.where(F.col("url") != "")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return read_url_csv(spark, path) if path.lower().endswith(".csv") else read_url_text(spark, path)
