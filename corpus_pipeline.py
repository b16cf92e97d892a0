"""From raw documents to training pieces: five stages, each written and read by the next.

Quality filter, line dedup, near-dedup, mixing to target weights, encoding. The stages work on all
rows that their predecessor kept and behave alike at every size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from waypost.llm import lines, mixing, pieces, quality, simhash
from waypost.session import shared_dir, ship_package

#: Words to mix by the words there are: shares are by weight, and no source passes MOST times its own.
SHARE = 1.0


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier of ``labels`` takes for good; all others go.

    Rows are judged by their text alone, null as empty: repeated rows stay or go together. Without labels
    of both classes all rows have one score. Columns stay as they are.
    """
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document or place has; every document stays.

    n_chars follows the text. Documents are ordered by doc_id, null first, ties by a hash of the text; rows
    equal in both are one document and come out equal. A null text stays null.
    """
    ship_package(spark)
    changed = lines.drop_repeated_lines(docs).select(*docs.columns)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: fingerprints of three-word shingles, chained by
    links of at most two differing bits.

    The row of the smallest doc_id stays, of rows that share it that of the smallest text hash, of equal
    rows any one; a row without doc_id stays only where its group has no other. All empty and null
    texts are one group.
    """
    ship_package(spark)
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight takes them.

    A null source is one source, repeated rows are separate documents, and empty texts weigh nothing:
    they are taken at their source's rate like others of one size.
    """
    ship_package(spark)
    return mixing.mix(docs, share=SHARE)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with their number and a digest of the text they decode to.

    Null and empty texts have no ids. Rows are independent; ids equal for equal texts.
    """
    ship_package(spark)
    return pieces.decode(pieces.encode(docs.select("doc_id", "source", "lang", "text"))).select(
        "doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_pieces"),
        F.md5("decoded").alias("decoded_md5"))


STAGES = [
    ("quality", good_quality),
    ("line_dedup", unrepeated_lines),
    ("near_dedup", one_of_each),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: SQL has no zstandard dictionaries, XXH64 or Viterbi; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/waypost/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
