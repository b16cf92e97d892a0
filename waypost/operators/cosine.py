"""Cosine top-1: the most similar target page by TF-IDF over title, headings and URL words.

Vectors are fitted on the targets. Exact copies are folded first on both sides, so a page
repeated a million times is scored once. Candidates come from two-sided prefix filtering
(published all-pairs similarity search): with terms in one global order, rarest first, two
unit vectors can only reach a cosine of ``t`` when they share a term inside both prefixes,
where a prefix ends once the remaining weights have a norm below ``t``. Hot terms come last
and rarely enter a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from waypost.functions.text import build_vocabulary, term_lists, weight_vectors
from waypost.operators.blocks import block_join
from waypost.session import hold

MAX_FEATURES: int | None = None   # terms that are kept; None: all
MAX_DF = 0.90
MIN_DF = 1
THRESHOLD = 0.30
HIGHEST = 1.0

BLOCK_ROWS = 16_384
PART_ENTRIES = 1_000_000   # postings and scores of a block that are held at a time
# Scores closer than this count as equal, so the tie rule does not depend on summation order.
SCORE_DIGITS = 9


@dataclass
class CosineIndex:
    """Target side of the phase: fitted once, reusable for many source batches."""

    vocabulary: DataFrame   # term, term_idx, df, total, idf
    vectors: DataFrame      # target_id (lowest page of a copy group), term_ids, weights

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.vectors.write.mode("overwrite").parquet(f"{path}/vectors")

    @classmethod
    def load(cls, spark, path: str) -> CosineIndex:
        return cls(spark.read.parquet(f"{path}/vocabulary"), spark.read.parquet(f"{path}/vectors"))


def target_vocabulary(target: DataFrame, max_features: int | None = MAX_FEATURES) -> DataFrame:
    terms = term_lists(target, F.col("match_text"))
    return build_vocabulary(terms, target.count(), min_df=MIN_DF, max_df=MAX_DF,
                            max_features=max_features)


def page_vectors(pages: DataFrame, vocabulary: DataFrame) -> DataFrame:
    # A word and its pair take about six characters; counting the terms would mean listing them twice.
    n_rows = pages.agg(F.coalesce(F.sum(F.length("match_text")), F.lit(0))).first()[0] // 3
    return weight_vectors(term_lists(pages, F.col("match_text")), vocabulary, sublinear=True, n_rows=n_rows)


def build_cosine_index(target: DataFrame, max_features: int | None = MAX_FEATURES) -> CosineIndex:
    """Fit on ``target(page_id, match_text)``."""
    vocabulary = target_vocabulary(target, max_features)
    vectors = page_vectors(target, vocabulary)
    # Equal term counts give equal vectors; the lowest page wins a tie anyway.
    folded = vectors.groupBy("term_ids", "weights").agg(F.min("page_id").alias("target_id"))
    return CosineIndex(vocabulary, hold(folded, "target-vectors"))


def prefix_keys(threshold: float) -> Column:
    """Leading terms of a vector: up to the last one whose tail norm reaches ``threshold``."""
    bound = (threshold - 1e-6) ** 2
    tails = F.aggregate(
        F.reverse("weights"),
        F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("outside")),
        lambda acc, w: F.struct(
            (acc["mass"] + w * w).alias("mass"),
            (acc["outside"] + (acc["mass"] + w * w < bound).cast("int")).alias("outside"),
        ),
    )["outside"]
    return F.slice("term_ids", F.lit(1), F.size("term_ids") - tails)


def _parts(hits: np.ndarray, n_right: int) -> Iterator[tuple[int, int]]:
    """Ranges of left rows with about ``PART_ENTRIES`` postings met and scores held, one row at least."""
    at = 0
    met = np.concatenate([[0], np.cumsum(hits)])
    while at < len(hits):
        last = min(at + max(1, PART_ENTRIES // n_right), int(np.searchsorted(met, met[at] + PART_ENTRIES, "right")) - 1)
        last = min(max(last, at + 1), len(hits))
        yield at, last
        at = last


def best_in_block(threshold: float):
    """Kernel: sparse product of a block, one best target per source."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"source_id": [], "target_id": [], "score": []})
        left = left.drop_duplicates("source_id")
        right = right.drop_duplicates("target_id").sort_values("target_id")
        n_right = len(right)
        # Postings of the block: entries ordered by term.
        sizes = right["term_ids"].str.len().to_numpy()
        terms = np.concatenate(right["term_ids"].to_list())
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        owner = np.repeat(np.arange(n_right), sizes)[order]
        weight = np.concatenate(right["weights"].to_list())[order]

        sizes = left["term_ids"].str.len().to_numpy()
        probes = np.concatenate(left["term_ids"].to_list())
        scales = np.concatenate(left["weights"].to_list())
        first = np.searchsorted(terms, probes, "left")
        hits = np.searchsorted(terms, probes, "right") - first
        row_ends = np.cumsum(sizes)
        left_ids, right_ids = left["source_id"].to_numpy(), right["target_id"].to_numpy()
        ids, best_ids, scores = [], [], []
        for at, last in _parts(np.bincount(np.repeat(np.arange(len(left)), sizes), hits, len(left)), n_right):
            own = slice(row_ends[at] - sizes[at], row_ends[last - 1])
            rows = np.repeat(np.arange(last - at), sizes[at:last])
            entry = np.repeat(np.arange(len(rows)), hits[own])
            within = np.arange(len(entry)) - np.repeat(np.cumsum(hits[own]) - hits[own], hits[own])
            posting = first[own][entry] + within
            product = np.bincount(rows[entry] * n_right + owner[posting],
                                  weights=scales[own][entry] * weight[posting],
                                  minlength=(last - at) * n_right)
            product = product.reshape(last - at, n_right).round(SCORE_DIGITS)
            best = product.argmax(axis=1)   # first maximum: the lowest target id
            top = product[np.arange(last - at), best]
            keep = top >= threshold
            ids.append(left_ids[at:last][keep])
            best_ids.append(right_ids[best[keep]])
            scores.append(top[keep])
        return pd.DataFrame({"source_id": np.concatenate(ids),
                             "target_id": np.concatenate(best_ids),
                             "score": np.concatenate(scores)})

    return kernel


def match_cosine(source: DataFrame, index: CosineIndex, *, threshold: float = THRESHOLD,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(page_id, target_page_id, score)`` for sources with a target at or above ``threshold``."""
    if threshold <= 0:
        raise ValueError("cosine threshold must be positive")
    members = hold(page_vectors(source.select("page_id", "match_text"), index.vocabulary),
                   "source-vectors")
    sources = hold(members.groupBy("term_ids", "weights").agg(
        F.min("page_id").alias("source_id")), "source-vectors-folded")
    found = block_join(
        sources.withColumn("keys", prefix_keys(threshold)),
        index.vectors.withColumn("keys", prefix_keys(threshold)),
        left_id="source_id", right_id="target_id", rows=block_rows,
        schema="source_id long, target_id long, score double", kernel=best_in_block(threshold),
    )
    # Highest score, then lowest target; partial aggregation leaves one row per source.
    top = F.max(F.struct("score", (-F.col("target_id")).alias("order")))
    best = found.groupBy("source_id").agg(top.alias("best")).select(
        "source_id", (-F.col("best.order")).alias("target_id"), F.col("best.score").alias("score"))
    folded = sources.join(best, "source_id")
    return members.join(folded, ["term_ids", "weights"]).select(
        "page_id", F.col("target_id").alias("target_page_id"), "score"
    )
