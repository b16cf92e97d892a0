"""Search intent: TF-IDF over page text and K-Means, both on tables of terms."""

from __future__ import annotations

import warnings

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, functions as F

from waypost.functions.scoring import INTENT_LABELS
from waypost.functions.text import build_vocabulary, weight_vectors, words
from waypost.functions.urls import strip
from waypost.operators.clusters import kmeans
from waypost.session import hold, spread

_SCHEMA = "page_id long, cluster_label int, intention string"


def class_text(body_chars: int | None = None) -> Column:
    """Title and headings three times, description, then the body or its first ``body_chars``."""
    def field(name: str) -> Column:
        return strip(F.coalesce(F.col(name), F.lit("")))

    body = F.coalesce(F.col("body_text"), F.lit(""))
    body = strip(body if body_chars is None else F.substring(body, 1, body_chars))
    return F.concat_ws(" ", *[field("title")] * 3, *[field("h1")] * 3, field("description"), body)


def classifiable(pages: DataFrame, site: str | None = None) -> DataFrame:
    pages = pages.where(F.col("body_text") != "")
    return pages if site is None else pages.where(F.col("site") == site)


def class_terms(pages: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """``(page_id, terms)``: single words without stop words."""
    tokens = pages.select("page_id", words(class_text()).alias("tokens"))
    if not stop_words:
        return tokens.withColumnRenamed("tokens", "terms")
    remover = StopWordsRemover(inputCol="tokens", outputCol="terms", stopWords=stop_words,
                               caseSensitive=True)
    return remover.transform(tokens).drop("tokens")


def class_features(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(page_id, term_ids, weights)``: a sparse unit vector for every page, null without a listed term."""
    return terms.select("page_id").join(weight_vectors(terms, vocabulary, sublinear=False), "page_id", "left")


def intention_of(cluster: Column) -> Column:
    labels = F.array(*[F.lit(label) for label in INTENT_LABELS])
    return F.get(labels, F.pmod(cluster, F.lit(len(INTENT_LABELS))))


def classify_intent(pages: DataFrame, *, n_clusters: int = 5, max_features: int | None = None,
                    min_df: int = 2, max_df: float = 0.85, language: str = "french",
                    stop_words: list[str] | None = None, site: str | None = None,
                    seed: int = 42, max_iter: int = 200) -> DataFrame:
    """``(page_id, cluster_label, intention)`` for every page with body text.

    Clusters are numbered by size, then by their lowest page, so a rerun keeps its labels. A warning
    tells if ``max_iter`` rounds were not enough.
    With too few pages for a vocabulary nothing is classified.
    """
    if stop_words is None:
        stop_words = StopWordsRemover.loadDefaultStopWords(
            "french" if language == "french" else "english")
    # Tokens are stored once: the vocabulary, the fit and the labelling all read them.
    terms = hold(class_terms(spread(classifiable(pages, site)), stop_words), "class-terms")
    n_pages = terms.count()
    vocabulary = build_vocabulary(terms, n_pages, min_df=min_df, max_df=max_df,
                                  max_features=max_features)
    if vocabulary.isEmpty():
        return terms.sparkSession.createDataFrame([], _SCHEMA)
    features = class_features(terms, vocabulary)
    k = min(n_clusters, n_pages)
    if k < 2:
        found = features.select("page_id", F.lit(0).alias("prediction"))
    else:
        fitted = kmeans(features, k, seed=seed, max_iter=max_iter)
        if not fitted.converged:
            warnings.warn(f"K-Means ended after {fitted.rounds} rounds without converging")
        found = fitted.pages
    # At most n_clusters rows.
    sizes = found.groupBy("prediction").agg(
        F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first")).collect()
    ordered = sorted(sizes, key=lambda row: (-row["pages"], row["first"]))
    renumbered = F.create_map(*[
        F.lit(value) for at, row in enumerate(ordered) for value in (row["prediction"], at)])
    return found.select("page_id", renumbered[F.col("prediction")].alias("cluster_label")).withColumn(
        "intention", intention_of(F.col("cluster_label")))
