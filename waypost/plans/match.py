"""The matching waterfall: exact path, cosine, fuzzy path, ancestors, fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waypost.functions.scoring import adjusted_confidence, confidence_tier, intent_conflict
from waypost.functions.urls import build_page_index
from waypost.operators import cosine, fuzzy
from waypost.operators.cosine import CosineIndex, build_cosine_index, match_cosine
from waypost.operators.fuzzy import match_fuzzy
from waypost.operators.paths import climb, target_path_table
from waypost.session import hold, spread

REDIRECT_COLUMNS = [
    "source_page_id", "source_url", "target_url", "match_type", "score", "raw_confidence",
    "confidence", "source_intention", "target_intention", "intent_mismatch",
]
_EMPTY = ("source_page_id long, source_url string, target_url string, match_type string, "
          "score double, raw_confidence string, confidence string, source_intention string, "
          "target_intention string, intent_mismatch boolean")

_READ_COLUMNS = ["page_id", "url", "title", "h1", "description", "intention"]
_INDEX_COLUMNS = ["page_id", "url", "path", "segments", "url_hash", "match_text", "intention"]


@dataclass
class TargetIndex:
    """Everything the phases need from the new site; built once, reusable per source batch."""

    pages: DataFrame      # page_id, url, intention
    paths: DataFrame      # one row per path
    cosine: CosineIndex | None

    def save(self, path: str) -> None:
        self.pages.write.mode("overwrite").parquet(f"{path}/pages")
        self.paths.write.mode("overwrite").parquet(f"{path}/paths")
        if self.cosine is not None:
            self.cosine.save(f"{path}/cosine")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TargetIndex:
        pages = spark.read.parquet(f"{path}/pages")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/cosine")
        stored = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        return cls(pages, spark.read.parquet(f"{path}/paths"),
                   CosineIndex.load(spark, f"{path}/cosine") if stored else None)


def _narrow(pages: DataFrame) -> DataFrame:
    return pages.select(*[name for name in _READ_COLUMNS if name in pages.columns])


def _indexed(pages: DataFrame, intents: DataFrame | None, status_filter: Column | None,
             label: str) -> DataFrame:
    """Only the columns matching reads; bodies and html never enter a shuffle."""
    if status_filter is not None:
        pages = pages.where(status_filter)
    # Taking an address apart is the costliest work per row, and rows are narrow here.
    pages = build_page_index(spread(_narrow(pages), even=True))
    if intents is not None:
        pages = pages.drop("intention").join(intents.select("page_id", "intention"),
                                             "page_id", "left")
    elif "intention" not in pages.columns:
        pages = pages.withColumn("intention", F.lit(""))
    pages = pages.withColumn("intention", F.coalesce("intention", F.lit("")))
    return hold(pages.select(*_INDEX_COLUMNS), label)


def _target_index(pages: DataFrame, max_features: int | None, with_cosine: bool) -> TargetIndex:
    return TargetIndex(
        pages.select("page_id", "url", "intention"),
        hold(target_path_table(pages), "target-paths"),
        build_cosine_index(pages.select("page_id", "match_text"), max_features)
        if with_cosine else None,
    )


def build_target_index(target: DataFrame, intents: DataFrame | None = None, *,
                       status_filter: Column | None = None,
                       max_features: int | None = cosine.MAX_FEATURES,
                       with_cosine: bool = True) -> TargetIndex:
    pages = _indexed(target, intents, status_filter, "target-pages")
    return _target_index(pages, max_features, with_cosine)


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched and unmatched rows of a phase, read from its one stored result."""
    return df.where(F.col("target_url").isNotNull()), df.where(F.col("target_url").isNull())


def _by_text(rest: DataFrame, index: TargetIndex, threshold: float) -> DataFrame:
    pages = index.pages.select(
        F.col("page_id").alias("target_page_id"), F.col("url").alias("target_url"),
        F.col("intention").alias("target_intention"))
    found = match_cosine(rest, index.cosine, threshold=threshold).join(pages, "target_page_id")
    return hold(rest.join(found, "page_id", "left").withColumn("match_type", F.lit("cosine")),
                "phase-cosine")


def _by_path(rest: DataFrame, paths: DataFrame, threshold: float) -> DataFrame:
    found = match_fuzzy(rest, paths, threshold=threshold).join(
        paths.select("first_id", "target_page_id", "target_url", "target_intention"), "first_id"
    ).drop("first_id")
    return hold(rest.join(found, "path", "left").withColumn("match_type", F.lit("fuzzy")),
                "phase-fuzzy")


def _match(source: DataFrame, index: TargetIndex, fuzzy_threshold: float,
           cosine_threshold: float, fallback_url: str) -> DataFrame:
    target = ["target_page_id", "target_url", "target_intention"]
    keep = ["page_id", "url", "intention", *target, "match_type", "score"]
    paths = index.paths

    # One left join per phase gives both its matches and the rest, without an anti-join.
    exact = hold(source.join(paths.select("url_hash", *target), "url_hash", "left"),
                 "phase-exact")
    done, rest = _split(exact)
    parts = [done.withColumns({"match_type": F.lit("exact"), "score": F.lit(100.0)}).select(*keep)]

    rest = rest.drop(*target)
    if cosine_threshold <= cosine.HIGHEST:
        done, rest = _split(_by_text(rest, index, cosine_threshold))
        parts.append(done.select(*keep))
        rest = rest.drop(*target, "match_type", "score")
    rest = rest.drop("match_text")
    if fuzzy_threshold <= fuzzy.HIGHEST:
        done, rest = _split(_by_path(rest, paths, fuzzy_threshold))
        parts.append(done.select(*keep))
        rest = rest.drop(*target, "match_type", "score")
    climbed = climb(rest, paths, fallback_url).withColumn("_one", F.lit(1))
    # The fallback is a single URL: it has the intent of the stored page it names, if any.
    named = index.pages.where(F.col("url") == fallback_url).agg(
        F.max("intention").alias("fallback_intention"), F.lit(1).alias("_one"))
    climbed = climbed.join(F.broadcast(named), "_one").withColumn(
        "target_intention",
        F.when(F.col("match_type") == "fallback", F.col("fallback_intention"))
        .otherwise(F.col("target_intention")))
    parts.append(climbed.select(*keep))

    plan = parts[0]
    for part in parts[1:]:
        plan = plan.unionByName(part)
    return plan


def score_redirects(plan: DataFrame) -> DataFrame:
    """Confidence from the unrounded score, then the stored, rounded score."""
    target_intention = F.coalesce("target_intention", F.lit(""))
    kind, score = F.col("match_type"), F.col("score")
    rounded = F.when(kind == "cosine", F.round(score, 4)).otherwise(F.round(score, 2))
    return plan.select(
        F.col("page_id").alias("source_page_id"), F.col("url").alias("source_url"),
        "target_url", "match_type", rounded.alias("score"),
        confidence_tier(kind, score).alias("raw_confidence"),
        F.col("intention").alias("source_intention"),
        target_intention.alias("target_intention"),
    ).withColumns({
        "confidence": adjusted_confidence(F.col("raw_confidence"), F.col("source_intention"),
                                          F.col("target_intention")),
        "intent_mismatch": intent_conflict(F.col("source_intention"),
                                           F.col("target_intention")),
    }).select(*REDIRECT_COLUMNS)


def match_against(source: DataFrame, index: TargetIndex, intents: DataFrame | None = None, *,
                  fuzzy_threshold: float = fuzzy.THRESHOLD,
                  cosine_threshold: float = cosine.THRESHOLD, fallback_url: str = "/",
                  status_filter: Column | None = None) -> DataFrame:
    """Match source pages against a stored target index: one redirect per source page."""
    pages = _indexed(source, intents, status_filter, "source-pages")
    if pages.isEmpty() or index.paths.isEmpty():
        return source.sparkSession.createDataFrame([], _EMPTY)
    return score_redirects(_match(pages, index, fuzzy_threshold, cosine_threshold, fallback_url))


def match_sites(source: DataFrame, target: DataFrame, intents: DataFrame | None = None, *,
                fuzzy_threshold: float = fuzzy.THRESHOLD,
                cosine_threshold: float = cosine.THRESHOLD, fallback_url: str = "/",
                max_features: int | None = cosine.MAX_FEATURES,
                status_filter: Column | None = None) -> DataFrame:
    """One redirect per source page, or none at all when either side is empty.

    ``source`` and ``target`` need ``page_id`` (unique over both) and ``url``; ``title``,
    ``h1`` and ``description`` feed the cosine phase. ``intents`` is ``(page_id, intention)``.
    A threshold no score can reach (cosine above 1, fuzzy above 100) skips its phase.
    """
    old = _indexed(source, intents, status_filter, "source-pages")
    new = _indexed(target, intents, status_filter, "target-pages")
    if old.isEmpty() or new.isEmpty():
        return source.sparkSession.createDataFrame([], _EMPTY)
    index = _target_index(new, max_features, cosine_threshold <= cosine.HIGHEST)
    return score_redirects(_match(old, index, fuzzy_threshold, cosine_threshold, fallback_url))
