"""Line dedup by prefix doubling over line sequences.

The corpus is one sequence of line identities per document. A suffix is named by its first line,
then by its first two, four, eight lines: the name of twice the length joins the names at a line
and one length further on. Suffixes of one name stand together in the suffix array, as an interval
whose common prefix has at least that length; an interval's earliest suffix is its source.
Suffixes alone in their interval drop out of every further round, so the rounds end when no run is
that long, and only repeated lines move. Later copies of a repeated run are deleted.

Names are 128 hash bits instead of dense ranks: ranks would need a global sort a round, and only
equality and the earliest place are used. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waypost.llm.rows import id_key, text_key
from waypost.session import hold

MIN_LINES = 1
_FILLED = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def suffixes(docs: DataFrame) -> DataFrame:
    """(id, th, n, line, a, b): every line with a character other than white space. ``n`` counts
    them within the document, ``line`` counts all its lines; ``a`` and ``b`` name the line."""
    numbered = F.transform(_lines(F.col("text")), lambda line, i: F.struct(
        i.alias("line"), line.rlike(_FILLED).alias("filled"), F.xxhash64(line).alias("a"),
        F.xxhash64(F.lit(1), line).alias("b")))
    return docs.select(id_key().alias("id"), text_key().alias("th"), F.posexplode(
        F.filter(numbered, lambda x: x["filled"])).alias("n", "x")).select(
        "id", "th", "n", "x.line", "x.a", "x.b")


def _repeated(named: DataFrame) -> DataFrame:
    """Suffixes whose name occurs more than once, with the earliest place of the name."""
    intervals = named.groupBy("a", "b").agg(
        F.min(F.struct("id", "th", "n")).alias("source"), F.max(F.struct("id", "th", "n")).alias("last"))
    return named.join(intervals.where("source != last").drop("last"), ["a", "b"])


def _doubled(named: DataFrame, step: int) -> DataFrame:
    """Names of suffixes joined with the names ``step`` lines further on."""
    later = named.select("id", "th", (F.col("n") - step).alias("n"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    return named.join(later, ["id", "th", "n"]).select(
        "id", "th", "n", F.xxhash64("a", "a2").alias("a"), F.xxhash64(F.lit(1), "b", "b2").alias("b"))


def repeated_runs(lines: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(id, th, n, length, source): runs of at least ``min_lines`` lines that start earlier at
    ``source``; a longer run comes with the parts its name was made of."""
    length, found = 1, []
    level = hold(_repeated(lines.select("id", "th", "n", "a", "b").distinct()), "suffixes")
    while True:
        if 2 * length > min_lines:
            named = level if length >= min_lines else _repeated(
                _doubled(level.drop("source"), min_lines - length))
            found.append(named.where(F.col("source") != F.struct("id", "th", "n")).select(
                "id", "th", "n", F.lit(max(length, min_lines)).alias("length"), "source"))
        doubled = hold(_repeated(_doubled(level.drop("source"), length)), "suffixes")
        if doubled.isEmpty():
            break
        level, length = doubled, 2 * length
    runs = found[0] if found else level.select("id", "th", "n", F.lit(0).alias("length"), "source").limit(0)
    for more in found[1:]:
        runs = runs.unionByName(more)
    return runs


def deleted_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(id, th, n, line): the lines that later copies of repeated runs cover."""
    lines = suffixes(docs)
    covered = repeated_runs(lines, min_lines).select(
        "id", "th", F.explode(F.sequence(F.col("n"), F.col("n") + F.col("length") - 1)).alias("n")).distinct()
    return lines.select("id", "th", "n", "line").distinct().join(covered, ["id", "th", "n"], "left_semi")


def drop_repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines out of ``text``, and n_lines, n_removed,
    n_runs (deleted stretches), longest_run (lines of the longest).

    A line goes if a run of at least ``min_lines`` lines over it starts earlier: in a document of
    smaller doc_id (null first; equal doc_ids by text hash) or earlier in its own. White-space lines
    are no part of runs and stay. Lines left are joined by a newline; a text all of whose lines go
    is empty, its row stays. A null text stays null and has no lines. Rows equal in doc_id and
    text are one document: each gets the same result. Columns named like those added are replaced.
    """
    added = ("n_lines", "n_removed", "n_runs", "longest_run")
    gone = deleted_lines(docs, min_lines)
    by_doc = gone.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("gone"))
    breaks = F.filter(F.sequence(F.lit(0), F.size("gone") - 1), lambda i: (i == 0) | (
        F.get("gone", i)["n"] != F.get("gone", i - 1)["n"] + 1))
    by_doc = by_doc.select(
        F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("gone.line").alias("_gone"), breaks.alias("_at"))
    ends = F.concat(F.slice("_at", F.lit(2), F.greatest(F.size("_at") - 1, F.lit(0))), F.array(F.size("_gone")))
    by_doc = by_doc.withColumns({
        "_longest": F.array_max(F.zip_with(ends, "_at", lambda end, at: end - at)), "_runs": F.size("_at")})
    docs = docs.drop(*[name for name in added if name in docs.columns])
    keys = docs.select("*", id_key().alias("_own_id"), text_key().alias("_own_th"))
    joined = keys.join(by_doc.hint("shuffle_hash"),
                       (F.col("_own_id") == F.col("_id")) & (F.col("_own_th") == F.col("_th")), "left")
    lines = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    zero = F.lit(0)
    return joined.select(
        *[text.alias("text") if name == "text" else F.col(name) for name in docs.columns],
        F.size(F.filter(lines, lambda line: line.rlike(_FILLED))).cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), zero).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
        F.coalesce("_runs", zero).cast("long").alias("n_runs"),
        F.coalesce("_longest", zero).cast("long").alias("longest_run"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return drop_repeated_lines(docs).select(
        "doc_id", "n_lines", "n_removed", "n_runs", "longest_run",
        F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
