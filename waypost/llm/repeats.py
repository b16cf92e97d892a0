"""Repetition rules by suffix arrays over the words of each text.

The suffixes of a text, sorted by their words, stand next to those they share most with. Places of
the array whose neighbours share at least ``m`` words form a longest-common-prefix interval of depth
``m``; a suffix lies in nested intervals, and the deepest one is as long as the longer of the common
prefixes with its two neighbours. That prefix is a repeated substring that cannot be made longer to
the right; it is maximal if the suffix one word earlier does not already have it. The union of the
spans of all maximal repeats tells how much of a text is repetition, the deepest interval how long
its longest repeat is. A text fails if either passes its limit.

The array is built by prefix doubling, for all texts of a chunk at once: ranks after 1, 2, 4, 8 ...
words, only suffixes that are not yet alone being sorted again. The ranks of all rounds then give
the common prefix of two neighbours, longest round first. Nothing is sampled; a text is never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waypost.llm.words import Words, byte_chunks, word_chunks, word_hashes

MIN_WORDS = 50          # fewer words fail
WINDOW = 3              # words of the windows whose repeats count in n_repeat_words
MAX_REPEAT_PERCENT = 50  # of all words, in repeated windows
MIN_RUN = 8             # words of the shortest repeat that counts as repetition
MAX_COVERED_PERCENT = 40  # of all words, in maximal repeats of MIN_RUN words or more
MAX_RUN = 200           # words of the longest repeat
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words",
          "longest_repeat")


def suffix_order(names: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffixes of every row in order, rows one after the other, and their ranks after 1, 2, 4 ...
    words: two are equal exactly where both suffixes have those words in common.

    ``names`` are the words' numbers; row ``r`` has words ``rows[r]`` to ``rows[r + 1]``.
    """
    sizes = np.diff(rows)
    row, ends = np.repeat(np.arange(len(sizes)), sizes), np.repeat(rows[1:], sizes)
    order = np.lexsort((names, row))
    first = np.ones(len(names), dtype=bool)
    first[1:] = (names[order[1:]] != names[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    rank = np.empty(len(names), np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(len(names)), 0))
    ranks, step = [], 1
    while True:
        shared = np.flatnonzero(~(first & np.append(first[1:], True)))
        if not len(shared):
            return order, ranks
        ranks.append(rank.astype(np.int32))
        # Groups keep their places: only the order within each changes.
        at = order[shared]
        ahead = at + step
        later = np.where(ahead < ends[at], rank[np.minimum(ahead, len(names) - 1)] + 1, 0)
        own = rank[at]
        again = np.lexsort((later, own))
        order[shared], own, later = at[again], own[again], later[again]
        fresh = np.ones(len(shared), dtype=bool)
        fresh[1:] = (own[1:] != own[:-1]) | (later[1:] != later[:-1])
        first[shared] = fresh
        rank[order[shared]] = np.maximum.accumulate(np.where(fresh, shared, 0))
        step *= 2


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """How many words the suffix at each place shares with the one before it."""
    shared = np.zeros(len(order), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        left, right = order[:-1] + shared[1:], order[1:] + shared[1:]
        inside = np.maximum(left, right) < len(order)
        left, right = np.where(inside, left, 0), np.where(inside, right, 0)
        shared[1:] += (inside & (ranks[level][left] == ranks[level][right])).astype(np.int64) << level
    return shared


def deepest_intervals(names: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Of every word, how many words from it on occur once more in its row: the depth of the deepest
    common-prefix interval that its suffix lies in."""
    order, ranks = suffix_order(names, rows)
    shared = common_prefixes(order, ranks)
    depth = np.empty(len(order), np.int64)
    depth[order] = np.maximum(shared, np.append(shared[1:], 0))
    return depth


def maximal_repeats(depth: np.ndarray, least: int) -> np.ndarray:
    """The words at which maximal repeats of ``least`` words or more start.

    A repeat that the word before it lengthens is a part of another; depths fall by one at most
    from word to word, so such a start is told by its neighbour alone.
    """
    starts = depth >= least
    starts[1:] &= depth[:-1] != depth[1:] + 1
    return np.flatnonzero(starts)


def covered(depth: np.ndarray, least: int) -> np.ndarray:
    """Which words the spans of maximal repeats of ``least`` words or more cover."""
    starts = maximal_repeats(depth, least)
    change = np.zeros(len(depth) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + depth[starts], -1)
    return np.cumsum(change[:-1]) > 0


def _line_repeats(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """Of each row, the lines with a word that equal an earlier line of the row."""
    breaks = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    lines = np.unique(np.searchsorted(bounds, words.starts, side="right") - 1)
    starts = bounds[lines]
    row = np.searchsorted(offsets, starts, side="right") - 1
    stop = np.searchsorted(breaks, starts)
    ends = np.minimum(np.append(breaks, len(data))[stop], offsets[row + 1])
    names = word_hashes(Words(words.first, words.last, data, starts, ends, words.rows))
    order = np.lexsort((names, row))
    same = (names[order[1:]] == names[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return np.bincount(row[order[1:]][same], minlength=len(offsets) - 1)


def counts_of(data: np.ndarray, offsets: np.ndarray, words: Words, min_run: int = MIN_RUN) -> list[np.ndarray]:
    """The values of ``COUNTS`` for every row."""
    def by_row(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(values)])[words.rows])

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return by_row(sums[words.ends] - sums[words.starts])

    depth = deepest_intervals(word_hashes(words), words.rows)
    longest = np.zeros(words.last - words.first, np.int64)
    filled = np.flatnonzero(words.counts())
    if len(filled):
        longest[filled] = np.maximum.reduceat(depth, words.rows[filled])
    return [words.counts(), inside((data & 0xC0) != 0x80), inside(_SYMBOLS[data]),
            _line_repeats(data, offsets, words), by_row(covered(depth, WINDOW)),
            by_row(covered(depth, min_run)), longest]


def counts(text: Column, min_run: int = MIN_RUN) -> Column:
    """A struct of ``COUNTS`` for each whole text; null counts as empty."""
    def run(column: pa.Array) -> pa.Array:
        found = [[np.zeros(0, np.int64)] for _ in COUNTS]
        for (_, _, data, offsets), words in zip(byte_chunks(column), word_chunks(column)):
            for values, more in zip(found, counts_of(data, offsets, words, min_run)):
                values.append(more)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(values), pa.int64()) for values in found], COUNTS)

    return F.arrow_udf(run, "struct<" + ", ".join(f"{name}: long" for name in COUNTS) + ">")(text)


def rated(docs: DataFrame, min_run: int = MIN_RUN, max_covered_percent: int = MAX_COVERED_PERCENT,
          max_run: int = MAX_RUN) -> DataFrame:
    """Every row and column of ``docs`` with ``COUNTS``, base_failed and kept (replacing columns named
    so).

    base_failed: fewer than ``MIN_WORDS`` words, or more than ``MAX_REPEAT_PERCENT`` of them in windows
    of three words found twice. kept: not so, and at most ``max_covered_percent`` of the words lie in
    maximal repeats of ``min_run`` words or more, and no repeat is longer than ``max_run`` words. Every
    occurrence of a repeat counts, the first included; occurrences may overlap. Null and empty texts
    have no words and fail. Rows are independent: repeated rows have equal results, other columns
    don't matter. An empty table gives an empty one. A text is held by one task whole, with some
    bytes a word and round of doubling.
    """
    docs = docs.drop(*[name for name in (*COUNTS, "base_failed", "kept") if name in docs.columns])
    found = docs.select("*", counts(F.col("text").cast("string"), min_run).alias("_counts"))
    rows = found.select(*[F.col(name) for name in docs.columns],
                        *[F.col("_counts")[name].alias(name) for name in COUNTS])
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    kept = ~failed & (100 * F.col("n_covered_words") <= max_covered_percent * F.col("n_words")) & (
        F.col("longest_repeat") <= max_run)
    return rows.select("*", failed.alias("base_failed"), kept.alias("kept"))


def keep_varied(docs: DataFrame, **limits: int) -> DataFrame:
    """The rows of ``docs`` that ``rated`` keeps, with their own columns; ``limits`` as there."""
    # Rated columns may replace own ones, so these get other names meanwhile.
    names = {name: f"c{at}" for at, name in enumerate(docs.columns)}
    held = docs.select(*[F.col(name).alias(other) for name, other in names.items()], F.col("text").alias("text"))
    return rated(held, **limits).where("kept").select(
        *[F.col(other).alias(name) for name, other in names.items()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return rated(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", "n_covered_words")
