"""Fuzzy top-1: the target path most similar to a source path, at or above a threshold.

Every pair is equivalent to a pair of distinct paths, so paths are folded first. Candidates
come from prefix filtering on character bigrams. If two strings of lengths n and m have a
common subsequence of length L, their sentinel-padded forms share at least 3L - n - m + 1
bigrams, and a score of t needs L >= t (n + m) / 2. Ordered by one global rarity order, such
strings share a bigram inside both prefixes. Below a threshold of 70 the bigram bound loses
its force and single characters take their place. Nothing is approximated.

Bigrams are hashed into a fixed number of codes. Merging codes can only raise an overlap, so
the filter stays lossless and its tables have a fixed size.

Strings whose lengths differ by more than the threshold allows never meet: a key is a token and a
band of lengths. Bands grow by the greatest ratio of lengths that can reach the threshold; a source has
its own band, a target those next to its own, with a shorter prefix for bands of longer partners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from waypost.functions.similarity import PathBlock, WordBlock
from waypost.operators.blocks import block_join
from waypost.session import hold, spread

THRESHOLD = 80.0
HIGHEST = 100.0
BLOCK_ROWS = 4_096
PART_PAIRS = 1_000_000   # pairs of a block that are held at a time

_CODES = 4_096
_REPEATS = 4                      # a code's 1st, 2nd, 3rd and later occurrences
TOKEN_SPACE = _CODES * _REPEATS
# Bigrams from this threshold up, else characters: below it the bigram bound proves nothing.
_SENTINEL_FROM = 0.70


def canonical(path: str) -> str:
    """Distinct blank-separated tokens in order; most paths have one and stay as they are."""
    return " ".join(sorted(set(path.split())))


def _codes(path: str, paired: bool) -> np.ndarray:
    chars = np.frombuffer(canonical(path).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = chars.astype(np.uint64)
    if paired:
        first = np.concatenate([[np.uint64(2)], chars])
        second = np.concatenate([chars, [np.uint64(3)]])
        chars = first * np.uint64(1_000_003) + second
    return ((chars * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % _CODES


def tokens(path: str, paired: bool) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of a path and the running occurrence number of each token's code."""
    codes = np.sort(_codes(path, paired))
    nth = np.arange(len(codes)) - np.searchsorted(codes, codes, "left")
    return codes * _REPEATS + np.minimum(nth, _REPEATS - 1), nth


def prefix_length(n: int, n_tokens: int, partner: float, t: float, paired: bool) -> int:
    """Tokens in the prefix of a string of length ``n`` whose partners have ``partner`` characters at least."""
    if paired:
        overlap = (1.5 * t - 1.0) * (n + partner) + 1.0
    else:
        overlap = 0.5 * t * (n + partner)
    return max(0, min(n_tokens, n_tokens - math.ceil(overlap - 1e-9) + 1))


def length_bands(n: int, t: float, own: bool) -> list[tuple[int, float]]:
    """(band, least length of a partner) for a string of length ``n``: ``own`` gives the one that it lies
    in, else those that hold a partner. Band ``k`` begins at the ``k``-th power of the ratio."""
    ratio = max((2.0 - t) / t, 1.05)

    def band(length: float) -> int:
        return math.floor(math.log(max(length, 1.0)) / math.log(ratio))

    shortest, longest = n * t / (2.0 - t), n * (2.0 - t) / t
    if own:
        return [(band(n), shortest)]
    # Rounding of the logarithm may move a length to the band beside; its own strings never move.
    return [(k, max(shortest, ratio ** k * (1 - 1e-9) if k else 0.0))
            for k in range(band(shortest * (1 - 1e-9)), band(longest * (1 + 1e-9)) + 1)]


def token_rarity(paths: DataFrame, paired: bool) -> np.ndarray:
    """Rank of every token id by how many ``paths`` hold it; a table of fixed size."""
    @F.pandas_udf("array<int>")
    def token_ids(values: pd.Series) -> pd.Series:
        return values.map(lambda path: np.unique(tokens(path, paired)[0]))

    counts = (
        paths.select(F.explode_outer(token_ids("path")).alias("token"))
        .where(F.col("token").isNotNull()).groupBy("token").count().collect()
    )   # at most TOKEN_SPACE rows
    held = np.zeros(TOKEN_SPACE, dtype=np.int64)
    for row in counts:
        held[row["token"]] = row["count"]
    return np.argsort(np.argsort(held, kind="stable"), kind="stable")


def prefix_tokens(rarity: np.ndarray, t: float, paired: bool, own: bool):
    """Column function ``path -> array<int>``: the tokens of the path's prefix in each of its bands."""

    def prefix(path: str) -> np.ndarray:
        ids, nth = tokens(path, paired)
        order = np.lexsort((nth, rarity[ids]))
        size = len(canonical(path))
        keys = [ids[order[:prefix_length(size, len(ids), partner, t, paired)]] + band * TOKEN_SPACE
                for band, partner in length_bands(size, t, own)]
        return np.unique(np.concatenate(keys)).astype(np.int32)

    @F.pandas_udf("array<int>")
    def prefixes(values: pd.Series) -> pd.Series:
        return values.map(prefix)

    return prefixes


def _found(path=(), first_id=(), score=()) -> pd.DataFrame:
    """Kernel output with fixed types, so that an empty one converts as well."""
    return pd.DataFrame({"path": pd.Series(path, dtype=object),
                         "first_id": pd.Series(first_id, dtype="int64"),
                         "score": pd.Series(score, dtype="float64")})


def _best_rows(i: np.ndarray, j: np.ndarray, score: np.ndarray, left: pd.DataFrame,
               right: pd.DataFrame) -> pd.DataFrame:
    first_id = right["first_id"].to_numpy()[j]
    order = np.lexsort((first_id, -score, i))
    ranked = i[order]
    lead = np.ones(len(ranked), dtype=bool)
    lead[1:] = ranked[1:] != ranked[:-1]
    pick = order[lead]
    return _found(left["path"].to_numpy()[ranked[lead]], first_id[pick], score[pick])


def _survivors(block: PathBlock, meets: np.ndarray, threshold: float
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs that may reach the threshold by their characters and by their bigrams, some left rows at a
    time. Both bounds are lossless for pairs without shared tokens."""
    n_left, n_right = meets.shape
    t = threshold / 100.0

    def needed(per_char: float, constant: float) -> tuple[np.ndarray, np.ndarray]:
        # Single precision, loosened by far more than its error.
        left = per_char * block.left_len + constant - 1e-2
        return left.astype(np.float32)[:, None], (per_char * block.right_len).astype(np.float32)

    char_left, char_right = needed(0.5 * t, 0.0)
    pair_left, pair_right = needed(1.5 * t - 1.0, 1.0)
    characters, bigrams = block.characters(), None
    step = max(1, PART_PAIRS // n_right)
    for at in range(0, n_left, step):
        part = slice(at, at + step)
        fits = characters.rows(part) >= char_left[part] + char_right
        fits &= meets[part]
        if t >= _SENTINEL_FROM:
            bigrams = bigrams or block.bigrams()
            fits &= bigrams.rows(part) >= pair_left[part] + pair_right
        i, j = np.nonzero(fits)
        yield i + at, j


def _meeting(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    """Which rows share a key: a matrix, as large however many keys two rows share."""
    left["row"], paths = pd.factorize(left["path"])
    right["row"], ids = pd.factorize(right["first_id"])
    meets = np.zeros((len(paths), len(ids)), dtype=bool)
    right_rows = dict(tuple(right.groupby("key")["row"]))
    for key, rows in left.groupby("key")["row"]:
        if key in right_rows:
            meets[np.ix_(rows.to_numpy(), right_rows[key].to_numpy())] = True
    return meets


def _best_of(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float, left: pd.DataFrame,
             right: pd.DataFrame) -> pd.DataFrame:
    """The best pair of every left row; a left row's pairs are all in one part."""
    found = []
    for i, j, score in parts:
        keep = score >= threshold
        if keep.any():
            found.append(_best_rows(i[keep], j[keep], score[keep], left, right))
    return pd.concat(found, ignore_index=True) if found else _found()


def _sharing_words(left_words: list[set], right_words: list[set], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs of paths with blanks that share a word: the token-set score holds for them instead."""
    blank = np.array([len(words) > 1 for words in left_words])[i] | np.array(
        [len(words) > 1 for words in right_words])[j]
    shared = np.zeros(len(i), dtype=bool)
    for k in np.flatnonzero(blank):
        shared[k] = not left_words[i[k]].isdisjoint(right_words[j[k]])
    return shared


def best_in_block(threshold: float):
    """Kernel: pairs sharing a key, cut by two overlap bounds, then scored exactly."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _found()
        meets = _meeting(left, right)
        left = left.drop_duplicates("row")
        right = right.drop_duplicates("row")
        left_words, right_words = ([set(path.split()) for path in side["path"]] for side in (left, right))
        block = PathBlock([canonical(path) for path in left["path"]], [canonical(path) for path in right["path"]])

        def scored():
            for i, j in _survivors(block, meets, threshold):
                apart = ~_sharing_words(left_words, right_words, i, j)
                i, j = i[apart], j[apart]
                yield i, j, block.scores(i, j)

        return _best_of(scored(), threshold, left, right)

    return kernel


def _best_sharing_words(threshold: float):
    """Kernel for paths with blanks on both sides: the full token-set score of pairs sharing a word."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return _found()
        meets = _meeting(left, right)
        left, right = left.drop_duplicates("row"), right.drop_duplicates("row")
        block = WordBlock(left["path"].to_list(), right["path"].to_list())

        def scored():
            step = max(1, PART_PAIRS // len(right))
            for at in range(0, len(left), step):
                i, j = np.nonzero(meets[at:at + step])
                yield i + at, j, block.scores(i + at, j, threshold)

        return _best_of(scored(), threshold, left, right)

    return kernel


_FOUND = "path string, first_id long, score double"


def _blank_pairs(source: DataFrame, target: DataFrame, threshold: float,
                 block_rows: int) -> DataFrame | None:
    """Pairs where a path with blanks shares a token with its partner, or ``None``."""
    blank = F.size(F.split(F.col("path"), r"(?U)\s+")) > 1
    if source.select("path").union(target.select("path")).where(blank).isEmpty():
        return None
    word_list = F.array_remove(F.array_distinct(F.split(F.col("path"), r"(?U)\s+")), "")
    by_word = [df.select("*", F.explode(word_list).alias("word")) for df in (source, target)]
    plain = [df.where(~blank) for df in (source, target)]
    full = F.lit(100.0).alias("score")
    # A path without blanks that is a token of the other path scores 100.
    source_word = plain[0].join(
        by_word[1].where(blank).groupBy("word").agg(F.min("first_id").alias("first_id")),
        F.col("path") == F.col("word")).select("path", "first_id", full)
    target_word = by_word[0].where(blank).join(
        plain[1].select(F.col("path").alias("word"), "first_id"), "word",
    ).select("path", "first_id", full)
    keys = F.transform(word_list, lambda word: F.xxhash64(word))
    both = block_join(
        source.where(blank).withColumn("keys", keys), target.where(blank).withColumn("keys", keys),
        left_id="path", right_id="first_id", rows=block_rows, schema=_FOUND,
        kernel=_best_sharing_words(threshold),
    )
    return source_word.unionByName(target_word).unionByName(both)


def match_fuzzy(source: DataFrame, target_paths: DataFrame, *, threshold: float = THRESHOLD,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(path, first_id, score)``: for each distinct path of ``source`` its best target path.

    ``target_paths`` has one row per path with ``first_id``, the lowest page holding it,
    which decides ties.
    """
    if threshold <= 0:
        raise ValueError("fuzzy threshold must be positive")
    t = threshold / 100.0
    paired = t >= _SENTINEL_FROM
    sources = source.select("path").distinct()
    # Paths are short, so a table of many is few splits; their tokens are costly.
    targets = spread(target_paths.select("path", "first_id"), even=True)
    rarity = token_rarity(targets, paired)
    # Both sides in one stored table; source rows have no page order.
    both = sources.select("path", F.lit(None).cast("long").alias("first_id"),
                          prefix_tokens(rarity, t, paired, own=True)("path").alias("keys")).unionByName(
        targets.withColumn("keys", prefix_tokens(rarity, t, paired, own=False)("path")))
    keyed = hold(both, "prefixes")
    sources = keyed.where(F.col("first_id").isNull()).drop("first_id")
    targets = keyed.where(F.col("first_id").isNotNull())
    found = block_join(
        sources, targets, left_id="path", right_id="first_id", rows=block_rows, schema=_FOUND,
        kernel=best_in_block(threshold),
    )
    blank = _blank_pairs(sources.drop("keys"), targets.drop("keys"), threshold, block_rows)
    if blank is not None:
        found = found.unionByName(blank)
    best = F.max(F.struct("score", (-F.col("first_id")).alias("order")))
    return found.groupBy("path").agg(best.alias("best")).select(
        "path", (-F.col("best.order")).alias("first_id"), F.col("best.score").alias("score")
    )
