"""Substring dedup by minimiser pieces of word windows.

They stand in for the non-branching paths of the De Bruijn graph of windows of ``size`` words, which is
not built; a piece may pass through a branching node. Every window has an anchor, the smallest hash of its inner
word grams, so equal windows have equal anchors at equal places, and neighbouring windows with one
anchor form a piece. A window can only repeat if its anchor does. So

1. anchors are counted (one row per piece, about a sixth of the words),
2. pieces with a repeated anchor are kept with their window hashes,
3. equal pieces are compacted: joined to the first place where the whole piece occurs; every other
   occurrence is a repeat from its first word to its last,
4. windows of the remaining, distinct pieces are compared one by one, for spans that begin or end
   inside a piece.

Places are (document, word), so what is removed is verified against the place it repeats. Pieces are
told apart by 128 hash bits, windows by their anchor and 64 bits more.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from waypost.llm.rows import keyed, shown_id
from waypost.llm.words import Words, mixed, window_hashes, word_chunks, word_hashes
from waypost.llm.store import steps
from waypost.session import hold

SIZE = 20
#: Repeated anchors sent to all tasks at most (eight bytes each); beyond it they are joined.
SENT_ANCHORS = 4_000_000


class Pieces:
    """The pieces of a chunk of documents: rows, first windows, window counts and hashes."""

    def __init__(self, words: Words, size: int):
        gram = size // 2
        spread = size - gram + 1
        one, two = word_hashes(words), word_hashes(words, 1)
        counts = words.counts()
        windows = np.maximum(counts - size + 1, 0)
        row = np.repeat(np.arange(len(counts)), windows)
        ahead = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = words.rows[:-1][row] + ahead
        grams = window_hashes(one, gram)
        least = grams[at]
        for step in range(1, spread):
            np.minimum(least, grams[at + step], out=least)
        place = at + spread - 1
        for step in range(spread - 2, -1, -1):
            same = grams[at + step] == least
            place[same] = at[same] + step
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
        begins = np.flatnonzero(new)
        self.begins, self.lengths = begins, np.diff(np.append(begins, len(at)))
        self.rows, self.starts, self.anchors = row[begins], ahead[begins], least[begins]
        self._at, self._size, self._hashes = at, size, (one, two)

    def spans(self, salt: int, chosen: np.ndarray) -> np.ndarray:
        """A hash of all words of each chosen piece and of where its anchor is not needed."""
        found = window_hashes(self._hashes[salt], self._size, salt)
        begins, lengths = self.begins[chosen], self.lengths[chosen]
        first = found[self._at[begins]] if len(begins) else np.zeros(0, np.uint64)
        last = found[self._at[begins + lengths - 1]] if len(begins) else np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mixed(first * np.uint64(0x9E3779B97F4A7C15) + last + lengths.astype(np.uint64))

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window hashes of the chosen pieces, flat, and offsets into them."""
        lengths = self.lengths[chosen]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths) + np.repeat(self.begins[chosen], lengths)
        found = window_hashes(self._hashes[0], self._size)
        return (found[self._at[index]] if len(index) else np.zeros(0, np.uint64)), offsets


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def anchors(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(anchor), one row per piece of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in word_chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([_signed(Pieces(words, size).anchors)], names=["anchor"])

    return docs.select("text").mapInArrow(run, "anchor long")


def pieces(docs: DataFrame, size: int = SIZE, wanted=None, windows: bool = True) -> DataFrame:
    """(id, th, start, n, anchor, s1, s2, windows) of keyed texts, with anchors in ``wanted`` if given
    (a broadcast sorted array); without ``windows`` only how many there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy() for i in (0, 1))
            for words in word_chunks(batch.column(2)):
                found = Pieces(words, size)
                if wanted is None:
                    chosen = np.arange(len(found.anchors))
                else:
                    there = wanted.value
                    near = np.searchsorted(there, found.anchors)
                    near[near == len(there)] = 0
                    chosen = np.flatnonzero(there[near] == found.anchors) if len(there) else np.zeros(0, int)
                row = found.rows[chosen] + words.first
                columns = {
                    "id": pa.array(ids[row]), "th": pa.array(keys[row]),
                    "start": pa.array(found.starts[chosen].astype(np.int32)),
                    "n": pa.array(found.lengths[chosen].astype(np.int32)), "anchor": _signed(found.anchors[chosen]),
                    "s1": _signed(found.spans(0, chosen)), "s2": _signed(found.spans(1, chosen))}
                if windows:
                    flat, offsets = found.windows(chosen)
                    columns["windows"] = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _signed(flat))
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, "id long, th long, start int, n int, anchor long, s1 long, s2 long"
                           + (", windows array<long>" if windows else ""))


def repeated_spans(docs: DataFrame, size: int = SIZE, sent_anchors: int = SENT_ANCHORS) -> DataFrame:
    """(id, th, firsts, lasts): word ranges covered by windows that start earlier elsewhere.

    Ranges of a document may overlap. ``docs`` is as ``rows.keyed`` gives it. The texts are read
    again for each step, which costs less disk than keeping their windows.
    """
    spark = docs.sparkSession
    own = F.struct("id", "th", "start")
    with steps(spark):
        repeated = hold(anchors(docs, size).groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
        wanted = None
        if repeated.count() <= sent_anchors:
            listed = repeated.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
            wanted = spark.sparkContext.broadcast(np.sort(listed))

        def found(windows: bool) -> DataFrame:
            some = pieces(docs, size, wanted, windows)
            return some if wanted is not None else some.join(repeated, "anchor", "left_semi")

        narrow = hold(found(False).drop("anchor"), "pieces")
        first = hold(narrow.groupBy("s1", "s2").agg(F.min(own).alias("source")), "sources")
        copies = hold(narrow.join(first, ["s1", "s2"]).where(own != F.col("source")).select(
            "id", "th", F.col("start").alias("first"), (F.col("start") + F.col("n") + (size - 2)).alias("last")),
            "copies")
        sources = first.select("s1", "s2", "source.*")
        edges = hold(found(True).join(sources, ["s1", "s2", "id", "th", "start"], "left_semi").select(
            "id", "th", "start", "anchor", F.posexplode("windows").alias("i", "window")).select(
            "id", "th", (F.col("start") + F.col("i")).alias("start"), "anchor", "window"), "edges")
        shared = edges.groupBy("anchor", "window").agg(
            F.min(own).alias("source"), F.max(own).alias("latest")).where("source != latest").drop("latest")
        later = edges.join(shared, ["anchor", "window"]).where(own != F.col("source")).select(
            "id", "th", F.col("start").alias("first"), (F.col("start") + (size - 1)).alias("last"))
        return hold(copies.unionByName(later).groupBy("id", "th").agg(
            F.collect_list("first").alias("firsts"), F.collect_list("last").alias("lasts")), "spans", scratch=False)


def _kept(text: bytes, firsts, lasts) -> tuple[int, list[bytes]]:
    """Number of words and the words outside all ranges."""
    words = text.split()
    if not firsts:
        return len(words), words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, firsts, 1)
    np.add.at(change, np.asarray(lasts) + 1, -1)
    return len(words), list(compress(words, np.cumsum(change[:-1]) == 0))


def without_repeats(docs: DataFrame, size: int = SIZE, sent_anchors: int = SENT_ANCHORS) -> DataFrame:
    """(doc_id, n_words, n_removed, text): every row of ``docs`` without the words of repeated windows.

    A word goes if a window of ``size`` consecutive words over it also starts earlier: in a document
    of smaller doc_id (null first; equal doc_ids by text hash) or earlier in its own. Windows are
    judged on the input. The words left are joined by one space. A null or empty text has no words.
    Rows equal in doc_id and text are one document: each gets the same result, and they do not
    repeat one another. Other columns are ignored.
    """
    texts = keyed(docs)
    spans = repeated_spans(texts, size, sent_anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            firsts, lasts = batch.column(2), batch.column(3)
            found = [_kept(texts[i].as_buffer().to_pybytes(), firsts[i].as_py(), lasts[i].as_py())
                     for i in range(len(batch))]
            kept = [b" ".join(words) for _, words in found]
            yield pa.RecordBatch.from_arrays([
                ids, pa.array([n for n, _ in found], pa.int64()),
                pa.array([n - len(words) for n, words in found], pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string())], names=["id", "n_words", "n_removed", "text"])

    joined = texts.join(spans.hint("shuffle_hash"), ["id", "th"], "left").select("id", "text", "firsts", "lasts")
    return joined.mapInArrow(run, "id long, n_words long, n_removed long, text string").select(
        shown_id(), "n_words", "n_removed", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of ``without_repeats`` over whole ``documents``."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
