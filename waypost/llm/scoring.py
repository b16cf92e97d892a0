"""Language-model scores of whole texts.

Steps over the documents:

1. every text is cut into pieces, once, and stored with them,
2. words and pairs of pieces of the training documents are counted,
3. every partition trains the attention model on adjoining windows of its training documents from
   common weights, and the weights are averaged by the places seen,
4. every text is scored in overlapping windows that score each piece once.

The counts of the most frequent words go to every task (a fixed number); all other words meet their
counts in a join. Words are known by a 64-bit hash. Pieces come from a public vocabulary file; the
model knows the most frequent ones; a rarer piece costs the symbol of rare pieces and its share of them
in the training documents, by add-one counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waypost.llm import attention as model
from waypost.llm.store import steps
from waypost.llm.words import Words, word_chunks, word_hashes
from waypost.session import hold

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose counts are sent to all tasks.
HEAD = 65_536
ROUNDS = 1
#: Each round trains on one window in so many: on all.
EVERY = 1
#: Words in a worker's table of segmented words before it starts anew.
TABLE = 400_000
#: Slots of tables of words, more than there are words.
_SLOTS = 1 << 20
_CHUNK, _BATCH = 1 << 20, 192
#: Counts that a worker gathers before it adds up those of equal keys.
_WAITING = 1 << 20
#: Rows that a worker takes at once.
_ROWS = 2_000
_END, _RARE, _KNOWN = 0, 1, model.VOCABULARY - 2
_PAIR = 1 << 20


class Segmenter:
    """Piece ids of words, kept by word hash: a slot holds the last word that fell on it."""

    def __init__(self, vocabulary: bytes):
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
        self.size = self._pieces.get_piece_size()
        self._reset()

    def _reset(self) -> None:
        # No word falls on a slot whose key has other last bits.
        self._keys, self._at = np.arange(1, _SLOTS + 1, dtype=np.uint64), np.zeros(_SLOTS, np.int64)
        self._flat, self._ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _add(self, words: Words, new: np.ndarray) -> None:
        """Entries of the words with the numbers ``new``, after those there are."""
        data = words.data.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(
            words.starts[new].tolist(), words.ends[new].tolist())]
        found = self._pieces.encode(texts, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._flat = np.concatenate([self._flat, np.fromiter(
            chain.from_iterable(found), np.int32, int(sizes.sum()))])
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])

    def pieces(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and how many each row has."""
        if len(self._ends) > TABLE:
            self._reset()
        if not len(hashes):
            return np.zeros(0, np.int32), np.zeros(len(words.rows) - 1, np.int64)
        slots = (hashes & np.uint64(_SLOTS - 1)).view(np.int64)
        own = self._at.take(slots)
        missing = np.flatnonzero(self._keys.take(slots) != hashes)
        if len(missing):
            unique, first, inverse = np.unique(hashes[missing], return_index=True, return_inverse=True)
            entries = len(self._ends) - 1 + np.arange(len(unique))
            self._add(words, missing[first])
            own[missing] = entries[inverse]
            into = slots[missing[first]]
            # Of two words for one slot either may go, but key and entry must be of the same.
            self._at[into] = entries
            self._keys[into] = hashes[missing[first[self._at[into] - entries[0]]]]
        sizes = np.diff(self._ends).take(own)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        index = np.arange(ends[-1]) + np.repeat(self._ends.take(own) - ends[:-1], sizes)
        return self._flat.take(index), np.diff(ends[words.rows])


def _sequences(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids between two ends each, in one array, and where each row starts."""
    starts = np.cumsum(counts + 2) - (counts + 2)
    found = np.full(int((counts + 2).sum()), end, np.int64)
    index = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts + 1, counts)
    found[index] = ids
    return found, starts


def held_out(column: str = "doc_id") -> Column:
    """Documents that are never learned from; those without doc_id are learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("long").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _id_type(size: int) -> np.dtype:
    """How the ids of ``size`` pieces are stored."""
    return np.dtype("<u2" if size <= 1 << 16 else "<i4")


def segmented(docs: DataFrame, path: str = PIECES) -> DataFrame:
    """(doc_id, held_out, text, ids) of every row: ids of the pieces of all words, none for a null text.

    Ids are bytes, as ``_id_type`` says: the rows of one text are one value for Spark, not one a piece.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(sent.value)
        kind = _id_type(segmenter.size)
        for batch in batches:
            for words in word_chunks(batch.column(2), lower=True, limit=_CHUNK):
                ids, number = segmenter.pieces(words, word_hashes(words))
                own = slice(words.first, words.last)
                offsets = (np.concatenate([[0], np.cumsum(number)]) * kind.itemsize).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [*(column[own] for column in batch.columns),
                     pa.BinaryArray.from_buffers(pa.binary(), len(number), [
                         None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind))])],
                    names=["doc_id", "held_out", "text", "ids"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, text string, ids binary")


def _lists(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of ``size`` pieces in a column of lists, or of bytes as ``segmented`` makes them, flat, and how
    many each row has."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(), pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    kind, column = _id_type(size), column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else [0]
    bytes_of = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return bytes_of.view(kind), np.diff(ends) // kind.itemsize


def _list_chunks(column: pa.Array, size: int, limit: int = _CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_lists`` of row ranges of about ``limit`` values."""
    ends = np.cumsum(_lists(column, size)[1])
    first = 0
    while first < len(column):
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + limit, side="right")), first + 1)
        yield _lists(column[first:last], size)
        first = last


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, with the sum of its numbers."""
    if len(parts) == 1:
        return parts[0]
    keys, n = (np.concatenate(part) for part in zip(*parts))
    order = np.argsort(keys)
    keys = keys.take(order)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
    return keys.take(first), np.add.reduceat(n.take(order), first) if len(first) else n


def _counted(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))],
        names=["kind", "key", "n"])


def counts(docs: DataFrame, size: int) -> DataFrame:
    """(kind, key, n) over all ``segmented`` rows: words by hash, pairs of pieces, and documents.

    ``size`` is the number of pieces and stands for the end of a text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Some chunks' counts of words and of pairs, not yet added up.
        waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        texts = empty = 0

        def added(kind: int) -> pa.RecordBatch:
            keys, n = _added(waiting[kind])
            waiting[kind] = []
            return _counted(kind, keys.view(np.int64), n)

        for batch in batches:
            for words in word_chunks(batch.column(0), lower=True, limit=_CHUNK):
                ids, number = _lists(batch.column(1)[words.first:words.last], size)
                sequence, _ = _sequences(ids, number, size)
                pairs = sequence[:-1] * _PAIR + sequence[1:]
                # An end after an end lies between two rows.
                pairs = pairs[~((sequence[:-1] == size) & (sequence[1:] == size))]
                texts, empty = texts + len(number), empty + int((number == 0).sum())
                for kind, keys in enumerate((word_hashes(words), pairs)):
                    waiting[kind].append(np.unique(keys, return_counts=True))
                    if sum(len(keys) for keys, _ in waiting[kind]) > _WAITING:
                        yield added(kind)
        for kind in (0, 1):
            if waiting[kind]:
                yield added(kind)
        yield _counted(2, np.zeros(1, np.int64), np.array([texts]))
        yield _counted(1, np.array([size * (_PAIR + 1)]), np.array([empty]))

    found = docs.select("text", "ids").mapInArrow(run, "kind int, key long, n long")
    return found.groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Trained:
    """What the scoring tasks need."""

    numbers: np.ndarray  # piece id -> number in the model, the last one is the end
    table: model.Bigrams
    weights: dict[str, np.ndarray]
    n_pieces: int
    rare: np.ndarray  # piece id -> log of its share of the rare pieces, 0 for others


def _vocabulary(pairs: DataFrame, size: int) -> tuple[np.ndarray, model.Bigrams, np.ndarray]:
    """Numbers of the most frequent pieces, the bigram table over them, and logs of the shares of the
    others among themselves."""
    after = F.pmod("key", F.lit(_PAIR)).alias("piece")
    # One row per piece of the vocabulary file at most.
    single = pairs.groupBy(after).agg(F.sum("n").alias("n")).where(F.col("piece") != size).orderBy(
        F.desc("n"), "piece").toArrow()
    top = single.column("piece").to_numpy()[:_KNOWN]
    numbers = np.full(size + 1, _RARE, np.int64)
    numbers[top] = 2 + np.arange(len(top))
    numbers[size] = _END
    times = np.ones(size + 1)
    times[single.column("piece").to_numpy()] += single.column("n").to_numpy()
    rare = np.where(numbers == _RARE, np.log(times / max(times[numbers == _RARE].sum(), 1.0)), 0.0)
    spark = pairs.sparkSession
    known = spark.createDataFrame(
        [(int(i), int(number)) for i, number in enumerate(numbers.tolist())], "piece long, number int")
    left = known.select(F.col("piece").alias("p1"), F.col("number").alias("a"))
    right = known.select(F.col("piece").alias("p2"), F.col("number").alias("b"))
    # One row per piece of the vocabulary file on either side, one per pair of known pieces after.
    found = pairs.select(F.floor(F.col("key") / _PAIR).alias("p1"), F.pmod("key", F.lit(_PAIR)).alias("p2"), "n").join(
        F.broadcast(left), "p1").join(F.broadcast(right), "p2").groupBy("a", "b").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((model.VOCABULARY, model.VOCABULARY))
    seen[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    return numbers, model.bigrams(seen), rare


def _windows(ids: np.ndarray, number: np.ndarray, numbers: np.ndarray, end: int, stride: int = model.STRIDE):
    """The model's sequences of a chunk and the windows over them."""
    sequence, starts = _sequences(ids, number, end)
    rows, begins = model.cut(number + 1, stride)
    return numbers[sequence], starts, rows, begins


def _rare_logs(ids: np.ndarray, number: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """What each row's rare pieces cost beyond their symbol."""
    return np.bincount(np.repeat(np.arange(len(number)), number), rare[ids], len(number))


def _round(docs: DataFrame, trained: Trained, number_of_round: int, every: int) -> dict[str, np.ndarray]:
    """Weights after one round of training in every partition, averaged by the places seen."""
    sent = docs.sparkSession.sparkContext.broadcast(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        trainer = model.Trainer(own.weights, own.table)
        pools: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def learn() -> None:
            parts = [np.concatenate(part) for part in zip(*pools)]
            order = np.random.default_rng(trainer.steps).permutation(len(parts[0]))
            parts = [part.take(order, axis=0) for part in parts]
            for first in range(0, len(order), 32):
                trainer.learn(*(part[first:first + 32] for part in parts))

        for batch in batches:
            for ids, number in _list_chunks(batch.column(0), own.n_pieces):
                # Adjoining windows: every place is learned from once, none is only context.
                sequence, starts, rows, begins = _windows(ids, number, own.numbers, own.n_pieces, model.WINDOW)
                chosen = np.flatnonzero(np.arange(len(rows)) % every == (7 * number_of_round + 3) % every)
                if len(chosen):
                    pools.append(model.filled(
                        sequence, starts, number + 1, rows[chosen], begins[chosen], model.WINDOW))
                    waiting += len(chosen)
                if waiting > 2048:
                    learn()
                    pools, waiting = [], 0
        if pools:
            learn()
        if trainer.seen:
            yield pa.RecordBatch.from_arrays([
                pa.array([model.flat(trainer.weights).astype(np.float64).tolist()], pa.list_(pa.float64())),
                pa.array([trainer.seen], pa.int64())], names=["weights", "seen"])

    rows = docs.select("ids").mapInArrow(run, "weights array<double>, seen long").select(
        F.posexplode("weights").alias("at", "weight"), "seen")
    # One row per weight, whatever the number of partitions.
    found = rows.groupBy("at").agg((F.sum(F.col("weight") * F.col("seen")) / F.sum("seen")).alias("weight")).orderBy(
        "at").toArrow()
    return model.shaped(found.column("weight").to_numpy()) if found.num_rows else trained.weights


def train(docs: DataFrame, counted: DataFrame, size: int, rounds: int = ROUNDS, every: int = EVERY) -> Trained:
    """A model of all ``segmented`` rows, whose counts are ``counted``, over ``size`` pieces."""
    numbers, table, rare = _vocabulary(counted.where("kind = 1"), size)
    trained = Trained(numbers, table, model.start(), size, rare)
    for number in range(rounds):
        trained.weights = _round(docs, trained, number, every)
    return trained


class Head:
    """Where words are among the sorted hashes ``keys``."""

    def __init__(self, keys: np.ndarray):
        self._keys, slots = keys, self._slots(keys)
        self._at = np.zeros(_SLOTS, np.int32)
        self._at[slots] = np.arange(len(keys))
        # Two of them on one slot are searched for.
        self._at[np.bincount(slots, minlength=_SLOTS) > 1] = -1

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64(_SLOTS - 1)).view(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number of a key for each hash, and whether that is its own."""
        if not len(self._keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        near = self._at.take(self._slots(hashes))
        several = np.flatnonzero(near < 0)
        near[several] = np.minimum(np.searchsorted(self._keys, hashes[several]), len(self._keys) - 1)
        return near, self._keys.take(near) == hashes


def _scored(docs: DataFrame, trained: Trained, head: np.ndarray, head_logs: np.ndarray) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast((trained, head, head_logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, head, logs = sent.value
        scorer, known_words = model.Scorer(trained.weights, trained.table), Head(head)
        row_number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for words in word_chunks(batch.column(2), lower=True, limit=_CHUNK):
                hashes = word_hashes(words)
                ids, number = _lists(batch.column(3)[words.first:words.last], trained.n_pieces)
                sequence, starts, rows, begins = _windows(ids, number, trained.numbers, trained.n_pieces)
                score = _rare_logs(ids, number, trained.rare)
                for first in range(0, len(rows), _BATCH):
                    some = slice(first, first + _BATCH)
                    pieces, target, scored = model.filled(sequence, starts, number + 1, rows[some], begins[some])
                    logs_of = scorer.windows(pieces, target, scored)
                    at = np.broadcast_to(rows[some][:, None], scored.shape)[scored]
                    score += np.bincount(at, logs_of, len(score))
                owner = np.repeat(np.arange(len(number)), words.counts())
                near, there = known_words.find(hashes)
                known = np.bincount(owner[there], minlength=len(number))
                base = np.bincount(owner[there], logs[near[there]], len(number)) if len(head) else np.zeros(len(number))
                tail = hashes[~there]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[~there], minlength=len(number)))])
                own = slice(words.first, words.last)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[own], batch.column(1)[own],
                    pa.array(row_number + np.arange(len(number))), pa.array(words.counts() + 1),
                    pa.array(known), pa.array(base), pa.array(score / np.log(10)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(tail.view(np.int64)))],
                    names=["doc_id", "held_out", "row", "n_tokens", "known", "base", "score", "tail"])
                row_number += len(number)

    return docs.select("doc_id", "held_out", "text", "ids").mapInArrow(
        run, "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, score double, "
             "tail array<long>")


def lm_scores(docs: DataFrame, rounds: int = ROUNDS, every: int = EVERY, head: int = HEAD, path: str = PIECES
              ) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Tokens are the words with A-Z in lower case and one end. ``base_score`` is the log10 probability by
    add-one word counts of the training documents, ``score`` that of the model. A null text counts as
    empty: its only token is the end. Repeated rows are counted and scored as often as they occur.
    Without training documents the model is nearly uniform over its pieces. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    size = sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
    with steps(spark, _ROWS):
        rows = hold(segmented(rows, path), "segmented")
        learned = rows.where(~F.col("held_out"))
        counted = hold(counts(learned, size), "counts")
        trained = train(learned, counted, size, rounds, every)
        words = counted.where("kind = 0").select(F.col("key").alias("word"), "n")
        n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        found = counted.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()
        ends = found[0]
        # The end is a distinct token too, once there is a document.
        tokens, kinds = n_words + ends, distinct + (ends > 0)
        top = words.orderBy(F.desc("n"), "word").limit(head).toArrow()
        keys, logs = top.column("word").to_numpy().view(np.uint64), np.log10(top.column("n").to_numpy() + 1.0)
        order = np.argsort(keys)
        scored = hold(_scored(rows, trained, keys[order], logs[order]), "scored")
        tail = scored.select("row", F.explode("tail").alias("word"))
        sums = tail.join(words, "word").groupBy("row").agg(
            F.sum(F.log10(F.col("n") + 1.0)).alias("more"), F.count(F.lit(1)).alias("also"))
        each = float(np.log10(tokens + kinds + 1.0))
        return hold(scored.drop("tail").join(sums, "row", "left").select(
            "doc_id", "held_out", "n_tokens",
            (F.col("known") + F.coalesce("also", F.lit(0)) + int(ends > 0)).alias("n_known"),
            F.lit(int(tokens)).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more", F.lit(0.0)) + float(np.log10(ends + 1.0))
             - F.col("n_tokens") * each).alias("base_score"), "score"), "lm", scratch=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
