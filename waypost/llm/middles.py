"""Fill-in-middle transformation with a Fenwick tree over blocks of text.

A text is cut into blocks of a fixed number of bytes. A Fenwick tree over them holds the units that
end in each block and the code points that begin in it. The end of unit ``k`` is found by binary
lifting: the descent adds up whole subtrees that hold fewer than ``k`` ends and stops at the block
with the wanted one; only that block is searched. The same descent sums the code points passed, so a
cut costs a logarithm of the text's length and one block. Units are lines with their newline.

Cuts are drawn by hash from a row's doc_id, so they do not depend on partitions and reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from waypost.llm.words import byte_chunks

SEED = 7
RATE = 100       # percent of texts that are transformed
SPM_RATE = 50    # percent of those that begin with the suffix
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK = 1024     # bytes of a block
_FORM = "struct<n: long, form: string, prefix_chars: long, middle_chars: long, output: string>"


class Blocks:
    """Fenwick trees of the units and code points in the blocks of one text."""

    def __init__(self, data: np.ndarray, block: int = BLOCK):
        self._data, self._block, self._size = data, block, -(-len(data) // block)
        ends = data == 10
        if len(data):
            ends[-1] = True
        begins = (data & 0xC0) != 0x80
        starts = np.arange(0, len(data), block)
        self._units, self._points = (self._tree(np.add.reduceat(flags, starts, dtype=np.int64).tolist())
                                     if len(starts) else [0] for flags in (ends, begins))
        self._ends, self._begins = ends, begins
        self.n = int(ends.sum())

    @staticmethod
    def _tree(counts: list[int]) -> list[int]:
        """Node ``i`` sums the ``i & -i`` blocks that end with block ``i``, from 1."""
        tree = [0, *counts]
        for i in range(1, len(tree)):
            above = i + (i & -i)
            if above < len(tree):
                tree[above] += tree[i]
        return tree

    def cut(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if k <= 0:
            return 0, 0
        block, units, points = 0, 0, 0
        step = 1 << self._size.bit_length()
        while step:
            ahead = block + step
            if ahead <= self._size and units + self._units[ahead] < k:
                block, units, points = ahead, units + self._units[ahead], points + self._points[ahead]
            step >>= 1
        start = block * self._block
        within = np.flatnonzero(self._ends[start:start + self._block])
        stop = start + int(within[k - units - 1]) + 1
        return stop, points + int(np.count_nonzero(self._begins[start:stop]))


def filled(text: bytes, first: int, second: int, spm: bool, data: np.ndarray | None = None,
           block: int = BLOCK) -> tuple[int, int, int, bytes]:
    """Units of ``text``, code points of prefix and middle, and the transformed text; ``first`` and
    ``second`` are drawn numbers, each cutting after that many units, modulo one more than there are."""
    blocks = Blocks(np.frombuffer(text, np.uint8) if data is None else data, block)
    cuts = sorted((first % (blocks.n + 1), second % (blocks.n + 1)))
    (start, prefix), (stop, both) = blocks.cut(cuts[0]), blocks.cut(cuts[1])
    parts = text[:start], text[start:stop], text[stop:]
    out = (b"".join((SUFFIX, parts[2], PREFIX, parts[0], MIDDLE, parts[1])) if spm else
           b"".join((PREFIX, parts[0], SUFFIX, parts[2], MIDDLE, parts[1])))
    return blocks.n, prefix, both - prefix, out


def _units(data: np.ndarray) -> int:
    return int(np.count_nonzero(data == 10)) + int(len(data) > 0 and data[-1] != 10)


def transformed(text: Column, draws: Column, rate: int = RATE, spm_rate: int = SPM_RATE) -> Column:
    """A struct of n, form, prefix_chars, middle_chars and output of each whole text (null: empty);
    ``draws`` is an array of four longs."""
    def run(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        drawn = numbers.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
        found = []
        for first, _, data, offsets in byte_chunks(texts):
            for row, (start, stop) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist()), first):
                own = data[start:stop]
                text = own.tobytes()
                one, two, three, four = map(int, drawn[row])
                if not text or three % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    found.append((_units(own), "plain", None, None, text))
                else:
                    spm = four % 100 < spm_rate
                    n, prefix, middle, out = filled(text, one, two, spm, own)
                    found.append((n, "spm" if spm else "psm", prefix, middle, out))
        columns = list(zip(*found)) if found else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays(
            [pa.array(column, pa.binary()).cast(kind) if at == 4 else pa.array(column, kind)
             for at, (column, kind) in enumerate(zip(columns, kinds))],
            ["n", "form", "prefix_chars", "middle_chars", "output"])

    return F.arrow_udf(run, _FORM)(text, draws)


def draws(key: Column, seed: int = SEED) -> Column:
    """Four numbers of 32 bits from ``seed`` and ``key``; a null key counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. Marks do not occur in transformed texts, so the first
    of each kind is the one that was put in."""
    def between(left: bytes, right: bytes) -> Column:
        rest = F.substring_index(output, left.decode(), -1)
        return F.substring_index(rest, right.decode(), 1)

    middle = F.substring_index(output, MIDDLE.decode(), -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
                   key: str = "doc_id") -> DataFrame:
    """Every row and column of ``docs`` with n, form, prefix_chars, middle_chars and output (replacing
    columns named so).

    n counts the lines of the whole text. The form is plain, the text as it is, if the text is null
    or empty, if it holds a mark, or for the part of texts beyond ``rate`` percent; prefix_chars and
    middle_chars are null then. Else it is spm for ``spm_rate`` percent of texts and psm for the
    others. Draws follow ``key`` alone: rows that share it are cut by the same numbers, repeated
    rows come out equal, and rows without it are drawn as one key. An empty table gives an empty one.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    own = [name for name in docs.columns if name not in added]
    made = transformed(F.col("text").cast("string"), draws(F.col(key), seed), rate, spm_rate)
    rows = docs.select(*[F.col(name) for name in own], made.alias("_made"))
    return rows.select(*[F.col(name) for name in own], *[F.col("_made")[name].alias(name) for name in added])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
