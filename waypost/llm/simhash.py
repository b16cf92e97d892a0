"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Each text gets a 64-bit fingerprint of its word shingles. Two fingerprints that differ in at most
two bits have a value between them that differs from each in at most one. So every distinct
fingerprint emits itself and its 64 one-bit variants; fingerprints that meet on a variant are
within two bits of each other, and each is linked to the smallest that met there (at most 65 can
meet, so no group grows with the data). The links are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from waypost.llm.components import components
from waypost.llm.rows import first_of_each
from waypost.llm.words import Words, joined, word_chunks
from waypost.session import hold

SHINGLE = 3
SEED = 42
RADIUS = 2
_LONG = 256
#: Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LANES = np.uint64(0x0101010101010101)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(lane: np.ndarray, read: np.ndarray) -> np.ndarray:
    return _rotated(lane + read * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many byte ranges at once; ranges of 256 bytes and more go to the library."""
    sizes = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    four = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    with np.errstate(over="ignore"):
        found = np.full(len(sizes), np.uint64(seed) + _P5)
        at = starts.copy()
        wide = np.flatnonzero((sizes >= 32) & (sizes < _LONG))
        if len(wide):
            lanes = [np.full(len(wide), np.uint64(seed) + add) for add in
                     (_P1 + _P2, _P2, np.uint64(0), np.uint64(0) - _P1)]
            stripes = sizes[wide] // 32
            for step in range(int(stripes.max())):
                go = np.flatnonzero(stripes > step)
                read = starts[wide[go]] + 32 * step
                for k in range(4):
                    lanes[k][go] = _round(lanes[k][go], eight[read + 8 * k])
            whole = sum(_rotated(lane, bits) for lane, bits in zip(lanes, (1, 7, 12, 18)))
            for lane in lanes:
                whole = (whole ^ _round(np.zeros_like(lane), lane)) * _P1 + _P4
            found[wide] = whole
            at[wide] += 32 * stripes
        found += sizes.astype(np.uint64)
        left = ends - at
        left[sizes >= _LONG] = 0
        go = np.flatnonzero(left >= 8)
        while len(go):
            lane = found[go] ^ _round(np.zeros(len(go), np.uint64), eight[at[go]])
            found[go] = _rotated(lane, 27) * _P1 + _P4
            at[go] += 8
            left[go] -= 8
            go = go[left[go] >= 8]
        go = np.flatnonzero(left >= 4)
        lane = found[go] ^ (four[at[go]].astype(np.uint64) * _P1)
        found[go] = _rotated(lane, 23) * _P2 + _P3
        at[go] += 4
        left[go] -= 4
        go = np.flatnonzero(left > 0)
        while len(go):
            found[go] = _rotated(found[go] ^ (padded[at[go]].astype(np.uint64) * _P5), 11) * _P1
            at[go] += 1
            left[go] -= 1
            go = go[left[go] > 0]
        found = (found ^ (found >> np.uint64(33))) * _P2
        found = (found ^ (found >> np.uint64(29))) * _P3
        found ^= found >> np.uint64(32)
    for i in np.flatnonzero(sizes >= _LONG):
        found[i] = xxhash.xxh64_intdigest(data[starts[i]:ends[i]].tobytes(), seed)
    return found


def _majority(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Per row, the bits that more than half of its hashes hold; no hash gives zero.

    Bits are counted in byte lanes, eight at once, over runs of at most 255 hashes.
    """
    sizes = np.diff(rows)
    filled = np.flatnonzero(sizes)
    result = np.zeros(len(sizes), np.uint64)
    if not len(filled):
        return result
    runs = -(-sizes[filled] // 255)
    owner = np.repeat(np.arange(len(filled)), runs)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)
    begins = rows[:-1][filled][owner] + 255 * number
    firsts = np.flatnonzero(number == 0)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & _LANES, begins)
        counts = lanes.view(np.uint8).reshape(-1, 8).astype(np.int64)
        total = np.add.reduceat(counts, firsts, axis=0)
        over = (2 * total > sizes[filled][:, None]).astype(np.uint8)
        result[filled] |= np.ascontiguousarray(over).view("<u8").ravel() << np.uint64(bit)
    return result


def shingles_of(words: Words, size: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's shingles of ``size`` words, or of all words if fewer, and where rows begin."""
    data, starts, ends = joined(words)
    counts = words.counts()
    shingles = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    rows = np.concatenate([[0], np.cumsum(shingles)])
    first = (np.arange(rows[-1]) - np.repeat(rows[:-1], shingles)) + np.repeat(words.rows[:-1], shingles)
    last = first + np.repeat(np.minimum(counts, size), shingles) - 1
    return xxh64(data, starts[first], ends[last], seed), rows


def fingerprints_of(words: Words, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The SimHash of each row's words."""
    return _majority(*shingles_of(words, size, seed))


def fingerprints(docs: DataFrame, size: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, bits): the fingerprint of every whole text, as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprints_of(words, size) for words in word_chunks(batch.column(1), lower=True)]
            bits = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, bits long")


def linked(bits: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints of ``bits`` within two bits, enough to reach
    every fingerprint that a chain of such links reaches."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)),
                        lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    balls = bits.select("bits", F.explode(F.concat(
        F.array(F.col("bits")), F.transform(flips, lambda flip: F.col("bits").bitwiseXOR(flip)))).alias("variant"))
    met = balls.groupBy("variant").agg(F.collect_list("bits").alias("all")).where(F.size("all") > 1)
    return met.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a != b").where(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def simhash_groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    A null text counts as empty; empty texts have fingerprint zero and are linked like any other.
    A row without doc_id has a fingerprint, takes part in links and keeps the smallest doc_id it
    reaches (null if it reaches none). Repeated rows come back as often as they occur. Columns
    other than doc_id and text are ignored, whatever their names.
    """
    rows = hold(fingerprints(docs, size), "simhash")
    grouped = _grouped(rows)
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    member = grouped.join(smallest, "component").select("bits", "component_id")
    return rows.join(member, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(rows: DataFrame) -> DataFrame:
    """(bits, least, component) of every distinct fingerprint, with the smallest doc_id that has it."""
    distinct = hold(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "fingerprints")
    reached = components(linked(distinct.select("bits")))
    return hold(distinct.join(reached, distinct.bits == reached.node, "left").select(
        "bits", "least", F.coalesce("component", "bits").alias("component")), "groups")


def keep_one(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each group, that of the smallest doc_id, as ``first_of_each`` has it."""
    def grouped(stored: DataFrame) -> DataFrame:
        rows = hold(fingerprints(stored, size, key="row"), "simhash")
        return rows.join(_grouped(rows).select("bits", "component"), "bits").select(
            F.col("doc_id").alias("row"), "component")

    return first_of_each(docs, grouped)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
