"""Words of whole Arrow text columns as numpy spans and hashes.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``. Everything works on the
UTF-8 buffer of a batch, a few megabytes at a time, so a long table costs no Python step per word
and a batch of long texts no more memory than its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
#: Bytes whose sums are taken at once.
_HASHED_BYTES = 1 << 15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


@dataclass
class Words:
    """Words of rows ``first`` to ``last`` of a batch.

    ``data`` holds the bytes, word ``w`` is ``data[starts[w]:ends[w]]`` and row ``r`` has words
    ``rows[r]`` to ``rows[r + 1]``.
    """

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.rows)


def byte_chunks(column: pa.Array, limit: int = CHUNK_BYTES
                ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes with their bytes and offsets; nulls count as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = (np.frombuffer(column.buffers()[2], dtype=np.uint8)
            if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8))
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def word_chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of every row of a text column, in row order."""
    for first, last, data, offsets in byte_chunks(column, limit):
        if lower:
            data = _LOWER[data]
        inside = ~_SPACE[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        filled = offsets[:-1] < offsets[1:]
        heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
        begins[heads] = inside[heads]
        stops[tails] = inside[tails]
        starts = np.flatnonzero(begins)
        yield Words(first, last, data, starts, np.flatnonzero(stops) + 1,
                    np.searchsorted(starts, offsets))


class _Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS: dict[int, _Powers] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _POWERS.setdefault(base, _Powers(base)).upto(n)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return values ^ (values >> np.uint64(33))


def word_hashes(words: Words, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums of a polynomial over the bytes.

    A hash does not depend on where the word lies, so the sums are over some words at a time.
    """
    found = np.empty(len(words.starts), np.uint64)
    edges = np.unique(np.concatenate([[0, len(found)], np.searchsorted(
        words.starts, np.arange(_HASHED_BYTES, len(words.data), _HASHED_BYTES))])).tolist()
    for first, last in zip(edges[:-1], edges[1:]):
        base = words.starts[first]
        starts, ends = words.starts[first:last] - base, words.ends[first:last] - base
        up, down = _powers(_BASES[salt & 1], int(ends[-1]) + 1)
        sums = np.zeros(len(up), np.uint64)
        with np.errstate(over="ignore"):
            np.add(words.data[base:words.ends[last - 1]], np.uint64(1 + salt), out=sums[1:])
            sums[1:] *= up[:-1]
            np.cumsum(sums, out=sums)
            own = sums.take(ends)
            own -= sums.take(starts)
            own *= down.take(starts)
            own += (ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
            found[first:last] = mixed(own)
    return found


def window_hashes(hashes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive word hashes (also across rows)."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    up, down = _powers(_BASES[salt & 1] ^ 0x5851F42D4C957F2C, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * up[:-1], out=sums[1:])
        return mixed((sums[size:] - sums[:-size]) * down[:len(hashes) - size + 1])


def joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words joined by one space: bytes, and where each word begins and ends in them.

    A space follows every word but the last of a row; rows adjoin.
    """
    keep = ~_SPACE[words.data]
    place = np.cumsum(keep, dtype=np.int64) - 1
    sizes = words.ends - words.starts
    gap = np.ones(len(sizes), np.int64)
    lasts = words.rows[1:][np.diff(words.rows) > 0] - 1
    gap[lasts] = 0
    before = np.concatenate([[0], np.cumsum(gap)[:-1]]) if len(gap) else np.zeros(0, np.int64)
    starts = place[words.starts] + before if len(gap) else np.zeros(0, np.int64)
    total = int(sizes.sum() + gap.sum())
    out = np.full(total, 32, np.uint8)
    inside = np.zeros(total + 1, np.int8)
    inside[starts] = 1
    inside[starts + sizes] -= 1
    out[np.cumsum(inside[:-1]) > 0] = words.data[keep]
    return out, starts, starts + sizes
