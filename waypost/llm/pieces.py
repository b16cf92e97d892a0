"""SentencePiece encoding and decoding with a unigram model.

The pieces of a vocabulary file stand in a double-array trie. Viterbi finds the segmentation of
the greatest sum of log scores; characters without a piece become byte pieces. White space is the
marker U+2581, one is put before the text, and decoding turns markers back and takes it off again.

No piece holds a marker after another character, so the best segmentation of a text is that of its
parts from marker to marker. Equal parts are segmented once per batch table, many at a time.

The file at hand ranks its pieces by merges and has no log scores, so a piece's score is that of
Zipf's law for its rank: -log(rank + 2).
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁".encode()
#: Fixed values of the file format: kinds of pieces, and the penalty of an unknown character.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_PENALTY = 10.0
#: Parts in a worker's table before it starts anew, and the longest part that is segmented in bulk.
TABLE = 400_000
_BULK = 96
#: Bytes of text, or ids, that a worker turns at once; it holds a batch of rows, but not what becomes of all of them.
CHUNK = 1 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def read_pieces(path: str = MODEL) -> list[tuple[bytes, float, int]]:
    """(piece, score, kind) of a model file, in order of id."""
    with open(path, "rb") as file:
        data = file.read()
    found = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            found.append((own.get(1, b""), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
    return found


def zipf(pieces: list[tuple[bytes, float, int]]) -> list[tuple[bytes, float, int]]:
    """The pieces with log scores by Zipf's law over the order of their scores in the file."""
    order = sorted((i for i, piece in enumerate(pieces) if piece[2] == NORMAL), key=lambda i: (-pieces[i][1], i))
    scores = {i: float(np.float32(-np.log(rank + 2.0))) for rank, i in enumerate(order)}
    return [(piece, scores.get(i, 0.0), kind) for i, (piece, _, kind) in enumerate(pieces)]


@dataclass
class Vocabulary:
    """Pieces in a double array: the child of state ``s`` by byte ``c`` is ``base[s] + c + 1`` if
    ``check`` there is ``s``; ``piece`` is the id that ends in a state, or -1."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    scores: np.ndarray
    unknown: np.float32
    bytes_at: np.ndarray
    shown: list[bytes]
    apart: bool


def vocabulary(pieces: list[tuple[bytes, float, int]]) -> Vocabulary:
    """The double array of the normal pieces, with byte ids and what each id decodes to."""
    children: list[dict[int, int]] = [{}]
    ends: list[int] = [-1]
    for number, (text, _, kind) in enumerate(pieces):
        if kind not in (NORMAL, USER, UNUSED) or not text:
            continue
        node = 0
        for byte in text:
            below = children[node].get(byte)
            if below is None:
                below = children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = below
        ends[node] = number
    # Bases are dealt breadth first. Low cells, which high bytes can't use, and 300 past the last stay free.
    size = 4 * len(children) + 8192
    base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
    piece, used = np.full(size, -1, np.int32), np.zeros(size, bool)
    used[:300], check[0], free, dense = True, 0, 300, 300
    queue, states = [0], {0: 0}
    for node in queue:
        below = children[node]
        if not below:
            continue
        codes = np.array(sorted(below))
        while used[free]:
            free += 1
        at = max(0, (free if len(codes) == 1 else max(free, dense)) - codes[0] - 1)
        while True:
            taken = np.zeros(1024, bool)
            for code in codes:
                taken |= used[at + code + 1:at + code + 1025]
            if not taken.all():
                at += int(np.argmin(taken))
                break
            at += 1024
        dense = max(dense, at) if len(codes) > 1 else dense
        state = states[node]
        base[state] = at
        used[at + codes + 1] = True
        check[at + codes + 1] = state
        for code in codes.tolist():
            piece[at + code + 1] = ends[below[code]]
            states[below[code]] = at + code + 1
            queue.append(below[code])
    size = int(np.flatnonzero(used)[-1]) + 300
    base, check, piece = base[:size], check[:size], piece[:size]
    scores = np.array([score for _, score, _ in pieces], np.float32)
    normal = [i for i, x in enumerate(pieces) if x[2] == NORMAL]
    bytes_at = np.full(256, -1, np.int32)
    shown = []
    for i, (text, _, kind) in enumerate(pieces):
        if kind == BYTE:
            bytes_at[int(text[3:5], 16)] = i
            shown.append(bytes([int(text[3:5], 16)]))
        elif kind == CONTROL:
            shown.append(b"")
        elif kind == UNKNOWN:
            shown.append(" ⁇ ".encode())
        else:
            shown.append(text.replace(MARK, b" "))
    if (bytes_at < 0).any():
        bytes_at[:] = next(i for i, x in enumerate(pieces) if x[2] == UNKNOWN)
    apart = not any(b" " in text.replace(MARK, b" ").lstrip(b" ") for text, _, _ in pieces)
    return Vocabulary(base, check, piece, scores, np.float32(scores[normal].min() - np.float32(_PENALTY)),
                      bytes_at, shown, apart)


def _char_size(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


def segment(voc: Vocabulary, text: bytes) -> list[int]:
    """Piece ids of one part, byte by byte."""
    n = len(text)
    best, back, ids = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = np.float32(0)
    at = 0
    while at < n:
        width = min(_char_size(text[at]), n - at)
        here, state, single = best[at], 0, False
        for end in range(at, n):
            below = int(voc.base[state]) + text[end] + 1
            if voc.check[below] != state or below == 0:
                break
            state = below
            number = int(voc.piece[state])
            if number >= 0:
                total = here + voc.scores[number]
                if best[end + 1] is None or total > best[end + 1]:
                    best[end + 1], back[end + 1], ids[end + 1] = total, at, number
                single |= end + 1 - at == width
        if not single:
            total = here + voc.unknown
            if best[at + width] is None or total > best[at + width]:
                best[at + width], back[at + width], ids[at + width] = total, at, -1
        at += width
    found: list[int] = []
    at = n
    while at:
        found += [ids[at]] if ids[at] >= 0 else [int(voc.bytes_at[b]) for b in reversed(text[back[at]:at])]
        at = back[at]
    return found[::-1]


def segment_many(voc: Vocabulary, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of parts of one length, flat, and the number for each part. All parts move through
    the trie, and back along their best paths, together."""
    n, m = len(parts[0]), len(parts)
    text = np.frombuffer(b"".join(parts), np.uint8).reshape(m, n)
    best = np.full((n + 1, m), -np.inf, np.float32)
    back, ids = np.zeros((n + 1, m), np.int32), np.full((n + 1, m), -1, np.int32)
    best[0] = 0
    sizes = np.ones(256, np.int32)
    sizes[0xC0:0xE0], sizes[0xE0:0xF0], sizes[0xF0:] = 2, 3, 4
    for at in range(n):
        who = np.flatnonzero((text[:, at] & 0xC0) != 0x80) if at else np.arange(m)
        if not len(who):
            continue
        width = np.minimum(sizes[text[who, at]], n - at)
        here, single = best[at, who], np.zeros(len(who), bool)
        alive, state = np.arange(len(who)), np.zeros(len(who), np.int32)
        for end in range(at, n):
            below = voc.base[state] + text[who[alive], end] + 1
            fits = voc.check[below] == state
            alive, state = alive[fits], below[fits]
            if not len(alive):
                break
            number = voc.piece[state]
            ending = np.flatnonzero(number >= 0)
            if len(ending):
                own = alive[ending]
                total = here[own] + voc.scores[number[ending]]
                better = total > best[end + 1, who[own]]
                chosen = who[own[better]]
                best[end + 1, chosen], back[end + 1, chosen] = total[better], at
                ids[end + 1, chosen] = number[ending][better]
                single[own] |= width[own] == end + 1 - at
        lost = np.flatnonzero(~single)
        if len(lost):
            to, rows = at + width[lost], who[lost]
            total = here[lost] + voc.unknown
            better = total > best[to, rows]
            best[to[better], rows[better]] = total[better]
            back[to[better], rows[better]], ids[to[better], rows[better]] = at, -1
    # Back from the end; a row of ``found`` fills from the right.
    found, filled, at = np.full((m, n), -1, np.int32), np.zeros(m, np.int64), np.full(m, n)
    who = np.arange(m)
    while len(who):
        number, start, end = ids[at[who], who], back[at[who], who], at[who]
        known = number >= 0
        rows = who[known]
        found[rows, n - 1 - filled[rows]] = number[known]
        filled[rows] += 1
        rows, first, last = who[~known], start[~known], end[~known]
        for _ in range(4):
            more = last > first
            rows, first, last = rows[more], first[more], last[more] - 1
            found[rows, n - 1 - filled[rows]] = voc.bytes_at[text[rows, last]]
            filled[rows] += 1
        at[who] = start
        who = who[start > 0]
    return found[found >= 0], filled


def _parts(column: pa.Array, sizes: pa.Array) -> Iterator[pa.Array]:
    """Row ranges of a column, each of about ``CHUNK`` bytes or ids by ``sizes``."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CHUNK, side="right"))
        yield column[first:max(last, first + 1)]
        first = max(last, first + 1)


class Encoder:
    """Segments texts; keeps the parts seen in a table of bounded size."""

    def __init__(self, voc: Vocabulary):
        self.voc = voc
        self._part = re.compile(rb" *[^ ]+| +") if voc.apart else re.compile(rb"(?s).+")
        self._reset()

    def _reset(self) -> None:
        self._number: dict[bytes, int] = {}
        self._flat, self._ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self, parts: set[bytes]) -> None:
        by_size: dict[int, list[bytes]] = {}
        for part in parts:
            by_size.setdefault(len(part) + 2 * part.count(b" "), []).append(part)
        flat, sizes = [self._flat], []
        for size, own in by_size.items():
            marked = [part.replace(b" ", MARK) for part in own]
            for first in range(0, len(own), 8192):
                some = marked[first:first + 8192]
                if size <= _BULK:
                    ids, counts = segment_many(self.voc, some)
                else:
                    each = [segment(self.voc, part) for part in some]
                    ids, counts = np.array(sum(each, []), np.int32), np.array([len(x) for x in each])
                flat.append(ids)
                sizes.append(counts)
            self._number.update(zip(own, range(len(self._number), len(self._number) + len(own))))
        self._flat = np.concatenate(flat)
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the number for each text."""
        parts = [self._part.findall(b" " + text) if text else [] for text in texts]
        flat = [part for own in parts for part in own]
        if len(self._number) > TABLE:
            self._reset()
        missing = set(flat) - self._number.keys()
        if missing:
            self._learn(missing)
        rows = np.fromiter(map(self._number.__getitem__, flat), np.int64, len(flat))
        lengths = self._ends[rows + 1] - self._ends[rows]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        index = np.arange(ends[-1]) + np.repeat(self._ends[rows] - ends[:-1], lengths)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        return self._flat[index], np.diff(ends[bounds])

    def arrays(self, column: pa.Array) -> Iterator[pa.Array]:
        """Lists of ids of all rows of a text column, a few rows at a time."""
        for some in _parts(column, pc.binary_length(column)):
            ids, number = self.encode([value.as_buffer().to_pybytes() for value in pc.fill_null(some, "")])
            offsets = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


class Decoder:
    """Turns ids back into text."""

    def __init__(self, voc: Vocabulary):
        self._bytes = np.frombuffer(b"".join(voc.shown), np.uint8)
        self._sizes = np.array([len(x) for x in voc.shown], np.int64)
        self._starts = np.cumsum(self._sizes) - self._sizes

    def decode(self, ids: np.ndarray) -> str:
        """The text of one list of ids; bytes that are no UTF-8 become replacement characters."""
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._starts[ids] - (ends - sizes), sizes)
        found = self._bytes[index].tobytes()
        return (found[1:] if found[:1] == b" " else found).decode("utf-8", "replace")

    def arrays(self, column: pa.Array) -> Iterator[pa.Array]:
        """Texts of all rows of a column of id lists, a few rows at a time."""
        for some in _parts(column, pc.list_value_length(column)):
            flat, offsets = some.values.to_numpy(zero_copy_only=False), some.offsets.to_numpy()
            yield pa.array([self.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())


def encoded(spark: SparkSession, voc: Vocabulary, text: Column) -> Column:
    """array<int> of piece ids of each text; null and empty texts have none."""
    sent = spark.sparkContext.broadcast(voc)
    own: dict[str, Encoder] = {}

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if "encoder" not in own:
            own["encoder"] = Encoder(sent.value)
        for column in columns:
            yield from own["encoder"].arrays(column)

    return F.arrow_udf(run, "array<int>")(text)


def decoded(spark: SparkSession, voc: Vocabulary, ids: Column) -> Column:
    """The text of each array of piece ids."""
    sent = spark.sparkContext.broadcast(voc)
    own: dict[str, Decoder] = {}

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if "decoder" not in own:
            own["decoder"] = Decoder(sent.value)
        for column in columns:
            yield from own["decoder"].arrays(column)

    return F.arrow_udf(run, "string")(ids)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """All rows and columns of ``docs`` with ids (replacing a column of that name).

    Null and empty texts have no ids. Rows are independent, so repeated rows give equal ids.
    """
    voc = vocabulary(zipf(read_pieces(path)))
    rows = docs.drop("ids") if "ids" in docs.columns else docs
    return rows.select("*", encoded(docs.sparkSession, voc, F.col("text").cast("string")).alias("ids"))


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """All rows and columns of ``rows`` with decoded, the text of ids; null ids give empty text."""
    voc = vocabulary(zipf(read_pieces(path)))
    kept = rows.drop("decoded") if "decoded" in rows.columns else rows
    filled = F.coalesce("ids", F.array().cast("array<int>"))
    return kept.select("*", decoded(rows.sparkSession, voc, filled).alias("decoded"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of encoding and decoding whole ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decode(encode(docs)).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"),
        F.md5("decoded").alias("decoded_md5"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
