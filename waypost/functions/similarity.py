"""Path similarity: token-set ratio over the Indel distance, for blocks of paths.

The length of the longest common subsequence follows the published bit-parallel recurrence
(Hyyrö 2004), evaluated with numpy for many pairs at once.
"""

from __future__ import annotations

import numpy as np

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def ratio(length_sum, common):
    """Normalised Indel similarity in percent; ``common`` is the subsequence length."""
    return 100.0 - 100.0 * (length_sum - 2.0 * common) / np.maximum(length_sum, 1)


def token_set_ratio(a: str, b: str) -> float:
    """Exact score of two paths of which at least one has blanks."""
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    only_left, only_right = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if shared and (not only_left or not only_right):
        return 100.0
    sect = len(" ".join(sorted(shared)))
    gap = 1 if sect else 0
    size_left, size_right = sect + gap + len(only_left), sect + gap + len(only_right)
    distance = len(only_left) + len(only_right) - 2 * common_length(only_left, only_right)
    best = 100.0 - 100.0 * distance / (size_left + size_right)
    if sect:
        for rest, size in ((only_left, size_left), (only_right, size_right)):
            best = max(best, 100.0 - 100.0 * (gap + len(rest)) / (sect + size))
    return best


def common_length(a: str, b: str) -> int:
    """Longest common subsequence of two strings."""
    marks: dict[str, int] = {}
    for at, char in enumerate(a):
        marks[char] = marks.get(char, 0) | 1 << at
    full = (1 << len(a)) - 1
    row = full
    for char in b:
        hit = row & marks.get(char, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


class Overlaps:
    """Multiset overlaps between two lists of code sequences, as products of 0/1 matrices.

    A column stands for the n-th occurrence of a code, so the scalar product of two rows is
    the size of the multiset intersection.
    """

    def __init__(self, left: tuple, right: tuple, n_left: int, n_right: int):
        (left_owner, left_key), (right_owner, right_key) = map(self._occurrences, (left, right))
        columns = np.intersect1d(left_key, right_key)
        self.left = self._matrix(left_owner, left_key, columns, n_left)
        self.right = self._matrix(right_owner, right_key, columns, n_right).T.copy()

    @staticmethod
    def _occurrences(sequence: tuple) -> tuple[np.ndarray, np.ndarray]:
        owner, codes = sequence
        order = np.lexsort((codes, owner))
        owner, codes = owner[order], codes[order].astype(np.int64)
        place = owner * (codes.max(initial=0) + 1) + codes
        nth = np.arange(len(place)) - np.searchsorted(place, place, "left")
        return owner, codes << 20 | nth

    @staticmethod
    def _matrix(owner, key, columns, n_rows) -> np.ndarray:
        at = np.searchsorted(columns, key)
        at[at == len(columns)] = 0
        held = columns[at] == key if len(columns) else np.zeros(len(key), dtype=bool)
        matrix = np.zeros((n_rows, len(columns)), dtype=np.float32)
        matrix[owner[held], at[held]] = 1.0
        return matrix

    def rows(self, part: slice) -> np.ndarray:
        return self.left[part] @ self.right


class PathBlock:
    """Two lists of strings, coded once so that any of their pairs can be compared fast."""

    PAIR_CODES = 512

    def __init__(self, left: list[str] | tuple, right: list[str] | tuple):
        """Strings, or their lengths and code points one after the other."""
        self.left_len, left_codes = left if isinstance(left, tuple) else self._codes(left)
        self.right_len, right_codes = right if isinstance(right, tuple) else self._codes(right)
        alphabet, coded = np.unique(np.concatenate([left_codes, right_codes]),
                                    return_inverse=True)
        self.blank = len(alphabet)
        left_codes, right_codes = coded[:len(left_codes)], coded[len(left_codes):]
        self._sides = ((self._positions(self.left_len)[0], left_codes),
                       (self._positions(self.right_len)[0], right_codes))
        self._shape = (len(self.left_len), len(self.right_len))
        # Position masks of the left strings, 64 positions per word.
        words = max(1, -(-int(self.left_len.max(initial=0)) // 64))
        owner, at = self._positions(self.left_len)
        self.masks = np.zeros((len(self.left_len), self.blank + 1, words), dtype=np.uint64)
        bits = np.left_shift(np.uint64(1), (at % 64).astype(np.uint64))
        np.bitwise_or.at(self.masks, (owner, left_codes, at // 64), bits)
        # Right strings as a padded matrix; the pad code has an empty mask.
        owner, at = self._positions(self.right_len)
        width = int(self.right_len.max(initial=0))
        self.right = np.full((len(self.right_len), width), self.blank, dtype=np.int32)
        self.right[owner, at] = right_codes

    def characters(self) -> Overlaps:
        """Characters two strings share in any order: at least their common subsequence."""
        return Overlaps(*self._sides, *self._shape)

    def bigrams(self) -> Overlaps:
        """Bigrams of the padded strings, hashed: merging codes only raises an overlap."""
        return Overlaps(*map(self._padded_pairs, self._sides), *self._shape)

    def _padded_pairs(self, side: tuple) -> tuple[np.ndarray, np.ndarray]:
        owner, codes = side
        n_rows = self._shape[0] if side is self._sides[0] else self._shape[1]
        edge = self.blank + 1
        # One pad before and one after every string.
        rows = np.concatenate([owner, np.arange(n_rows), np.arange(n_rows)])
        rank = np.concatenate([np.ones(len(owner)), np.zeros(n_rows), np.full(n_rows, 2.0)])
        chars = np.concatenate([codes, np.full(n_rows, edge), np.full(n_rows, edge + 1)])
        order = np.lexsort((np.arange(len(rows)), rank, rows))
        rows, chars = rows[order], chars[order].astype(np.int64)
        same = rows[1:] == rows[:-1]
        pairs = (chars[:-1] * 1_000_003 + chars[1:]) * 2_654_435_761 >> 12
        return rows[1:][same], pairs[same] % self.PAIR_CODES

    @staticmethod
    def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(text) for text in texts], dtype=np.int64)
        data = "".join(texts).encode("utf-32-le", "surrogatepass")
        return lengths, np.frombuffer(data, dtype=np.uint32)

    @staticmethod
    def _positions(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(lengths)), lengths)
        start = np.cumsum(lengths) - lengths
        return owner, np.arange(len(owner)) - np.repeat(start, lengths)

    def scores(self, i: np.ndarray, j: np.ndarray, batch: int = 65_536) -> np.ndarray:
        """Ratio of left string ``i[k]`` and right string ``j[k]`` for every ``k``."""
        return ratio(self.left_len[i] + self.right_len[j], self.common(i, j, batch))

    def common(self, i: np.ndarray, j: np.ndarray, batch: int = 65_536) -> np.ndarray:
        """Longest common subsequence of left string ``i[k]`` and right string ``j[k]``."""
        common = np.zeros(len(i), dtype=np.int64)
        by_length = np.argsort(self.right_len[j], kind="stable")
        for at in range(0, len(i), batch):
            part = by_length[at:at + batch]
            common[part] = self._common(i[part], j[part])
        return common

    def _common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        words = self.masks.shape[2]
        rows = [np.full(len(i), _ALL) for _ in range(words)]
        for column in range(int(self.right_len[j].max(initial=0))):
            codes = self.right[j, column]
            carry = np.zeros(len(i), dtype=np.uint64)
            for word in range(words):
                row = rows[word]
                hit = row & self.masks[i, codes, word]
                total = row + hit
                over = total < row
                total_in = total + carry
                carry = (over | (total_in < total)).astype(np.uint64)
                rows[word] = total_in | (row - hit)
        common = np.zeros(len(i), dtype=np.int64)
        for word in range(words):
            used = np.clip(self.left_len[i] - 64 * word, 0, 64).astype(np.uint64)
            keep = np.where(used == 64, _ALL,
                            np.left_shift(np.uint64(1), used % np.uint64(64)) - np.uint64(1))
            common += np.bitwise_count(~rows[word] & keep)
        return common


class WordBlock:
    """Two lists of strings as sets of blank-separated words, to score pairs that share a word.

    Words are numbered in their order, so the rest of a string, its words outside the common ones,
    is again a run of code points in the order of the joined string.
    """

    def __init__(self, left: list[str], right: list[str]):
        sets = [[sorted(set(path.split())) for path in side] for side in (left, right)]
        words = sorted({word for side in sets for own in side for word in own})
        number = {word: at for at, word in enumerate(words)}
        self._size, self._points = PathBlock._codes(words)
        self._start = np.cumsum(self._size) - self._size
        self._flat, self._count, self._first = [], [], []
        for side in sets:
            count = np.array([len(own) for own in side], dtype=np.int64)
            self._flat.append(np.array([number[word] for own in side for word in own], dtype=np.int64))
            self._count.append(count)
            self._first.append(np.cumsum(count) - count)

    def _entries(self, side: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pair and which word, for all words of each pair's string."""
        count = self._count[side][rows]
        pair = np.repeat(np.arange(len(rows)), count)
        within = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
        return pair, self._flat[side][self._first[side][rows][pair] + within]

    def _joined(self, pair: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and code points of the words of each pair joined by blanks."""
        size = self._size[word]
        lead = np.ones(len(pair), dtype=bool)
        lead[1:] = pair[1:] != pair[:-1]
        room = size + ~lead
        ends = np.cumsum(room)
        points = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint32)
        at = np.repeat(ends - size, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        points[at] = self._points[np.repeat(self._start[word], size) + at - np.repeat(ends - size, size)]
        return np.bincount(pair, weights=room, minlength=n).astype(np.int64), points

    def scores(self, i: np.ndarray, j: np.ndarray, least: float, batch: int = 16_384) -> np.ndarray:
        """Token-set ratio of left string ``i[k]`` and right string ``j[k]``; pairs that cannot reach
        ``least`` may come out below their score."""
        found = np.zeros(len(i))
        for at in range(0, len(i), batch):
            part = slice(at, at + batch)
            found[part] = self._some(i[part], j[part], least)
        return found

    def _some(self, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
        n, total = len(i), len(self._size)
        sides = [self._entries(0, i), self._entries(1, j)]
        shared = [np.isin(pair * total + word, other[0] * total + other[1])
                  for (pair, word), other in zip(sides, reversed(sides))]
        common = np.bincount(sides[0][0][shared[0]], minlength=n)
        sect = np.bincount(sides[0][0][shared[0]], self._size[sides[0][1][shared[0]]], n).astype(np.int64)
        sect += np.maximum(common - 1, 0)
        rests = [self._joined(pair[~same], word[~same], n) for (pair, word), same in zip(sides, shared)]
        (left, _), (right, _) = rests
        gap = (common > 0).astype(np.int64)
        whole = 2 * (sect + gap) + left + right
        full = (common > 0) & ((left == 0) | (right == 0))
        score = np.where(full, 100.0, 0.0)
        for rest in (left, right):
            alone = 100.0 - 100.0 * (gap + rest) / np.maximum(2 * sect + gap + rest, 1)
            score = np.where((common > 0) & ~full, np.maximum(score, alone), score)
        # The longest possible subsequence is the shorter rest.
        bound = 100.0 - 100.0 * np.abs(left - right) / np.maximum(whole, 1)
        # Two strings without words score nothing.
        open_ = np.flatnonzero(~full & (whole > 0) & (bound >= least) & (bound > score))
        if len(open_):
            kept = np.zeros(n, dtype=bool)
            kept[open_] = True
            cut = [(size[open_], points[np.repeat(kept, size)]) for size, points in rests]
            block, own = PathBlock(*cut), np.arange(len(open_))
            distance = (left + right)[open_] - 2 * block.common(own, own)
            score[open_] = np.maximum(score[open_], 100.0 - 100.0 * distance / np.maximum(whole[open_], 1))
        return score
