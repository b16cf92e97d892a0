"""A small causal self-attention language model in numpy.

One head of attention looks back over a window of pieces and corrects a bigram table. The next
piece is predicted in two steps, its class and then the member of the class, so that a prediction
costs twice the square root of the vocabulary. Forward and backward pass are written out; windows
of many texts run through them as one batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Pieces in a window, and how far windows move on: later windows score their last ``STRIDE`` pieces.
WINDOW, STRIDE = 48, 32
WIDTH = 16
#: Classes, and members of each.
CLASSES = 32
VOCABULARY = CLASSES * CLASSES
_NAMES = ("embed", "place", "wq", "wk", "wv", "uc", "um")


@dataclass
class Bigrams:
    """Log probabilities of a next piece's class, and of the member within it, after each piece."""

    classes: np.ndarray  # (vocabulary, classes)
    members: np.ndarray  # (vocabulary, classes, members)


def bigrams(counts: np.ndarray, trust: float = 30.0) -> Bigrams:
    """Bigram counts mixed with ``trust`` pseudo-counts that follow the frequencies of single pieces."""
    single = counts.sum(axis=0) + 0.5
    mixed = counts + trust * single / single.sum()
    mixed = (mixed / mixed.sum(axis=1, keepdims=True)).reshape(VOCABULARY, CLASSES, -1)
    classes = mixed.sum(axis=2)
    return Bigrams(np.log(classes).astype(np.float32), np.log(mixed / classes[:, :, None]).astype(np.float32))


def start(seed: int = 42) -> dict[str, np.ndarray]:
    """Weights to begin with: attention is random, corrections are zero."""
    rng = np.random.default_rng(seed)
    members = VOCABULARY // CLASSES
    return {name: value.astype(np.float32) for name, value in {
        "embed": rng.standard_normal((VOCABULARY, WIDTH)) * 0.5,
        "place": rng.standard_normal((WINDOW, WIDTH)) * 0.1,
        "wq": rng.standard_normal((WIDTH, WIDTH)) / WIDTH ** 0.5,
        "wk": rng.standard_normal((WIDTH, WIDTH)) / WIDTH ** 0.5,
        "wv": rng.standard_normal((WIDTH, WIDTH)) / WIDTH ** 0.5,
        "uc": np.zeros((WIDTH, CLASSES)), "um": np.zeros((CLASSES, WIDTH, members))}.items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in _NAMES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for name, like in start().items():
        found[name] = np.asarray(values[at:at + like.size], np.float32).reshape(like.shape)
        at += like.size
    return found


_LATER = np.triu(np.full((WINDOW, WINDOW), -1e30, np.float32), 1)
_EARLIER = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Where the weights of each piece lie.
_CELLS = np.arange(VOCABULARY * WIDTH).reshape(VOCABULARY, WIDTH)
#: Sums of a row's exponentials between these have lost nothing to overflow or underflow.
_MILD = (1e-10, 1e15)


def _attend(q: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention of the last places, as many as ``q`` has, to themselves and earlier ones, not yet
    divided by its sum, and one by the sum."""
    first, k = WINDOW - q.shape[1], k.transpose(0, 2, 1)
    scores = q @ k
    ones = np.ones((WINDOW, 1), scores.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(scores, out=scores)
        scores *= _EARLIER[first:]
        sums = scores.reshape(-1, WINDOW) @ ones
        mild = not sums.size or (_MILD[0] <= sums.min() and sums.max() <= _MILD[1])
    if not mild:
        np.matmul(q, k, out=scores)
        scores += _LATER[first:]
        # The largest of each row becomes zero, so no row is all underflow.
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        sums = scores.reshape(-1, WINDOW) @ ones
    return scores, 1 / sums.reshape(*q.shape[:2], 1)


def _by_class(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of targets by class, and where each class begins and ends in it."""
    classes = (target // (VOCABULARY // CLASSES)).astype(np.uint8)
    order = np.argsort(classes, kind="stable")
    return order, np.searchsorted(classes[order], np.arange(CLASSES + 1))


def _exponentials(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log softmax at flat places, one in a row, and the sums of the exponentials, which overwrite
    ``logits``."""
    found = logits.ravel().take(at)
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    return found - np.log(sums), sums


def _logits(table: Bigrams, uc: np.ndarray, um: np.ndarray, seen: np.ndarray, before: np.ndarray,
            target: np.ndarray, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Logits of the classes, and below them of the members of each target's class, for rows in the
    order of classes, and where the targets are in both, flat."""
    members, n = VOCABULARY // CLASSES, len(target)
    classes = target // members
    logits = np.empty((2 * n, members), uc.dtype)
    np.dot(seen, uc, out=logits[:n])
    for c, (first, last) in enumerate(zip(bounds[:-1], bounds[1:])):
        if first < last:
            np.dot(seen[first:last], um[c], out=logits[n + first:n + last])
    logits[:n] += table.classes.take(before, axis=0)
    logits[n:] += table.members.reshape(-1, members).take(before * CLASSES + classes, axis=0)
    at = np.arange(0, logits.size, members)
    at[:n] += classes
    at[n:] += target
    at[n:] -= classes * members
    return logits, at


class Scorer:
    """Log probabilities of next pieces; keeps what depends on single pieces in tables."""

    def __init__(self, weights: dict[str, np.ndarray], table: Bigrams):
        self.table, self.uc, self.um = table, weights["uc"], weights["um"]
        scaled = weights["wq"] * weights["wq"].dtype.type(WIDTH ** -0.5)
        self.parts = [(weights["embed"] @ own, weights["place"] @ own)
                      for own in (scaled, weights["wk"], weights["wv"])]

    def _heads(self, pieces: np.ndarray, places: int) -> np.ndarray:
        """What the last ``places`` of each window gather from the window."""
        (q, q_place), (k, k_place), (v, v_place) = self.parts
        asked, keys = q.take(pieces[:, WINDOW - places:], axis=0), k.take(pieces, axis=0)
        asked += q_place[WINDOW - places:]
        keys += k_place
        values = v.take(pieces, axis=0)
        values += v_place
        found, shares = _attend(asked, keys)
        found = found @ values
        found *= shares
        return found

    def windows(self, pieces: np.ndarray, target: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural log probabilities at the places of (n, WINDOW) windows where ``scored``."""
        late = ~scored[:, :WINDOW - STRIDE].any(axis=1)
        whole = np.flatnonzero(~late)
        seen = np.empty((int(scored.sum()), WIDTH), self.uc.dtype)
        of_late = np.repeat(late, scored.sum(axis=1))
        if late.any():
            seen[of_late] = self._heads(pieces[late], STRIDE)[scored[late, WINDOW - STRIDE:]]
        if len(whole):
            seen[~of_late] = self._heads(pieces[whole], WINDOW)[scored[whole]]
        before, target = pieces[scored], target[scored]
        order, bounds = _by_class(target)
        seen, before, target = seen.take(order, axis=0), before.take(order), target.take(order)
        logs, _ = _exponentials(*_logits(self.table, self.uc, self.um, seen, before, target, bounds.tolist()))
        found = logs[:len(target)] + logs[len(target):]
        result = np.empty_like(found)
        result[order] = found
        return result


def loss_and_slopes(weights: dict[str, np.ndarray], table: Bigrams, pieces: np.ndarray, target: np.ndarray,
                    scored: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log probability of the scored places and its derivatives."""
    root, n_windows = weights["wq"].dtype.type(WIDTH ** -0.5), len(pieces)
    x = weights["embed"].take(pieces.ravel(), axis=0)
    x.reshape(n_windows, -1)[:] += weights["place"].ravel()
    heads_of = np.concatenate([weights["wq"] * root, weights["wk"], weights["wv"]], axis=1)
    joint = x.reshape(n_windows, WINDOW, WIDTH) @ heads_of
    q, k, v = (joint[:, :, first:first + WIDTH] for first in range(0, 3 * WIDTH, WIDTH))
    # Not divided by its sums; what it gathers and the slopes of that are, which are narrower.
    attention, shares = _attend(q, k)
    heads = attention @ v
    heads *= shares
    at = np.flatnonzero(scored)
    order, bounds = _by_class(target.take(at))
    at, ends = at.take(order), bounds.tolist()
    seen, before, after = heads.reshape(-1, WIDTH).take(at, axis=0), pieces.take(at), target.take(at)
    n = len(at)
    wrong, right = _logits(table, weights["uc"], weights["um"], seen, before, after, ends)
    logs, sums = _exponentials(wrong, right)
    sums *= n
    wrong *= (1 / sums)[:, None]
    wrong.ravel()[right] -= wrong.dtype.type(1 / max(n, 1))
    slopes = {"uc": seen.T @ wrong[:n], "um": np.zeros_like(weights["um"])}
    back = wrong[:n] @ weights["uc"].T.copy()
    more, wrong, um_back = np.empty_like(back), wrong[n:], weights["um"].transpose(0, 2, 1).copy()
    for c, (first, last) in enumerate(zip(ends[:-1], ends[1:])):
        if first < last:
            own = wrong[first:last]
            np.dot(seen[first:last].T, own, out=slopes["um"][c])
            np.dot(own, um_back[c], out=more[first:last])
    back += more
    down = np.zeros_like(heads)
    down.reshape(-1, WIDTH)[at] = back
    down *= shares
    # The attention-weighted mean of its slopes is what a place gathers times the slope of that.
    mean = np.einsum("wph,wph->wp", down, heads)[:, :, None]
    ds = down @ v.transpose(0, 2, 1)
    ds -= mean
    ds *= attention
    steep = np.empty_like(joint)
    np.matmul(ds, k, out=steep[:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=steep[:, :, WIDTH:2 * WIDTH])
    np.matmul(attention.transpose(0, 2, 1), down, out=steep[:, :, 2 * WIDTH:])
    of_heads = (x.reshape(n_windows, WINDOW, WIDTH).transpose(0, 2, 1) @ steep).sum(axis=0)
    # The root is in q already, but not in its weights.
    of_heads[:, :WIDTH] *= root
    for name, first in (("wq", 0), ("wk", WIDTH), ("wv", 2 * WIDTH)):
        slopes[name] = of_heads[:, first:first + WIDTH]
    dx = steep @ heads_of.T.copy()
    slopes["place"] = dx.sum(axis=0)
    cell = _CELLS.take(pieces.ravel(), axis=0)
    slopes["embed"] = np.bincount(cell.ravel(), dx.ravel(), VOCABULARY * WIDTH).astype(x.dtype).reshape(-1, WIDTH)
    return -float(logs.sum()) / max(n, 1), slopes


class Trainer:
    """Adam from given weights, which lie one after another, as do its means."""

    def __init__(self, weights: dict[str, np.ndarray], table: Bigrams, rate: float = 0.01):
        self._flat = flat(weights).astype(np.float32)
        self.weights = shaped(self._flat)  # views of it
        self.table, self.rate, self.steps, self.seen = table, rate, 0, 0
        # Means of the slopes and of their squares, ten and a hundred times as large.
        self._mean, self._square = np.zeros_like(self._flat), np.zeros_like(self._flat)

    def learn(self, pieces: np.ndarray, target: np.ndarray, scored: np.ndarray) -> float:
        """One step on a batch of windows; returns its loss before the step."""
        if not scored.any():
            return 0.0
        loss, slopes = loss_and_slopes(self.weights, self.table, pieces, target, scored)
        self.steps += 1
        self.seen += int(scored.sum())
        slope = flat(slopes)
        self._mean *= 0.9
        self._mean += slope
        slope *= slope
        self._square *= 0.99
        self._square += slope
        part = (1 - 0.9 ** self.steps) * 10 / self.rate
        np.sqrt(self._square, out=slope)
        slope *= part / (100 * (1 - 0.99 ** self.steps)) ** 0.5
        slope += 1e-8 * part
        np.divide(self._mean, slope, out=slope)
        self._flat -= slope
        return loss


def cut(lengths: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(row, begin): overlapping windows over rows with so many places to score, each place once. The
    first window of a row scores all its places, a later one those past the first WINDOW - ``stride``.
    With a stride of WINDOW they adjoin."""
    number = np.where(lengths <= WINDOW, 1, 1 - (WINDOW - lengths) // stride)
    number = np.where(lengths > 0, number, 0)
    rows = np.repeat(np.arange(len(lengths)), number)
    return rows, stride * (np.arange(len(rows)) - np.repeat(np.cumsum(number) - number, number))


def filled(sequence: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, begins: np.ndarray,
           stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pieces, target, scored) of windows. Row r's sequence is ``sequence[starts[r]:]``, one longer than
    its places: place p predicts piece p + 1 from piece p and those before."""
    place = begins[:, None] + np.arange(WINDOW)
    there = place < lengths[rows][:, None]
    index = starts[rows][:, None] + np.where(there, place, 0)
    scored = there & ((begins[:, None] == 0) | (np.arange(WINDOW) >= WINDOW - stride))
    return sequence.take(index), sequence.take(index + there), scored
