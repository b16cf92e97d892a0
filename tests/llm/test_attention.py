"""The language model: slopes, windows, and training."""

import numpy as np

from waypost.llm import attention as model


def _setting(seed=0):
    rng = np.random.default_rng(seed)
    table = model.bigrams(rng.integers(0, 3, (model.VOCABULARY, model.VOCABULARY)).astype(float))
    table = model.Bigrams(table.classes.astype(float), table.members.astype(float))
    weights = {name: (value + 0.1 * rng.standard_normal(value.shape)).astype(float)
               for name, value in model.start().items()}
    lengths = np.array([100, 3, 0, 48, 49, 1])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    return rng, table, weights, lengths, starts, rng.integers(0, model.VOCABULARY, int((lengths + 1).sum()))


def test_slopes_equal_differences():
    rng, table, weights, lengths, starts, sequence = _setting()
    pieces, target, scored = model.filled(sequence, starts, lengths, *model.cut(lengths))
    _, slopes = model.loss_and_slopes(weights, table, pieces, target, scored)
    for name in weights:
        at = {"embed": (pieces[0, 5], 3), "um": (target[0, 5] // 32, 2, target[0, 5] % 32)}.get(
            name, tuple(rng.integers(0, n) for n in weights[name].shape))
        moved = []
        for step in (1e-4, -1e-4):
            other = {key: value.copy() for key, value in weights.items()}
            other[name][at] += step
            moved.append(model.loss_and_slopes(other, table, pieces, target, scored)[0])
        assert np.isclose((moved[0] - moved[1]) / 2e-4, slopes[name][at], rtol=1e-3, atol=1e-7)


def test_windows_score_each_place_once_from_earlier_pieces_only():
    _, table, weights, lengths, starts, sequence = _setting(1)
    rows, begins = model.cut(lengths)
    pieces, target, scored = model.filled(sequence, starts, lengths, rows, begins)
    place = begins[:, None] + np.arange(model.WINDOW)
    seen = [(int(r), int(p)) for r, p in zip(np.broadcast_to(rows[:, None], scored.shape)[scored], place[scored])]
    assert sorted(seen) == [(r, p) for r, n in enumerate(lengths) for p in range(n)]
    scorer = model.Scorer(weights, table)
    found = scorer.windows(pieces, target, scored)
    changed = pieces.copy()
    changed[0, 20:] = 5
    before = scored.copy()
    before[0, 20:] = False
    before[1:] = False
    assert np.allclose(scorer.windows(changed, target, before), found[:20])
    total = np.zeros(1)
    one = np.zeros_like(scored[:1])
    one[0, 10] = True
    for guess in range(model.VOCABULARY):
        own = target[:1].copy()
        own[0, 10] = guess
        total += np.exp(scorer.windows(pieces[:1], own, one))
    assert np.isclose(total[0], 1, atol=1e-6)


def test_training_learns_what_a_bigram_cannot():
    rng = np.random.default_rng(2)
    lengths = np.full(300, 60)
    starts = np.cumsum(lengths + 1) - 61
    # Each row keeps to its own half of the pieces, which the single previous piece doesn't tell.
    rows = [rng.integers(0, 40, 61) * 2 + (rng.random(61) < 0.02) + k % 2 for k in range(300)]
    sequence = np.concatenate(rows) % 80
    counts = np.zeros((model.VOCABULARY, model.VOCABULARY))
    counts[:80, :80] = 10.0
    table = model.bigrams(counts)
    trainer = model.Trainer(model.start(), table)
    windows = model.filled(sequence, starts, lengths, *model.cut(lengths))
    first = trainer.learn(*windows)
    for _ in range(60):
        last = trainer.learn(*windows)
    assert last < first - 0.1
    again = model.shaped(model.flat(trainer.weights))
    assert all(np.array_equal(again[name], value) for name, value in trainer.weights.items())


def test_large_weights_give_no_nan():
    _, table, weights, lengths, starts, sequence = _setting(4)
    large = {name: value * (40 if name in ("wq", "wk", "embed") else 1) for name, value in weights.items()}
    windows = model.filled(sequence, starts, lengths, *model.cut(lengths))
    assert np.isfinite(model.Scorer(large, table).windows(*windows)).all()
    loss, slopes = model.loss_and_slopes(large, table, *windows)
    assert np.isfinite(loss) and all(np.isfinite(slope).all() for slope in slopes.values())


def test_adjoining_windows_hold_each_place_once():
    _, _, _, lengths, starts, sequence = _setting(5)
    rows, begins = model.cut(lengths, model.WINDOW)
    _, _, scored = model.filled(sequence, starts, lengths, rows, begins, model.WINDOW)
    place = begins[:, None] + np.arange(model.WINDOW)
    seen = [(int(r), int(p)) for r, p in zip(np.broadcast_to(rows[:, None], scored.shape)[scored], place[scored])]
    assert sorted(seen) == [(r, p) for r, n in enumerate(lengths) for p in range(n)]
    assert len(rows) == sum(-(-n // model.WINDOW) for n in lengths)


def test_weights_lie_in_one_array_and_steps_are_those_of_adam():
    _, table, _, lengths, starts, sequence = _setting(6)
    windows = model.filled(sequence, starts, lengths, *model.cut(lengths))
    trainer = model.Trainer(model.start(), table)
    own, mean, square = model.start(), 0.0, 0.0
    for step in range(1, 4):
        slope = model.flat(model.loss_and_slopes(own, table, *windows)[1]).astype(float)
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        moved = 0.01 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        own = model.shaped(model.flat(own) - moved)
        trainer.learn(*windows)
        assert np.mean(np.abs(model.flat(trainer.weights) - model.flat(own)) < 1e-3) > 0.999
    base = trainer.weights["uc"].base
    assert base is not None and all(value.base is base for value in trainer.weights.values())
