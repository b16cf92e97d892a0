"""Language-model scores: every window trains, rare pieces cost by their own counts."""

import numpy as np

from waypost.llm import attention as model, scoring


def test_every_window_trains(spark):
    size = 3000
    for length in (5, 40):
        docs = spark.createDataFrame([([(7 * k) % 90 for k in range(length)],)], "ids array<int>").coalesce(1)
        numbers = np.minimum(np.arange(size + 1) + 2, model.VOCABULARY - 1)
        table = model.bigrams(np.ones((model.VOCABULARY, model.VOCABULARY)))
        trained = scoring.Trained(numbers, table, model.start(), size, np.zeros(size + 1))
        for number in range(scoring.ROUNDS):
            weights = scoring._round(docs, trained, number, scoring.EVERY)
            assert not np.allclose(weights["uc"], trained.weights["uc"])


def test_rare_pieces_cost_their_share(spark, monkeypatch):
    monkeypatch.setattr(scoring, "_KNOWN", 2)
    times = {0: 50, 1: 40, 2: 9, 3: 1, 4: 5}
    size = 7
    pairs = spark.createDataFrame(
        [(1, size * scoring._PAIR + piece, n) for piece, n in times.items()], "kind int, key long, n long")
    numbers, _, rare = scoring._vocabulary(pairs, size)
    assert [int(numbers[k]) for k in (0, 1, 7)] == [2, 3, scoring._END] and set(numbers[2:7]) == {scoring._RARE}
    share = np.array([10, 2, 6, 1, 1]) / 20
    assert np.allclose(np.exp(rare[2:7]), share) and not rare[[0, 1, 7]].any()
    got = scoring._rare_logs(np.array([2, 0, 2, 3, 1]), np.array([3, 0, 1, 1]), rare)
    assert np.allclose(got, [2 * np.log(0.5), 0, np.log(0.1), 0])
