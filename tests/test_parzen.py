"""The batched Parzen search on fixed functions, and its trials on a small table."""

import numpy as np

from markwright.operators import gbt, parzen


def bowl(space):
    """Best at a fixed inner point, falling off in every setting."""
    goal = np.linspace(0.2, 0.8, len(space))
    return lambda options: [-float(((parzen.placed(o, space) - goal) ** 2).sum()) for o in options]


def test_better_than_even_draws_and_reproducible():
    value = bowl(gbt.SEARCH_SPACE)
    ours, even = [], []
    for seed in range(8):
        run = parzen.search(value, gbt.SEARCH_SPACE, 40, 8, seed)
        assert run == parzen.search(value, gbt.SEARCH_SPACE, 40, 8, seed) and len(run) == 40
        ours.append(max(r["value"] for r in run))
        even.append(max(r["value"] for r in parzen.search(value, gbt.SEARCH_SPACE, 40, 8, seed, startup=40)))
    assert np.mean(ours) > np.mean(even) and sum(a > b for a, b in zip(ours, even, strict=True)) >= 6


def test_settings_stay_in_their_space_and_read_back():
    for r in parzen.search(bowl(gbt.SEARCH_SPACE), gbt.SEARCH_SPACE, 30, 7, 3):
        for name, (low, high, how) in gbt.SEARCH_SPACE.items():
            assert low <= r[name] <= high * (1 + 1e-12)
            assert isinstance(how, str) or (r[name] - low) % how == 0
        again = parzen.read_off(parzen.placed(r, gbt.SEARCH_SPACE), gbt.SEARCH_SPACE)
        assert all(abs(again[k] - r[k]) <= 1e-9 * abs(r[k]) for k in again)


def test_a_batch_spreads_and_failed_trials_are_worst():
    rng = np.random.default_rng(1)
    points = rng.random((20, 3))
    values = np.where(np.arange(20) % 4 == 0, np.nan, -((points - 0.5) ** 2).sum(1))
    batch = parzen.propose(points, values, 6, rng)
    assert batch.shape == (6, 3) and min(np.abs(a - b).max() for i, a in enumerate(batch) for b in batch[:i]) > 0.01


def test_search_over_cells(spark, monkeypatch):
    monkeypatch.setitem(gbt.SEARCH_SPACE, "n_estimators", (5, 20, 5))
    monkeypatch.setitem(gbt.SEARCH_SPACE, "num_leaves", (3, 8, 1))
    rng = np.random.default_rng(4)
    rows = [(i, f"q{i % 5}", float(x), float(rng.random()), float(round(x * 3)), "train" if i % 3 else "test", "c", 1) for i, x in enumerate(rng.random(240))]
    cells = spark.createDataFrame(rows, "row_id long, question_id string, a double, b double, y double, role string, cell string, seed int")
    found = gbt.search(cells, ["a", "b"], "ordinal", "qwk", 6, 3, 7)
    assert [r["trial"] for r in found] == list(range(6)) and max(r["value"] for r in found) > 0.7
    errors = gbt.search(cells, ["a", "b"], "regression", "rmse", 3, 3, 7)
    assert all(r["value"] < 0 for r in errors)
