"""Boosting over partitions against the local booster, nested cells, and what a cell may not see."""

import numpy as np
import pytest

from markwright.operators import gbt
from markwright.operators import partitioned_gbt as pg

FEATURES = ["a", "b", "c"]
PARAMS = {"n_estimators": 6, "learning_rate": 0.3, "num_leaves": 7, "min_child_samples": 5, "max_bin": 16}
SHAPE = ("feature", "threshold", "missing_left", "left", "right", "value", "cover", "gain")


def data(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.normal(size=n).round(1)], 1)
    x[rng.random((n, 3)) < 0.1] = np.nan
    y = np.clip(np.rint(np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 1]) / 2 + rng.normal(size=n) / 4), 0, 3)
    return x, y, rng.integers(0, 3, n)


def frame(spark, x, y, slot, parts=3):
    rows = [(i, int(s) if s is not None else None, None if v is None else float(v), *[None if np.isnan(c) else float(c) for c in r]) for i, (r, v, s) in enumerate(zip(x, y, slot, strict=True))]
    return spark.createDataFrame(rows, "row_id long, slot int, y double, a double, b double, c double").repartition(parts)


def same(one, other):
    return len(one.trees) == len(other.trees) and all(getattr(a, k) == getattr(b, k) for g, h in zip(one.trees, other.trees, strict=True) for a, b in zip(g, h, strict=True) for k in SHAPE)


def test_cuts_equal_local_bins(spark):
    x, y, slot = data()
    local = gbt.Booster(max_bin=16)._bin(x)[1]
    for got, want in zip(pg.cuts_of(frame(spark, x, y, slot), FEATURES, 16), local, strict=True):
        np.testing.assert_array_equal(got, want)


@pytest.mark.parametrize("parts", [1, 5])
def test_trees_equal_local_booster(spark, parts):
    x, y, slot = data()
    cuts = gbt.Booster(max_bin=16)._bin(x)[1]
    cells, _ = pg.nested([0, 1, 2])
    heads = pg.fit(frame(spark, x, y, slot, parts), FEATURES, cells, "regression", PARAMS, 7, cuts)
    for name, slots in cells.items():
        own = np.isin(slot, list(slots))
        want = gbt.Booster(**PARAMS, seed=7).fit(x[own], y[own], cuts)
        assert same(heads[name].model, want), name


def test_classes_and_staging(spark, monkeypatch):
    monkeypatch.setattr(pg, "STAGE_EVERY", 2)
    x, y, slot = data(300)
    params = PARAMS | {"n_estimators": 3, "colsample": 0.7, "reg_lambda": 1.0, "reg_alpha": 0.1}
    cuts = gbt.Booster(max_bin=16)._bin(x)[1]
    got = pg.fit(frame(spark, x, y, slot), FEATURES, {"all": {0, 1, 2}}, "classification", params, 5, cuts)["all"]
    labels = np.unique(y)
    assert got.labels.tolist() == labels.tolist()
    assert same(got.model, gbt.Booster(**params, seed=5, classes=len(labels)).fit(x, np.searchsorted(labels, y), cuts))


def test_held_out_targets_change_nothing(spark):
    """The head of a cell, and so its predictions, are the same whatever the targets of its test rows."""
    x, y, slot = data(200)
    train, tests = pg.official([0, 1], {"dev": 2})
    turned = np.where(slot == 0, 3 - y, y)
    params = PARAMS | {"n_estimators": 2}
    one, other = (pg.fit(frame(spark, x, t, slot), FEATURES, train, "ordinal", params) for t in (y, turned))
    assert same(one["oof-0"].model, other["oof-0"].model) and not same(one["full"].model, other["full"].model)
    got = pg.predicted(frame(spark, x, y, slot), FEATURES, one, tests).toPandas()
    assert sorted(got.row_id) == list(range(200))
    assert {c: set(slot[g.row_id]) for c, g in got.groupby("cell")} == {"oof-0": {0}, "oof-1": {1}, "full": {2}}
    back = one["oof-0"].predict(x[slot == 0])
    assert got[got.cell == "oof-0"].sort_values("row_id").y_pred.tolist() == back.tolist()


def test_odd_rows(spark):
    """No rows, one target value, null slots and targets, a column without values, a sample of the rows."""
    x, y, slot = data(60)
    x[:, 1] = np.nan
    rows = frame(spark, x, [None if i < 5 else v for i, v in enumerate(y)], [None if i > 55 else s for i, s in enumerate(slot)])
    heads = pg.fit(rows, FEATURES, {"none": {9}, "all": {0, 1, 2}}, "regression", PARAMS | {"n_estimators": 2, "subsample": 0.5})
    assert set(heads) == {"all"}
    assert np.isfinite(heads["all"].predict(x)).all()
    kept = frame(spark, x, np.ones(60), slot)
    assert (pg.fit(kept, FEATURES, {"one": {0, 1}}, "classification", PARAMS)["one"].predict(x) == 1).all()
    assert pg.fit(kept.limit(0), FEATURES, {"one": {0}}, "regression", PARAMS) == {}


def test_nested_folds_serve_both_sides(spark):
    """Each outer fold has every other fold tested as an inner one, by a head that saw neither."""
    train, tests = pg.nested([0, 1, 2])
    assert train["inner-0-2"] == {1} and tests["inner-0-2"] == {0, 2} and train["outer-1"] == {0, 2}
    rows = [(c, s) for c, slots in tests.items() for s in slots]
    got = {(r.cell, r.slot): (r.outer, r.inner) for r in pg.by_outer(spark.createDataFrame(rows, "cell string, slot int")).collect()}
    assert got["outer-1", 1] == (1, None) and got["inner-0-2", 0] == (2, 0) and got["inner-0-2", 2] == (0, 2)
    assert sorted((o, i) for o, i in got.values() if i is not None) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert all(not {o, i} & train[c] for (c, _), (o, i) in got.items())


def test_crossed_folds_part_the_slots():
    train, tests = pg.crossed(3)
    for kind in ("grouped", "stratified"):
        own = [tests[f"{kind}-{f}"] for f in range(3)]
        assert sorted(s for t in own for s in t) == list(range(9))
    assert tests["grouped-1"] == {3, 4, 5} and tests["stratified-1"] == {1, 4, 7}
    assert all(not train[c] & tests[c] and len(train[c]) == 6 for c in train)
