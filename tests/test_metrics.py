import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markwright.functions import metrics as mt
from markwright.functions import vector as vx
from markwright.operators import gbt, splits, stats
from markwright.schema import TASKS, Config, coerce


def preds(spark, true, pred):
    return spark.createDataFrame([(int(a), int(b)) for a, b in zip(true, pred, strict=True)], "y_true int, y_pred int")


def test_qwk(spark):
    q = lambda a, b: mt.qwk(preds(spark, a, b), []).first().qwk
    assert q([0, 1, 2, 3], [0, 1, 2, 3]) == pytest.approx(1)
    assert q([0, 1, 2], [1, 1, 1]) == pytest.approx(0)
    assert q([1, 1, 1], [1, 1, 1]) is None


def test_regression_metrics(spark):
    m = preds(spark, [1, 2, 3], [1, 2, 5]).agg(*[c.alias(n) for n, c in mt.regression().items()]).first()
    assert m.rmse == pytest.approx(math.sqrt(4 / 3)) and m.mae == pytest.approx(2 / 3)
    assert preds(spark, [1, 1], [1, 2]).agg(mt.pearson("y_true", "y_pred").alias("r")).first().r is None


def test_unknown_metric():
    with pytest.raises(KeyError):
        mt.compute(None, [], ["nope"])


def test_ece(spark):
    rows = lambda *x: spark.createDataFrame(x, "conf double, correct int")
    assert mt.ece(rows((1.0, 1), (1.0, 1)), [], 5).first().ece == 0
    assert mt.ece(rows((1.0, 1), (1.0, 0)), [], 5).first().ece == 0.5


def test_decoding(spark):
    z = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    row = spark.range(1).select(*[f(z(*l)).alias(f"{n}{i}") for n, f in (("n", vx.corn_rank), ("l", vx.coral_rank)) for i, l in enumerate(([-12] * 3, [12, -12, -12], [12, 12, -12], [12] * 3))], vx.corn_rank(z(-5, 5, 5)).alias("c")).first()
    assert tuple(row) == (0, 1, 2, 3, 0, 1, 2, 3, 0)


def test_baselines(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 2.0), ("b", 2.0)], "k string, score double")
    a, b = splits.constants(df, ["k"]).orderBy("k").collect()
    assert (a.mode_score, a.max_score, b.mode_score, b.median_score) == (0.0, 1.0, 2.0, 2.0)


ROWS = "row_id long, question_id string, split string, score double, label string, dataset string"


def test_question_prior_and_shortcut(spark):
    df = spark.createDataFrame([(0, "a", "train", 1.0, "", "d"), (1, "a", "train", 2.0, "", "d"), (2, "a", "train", 3.0, "", "d"), (3, "a", "test_ua", 0.0, "", "d"), (4, "zzz", "test_uq", 0.0, "", "d")], ROWS)
    prior = {r.row_id: r.qprior_train_mean for r in splits.question_prior(df).collect()}
    assert (prior[0], prior[3], prior[4]) == (2.5, 2.0, None)
    assert {r.row_id: (r.y_pred, r.seen) for r in splits.question_shortcut(df).collect()} == {3: (2.0, True), 4: (2.0, False)}


def test_binarise(spark):
    df = spark.createDataFrame([(0, "q", "s", None, "correct", "a"), (1, "q", "s", None, "incorrect", "a"), (2, "q", "s", 0.0, "", "b"), (3, "q", "s", 5.0, "", "b"), (4, "q", "s", None, "", "b")], ROWS)
    assert [r.target for r in splits.binarised(df).orderBy("row_id").collect()] == [1, 0, 0, 1, None]


def test_folds(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, f"q{rng.randrange(12)}", "all", float(rng.randrange(4)), "", "d") for i in range(300)], ROWS)
    for folds in (splits.grouped(df, ["dataset"]), splits.grouped_stratified(df).select("question_id", "fold").distinct()):
        assert folds.count() == folds.select("question_id").distinct().count()
        assert {r.fold for r in folds.select("fold").distinct().collect()} == set(range(5))
    with pytest.raises(ValueError):
        splits.stratified(df, ["dataset"], 1)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.2), ("d", 0.3)], "name string, p double")
    got = {r.name: (round(r.p_holm, 6), r.significant) for r in stats.holm(df, []).collect()}
    assert got["a"] == (0.004, True) and not got["b"][1]


def test_bootstrap_of_a_perfect_head(spark):
    rows = [(f"q{i % 30}", float(i % 5), float(i % 5), 2.0) for i in range(150)]
    r = stats.bootstrap_pearson(spark.createDataFrame(rows, "question_id string, y double, head double, base double"), 200).first()
    assert r.delta == pytest.approx(1) and r.lo > 0 and r.p < 0.01


def test_booster_handles_missing_and_is_additive():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = np.nan
    y = np.where(np.isnan(x[:, 0]), 3.0, x[:, 0]) + 0.1 * rng.normal(size=300)
    m = gbt.Booster(n_estimators=25, learning_rate=0.2, num_leaves=8, min_child_samples=5).fit(x, y)
    assert np.corrcoef(m.predict(x), y)[0, 1] > 0.95
    assert np.allclose(m.contributions(x[:20]).sum(2), m.raw(x[:20]), atol=1e-6)
    head = gbt.Head("ordinal", {"n_estimators": 10, "min_child_samples": 5}, 1).fit(x, np.clip(np.rint(y), 0, 3))
    assert set(np.unique(head.predict(x))) <= {0, 1, 2, 3}
    c = gbt.Head("classification", {"n_estimators": 10, "min_child_samples": 5}, 1).fit(x, (y > 0).astype(int) * 2)
    assert (c.predict(x) == (y > 0) * 2).mean() > 0.9
    assert (gbt.Head("regression", {}, 1).fit(x, np.ones(300)).predict(x) == 1).all()


def test_grid(spark):
    rng = random.Random(2)
    rows = [(i, f"q{i % 10}", "train" if i % 3 else "dev", float(i % 4), float(i % 4) + rng.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, question_id string, split string, score double, f double")
    out = gbt.run_grid(gbt.split_cells(df, ("dev",), (1, 2)), ["f"], "ordinal", {"n_estimators": 20, "min_child_samples": 5})
    assert out.count() == 2 * 40 and mt.qwk(out, ["seed"]).where("qwk < 0.6").isEmpty()


def test_schema_and_config(spark):
    df = coerce(spark.createDataFrame([("q", "x", "nan"), ("q", None, "2")], "question_id string, student_answer string, score string"))
    assert [tuple(r) for r in df.select("student_answer", "score", "label").collect()] == [("x", None, ""), ("", 2.0, "")]
    assert Config.load({"tau": 0.4}).tau == 0.4 and TASKS["asap_sas"].per_prompt
    with pytest.raises(ValueError):
        Config.load({"nope": 1})


def test_every_scored_row_is_explained(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 2))
    x[rng.random(x.shape) < 0.2] = np.nan
    y = np.nan_to_num(x[:, 0]) + 2 * (np.nan_to_num(x[:, 1]) > 0)
    rows = [("d" if i % 5 else "e", i, *map(float, x[i]), float(y[i]) if i % 10 != 9 else None) for i in range(500)]
    frame = spark.createDataFrame(rows, "dataset string, row_id long, f0 double, f1 double, score double")
    params = {"n_estimators": 3, "num_leaves": 5, "min_child_samples": 5}
    got = gbt.explain(frame, ["f0", "f1"], "regression", params, block=64).toPandas()
    for name in ("d", "e"):
        own = [r for r in rows if r[0] == name and r[4] is not None]
        v = np.array([r[2:4] for r in own])
        model = gbt.Booster(**params, seed=42).fit(v, np.array([r[4] for r in own]))
        want = np.array([sum(gbt.tree_shap(t, one) for group in model.trees for t in group) for one in v])
        mine = got[got.dataset == name].pivot(index="row_id", columns="feature", values="shap").sort_index()
        assert mine.index.tolist() == [r[1] for r in own] and np.allclose(mine.to_numpy(), want[:, :2])
