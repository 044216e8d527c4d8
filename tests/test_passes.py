"""What a query computes once, and what it shuffles."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from markwright.operators import features as ft
from markwright.operators import gbt
from markwright.plans import metric_queries

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]


def answers(spark):
    rows = [(1, "d", "No cat and not a dog. The cat isn't here", "The cat is not here. It ran"), (2, "d", "cat cat cat", "cat cat"), (3, "e", "", "Only this"), (4, None, "cat", "cat")]
    return spark.createDataFrame(rows, "row_id long, dataset string, student_answer string, reference_answer string")


def test_branches_of_a_row_need_no_join(spark):
    m = ft.matrix(answers(spark), ("lexical", "negation", "entities", "rubric", "semantic"), normalize=False)
    assert "Join" not in plan(m) and "Exchange" not in plan(m)
    assert m.columns == ["row_id", "dataset", *[c for b in ("lexical", "negation", "entities", "rubric", "semantic") for c in ft.BRANCHES[b]]]
    one = ft.rubric(ft_rubric(answers(spark))).orderBy("row_id").collect()
    two = m.orderBy("row_id").collect()
    assert [r.rub_mean_maxsim for r in two] == pytest.approx([r.rub_mean_maxsim for r in one])


def ft_rubric(df):
    from markwright.operators.rubric_text import sentence_similarities

    return sentence_similarities(ft.views(df, normalize=False))


def test_padding_needs_no_negation_view(spark):
    v = ft.views(answers(spark), normalize=False, negation=False)
    assert ft.perturb(v, "length_pad").where("row_id = 2").first().s_tok[-1] == "basically"


def test_tfidf_counts_terms_within_their_row(spark):
    v = ft.views(answers(spark), normalize=False, negation=False)
    out = ft.tfidf_cosine(v, "s_tok", "r_tok")
    assert "hashpartitioning(row_id" in plan(out) and not any("term#" in x for x in plan(out).splitlines() if "hashpartitioning(row_id" in x)
    rows = [r for r in v.collect() if r.dataset is not None]
    grams = lambda t: collections.Counter([*t, *zip(t, t[1:], strict=False)])
    df = {d: collections.Counter(g for r in rows if r.dataset == d for side in (r.s_tok, r.r_tok) for g in grams(side)) for d in ("d", "e")}
    n = {d: 2 * sum(r.dataset == d for r in rows) for d in df}
    want = {4: 0.0}
    for r in rows:
        least = 2 if max(df[r.dataset].values()) >= 2 else 1
        w = [{g: c * (math.log((1 + n[r.dataset]) / (1 + df[r.dataset][g])) + 1) for g, c in grams(t).items() if df[r.dataset][g] >= least} for t in (r.s_tok, r.r_tok)]
        norm = math.sqrt(sum(x * x for x in w[0].values()) * sum(x * x for x in w[1].values()))
        want[r.row_id] = sum(x * w[1].get(g, 0) for g, x in w[0].items()) / norm if norm else 0.0
    assert {r.row_id: r.tfidf_cosine for r in out.collect()} == pytest.approx(want)


def test_a_split_sums_its_smaller_side_only():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    y = np.where(np.nan_to_num(x[:, 0]) > 0.3, 2.0, np.nan_to_num(x[:, 1]))
    seen = []

    class Counted(gbt.Booster):
        def _sums(self, flat, g, h, rows, shape):
            seen.append(len(rows))
            return super()._sums(flat, g, h, rows, shape)

    model = Counted(n_estimators=1, num_leaves=12, min_child_samples=5).fit(x, y)
    tree = model.trees[0][0]
    inner = [i for i, f in enumerate(tree.feature) if f >= 0]
    assert sum(seen) == 500 + sum(min(tree.cover[tree.left[i]], tree.cover[tree.right[i]]) for i in inner)
    for i in inner:  # covers are those of the rows that come by
        assert tree.cover[i] == tree.cover[tree.left[i]] + tree.cover[tree.right[i]]


def test_cells_are_dealt_to_tasks_of_their_own(spark):
    cells = spark.range(40).select(F.concat(F.lit("c"), F.col("id") % 4).alias("cell"), F.lit(1).alias("seed"), F.when(F.col("id") < 30, "train").otherwise("test").alias("role"), F.col("id").alias("row_id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("y"), F.rand(1).alias("x"))
    out = gbt.run_grid(cells, ["x"], "regression", {"n_estimators": 2, "min_child_samples": 2})
    assert "REPARTITION_BY_NUM" in plan(out)
    assert sorted(r.row_id for r in out.collect()) == list(range(30, 40))


def test_contributions_and_predictions_are_stored(spark):
    assert all("/contributions-" in f for f in metric_queries._explained(spark, DATA).inputFiles())
    assert any("/predictions-" in f or "/ranges-" in f for f in metric_queries.gbt_lodo(spark, DATA).inputFiles())


def test_a_trial_is_fitted_once(spark, tmp_path, monkeypatch):
    """However often the metric reads a batch's predictions."""
    log = str(tmp_path)
    monkeypatch.setattr(gbt, "SEARCH_SPACE", {"learning_rate": (0.05, 0.3, "log"), "num_leaves": (2, 4, 1), "n_estimators": (1, 3, 1)})
    cells = spark.range(200).select(F.lit("dev").alias("cell"), F.lit(1).alias("seed"), F.when(F.col("id") % 3 > 0, "train").otherwise("test").alias("role"), F.col("id").alias("row_id"), (F.col("id") % 4).cast("double").alias("y"), F.rand(1).alias("x"))
    real = gbt.tried
    monkeypatch.setattr(gbt, "tried", lambda c, f, k, options: noted(real, c, f, k, options, log))
    assert len(gbt.search(cells, ["x"], "ordinal", "qwk", 4, 2, 1)) == 4
    assert len(list(tmp_path.iterdir())) == 4


def noted(real, cells, features, kind, options, log):
    """``tried``, with a file for each task that has a trial's rows."""

    def touched(batches):
        import uuid

        for b in batches:
            for i in b.column("trial").unique().to_pylist():
                open(f"{log}/{i}-{uuid.uuid4().hex}", "w").close()
            yield b

    return real(cells, features, kind, options).mapInArrow(touched, "trial int, row_id long, y_true double, y_pred double")
