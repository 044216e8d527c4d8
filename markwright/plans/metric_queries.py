"""Queries over predictions: metrics, calibration, significance, heads and explanations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import metrics as mt
from ..functions import vector as vx
from ..operators import features as ft
from ..operators import gbt, partitioned_gbt, splits, stats
from .answer_queries import query as _query
from .answer_queries import r6
from .fixtures import PREDS, answers, preds, read, with_
from .storage import scratch

P = with_(PREDS)
query = _query  # both modules fill one registry


@query(P + "SELECT grp, round(CASE WHEN stddev_pop(y_true) > 1e-8 AND stddev_pop(y_pred) > 1e-8 THEN covar_pop(y_true, y_pred) / (stddev_pop(y_true) * stddev_pop(y_pred)) END, 6) AS pearson FROM preds GROUP BY grp")
def pearson_by_group(spark, sf):
    return r6(preds(spark, sf).groupBy("grp").agg(mt.pearson("y_true", "y_pred").alias("pearson")), "pearson")


@query(
    P
    + """, r AS (SELECT grp, rank() OVER (PARTITION BY grp ORDER BY y_true) + (count(*) OVER (PARTITION BY grp, y_true) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY grp ORDER BY y_pred) + (count(*) OVER (PARTITION BY grp, y_pred) - 1) / 2.0::DOUBLE AS y FROM preds)
SELECT grp, count(*) AS n, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) AS spearman FROM r GROUP BY grp"""
)
def spearman_by_group(spark, sf):
    return r6(mt.spearman(preds(spark, sf), ["grp"], "y_true", "y_pred"), "spearman")


@query(P + "SELECT grp, count(*) AS n, round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS rmse, round(avg(abs(y_pred - y_true)), 6) AS mae, round(avg((y_pred = y_true)::INT), 6) AS accuracy, round(covar_pop(y_true, y_pred) / (stddev_pop(y_true) * stddev_pop(y_pred)), 6) AS pearson FROM preds GROUP BY grp")
def regression_metrics(spark, sf):
    return r6(preds(spark, sf).groupBy("grp").agg(*[c.alias(n) for n, c in mt.regression().items()]), "rmse", "mae", "accuracy", "pearson")


def _qwk(by: str) -> str:
    key = f"{by}, " if by else ""
    on = f"a.{by} = b.{by}" if by else "true"
    return f"""c AS (SELECT {key}y_true AS t, y_pred AS p, count(*)::DOUBLE AS n FROM preds GROUP BY ALL),
l AS (SELECT {key}y, dense_rank() OVER ({f'PARTITION BY {by}' if by else ''} ORDER BY y) - 1 AS i FROM (SELECT {key}t AS y FROM c UNION SELECT {key}p FROM c)),
tot AS (SELECT {key}sum(n) AS n FROM c {f'GROUP BY {by}' if by else ''}),
o AS (SELECT {'c.' + by + ', ' if by else ''}sum(c.n * (lt.i - lp.i) ** 2) AS o FROM c JOIN l lt ON lt.y = c.t {f'AND lt.{by} = c.{by}' if by else ''} JOIN l lp ON lp.y = c.p {f'AND lp.{by} = c.{by}' if by else ''} {f'GROUP BY c.{by}' if by else ''}),
ht AS (SELECT {key}t AS y, sum(n) AS n FROM c GROUP BY ALL), hp AS (SELECT {key}p AS y, sum(n) AS n FROM c GROUP BY ALL),
e AS (SELECT {'a.' + by + ', ' if by else ''}sum(a.n * b.n * (la.i - lb.i) ** 2) AS e FROM ht a JOIN hp b ON {on} JOIN l la ON la.y = a.y {f'AND la.{by} = a.{by}' if by else ''} JOIN l lb ON lb.y = b.y {f'AND lb.{by} = b.{by}' if by else ''} {f'GROUP BY a.{by}' if by else ''}),
k AS (SELECT {'tot.' + by + ', ' if by else ''}CAST(tot.n AS BIGINT) AS n, 1 - o.o / (e.e / tot.n) AS qwk FROM tot JOIN o ON {f'o.{by} = tot.{by}' if by else 'true'} JOIN e ON {f'e.{by} = tot.{by}' if by else 'true'})"""


@query(with_(PREDS, _qwk("")) + "SELECT n, round(qwk, 6) AS qwk FROM k")
def qwk(spark, sf):
    return r6(mt.qwk(preds(spark, sf), []), "qwk")


@query(with_(PREDS, _qwk("grp")) + "SELECT grp, n, round(qwk, 6) AS qwk FROM k")
def qwk_per_prompt(spark, sf):
    return r6(mt.qwk(preds(spark, sf), ["grp"]), "qwk")


@query(with_(PREDS, _qwk("grp")) + "SELECT count(*) AS n_prompts, CAST(sum(n) AS BIGINT) AS n_pairs, round(avg(qwk), 6) AS macro_qwk FROM k")
def iaa_ceiling(spark, sf):
    """Agreement of two raters (true and predicted) per prompt, averaged."""
    return r6(mt.qwk(preds(spark, sf), ["grp"]).agg(F.count("*").alias("n_prompts"), F.sum("n").alias("n_pairs"), F.avg("qwk").alias("macro_qwk")), "macro_qwk")


@query(P + "SELECT grp, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL")
def confusion_matrix(spark, sf):
    return mt.confusion(preds(spark, sf), ["grp"])


_PRF = """lab AS (SELECT grp, y_true AS label FROM preds UNION SELECT grp, y_pred FROM preds),
prf AS (SELECT l.grp, l.label, coalesce(count(*) FILTER (p.y_true = l.label AND p.y_pred = l.label)::DOUBLE / nullif(count(*) FILTER (p.y_pred = l.label), 0), 0) AS precision,
  coalesce(count(*) FILTER (p.y_true = l.label AND p.y_pred = l.label)::DOUBLE / nullif(count(*) FILTER (p.y_true = l.label), 0), 0) AS recall,
  coalesce(2 * count(*) FILTER (p.y_true = l.label AND p.y_pred = l.label)::DOUBLE / nullif(count(*) FILTER (p.y_true = l.label) + count(*) FILTER (p.y_pred = l.label), 0), 0) AS f1, count(*) FILTER (p.y_true = l.label) AS support
  FROM lab l JOIN preds p ON p.grp = l.grp GROUP BY ALL)"""


@query(with_(PREDS, _PRF) + "SELECT grp, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM prf")
def per_class_prf(spark, sf):
    return r6(mt.per_class(preds(spark, sf), ["grp"]), "precision", "recall", "f1")


@query(with_(PREDS, _PRF) + "SELECT grp, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM prf GROUP BY grp")
def macro_weighted_f1(spark, sf):
    return r6(mt.f1(preds(spark, sf), ["grp"]), "macro_f1", "weighted_f1")


@query(P + "SELECT y_true, y_pred, count(*) AS n FROM preds WHERE y_true <> y_pred GROUP BY ALL ORDER BY n DESC, y_true DESC, y_pred DESC LIMIT 6")
def top_confused_pairs(spark, sf):
    return mt.confusion(preds(spark, sf), []).where("y_true <> y_pred").orderBy(F.desc("n"), F.desc("y_true"), F.desc("y_pred")).limit(6)


@query(with_(PREDS, "s AS (SELECT grp, row_id % 5 AS seed, avg(correct) AS accuracy FROM preds GROUP BY ALL)") + "SELECT grp, round(avg(accuracy), 6) AS mean, round(stddev_pop(accuracy), 6) AS std, count(accuracy) AS n FROM s GROUP BY grp")
def seed_aggregate(spark, sf):
    per = preds(spark, sf).groupBy("grp", (F.col("row_id") % 5).alias("seed")).agg(F.avg("correct").alias("accuracy"))
    return r6(per.groupBy("grp").agg(F.avg("accuracy").alias("mean"), F.stddev_pop("accuracy").alias("std"), F.count("accuracy").alias("n")), "mean", "std")


@query(P + "SELECT grp, round(avg((y_pred = y_true)::INT), 6) AS exact, round(avg((abs(y_pred - y_true) = 1)::INT), 6) AS off_by_one, round(avg((abs(y_pred - y_true) >= 2)::INT), 6) AS gross, round(avg(y_pred - y_true), 6) AS signed_error, round(avg(abs(y_pred - y_true)), 6) AS mae FROM preds GROUP BY grp")
def ordinal_errors(spark, sf):
    e = mt.ordinal_errors()
    return r6(preds(spark, sf).groupBy("grp").agg(*[c.alias(n) for n, c in e.items()]), *e)


@query(P + "SELECT grp, round(avg((abs(d) <= 0.5)::INT), 6) AS within_half, round(avg((abs(d) <= 1)::INT), 6) AS within_one, round(avg((abs(d) > 1)::INT), 6) AS beyond_one, round(avg(d), 6) AS bias FROM (SELECT grp, y_pred + conf - y_true AS d FROM preds) GROUP BY grp")
def regression_errors(spark, sf):
    e = mt.tolerance_bands()
    shifted = preds(spark, sf).select("grp", "y_true", (F.col("y_pred") + F.col("conf")).alias("y_pred"))
    return r6(shifted.groupBy("grp").agg(*[c.alias(n) for n, c in e.items()]), *e)


@query(
    P
    + """, b AS (SELECT grp, CAST(ceil(conf * 10) AS INT) AS bin, count(*) AS n, avg(conf) AS c, avg(correct) AS a FROM preds WHERE conf > 0 AND conf <= 1 GROUP BY ALL), t AS (SELECT grp, count(*) AS total FROM preds GROUP BY ALL)
SELECT b.grp, round(sum(n * abs(a - c)) / any_value(total), 6) AS ece FROM b JOIN t ON t.grp = b.grp GROUP BY b.grp"""
)
def ece(spark, sf):
    return r6(mt.ece(preds(spark, sf), ["grp"]), "ece")


@query(P + "SELECT grp, CAST(ceil(conf * 10) AS INT) AS bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg(correct), 6) AS accuracy FROM preds WHERE conf > 0 AND conf <= 1 GROUP BY ALL")
def reliability_bins(spark, sf):
    return r6(mt.reliability(preds(spark, sf), ["grp"]), "confidence", "accuracy")


@query(
    P
    + """, r AS (SELECT grp, correct, rank() OVER (PARTITION BY grp ORDER BY conf) + (count(*) OVER (PARTITION BY grp, conf) - 1) / 2.0::DOUBLE AS r FROM preds)
SELECT grp, CAST(sum(correct) AS BIGINT) AS n_pos, CAST(sum(1 - correct) AS BIGINT) AS n_neg, round((sum(r) FILTER (correct = 1) - sum(correct) * (sum(correct) + 1) / 2.0::DOUBLE) / (sum(correct)::DOUBLE * sum(1 - correct)), 6) AS auc FROM r GROUP BY grp"""
)
def auc(spark, sf):
    return r6(mt.auc(preds(spark, sf), ["grp"], "correct", "conf"), "auc")


@query(
    P
    + """, k AS (SELECT grp, correct, row_number() OVER (PARTITION BY grp ORDER BY conf DESC, row_id) AS i, count(*) OVER (PARTITION BY grp) AS n FROM preds)
SELECT grp, c.coverage::DOUBLE AS coverage, count(*) AS n_kept, round(avg(correct), 6) AS accuracy FROM k CROSS JOIN (VALUES (0.25), (0.5), (0.75), (1.0)) c(coverage) WHERE i <= greatest(floor(c.coverage * n), 1) GROUP BY ALL"""
)
def risk_coverage(spark, sf):
    return r6(stats.risk_coverage(preds(spark, sf), ["grp"]), "accuracy")


def _probs(df):
    """Three made-up class probabilities from conf, and a class."""
    a, b = 0.2 + 0.6 * F.col("conf"), 0.5 - 0.3 * F.col("conf")
    return df.select("grp", "row_id", F.array(a / (a + b + 0.3), b / (a + b + 0.3), 0.3 / (a + b + 0.3)).alias("probs"), (F.col("y_true") % 3).alias("y"))


_PROBS = "pa AS (SELECT grp, row_id, y_true % 3 AS y, 0.2::DOUBLE + 0.6::DOUBLE * conf AS a, 0.5::DOUBLE - 0.3::DOUBLE * conf AS b FROM preds), pb AS (SELECT grp, row_id, y, [a / (a + b + 0.3::DOUBLE), b / (a + b + 0.3::DOUBLE), 0.3::DOUBLE / (a + b + 0.3::DOUBLE)] AS pr FROM pa)"


@query(
    with_(PREDS, _PROBS)
    + """, z AS (SELECT grp, row_id, y, ln(pr[1]) AS z1, ln(pr[2]) AS z2, ln(pr[3]) AS z3 FROM pb), g AS (SELECT 0.5::DOUBLE + i * 0.05::DOUBLE AS t FROM range(191) r(i)),
n AS (SELECT grp, t, avg(ln(exp(z1 / t - greatest(z1, z2, z3) / t) + exp(z2 / t - greatest(z1, z2, z3) / t) + exp(z3 / t - greatest(z1, z2, z3) / t)) + greatest(z1, z2, z3) / t - (CASE y WHEN 0 THEN z1 WHEN 1 THEN z2 ELSE z3 END) / t) AS nll FROM z CROSS JOIN g GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(nll, 9), t) AS rn FROM n) SELECT grp, round(t, 2) AS temperature, round(nll, 6) AS nll FROM k WHERE rn = 1"""
)
def temperature_fit(spark, sf):
    t = stats.temperature(_probs(preds(spark, sf)), ["grp"])
    return t.select("grp", F.round("temperature", 2).alias("temperature"), F.round("nll", 6).alias("nll"))


@query(with_(PREDS, _PROBS) + ", s AS (SELECT row_id, list_transform(pr, lambda x: x ** (1 / 2.0::DOUBLE)) AS q FROM pb) SELECT row_id, round(q[1] / list_sum(q), 6) AS p0, round(q[2] / list_sum(q), 6) AS p1, round(q[3] / list_sum(q), 6) AS p2 FROM s")
def temperature_scale(spark, sf):
    s = _probs(preds(spark, sf)).select("row_id", vx.softmax_temperature(F.col("probs"), 2.0).alias("q"))
    return s.select("row_id", *[F.round(F.get("q", F.lit(i)), 6).alias(f"p{i}") for i in range(3)])


def _logits(spark, sf):
    return read(spark, sf, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 6).alias("z"), (F.col("label") % 4).alias("rank"))


_LOGITS = "z AS (SELECT vec_id, label % 4 AS r, CAST(embedding[1] AS DOUBLE) * 6 AS a, CAST(embedding[2] AS DOUBLE) * 6 AS b, CAST(embedding[3] AS DOUBLE) * 6 AS c FROM embeddings), s AS (SELECT *, 1 / (1 + exp(-a)) AS sa, 1 / (1 + exp(-b)) AS sb, 1 / (1 + exp(-c)) AS sc FROM z)"


@query(with_(_LOGITS) + "SELECT vec_id, (sa > 0.5)::INT + (sa * sb > 0.5)::INT + (sa * sb * sc > 0.5)::INT AS rank FROM s")
def corn_decode(spark, sf):
    return _logits(spark, sf).select("vec_id", vx.corn_rank(F.col("z")).alias("rank"))


@query(with_(_LOGITS) + "SELECT vec_id, (sa > 0.5)::INT + (sb > 0.5)::INT + (sc > 0.5)::INT AS rank, round(sa + sb + sc, 6) AS expected FROM s")
def coral_decode(spark, sf):
    return _logits(spark, sf).select("vec_id", vx.coral_rank(F.col("z")).alias("rank"), F.round(vx.expected_rank(F.col("z")), 6).alias("expected"))


@query(with_(_LOGITS) + "SELECT vec_id, round(-(CASE WHEN r > 0 THEN ln(sa) ELSE ln(1 - sa) END) - (CASE WHEN r > 1 THEN ln(sb) ELSE ln(1 - sb) END) - (CASE WHEN r > 2 THEN ln(sc) ELSE ln(1 - sc) END), 6) AS loss FROM s")
def coral_loss(spark, sf):
    return _logits(spark, sf).select("vec_id", F.round(vx.coral_loss(F.col("z"), F.col("rank")), 6).alias("loss"))


@query(with_(_LOGITS) + "SELECT vec_id, round(-(CASE WHEN r > 0 THEN ln(sa) ELSE ln(1 - sa) END) - (CASE WHEN r > 1 THEN ln(sb) WHEN r = 1 THEN ln(1 - sb) ELSE 0 END) - (CASE WHEN r > 2 THEN ln(sc) WHEN r = 2 THEN ln(1 - sc) ELSE 0 END), 6) AS loss FROM s")
def corn_loss(spark, sf):
    return _logits(spark, sf).select("vec_id", F.round(vx.corn_loss(F.col("z"), F.col("rank")), 6).alias("loss"))


_HP = "hp AS (SELECT CAST(l_linenumber AS VARCHAR) AS name, count(*) FILTER (l_quantity > 49)::DOUBLE / count(*) AS p FROM lineitem GROUP BY ALL)"


@query(
    with_(_HP)
    + ", h AS (SELECT *, row_number() OVER (ORDER BY p, name) - 1 AS i, count(*) OVER () AS m FROM hp) SELECT name, round(p, 6) AS p, round(max(least(p * (m - i), 1)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS p_holm, max(least(p * (m - i), 1)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING) < 0.05 AS significant FROM h"
)
def holm_bonferroni(spark, sf):
    p = read(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("name")).agg((F.count_if(F.col("l_quantity") > 49).cast("double") / F.count("*")).alias("p"))
    return r6(stats.holm(p, []), "p", "p_holm")


@query(
    P
    + """, k AS (SELECT grp, row_id, row_number() OVER (PARTITION BY grp ORDER BY y_pred, row_id) - 1 AS position, count(*) OVER (PARTITION BY grp) AS n FROM preds), w AS (SELECT DISTINCT grp, CAST(round_even(i * (n - 1) / 4.0::DOUBLE, 0) AS BIGINT) AS position FROM k CROSS JOIN range(5) r(i))
SELECT k.grp, k.row_id, k.position FROM k JOIN w ON w.grp = k.grp AND w.position = k.position"""
)
def spread_picks(spark, sf):
    return stats.spread_picks(preds(spark, sf), ["grp"], ["y_pred", "row_id"], 5).select("grp", "row_id", "position")


_BOOT = """q AS (SELECT question_id, count(*)::DOUBLE AS n, sum(y_true)::DOUBLE AS y, sum(y_true * y_true)::DOUBLE AS yy, sum(y_pred)::DOUBLE AS h, sum(y_pred * y_pred)::DOUBLE AS hh, sum(y_true * y_pred)::DOUBLE AS yh, sum(conf) AS b, sum(conf * conf) AS bb, sum(y_true * conf) AS yb FROM preds GROUP BY ALL),
qn AS (SELECT *, row_number() OVER (ORDER BY question_id) - 1 AS qi, count(*) OVER () AS m FROM q),
dr AS (SELECT boot, (((boot * 7919 + i * 104729 + 42) % 2147483647 * 1103515245 + 12345) % 2147483647) % m AS qi FROM range(10000) a(boot) CROSS JOIN (SELECT qi AS i, m FROM qn)),
sm AS (SELECT boot, sum(n) AS n, sum(y) AS y, sum(yy) AS yy, sum(h) AS h, sum(hh) AS hh, sum(yh) AS yh, sum(b) AS b, sum(bb) AS bb, sum(yb) AS yb FROM dr JOIN qn ON qn.qi = dr.qi GROUP BY boot),
dl AS (SELECT (yh - y * h / n) / sqrt((yy - y * y / n) * (hh - h * h / n)) - (yb - y * b / n) / sqrt((yy - y * y / n) * (bb - b * b / n)) AS d FROM sm)"""


@query(with_(PREDS, _BOOT) + "SELECT round(avg(d), 6) AS delta, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(avg((d <= 0)::INT), 6) AS p, count(*) AS n_boot FROM dl")
def cluster_bootstrap(spark, sf):
    p = preds(spark, sf).select("question_id", F.col("y_true").cast("double").alias("y"), F.col("y_pred").cast("double").alias("head"), F.col("conf").alias("base"))
    return r6(stats.bootstrap_pearson(p, 10_000), "delta", "lo", "hi", "p")


@query(
    P
    + """, t AS (SELECT grp, avg((y_true = y_pred)::INT) AS feature_only, avg((y_true = CAST(round_even(conf * 3, 0) AS INT))::INT) AS neural_only, avg((y_true = CASE WHEN conf > 0.5 THEN y_pred ELSE CAST(round_even(conf * 3, 0) AS INT) END)::INT) AS hybrid FROM preds GROUP BY grp)
SELECT grp, round(feature_only, 6) AS feature_only, round(neural_only, 6) AS neural_only, round(hybrid, 6) AS hybrid, round(hybrid - feature_only, 6) AS fusion_gain, round(hybrid - neural_only, 6) AS interpretability_gain FROM t"""
)
def three_way_compare(spark, sf):
    neural = F.rint(F.col("conf") * 3).cast("int")
    arm = lambda c: F.avg((F.col("y_true") == c).cast("double"))
    t = preds(spark, sf).groupBy("grp").agg(arm(F.col("y_pred")).alias("feature_only"), arm(neural).alias("neural_only"), arm(F.when(F.col("conf") > 0.5, F.col("y_pred")).otherwise(neural)).alias("hybrid"))
    t = t.withColumns({"fusion_gain": F.col("hybrid") - F.col("feature_only"), "interpretability_gain": F.col("hybrid") - F.col("neural_only")})
    return r6(t, "feature_only", "neural_only", "hybrid", "fusion_gain", "interpretability_gain")


# -- heads: trained in cells, checked by contracts in the tests --

_HEAD = {"n_estimators": 30, "learning_rate": 0.1, "num_leaves": 15, "min_child_samples": 10}
_COLS = [*ft.BRANCHES["lexical"], *ft.BRANCHES["negation"]]


def _features(spark, sf, scored=False):
    """Lexical and negation columns; ``scored``: of rows with a score alone, for what neither trains on others nor reports them."""
    a = answers(spark, sf)
    return ft.matrix(a.where("score is not null") if scored else a, ("lexical", "negation"), normalize=False).drop("domain")


def _stored(df, name):
    """``df`` written once, as what follows reads it more than once."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def _matrix(spark, sf, scored=False):
    return _stored(_features(spark, sf, scored), "head-matrix")


def _folds(spark, sf):
    return splits.grouped(answers(spark, sf).withColumn("__one", F.lit(1)), ["__one"])


@query()
def gbt_official(spark, sf):
    """Official-split protocol of the ordinal head: metrics per test split, mean and deviation over seeds."""
    out = _stored(gbt.run_grid(gbt.split_cells(_matrix(spark, sf, True), ("dev", "test_ua", "test_uq", "test_ud"), (42, 1)), _COLS, "ordinal", _HEAD | {"subsample": 0.8}).where("y_true is not null"), "predictions")
    per = mt.qwk(out, ["cell", "seed"])
    return r6(per.groupBy("cell").agg(F.avg("qwk").alias("mean"), F.stddev_pop("qwk").alias("std"), F.count("qwk").alias("n_seeds"), F.max("n").alias("n_rows")), "mean", "std")


@query()
def gbt_grouped_cv(spark, sf):
    """Grouped cross-validation of the regression head: pooled out-of-fold metrics per seed."""
    out = gbt.run_grid(gbt.fold_cells(_matrix(spark, sf, True), _folds(spark, sf), (42,)), _COLS, "regression", _HEAD).where("y_true is not null")
    return r6(out.groupBy("seed").agg(*[c.alias(n) for n, c in mt.regression().items()]), "rmse", "mae", "accuracy", "pearson")


@query()
def gbt_oof(spark, sf):
    """Out-of-fold predictions of every scored answer."""
    return r6(gbt.run_grid(gbt.fold_cells(_matrix(spark, sf), _folds(spark, sf), (42,)), _COLS, "regression", _HEAD), "y_pred")


_SMALL = _HEAD | {"n_estimators": 8, "num_leaves": 8}


def _slotted(spark, sf, slot):
    """The matrix with slots, by ``slot`` of the split and the grouped fold, stored once: all cells read it."""
    m = _features(spark, sf).join(_folds(spark, sf).select("question_id", "fold"), "question_id")
    path = scratch(spark, "head-matrix")
    m.select("row_id", slot.cast("int").alias("slot"), F.col("score").cast("double").alias("y"), *_COLS).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@query()
def gbt_nested_cv(spark, sf):
    """Nested grouped cross-validation over one stored matrix: an outer fold's error, and its inner folds' mean and deviation."""
    rows = _slotted(spark, sf, F.col("fold"))
    train, tests = partitioned_gbt.nested([0, 1, 2, 3, 4])
    out = partitioned_gbt.by_outer(partitioned_gbt.predicted(rows, _COLS, partitioned_gbt.fit(rows, _COLS, train, "regression", _SMALL), tests)).where("y_true is not null")
    per = out.groupBy("outer", "inner").agg(F.sqrt(F.avg((F.col("y_true") - F.col("y_pred")) ** 2)).alias("rmse"), F.count("*").alias("n"))
    at = lambda agg, inside: agg(F.when(F.col("inner").isNotNull() == F.lit(inside), F.col("rmse")))
    both = per.groupBy("outer").agg(at(F.max, False).alias("rmse"), F.max(F.when(F.col("inner").isNull(), F.col("n"))).alias("n"), at(F.avg, True).alias("inner_mean"), at(F.stddev_pop, True).alias("inner_std"), at(F.count, True).alias("inner_folds"))
    return r6(both, "rmse", "inner_mean", "inner_std")


@query()
def gbt_official_oof(spark, sf):
    """The official protocol's feature column without a leak: train rows are predicted by the other grouped folds of the train split, all other splits by a head of the whole train split."""
    others = {"dev": 10, "test_ua": 11, "test_uq": 12, "test_ud": 13}
    slot = F.when(F.col("split") == "train", F.col("fold"))
    for name, number in others.items():
        slot = slot.when(F.col("split") == name, F.lit(number))
    rows = _slotted(spark, sf, slot)
    train, tests = partitioned_gbt.official([0, 1, 2, 3, 4], others)
    heads = partitioned_gbt.fit(rows, _COLS, train, "ordinal", _SMALL)
    return r6(partitioned_gbt.predicted(rows, _COLS, heads, tests).select("row_id", "cell", "y_true", "y_pred"), "y_pred")


@query()
def gbt_leakage_inflation(spark, sf):
    """A head's pooled error over folds that split questions, less that over grouped folds; both cross-validations read one stored matrix."""
    a = answers(spark, sf)
    m = _features(spark, sf).join(splits.stratified(a, ["dataset"]).select("row_id", F.col("fold").alias("other")), "row_id")
    m = m.join(_folds(spark, sf).select("question_id", "fold"), "question_id")
    path = scratch(spark, "head-matrix")
    m.select("row_id", (5 * F.col("fold") + F.col("other")).cast("int").alias("slot"), F.col("score").cast("double").alias("y"), *_COLS).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    train, tests = partitioned_gbt.crossed(5)
    out = partitioned_gbt.predicted(rows, _COLS, partitioned_gbt.fit(rows, _COLS, train, "regression", _SMALL), tests).where("y_true is not null")
    error = lambda kind: F.sqrt(F.avg(F.when(F.col("cell").startswith(kind), (F.col("y_true") - F.col("y_pred")) ** 2)))
    both = out.agg(error("stratified").alias("stratified"), error("grouped").alias("grouped"))
    return r6(both.withColumn("inflation", F.col("stratified") - F.col("grouped")), "stratified", "grouped", "inflation")


@query()
def gbt_ablation(spark, sf):
    """The grid with the lexical and the negation columns left out in turn, against the full set."""
    cells = gbt.fold_cells(_matrix(spark, sf, True), _folds(spark, sf), (42,))
    drop = {"full": (), "minus_lexical": ft.BRANCHES["lexical"], "minus_negation": ft.BRANCHES["negation"]}
    runs = [gbt.run_grid(cells, [c for c in _COLS if c not in d], "regression", _HEAD).where("y_true is not null").groupBy().agg(mt.regression()["rmse"].alias("rmse")).select(F.lit(v).alias("variant"), "rmse") for v, d in drop.items()]
    out = runs[0]
    for r in runs[1:]:
        out = out.union(r)
    full = F.max(F.when(F.col("variant") == "full", F.col("rmse"))).over(_whole())
    return r6(out.withColumn("delta_vs_full", F.col("rmse") - full), "rmse", "delta_vs_full")


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


@query()
def gbt_lodo(spark, sf):
    """Leave one dataset out: binarised target, AUC and macro-F1 of the held-out dataset."""
    m = _matrix(spark, sf).drop("score", "label", "split")
    rows = m.drop("dataset").join(splits.binarised(answers(spark, sf)).select("row_id", "dataset", "target"), "row_id").withColumn("y", F.col("target").cast("double"))
    held = rows.select(F.col("dataset").alias("cell")).distinct()
    cells = rows.join(F.broadcast(held)).withColumn("role", F.when(F.col("dataset") == F.col("cell"), "test").otherwise("train")).withColumn("seed", F.lit(42))
    out = _stored(gbt.run_grid(cells, _COLS, "regression", _HEAD).where("y_true is not null"), "predictions")
    area = mt.auc(out, ["cell"], "y_true", "y_pred")
    f1 = mt.f1(out.withColumn("y_pred", (F.col("y_pred") >= 0.5).cast("double")), ["cell"]).select("cell", "macro_f1")
    return r6(area.join(f1, "cell"), "auc", "macro_f1")


@query()
def gbt_search(spark, sf):
    """Eight trials over the head's settings on the dev split in two batches, by quadratic weighted kappa, best first."""
    cells = gbt.split_cells(_stored(_features(spark, sf, True).where("split in ('train', 'dev')"), "head-matrix"), ("dev",), (42,))
    found = gbt.search(cells, _COLS, "ordinal", "qwk", 8, 4, 42)
    names = [c for c in found[0] if c != "trial"]
    rows = [(r["trial"], *[None if np.isnan(r[c]) else float(r[c]) for c in names]) for r in found]
    return r6(spark.createDataFrame(rows, "trial int, " + ", ".join(f"{c} double" for c in names)), *names).orderBy(F.desc_nulls_last("value"), "trial")


def _explained(spark, sf):
    """Stored, as the queries read the contributions several times."""
    return _stored(gbt.explain(_features(spark, sf), _COLS, "regression", _HEAD), "contributions")


@query()
def shap_importance(spark, sf):
    """Mean absolute contribution of each feature and its rank agreement with split counts."""
    e = _explained(spark, sf).groupBy("dataset", "feature").agg(F.avg(F.abs("shap")).alias("importance"), F.max("split_count").alias("split_count"))
    agree = mt.spearman(e, ["dataset"], "importance", "split_count").select("dataset", F.col("spearman").alias("rank_agreement"))
    return r6(e.join(agree, "dataset"), "importance", "rank_agreement")


@query()
def branch_share(spark, sf):
    """Contribution of each branch, shares within a dataset."""
    from pyspark.sql import Window

    names = spark.createDataFrame([(c, b) for b, cs in ft.BRANCHES.items() for c in cs], "feature string, branch string")
    e = _explained(spark, sf).groupBy("dataset", "feature").agg(F.avg(F.abs("shap")).alias("v")).join(F.broadcast(names), "feature").groupBy("dataset", "branch").agg(F.sum("v").alias("v"))
    return e.select("dataset", "branch", F.round(F.try_divide("v", F.sum("v").over(Window.partitionBy("dataset"))), 6).alias("share"))


@query()
def faithfulness(spark, sf):
    """Per feature: does the sign of its contribution follow the side of its median, and do ranks agree."""
    e = _explained(spark, sf).where("value is not null and not isnan(value)")
    med = e.groupBy("dataset", "feature").agg(F.median("value").alias("med"))
    signs = e.join(med, ["dataset", "feature"]).where(F.abs("shap") > 1e-12).groupBy("dataset", "feature").agg(F.avg((F.signum(F.col("value") - F.col("med")) == F.signum("shap")).cast("double")).alias("sign_consistency"))
    rho = mt.spearman(e, ["dataset", "feature"], "value", "shap").select("dataset", "feature", F.col("spearman").alias("rho"))
    return r6(signs.join(rho, ["dataset", "feature"]), "sign_consistency", "rho")
