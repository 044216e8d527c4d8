"""Agreement and error metrics as aggregations over (y_true, y_pred).

All take a frame and grouping columns and return one row a group. Undefined is null. Only
counts or moments are shuffled, never rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranks


def _by(keys: list[str]) -> list[str]:
    return list(keys) or ["__all"]


def _with(df: DataFrame, keys: list[str]) -> DataFrame:
    return df if keys else df.withColumn("__all", F.lit(1))


def _drop(df: DataFrame) -> DataFrame:
    return df.drop("__all")


def pearson(x: str, y: str, least: int = 2) -> Column:
    """Null for fewer than ``least`` rows or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    u, v = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    su, sv = F.stddev_pop(u), F.stddev_pop(v)
    return F.when((F.count(u) >= least) & (su > 1e-8) & (sv > 1e-8), F.try_divide(F.covar_pop(u, v), su * sv))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, spearman of the rows with both values; groups of any size, see ``ranks``."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = both.groupBy(*keys, F.col(x).cast("double").alias("__px"), F.col(y).cast("double").alias("__py")).agg(F.count("*").alias("__pn"))
    return ranks.rank_sums(counts, keys, "__px", "__py", "__pn")


def confusion(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts n of each (keys, y_true, y_pred)."""
    return df.where("y_true is not null and y_pred is not null").groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))


def qwk(df: DataFrame, keys: list[str], rounded: bool = True) -> DataFrame:
    """Quadratic weighted kappa; weights use a label's position among the labels of either side; null below two labels."""
    whole = df.withColumns({c: F.rint(F.col(c).cast("double")).cast("long") for c in ("y_true", "y_pred")}) if rounded else df
    cells = _with(confusion(whole, keys), keys)
    by = _by(keys)
    labels = cells.select(*by, F.explode(F.array("y_true", "y_pred")).alias("y")).distinct()
    place = labels.withColumn("i", F.dense_rank().over(Window.partitionBy(*by).orderBy("y")) - 1)
    placed = cells.join(place.withColumnsRenamed({"y": "y_true", "i": "i"}), [*by, "y_true"]).join(place.withColumnsRenamed({"y": "y_pred", "i": "j"}), [*by, "y_pred"])
    total = placed.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("i") - F.col("j"), 2)).alias("o"), F.sum(F.col("n") * F.col("i")).alias("si"), F.sum(F.col("n") * F.col("j")).alias("sj"),
        F.sum(F.col("n") * F.pow("i", 2)).alias("sii"), F.sum(F.col("n") * F.pow("j", 2)).alias("sjj"), F.max(F.greatest("i", "j")).alias("top"),
    )
    # The expected weight of independent sides, sum_ij n_i n_j (i-j)^2 / n, by moments.
    expected = (F.col("n") * F.col("sii") + F.col("n") * F.col("sjj") - 2 * F.col("si") * F.col("sj")) / F.col("n")
    return _drop(total.select(*by, F.col("n"), F.when(F.col("top") >= 1, 1 - F.try_divide(F.col("o"), expected)).alias("qwk")))


def per_class(df: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and support of every label of either side."""
    cells = confusion(df, keys)
    hit = F.sum(F.when(F.col("side") == "both", F.col("n")).otherwise(0))
    sides = cells.select(
        *keys,
        "n",
        F.explode(F.filter(F.array(F.struct(F.col("y_true").alias("y"), F.lit("true").alias("side")), F.struct(F.col("y_pred").alias("y"), F.lit("pred").alias("side")), F.when(F.col("y_true") == F.col("y_pred"), F.struct(F.col("y_true").alias("y"), F.lit("both").alias("side")))), lambda s: s.isNotNull())).alias("s"),
    ).select(*keys, "n", "s.y", "s.side")
    tot = sides.groupBy(*keys, F.col("y").alias("label")).agg(hit.alias("tp"), F.sum(F.when(F.col("side") == "pred", F.col("n")).otherwise(0)).alias("np"), F.sum(F.when(F.col("side") == "true", F.col("n")).otherwise(0)).alias("support"))
    zero = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    return tot.select(
        *keys, "label", zero(F.col("tp"), F.col("np")).alias("precision"), zero(F.col("tp"), F.col("support")).alias("recall"), zero(2 * F.col("tp"), F.col("np") + F.col("support")).alias("f1"), "support"
    )


def f1(df: DataFrame, keys: list[str]) -> DataFrame:
    """Macro (all labels alike) and weighted (by true support) F1."""
    per = _with(per_class(df, keys), keys)
    return _drop(per.groupBy(*_by(keys)).agg(F.avg("f1").alias("macro_f1"), F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1")))


def regression(x: str = "y_true", y: str = "y_pred") -> dict[str, Column]:
    d = F.col(y).cast("double") - F.col(x).cast("double")
    return {
        "n": F.count(d), "rmse": F.sqrt(F.avg(d * d)), "mae": F.avg(F.abs(d)), "accuracy": F.avg((F.rint(F.col(x).cast("double")) == F.rint(F.col(y).cast("double"))).cast("double")), "pearson": pearson(x, y),
    }


def ordinal_errors(x: str = "y_true", y: str = "y_pred") -> dict[str, Column]:
    d = F.rint(F.col(y).cast("double")) - F.rint(F.col(x).cast("double"))
    share = lambda c: F.avg(c.cast("double"))
    return {"exact": share(d == 0), "off_by_one": share(F.abs(d) == 1), "gross": share(F.abs(d) >= 2), "signed_error": F.avg(d), "mae": F.avg(F.abs(d))}


def tolerance_bands(x: str = "y_true", y: str = "y_pred") -> dict[str, Column]:
    d = F.col(y).cast("double") - F.col(x).cast("double")
    share = lambda c: F.avg(c.cast("double"))
    return {"within_half": share(F.abs(d) <= 0.5), "within_one": share(F.abs(d) <= 1), "beyond_one": share(F.abs(d) > 1), "bias": F.avg(d)}


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Rank-sum ROC-AUC, ties counting half; null with one class only. From counts of distinct scores and their running sums."""
    both = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    side = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    counts = both.groupBy(*keys, F.col(score).cast("double").alias("__s")).agg(side(F.col(label) == 1).alias("__pos"), side(F.col(label) != 1).alias("__neg"))
    below = ranks.running(counts, keys, ["__s"], {"__less": "__neg"})
    n1, n0 = F.sum("__pos"), F.sum("__neg")
    won = F.sum(F.col("__pos") * (F.col("__less") + F.col("__neg") / 2.0))
    return below.groupBy(*keys).agg(n1.alias("n_pos"), n0.alias("n_neg"), F.try_divide(won, (n1 * n0).cast("double")).alias("auc"))


def reliability(df: DataFrame, keys: list[str], bins: int = 10, confidence: str = "conf", correct: str = "correct") -> DataFrame:
    """Right-closed equal-width bins; a confidence of 0 is in none."""
    inside = df.where((F.col(confidence) > 0) & (F.col(confidence) <= 1))
    return inside.groupBy(*keys, F.ceil(F.col(confidence) * bins).cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(F.col(confidence)).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    )


def ece(df: DataFrame, keys: list[str], bins: int = 10, confidence: str = "conf", correct: str = "correct") -> DataFrame:
    """Expected calibration error; the rows outside the bins count in its denominator."""
    total = _with(df, keys).groupBy(*_by(keys)).agg(F.count(confidence).alias("total"))
    binned = _with(reliability(df, keys, bins, confidence, correct), keys)
    gap = binned.groupBy(*_by(keys)).agg(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))).alias("gap"))
    return _drop(total.join(gap, _by(keys), "left").select(*_by(keys), F.coalesce(F.try_divide("gap", F.col("total")), F.lit(0.0)).alias("ece")))


#: The metric registry: name -> (frame, keys) -> frame with a column of that name.
REGISTRY = {
    "qwk": lambda df, keys: qwk(df, keys).select(*keys, "qwk"),
    "macro_f1": lambda df, keys: f1(df, keys).select(*keys, "macro_f1"),
    "weighted_f1": lambda df, keys: f1(df, keys).select(*keys, "weighted_f1"),
    "spearman": lambda df, keys: spearman(df, keys, "y_true", "y_pred").select(*keys, "spearman"),
} | {m: (lambda df, keys, m=m: df.groupBy(*keys).agg(regression()[m].alias(m))) for m in ("rmse", "mae", "accuracy", "pearson")}


def compute(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Several metrics side by side; an unknown name raises KeyError."""
    parts = [REGISTRY[n](df, keys) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, list(keys)) if keys else out.join(F.broadcast(p))  # without keys each is one row
    return out
