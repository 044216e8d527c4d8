"""Parts of the evaluation protocols: encoder joins, calibration splits, verdict signals, resampled metrics, local explanations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .splits import order_key

LOWER_IS_BETTER = ("rmse", "mae")


def encode_distinct(df: DataFrame, columns: list[str], encode: Callable[[DataFrame], DataFrame], model: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Encode each distinct text of ``columns`` once and join the vectors back.

    ``encode`` maps a frame (text) to (text, vector). ``cache`` (model, text, vector) spares what it holds of the same
    model; rows of other models are ignored. Blank and null texts have no vector. Returns ``df`` with ``<column>_vec``
    and the rows (model, text, vector) to add to the cache. Texts meet by a 128-bit digest, so none is shuffled twice.
    """
    texts = df.select(F.explode(F.array(*columns)).alias("text")).where("trim(text) <> ''").distinct()
    known = cache.where(F.col("model") == model).select("text", "vector").dropDuplicates(["text"]) if cache is not None else None
    new = encode(texts if known is None else texts.join(known, "text", "left_anti"))
    every = (new if known is None else new.unionByName(known.join(texts, "text", "left_semi"))).select(F.md5("text").alias("__key"), "vector")
    out = df
    for c in columns:
        out = out.join(every.withColumnRenamed("vector", f"{c}_vec"), F.md5(F.col(c)) == F.col("__key"), "left").drop("__key")
    return out, new.select(F.lit(model).alias("model"), "text", "vector")


def with_oof(features: DataFrame, oof: DataFrame, columns: tuple[str, ...] = ("neural_score", "neural_pred")) -> DataFrame:
    """Features with a neural head's out-of-fold columns (row_id, ...); rows that it didn't score get nulls."""
    return features.join(oof.select("row_id", *columns), "row_id", "left")


def calibration_parts(df: DataFrame, official: bool, test_split: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with ``part``: train, val or test, else null.

    Official splits: test is ``test_split``; the first ``share`` (one row at least) of the training rows in a fixed
    pseudo-random order are val. Folds (column ``fold``): 0 is test, 1 val, the others train. Rows without a target
    (``y`` null) have none. The order's limit is one percentile-like cut from counts, not a sort of the table.
    """
    if not official:
        return df.withColumn("part", F.when(F.col("y").isNull(), None).when(F.col("fold") == 0, "test").when(F.col("fold") == 1, "val").when(F.col("fold") >= 2, "train"))
    key = order_key(F.col("row_id"), seed)
    train = F.expr("split = 'train' and y is not null")
    slots = 4096  # the order is cut in one slot; only that slot's rows are ranked
    width = 2147483647 // slots + 1
    per = df.where(train).groupBy(F.floor(key / width).alias("slot")).agg(F.count("*").alias("n"))
    total = per.agg(F.greatest(F.lit(1), F.floor(F.sum("n") * share)).alias("cut"))
    run = per.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # at most 4096 rows
    edge = run.crossJoin(F.broadcast(total)).where("before < cut and before + n >= cut").select(F.col("slot").alias("__edge"), (F.col("cut") - F.col("before")).alias("__left"))
    placed = df.withColumns({"__train": train, "__key": key}).join(F.broadcast(edge), how="left")  # one row
    placed = placed.withColumn("__slot", F.floor(F.col("__key") / width))
    own = Window.partitionBy("__at").orderBy("__key", "row_id")
    at_edge = placed.where("__train and __slot = __edge").withColumn("__at", F.col("__slot")).withColumn("__i", F.row_number().over(own)).where("__i <= __left").select(F.col("row_id").alias("__val"))
    both = placed.join(at_edge, F.col("row_id") == F.col("__val"), "left")
    val = F.col("__train") & ((F.col("__slot") < F.col("__edge")) | F.col("__val").isNotNull())
    part = F.when(val, "val").when(F.col("__train"), "train").when((F.col("split") == test_split) & F.col("y").isNotNull(), "test")
    return both.withColumn("part", part).drop("__train", "__key", "__slot", "__edge", "__left", "__val")


def verdict_signal(df: DataFrame, order: tuple[str, str, str], signal: str = "signal", verdict: str = "verdict") -> DataFrame:
    """One row: n, the mean signal of each verdict (worst to best), whether the means rise, rank correlation with the verdicts, AUC of the best against the rest.

    Ranks come from counts of distinct signal values, so no task sorts all rows.
    """
    from ..functions import metrics as mt

    rank = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])[F.col(verdict)]
    rows = df.where(F.col(signal).isNotNull()).select(F.col(signal).cast("double").alias("x"), rank.alias("y")).where("y is not null")
    counts = rows.groupBy("x", "y").agg(F.count("*").alias("n"))
    means = rows.agg(F.count("*").alias("n"), *[F.avg(F.when(F.col("y") == i, F.col("x"))).alias(f"mean_{i}") for i in range(3)])
    rho = ranks.rank_sums(counts, [], "x", "y", "n").select("spearman")
    area = mt.auc(rows.select("x", (F.col("y") == 2).cast("int").alias("y")), [], "y", "x").select("auc")
    one = means.crossJoin(F.broadcast(rho)).crossJoin(F.broadcast(area))  # one row each
    return one.withColumn("monotonic", F.coalesce((F.col("mean_0") <= F.col("mean_1")) & (F.col("mean_1") <= F.col("mean_2")), F.lit(False)))


def top_contributions(long: DataFrame, keys: list[str], k: int = 5, by: str = "shap") -> DataFrame:
    """The k contributions of each row with the largest absolute value, in order (then by feature): keys, rank, feature, by.

    A bounded array per row replaces a window: only features of one row meet.
    """
    one = F.struct(F.negative(F.abs(by)).alias("order"), F.col("feature"), F.col(by))
    top = long.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("top"))
    return top.select(*keys, F.posexplode("top").alias("rank", "t")).select(*keys, (F.col("rank") + 1).alias("rank"), "t.feature", f"t.{by}")


def first_of_each(df: DataFrame, keys: list[str], value: str, order: str = "row_id") -> DataFrame:
    """The first row of each predicted class: keys, value and its row."""
    return df.groupBy(*keys, value).agg(F.min(order).alias(order))


def bootstrap_counts(preds: DataFrame, metric: Callable[[str], dict[str, Column]], n_boot: int, seed: int = 42, ci: float = 0.95, cluster: str = "question_id") -> DataFrame:
    """Paired cluster bootstrap of any metric of a confusion table: delta, lo, hi, p, n_boot, degenerate.

    Rows (cluster, y, head, base) collapse to counts a cluster; a resample sums the counts of the clusters it draws.
    ``metric(df, keys)`` takes (keys, y_true, y_pred, n). Where base has one value only, head is held against 0.
    """
    from .stats import numbered, resampled

    cells = preds.groupBy(cluster, "y", "head", "base").agg(F.count("*").alias("value"))
    kinds = ranks.positions(cells.select("y", "head", "base").distinct(), [], ["y", "head", "base"], "key")  # combinations of labels
    places, n = numbered(preds, cluster)
    keyed = ranks.matched(ranks.matched(cells, kinds, ["y", "head", "base"]), places, [cluster]).select("at", "key", "value")
    sums = resampled(keyed, n, n_boot, seed).where("value > 0").select("boot", "key", F.col("value").cast("long").alias("n"))
    drawn = ranks.matched(sums, kinds, ["key"])
    arm = lambda c: metric(drawn.groupBy("boot", F.col("y").alias("y_true"), F.col(c).alias("y_pred")).agg(F.sum("n").alias("n")), ["boot"])
    flat = preds.agg((F.min("base") == F.max("base")).alias("degenerate"))
    both = arm("head").toDF("boot", "h").join(arm("base").toDF("boot", "b"), "boot").crossJoin(F.broadcast(flat))  # one row
    d = both.select("degenerate", (F.col("h") - F.when(F.col("degenerate"), 0.0).otherwise(F.col("b"))).alias("d"))
    at = lambda q: F.percentile("d", F.lit(q))
    return d.agg(F.avg("d").alias("delta"), at((1 - ci) / 2).alias("lo"), at((1 + ci) / 2).alias("hi"), F.avg((F.col("d") <= 0).cast("double")).alias("p"), F.count("*").alias("n_boot"), F.max("degenerate").alias("degenerate"))


def macro_f1_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, macro_f1 of (keys, y_true, y_pred, n): the mean F1 over labels that occur on either side."""
    n, hit = F.col("n"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    sides = counts.select(*keys, F.explode(F.array(F.struct(F.col("y_true").alias("label"), n.alias("t"), F.lit(0).cast("long").alias("p"), hit.cast("long").alias("tp")), F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("t"), n.alias("p"), F.lit(0).cast("long").alias("tp")))).alias("s")).select(*keys, "s.*")
    per = sides.groupBy(*keys, "label").agg((2 * F.sum("tp") / (F.sum("t") + F.sum("p"))).alias("f1"))
    return per.groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def qwk_of_counts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, qwk of (keys, y_true, y_pred, n) by moments; 1 where both sides are one equal constant, else null without spread."""
    n, a, b = F.col("n").cast("double"), F.col("y_true"), F.col("y_pred")
    s = counts.groupBy(*keys).agg(F.sum(n).alias("w"), F.sum(n * a).alias("a"), F.sum(n * b).alias("b"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"), F.sum(n * (a - b) * (a - b)).alias("dd"))
    expected = F.col("aa") + F.col("bb") - 2 * F.col("a") * F.col("b") / F.col("w")
    return s.select(*keys, F.when(expected > 1e-12, 1 - F.col("dd") / expected).when(F.col("dd") == 0, 1.0).alias("qwk"))


def probe_inflation(df: DataFrame, folds: DataFrame) -> DataFrame:
    """RMSE of the question-mean probe over given folds (row_id, fold): each row's question mean in the other folds, else their global mean."""
    rows = df.where("score is not null").select("row_id", "question_id", "score").join(folds, "row_id")
    own = rows.groupBy("fold", "question_id").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    question = own.groupBy("question_id").agg(F.sum("s").alias("qs"), F.sum("n").alias("qn"))
    fold = own.groupBy("fold").agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    total = fold.agg(F.sum("fs").alias("ts"), F.sum("fn").alias("tn"))
    rest = own.join(question, "question_id").join(F.broadcast(fold), "fold").crossJoin(F.broadcast(total))  # a row a fold, one row
    pred = rest.select("fold", "question_id", F.coalesce(F.try_divide(F.col("qs") - F.col("s"), F.col("qn") - F.col("n")), F.try_divide(F.col("ts") - F.col("fs"), F.col("tn") - F.col("fn"))).alias("y_pred"))
    return rows.join(pred, ["fold", "question_id"]).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col("score") - F.col("y_pred"), 2))).alias("rmse"))


def shared_features(available: dict[str, list[str]]) -> list[str]:
    """Feature names that every dataset has, neural columns apart, sorted."""
    sets = [{c for c in names if not c.startswith("neural_")} for names in available.values()]
    return sorted(set.intersection(*sets)) if sets else []


def headline(task, metrics: dict[str, dict[str, float]]) -> dict:
    """Split, metric and value a task is judged by (the last test split, or ``cv``), and what unseen questions cost where both splits are known."""
    split = task.test_splits[-1] if task.protocol == "official" else "cv"
    value = metrics.get(split, {}).get(task.headline)
    seen = metrics.get("test_ua", {}).get(task.headline) if split not in ("cv", "test_ua") else None
    return {"split": split, "metric": task.headline, "value": value, "generalization_gap": None if seen is None or value is None else round(seen - value, 4)}


def gain(metric: str, new: Column, old: Column) -> Column:
    """How much better ``new`` is than ``old``: positive is better for errors, too."""
    return old - new if metric in LOWER_IS_BETTER else new - old
