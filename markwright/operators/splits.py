"""Folds, baselines and priors that keep questions apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def order_key(row_id: Column, seed: int) -> Column:
    """A portable pseudo-random order of ids (BIGINT arithmetic, no engine's own hash)."""
    return ((row_id * 7919 + seed) % 2147483647 * 1103515245 + 12345) % 2147483647


def score_bins(score: Column, low: Column, high: Column, n: int = 6) -> Column:
    """Right-closed equal-width bins 0..n-1, the lowest value included; null and constant scores are 0."""
    width = (high - low) / n
    return F.when(score.isNull() | (width <= 0), 0).otherwise(F.greatest(F.ceil((score - low) / F.nullif(width, F.lit(0.0))) - 1, F.lit(0))).cast("int")


def binned(df: DataFrame, keys: list[str], n: int = 6) -> DataFrame:
    """df with ``bin``: limits by one aggregation (a row a key; of the whole table one row), not by a window over whole rows."""
    limits = df.groupBy(*keys).agg(F.min("score").alias("__low"), F.max("score").alias("__high"))
    if keys:
        near = df.join(limits.withColumnsRenamed({k: f"__{k}" for k in keys}), F.expr(" and ".join(f"`{k}` <=> `__{k}`" for k in keys)), "left")
    else:
        near = df.crossJoin(F.broadcast(limits))
    return near.withColumn("bin", score_bins(F.col("score"), F.col("__low"), F.col("__high"), n)).select(*df.columns, "bin")


def stratified(df: DataFrame, keys: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """fold = position within the score bin modulo k; it splits questions, so it only bounds from above.

    Positions are taken from narrow rows and joined back by row_id, which is to be unique.
    """
    if k < 2:
        raise ValueError("k must be at least 2")
    narrow = binned(df.select(*dict.fromkeys([*keys, "row_id", "score"])), keys).select(*keys, "row_id", "bin", order_key(F.col("row_id"), seed).alias("__order"))
    placed = ranks.positions(narrow, [*keys, "bin"], ["__order", "row_id"], "__place")
    folds = placed.select("row_id", "bin", ((F.col("__place") + F.col("bin")) % k).cast("int").alias("fold"))
    return folds if set(df.columns) <= {"row_id"} else df.join(folds, "row_id").select(*df.columns, "bin", "fold")


def grouped(df: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """question_id -> fold: questions by size, dealt back and forth over min(k, n_questions), at least 2, folds."""
    if k < 2:
        raise ValueError("k must be at least 2")
    size = df.groupBy(*keys, "question_id").agg(F.count("*").alias("n_rows"))
    own = Window.partitionBy(*keys)
    place = size.withColumn("i", F.row_number().over(own.orderBy(F.desc("n_rows"), "question_id")) - 1).withColumn("k", F.greatest(F.least(F.count("*").over(own), F.lit(k)), F.lit(2)))
    turn = F.floor(F.col("i") / F.col("k")) % 2
    return place.select(*keys, "question_id", "n_rows", F.when(turn == 0, F.col("i") % F.col("k")).otherwise(F.col("k") - 1 - F.col("i") % F.col("k")).cast("int").alias("fold"))


def balanced_groups(sizes: list[tuple[str, dict]], k: int) -> dict[str, int]:
    """Greedy stratified assignment of (group, counts by bin) on the driver: the largest group first, to the fold it unbalances least."""
    bins = sorted({b for _, c in sizes for b in c})
    total = {b: sum(c.get(b, 0) for _, c in sizes) or 1 for b in bins}
    folds = [dict.fromkeys(bins, 0) for _ in range(k)]
    out = {}
    for name, counts in sorted(sizes, key=lambda x: (-sum(x[1].values()), x[0])):

        def cost(f: int, counts: dict = counts) -> tuple:
            worst = sum(max((g[b] + (counts.get(b, 0) if i == f else 0)) / total[b] for i, g in enumerate(folds)) - min((g[b] + (counts.get(b, 0) if i == f else 0)) / total[b] for i, g in enumerate(folds)) for b in bins)
            return worst, sum(folds[f].values()), f

        best = min(range(k), key=cost)
        for b, c in counts.items():
            folds[best][b] += c
        out[name] = best
    return out


def grouped_stratified(df: DataFrame, k: int = 5, n_bins: int = 6) -> DataFrame:
    """df with ``fold``: questions stay whole and score bins are balanced; the driver sees one row a (question, bin)."""
    counts = binned(df, [], n_bins).groupBy("question_id", "bin").agg(F.count("*").alias("n")).collect()
    sizes: dict[str, dict] = {}
    for r in counts:
        sizes.setdefault(r["question_id"], {})[r["bin"]] = r["n"]
    k = max(2, min(k, len(sizes)))
    folds = balanced_groups(list(sizes.items()), k)
    table = df.sparkSession.createDataFrame(list(folds.items()), "question_id string, fold int")
    return df.join(F.broadcast(table) if len(folds) <= 1_000_000 else table, "question_id")


def materialise(df: DataFrame, k: int = 5) -> DataFrame:
    """fold of every row: grouped where a dataset has the one split ``all``, else -1."""
    only = df.groupBy("dataset").agg((F.min("split") == "all").alias("a"), (F.max("split") == "all").alias("b")).select("dataset", (F.col("a") & F.col("b")).alias("cv"))
    folds = grouped(df, ["dataset"], k).select("dataset", "question_id", "fold")
    return df.join(folds, ["dataset", "question_id"]).join(only, "dataset").withColumn("fold", F.when(F.col("cv"), F.col("fold")).otherwise(-1)).drop("cv")


def fold_leaks(folded: DataFrame, keys: list[str]) -> DataFrame:
    """Questions that lie in more than one fold."""
    per = folded.groupBy(*keys, "question_id").agg(F.count_distinct("fold").alias("n_folds"))
    return per.groupBy(*keys).agg(F.count("*").alias("n_questions"), F.count_if(F.col("n_folds") > 1).alias("n_split_questions"))


def mode(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value, the smallest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(name), F.max("n").alias("n_mode"))


def constants(df: DataFrame, keys: list[str]) -> DataFrame:
    """Constant predictions: mean, rounded median, most frequent and largest score."""
    stats = df.where("score is not null").groupBy(*keys).agg(F.avg("score").alias("mean_score"), F.rint(F.median("score")).alias("median_score"), F.max("score").alias("max_score"))
    return stats.join(mode(df, keys, "score", "mode_score").drop("n_mode"), keys)


def question_means(df: DataFrame, value: str = "score") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy("question_id").agg(F.avg(value).alias("q_mean"), F.count("*").alias("q_n"))


def question_shortcut(df: DataFrame) -> DataFrame:
    """Predicts each test row by its question's training mean, unseen questions by the global one: row_id, split, y_true, y_pred, seen."""
    train = df.where("split = 'train'")
    overall = train.agg(F.avg("score").alias("g_mean"))
    test = df.where("split <> 'train' and score is not null").join(question_means(train), "question_id", "left").join(F.broadcast(overall))  # one row
    return test.select("row_id", "question_id", "split", F.col("score").alias("y_true"), F.coalesce("q_mean", "g_mean").alias("y_pred"), F.col("q_mean").isNotNull().alias("seen"))


def question_prior(df: DataFrame) -> DataFrame:
    """qprior_train_mean: leave-one-out question mean for training rows (global for lone or unscored ones), plain mean otherwise, null if unseen."""
    train = df.where("split = 'train'")
    overall = train.agg(F.avg("score").alias("g_mean"))
    sums = train.groupBy("question_id").agg(F.sum("score").alias("q_sum"), F.count("score").alias("q_n"))
    both = df.join(sums, "question_id", "left").join(F.broadcast(overall))  # one row
    loo = F.when(F.col("score").isNull(), F.col("g_mean")).otherwise(F.coalesce(F.try_divide(F.col("q_sum") - F.col("score"), F.col("q_n") - 1), F.col("g_mean")))
    return both.select("row_id", "question_id", "split", F.when(F.col("split") == "train", loo).otherwise(F.try_divide("q_sum", F.col("q_n"))).alias("qprior_train_mean"))


def out_of_fold_means(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row's prediction is the mean score of the other folds, by total minus own fold: row_id, fold, y_true, y_pred."""
    rows = df.where("score is not null").join(folds, "question_id")
    per = rows.groupBy("fold").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    total = per.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    rest = per.join(F.broadcast(total)).select("fold", F.try_divide(F.col("ts") - F.col("s"), F.col("tn") - F.col("n")).alias("y_pred"))  # one row
    return rows.join(F.broadcast(rest), "fold").select("row_id", "fold", F.col("score").alias("y_true"), "y_pred")


def binarised(df: DataFrame) -> DataFrame:
    """target: a label decides if there is one, else the score against the middle of the dataset's range; neither: null."""
    span = df.groupBy("dataset").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    by_label = F.when(F.col("label") != "", (F.col("label") == "correct").cast("int"))
    by_score = F.when(F.col("score").isNotNull(), (F.col("score") >= (F.col("lo") + F.col("hi")) / 2).cast("int"))
    return df.join(span, "dataset").withColumn("target", F.coalesce(by_label, by_score)).drop("lo", "hi")


def leave_one_out(df: DataFrame) -> DataFrame:
    """For each dataset, the rows and positives of all others (total minus own)."""
    per = binarised(df).where("target is not null").groupBy("dataset").agg(F.count("*").alias("n_test"), F.sum("target").alias("pos"))
    total = per.agg(F.sum("n_test").alias("tn"), F.sum("pos").alias("tp"))
    return per.join(F.broadcast(total)).select(F.col("dataset").alias("held_out"), "n_test", (F.col("tn") - F.col("n_test")).alias("n_train"), F.try_divide((F.col("tp") - F.col("pos")).cast("double"), (F.col("tn") - F.col("n_test")).cast("double")).alias("train_positive_rate"))


def sample(df: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """Exactly n rows a group (or all), in a portable pseudo-random order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order_key(F.col("row_id"), seed), "row_id"))
    return df.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")
