"""Significance, variance, calibration and ranking statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranks


def eta_squared(df: DataFrame, keys: list[str], group: str = "question_id", value: str = "score") -> DataFrame:
    """Between-group share of variance from group sums; null with one group or a constant value."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    total = per.groupBy(*keys).agg(F.count("*").alias("n_groups"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    grand = F.col("s") * F.col("s") / F.col("n")
    spread = F.col("q") - grand
    return total.select(*keys, "n_groups", "n", F.when((F.col("n_groups") > 1) & (spread > 1e-12), (F.col("b") - grand) / spread).alias("eta2"))


def skew(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bias-corrected skewness; null below three values."""
    n = F.count(value)
    return df.groupBy(*keys).agg(n.alias("n"), F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))).alias("skew"))


def holm(df: DataFrame, keys: list[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Step-down adjusted p-values: running maximum of p (m - i), at most 1."""
    by = [F.col(k) for k in keys] or [F.lit(1)]
    order = Window.partitionBy(*by).orderBy(p, "name")
    raw = df.withColumn("__i", F.row_number().over(order) - 1).withColumn("__m", F.count("*").over(Window.partitionBy(*by)))
    run = F.max(F.least(F.col(p) * (F.col("__m") - F.col("__i")), F.lit(1.0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn("p_holm", run).withColumn("significant", F.col("p_holm") < alpha).drop("__i", "__m")


def drawn(boot: np.ndarray, n: int, seed: int) -> np.ndarray:
    """boots x n: which cluster number each draw of each resample takes, by integer arithmetic that any engine repeats."""
    mixed = (boot.astype(np.int64)[:, None] * 7919 + np.arange(n, dtype=np.int64) * 104729 + seed) % 2147483647
    return (mixed * 1103515245 + 12345) % 2147483647 % n


BOOTS, CLUSTERS = 128, 1 << 15  # of a block of the resample-weight matrix


def resampled(cells: DataFrame, n: int, n_boot: int, seed: int = 42) -> DataFrame:
    """(boot, key, value): the values of (at, key, value) summed over the clusters ``at`` (0 to n - 1) that each resample draws.

    The matrix of resample weights (resamples x clusters) is never rows of a table: a task has a block of it, makes the
    weights, multiplies them with the block's cells and returns sums a (resample, key). Cells of a block of clusters
    travel as arrays, once for each block of resamples.
    """
    spark = cells.sparkSession
    packed = cells.groupBy(F.floor(F.col("at") / CLUSTERS).cast("long").alias("block")).agg(F.collect_list(F.struct((F.col("at") % CLUSTERS).alias("at"), F.col("key").cast("long").alias("key"), F.col("value").cast("double").alias("value"))).alias("cells"))
    packed = packed.select("block", F.transform("cells", lambda c: c["at"]).alias("at"), F.transform("cells", lambda c: c["key"]).alias("key"), F.transform("cells", lambda c: c["value"]).alias("value"))
    starts = spark.range(0, n_boot, BOOTS).withColumnRenamed("id", "first")
    blocks = packed.join(F.broadcast(starts)).repartition("block", "first")  # starts: n_boot / BOOTS rows

    def product(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                block, first = batch.column("block")[r].as_py(), batch.column("first")[r].as_py()
                at, key, value = (batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in ("at", "key", "value"))
                names, place = np.unique(key, return_inverse=True)
                boots = np.arange(first, min(first + BOOTS, n_boot))
                sums = np.empty((len(boots), len(names)))
                for i, boot in enumerate(boots):
                    inside = drawn(np.array([boot]), n, seed)[0] - block * CLUSTERS
                    weights = np.bincount(inside[(inside >= 0) & (inside < CLUSTERS)], minlength=CLUSTERS)
                    sums[i] = np.bincount(place, weights[at] * value, len(names))
                yield pa.RecordBatch.from_pydict({"boot": np.repeat(boots, len(names)), "key": np.tile(names, len(boots)), "value": sums.ravel()})

    return blocks.mapInArrow(product, "boot long, key long, value double").groupBy("boot", "key").agg(F.sum("value").alias("value"))


def numbered(clusters: DataFrame, cluster: str) -> tuple[DataFrame, int]:
    """Distinct clusters with their number ``at`` in order, and how many there are; null is a cluster."""
    out = ranks.positions(clusters.select(cluster).distinct(), [], [cluster], "at")
    return out, out.count()


def bootstrap_pearson(preds: DataFrame, n_boot: int, seed: int = 42, ci: float = 0.95, cluster: str = "question_id") -> DataFrame:
    """Paired cluster bootstrap of Pearson(head) - Pearson(base).

    Rows (cluster, y, head, base) collapse to additive moments once a cluster; each resample sums the moments of
    drawn clusters. A constant side counts as 0 (head against nothing). One row: delta, lo, hi, p, n_boot.
    """
    moment = {"n": F.count("*").cast("double"), "y": F.sum("y"), "yy": F.sum(F.col("y") * F.col("y"))}
    for c in ("head", "base"):
        moment |= {c: F.sum(c), f"{c}2": F.sum(F.col(c) * F.col(c)), f"y{c}": F.sum(F.col("y") * F.col(c))}
    places, n = numbered(preds, cluster)
    stats = ranks.matched(preds.groupBy(cluster).agg(*[v.alias(k) for k, v in moment.items()]), places, [cluster])
    cells = stats.select("at", F.posexplode(F.array(*[F.col(k).cast("double") for k in moment])).alias("key", "value"))
    pick = lambda i: F.max(F.when(F.col("key") == i, F.col("value")))
    sums = resampled(cells, n, n_boot, seed).groupBy("boot").agg(*[pick(i).alias(k) for i, k in enumerate(moment)])

    def r(c: str):
        cov = F.col(f"y{c}") - F.col("y") * F.col(c) / F.col("n")
        vy, vc = F.col("yy") - F.col("y") * F.col("y") / F.col("n"), F.col(f"{c}2") - F.col(c) * F.col(c) / F.col("n")
        return F.when((vy > 1e-9) & (vc > 1e-9), cov / F.sqrt(vy * vc)).otherwise(0.0)

    d = sums.select((r("head") - r("base")).alias("d"))
    out = d.agg(F.avg("d").alias("delta"), F.percentile("d", F.lit((1 - ci) / 2)).alias("lo"), F.percentile("d", F.lit((1 + ci) / 2)).alias("hi"), F.avg((F.col("d") <= 0).cast("double")).alias("p"), F.count("*").alias("n_boot"))
    return out


def temperature(df: DataFrame, keys: list[str], low: float = 0.5, high: float = 10.0, step: float = 0.05) -> DataFrame:
    """Temperature with the least mean negative log-likelihood over a grid; of equals the first. Rows: probs (array), y (index)."""
    n = round((high - low) / step) + 1
    grid = df.sparkSession.range(n).select((F.lit(low) + F.col("id") * step).alias("t"))
    counted = df.groupBy(*keys, "probs", "y").agg(F.count("*").alias("n"))  # equal rows meet the grid once
    logp = counted.withColumn("__z", F.transform("probs", lambda x: F.ln(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)))))
    each = logp.join(F.broadcast(grid))  # a fixed grid of n rows
    top = F.array_max("__z") / F.col("t")
    total = F.aggregate("__z", F.lit(0.0), lambda s, z: s + F.exp(z / F.col("t") - top))
    nll = F.ln(total) + top - F.get("__z", F.col("y")) / F.col("t")
    mean = each.groupBy(*keys, "t").agg((F.sum(nll * F.col("n")) / F.sum(F.when(nll.isNotNull(), F.col("n")))).alias("nll"))
    return mean.groupBy(*keys).agg(F.min_by("t", F.struct(F.round("nll", 9), F.col("t"))).alias("temperature"), F.min(F.round("nll", 9)).alias("nll"))


def risk_coverage(df: DataFrame, keys: list[str], levels: tuple[float, ...] = (0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Accuracy of the most confident share of rows: at least one row, ties by row_id, null confidences last."""
    rows = df.select(*keys, "correct", F.col("conf").isNull().alias("__none"), (-F.col("conf")).alias("__down"), "row_id")
    placed = ranks.positions(rows, keys, ["__none", "__down", "row_id"], "i")
    sized = with_size(placed, df, keys)
    kept = sized.select("*", F.explode(F.array(*[F.lit(x) for x in levels])).alias("coverage")).where(F.col("i") < F.greatest(F.floor(F.col("coverage") * F.col("__n")), F.lit(1)))
    return kept.groupBy(*keys, "coverage").agg(F.count("*").alias("n_kept"), F.avg(F.col("correct").cast("double")).alias("accuracy"))


def with_size(rows: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the number ``__n`` of rows of their group in ``of``."""
    size = of.groupBy(*keys).agg(F.count("*").alias("__n"))
    return ranks.matched(rows, size, keys) if keys else rows.crossJoin(F.broadcast(size))  # one row


def spread_picks(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """k rows evenly spaced over the sorted order."""
    placed = with_size(ranks.positions(df, keys, order, "position"), df, keys)
    want = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (F.col("__n") - 1) / float(max(k - 1, 1))).cast("long"))
    return placed.where(F.array_contains(want, F.col("position"))).drop("__n")


def percentile_block(df: DataFrame, keys: list[str], length: str) -> DataFrame:
    """n, mean, max, truncated percentiles and shares beyond 128 and 256."""
    at = lambda q: F.floor(F.percentile(F.col(length), F.lit(q))).cast("long")
    over = lambda n: F.round(F.avg((F.col(length) > n).cast("double")) * 100, 2)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(length), 2).alias("mean"), F.max(length).cast("long").alias("max"), at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"), over(128).alias("pct_over_128"), over(256).alias("pct_over_256")
    )


def ladder(p99):
    """The smallest rung of 128, 256, 384 that holds a length, else 512."""
    return F.when(p99 <= 128, 128).when(p99 <= 256, 256).when(p99 <= 384, 384).otherwise(512)


def summary(df: DataFrame, tokens) -> DataFrame:
    """Questions, answers, mean length, score range, usual domain and splits of each dataset."""
    per = df.groupBy("dataset").agg(
        F.count_distinct("question_id").alias("n_questions"), F.count("*").alias("n_answers"), F.floor(F.avg(tokens)).cast("long").alias("mean_tokens"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.array_join(F.array_sort(F.collect_set("split")), ",").alias("splits")
    )
    from .splits import mode

    return per.join(mode(df, ["dataset"], "domain", "domain").drop("n_mode"), "dataset")
