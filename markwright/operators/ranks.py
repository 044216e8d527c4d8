"""Exact ranks and running sums of groups of any size, without a window over a group.

Two levels: rows are range-partitioned by (group, order), so a group lies in
consecutive partitions and equal values in one. A window within (partition,
group) gives what lies before a row there; what the group's earlier partitions
hold is added. Those offsets are one row a partition at most, as only the first
group of a partition can have begun in an earlier one, and so may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import scratch

PART = "__part"


def placed(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``df`` in ranges of (group, order), written once so that every later read sees the same ranges; ``__part`` numbers them."""
    spark = df.sparkSession
    ranges = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *group, *order)
    path = scratch(spark, "ranges")
    ranges.withColumn(PART, F.spark_partition_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def offsets(local: DataFrame, group: list[str], totals: dict[str, Column]) -> DataFrame:
    """What earlier partitions hold of a group, for groups that began in one: at most a row a partition."""
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    each = local.groupBy(PART, *group).agg(*[v.alias(k) for k, v in totals.items()])
    return each.select(PART, *group, *[F.sum(k).over(before).alias(f"__{k}_before") for k in totals]).where(F.coalesce(*[F.col(f"__{k}_before") for k in totals]).isNotNull())


def added(local: DataFrame, group: list[str], over: DataFrame) -> DataFrame:
    return matched(local, F.broadcast(over), [PART, *group], "left").drop(PART)


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys match, with the columns ``on`` once."""
    names = {c: f"__{i}_key" for i, c in enumerate(on)}
    same = F.lit(True)
    for c, k in names.items():
        same = same & F.col(c).eqNullSafe(F.col(k))
    return left.join(right.withColumnsRenamed(names), same, how).drop(*names.values())


def running(df: DataFrame, group: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` plus, for each (name, column) of ``sums``, that column's sum over the rows of the same group that come before.

    Rows are to be distinct in (group, order): count ties first. Null groups are one group; null values come first.
    """
    staged = placed(df, group, order)
    earlier = Window.partitionBy(PART, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = staged.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(k) for k, c in sums.items()])
    out = added(local, group, offsets(staged, group, {k: F.sum(c) for k, c in sums.items()}))
    return out.select(*df.columns, *[(F.col(k) + F.coalesce(f"__{k}_before", F.lit(0))).alias(k) for k in sums])


def dense_rank(df: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """``df`` plus the dense rank (long, from 1) of ``order`` in its group; nulls rank first."""
    staged = placed(df, group, [order])
    local = staged.withColumn(name, F.dense_rank().over(Window.partitionBy(PART, *group).orderBy(order)).cast("long"))
    distinct = F.countDistinct(order) + F.max(F.col(order).isNull().cast("long"))  # by partial sums, without the window
    out = added(local, group, offsets(staged, group, {name: distinct}))
    return out.select(*df.columns, (F.col(name) + F.coalesce(f"__{name}_before", F.lit(0))).alias(name))


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` plus each row's 0-based place in its group (long). Rows equal in ``order`` take places in no given order."""
    return running(df.withColumn("__one", F.lit(1).cast("long")), group, order, {name: "__one"}).drop("__one")


def average_ranks(df: DataFrame, group: list[str], value: str, name: str = "rank") -> DataFrame:
    """One row for each (group, value) with its number of rows ``n`` and the average rank of its ties; nulls are left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return running(counted, group, [value], {"__less": "n"}).select(*group, value, "n", (F.col("__less") + (F.col("n") + 1) / 2.0).alias(name))


def rank_sums(counts: DataFrame, group: list[str], x: str, y: str, n: str) -> DataFrame:
    """Spearman's rho of (x, y) pairs that occur ``n`` times: group, n, spearman (null if a side is constant). Values are compared as doubles.

    Both sides' distinct values are ranked in one pass, ties averaged; ranks are centred, so sums stay exact enough for large groups.
    """
    pairs = counts.select(*group, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.col(n).alias("__n")).where("__x is not null and __y is not null")
    sides = F.explode(F.array(F.struct(F.lit(0).alias("__side"), F.col("__x").alias("__v")), F.struct(F.lit(1).alias("__side"), F.col("__y").alias("__v")))).alias("s")
    values = pairs.select(*group, "__n", sides).select(*group, "__n", "s.*").groupBy(*group, "__side", "__v").agg(F.sum("__n").alias("__m"))
    ranked = running(values, [*group, "__side"], ["__v"], {"__less": "__m"}).select(*group, "__side", "__v", (F.col("__less") + (F.col("__m") + 1) / 2.0).alias("__rank"))
    side = lambda i, v, r: ranked.where(F.col("__side") == i).select(*group, F.col("__v").alias(v), F.col("__rank").alias(r))
    both = matched(matched(pairs, side(0, "__x", "__a"), [*group, "__x"]), side(1, "__y", "__b"), [*group, "__y"])
    size = pairs.groupBy(*group).agg(F.sum("__n").alias("__total"))
    sized = matched(both, size, group) if group else both.crossJoin(F.broadcast(size))  # one row
    middle = (F.col("__total") + 1) / 2.0
    w, a, b = F.col("__n").cast("double"), F.col("__a") - middle, F.col("__b") - middle
    sums = sized.groupBy(*group).agg(F.sum("__n").alias("n"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    return sums.select(*group, "n", F.when((F.col("n") >= 2) & (F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("spearman"))
