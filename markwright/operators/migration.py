"""Folds of a stored table replaced in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import scratch
from . import splits, validation


def migrate_folds(spark: SparkSession, canonical: str, views: list[str], datasets: list[str], k: int = 5) -> DataFrame:
    """Gives the datasets' rows new grouped folds in every view, a Parquet table partitioned by ``dataset``: question_id -> fold of each dataset.

    Folds come from the ``canonical`` view. First every view is checked: it has to hold the canonical rows of those
    datasets, each once and under the same question, or nothing is written (ValueError). Then each view's new rows are
    staged beside it, and last the staged rows replace these datasets' partitions, and no others, by dynamic overwrite.
    A run that is lost before that leaves the view as it was; one that is lost in it can be repeated.
    """
    wanted = F.col("dataset").isin(datasets)
    base = spark.read.parquet(canonical).where(wanted)
    keys = ["dataset", "row_id", "question_id"]
    for view in views:
        validation.assert_aligned(base.select(F.struct(*keys).alias("row_id")), spark.read.parquet(view).where(wanted).select(F.struct(*keys).alias("row_id")))
    path = scratch(spark, "folds")
    splits.grouped(base, ["dataset"], k).write.parquet(path)
    folds = spark.read.parquet(path)
    for view in views:
        old = spark.read.parquet(view)
        new = old.where(wanted).drop("fold").join(folds.select("dataset", "question_id", F.col("fold").cast("int").alias("fold")), ["dataset", "question_id"])
        staged = scratch(spark, "staged-view")
        new.select(*old.columns).write.partitionBy("dataset").parquet(staged)
        ready = spark.read.schema(old.schema).parquet(staged)
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(view)
    return folds
