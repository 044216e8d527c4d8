"""A stored table of text vectors by model, so that each text is encoded once over all runs.

A model's folder holds batches, a batch holds buckets of text digests. A writer stages its batch under a name that
readers skip and renames it as a whole: a lost writer leaves nothing visible, and writers at the same time don't
meet. Where two of them encoded the same text, either vector is taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path in its terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _children(spark: SparkSession, path: str, prefix: str) -> list[str]:
    fs, at = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().startswith(prefix)] if fs.exists(at) else []


def folder(root: str, model: str) -> str:
    return f"{root.rstrip('/')}/{quote(model, safe='')}"


def bucket(digest: str):
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int") % BUCKETS


def keyed(texts: DataFrame) -> DataFrame:
    """``texts`` (text) with the 128-bit ``digest`` and its ``bucket``; null and blank texts go."""
    return texts.where("trim(text) <> ''").withColumn("digest", F.md5("text")).withColumn("bucket", bucket("digest"))


def lookup(spark: SparkSession, root: str, model: str, keys: DataFrame) -> DataFrame | None:
    """(digest, vector) of the stored ones among ``keys`` (digest, bucket); None if the model has none stored.

    Only this model's folder is listed, and in it the buckets that the keys have (64 numbers at most reach the driver).
    """
    at = folder(root, model)
    if not _children(spark, at, "batch="):
        return None
    touched = [r.bucket for r in keys.select("bucket").distinct().collect()]
    stored = spark.read.parquet(at).where(F.col("bucket").isin(touched))
    return stored.join(keys.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.any_value("vector").alias("vector"))


def publish(spark: SparkSession, root: str, model: str, vectors: DataFrame) -> bool:
    """Add ``vectors`` (digest, bucket, vector) as one batch; nothing is added if there are no rows (False)."""
    at, name = folder(root, model), uuid.uuid4().hex
    staged = f"{at}/_staged-{name}"
    vectors.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(staged)
    fs, source = _files(spark, staged)
    if not _children(spark, staged, "bucket="):
        fs.delete(source, True)
        return False
    if not fs.rename(source, _files(spark, f"{at}/batch=b{name}")[1]):
        raise OSError(f"could not publish {staged}")
    return True


def compact(spark: SparkSession, root: str, model: str) -> None:
    """One batch in place of all that are there now; a reader that lists it between the two steps sees texts twice, which does no harm.

    A reader that listed the old batches before may not find their files any more: run it while no other run reads the model.
    """
    at = folder(root, model)
    old = _children(spark, at, "batch=")
    if len(old) < 2:
        return
    rows = spark.read.option("basePath", at).parquet(*[f"{at}/{b}" for b in old])
    publish(spark, root, model, rows.groupBy("digest", "bucket").agg(F.any_value("vector").alias("vector")))
    for b in old:
        fs, path = _files(spark, f"{at}/{b}")
        fs.delete(path, True)


def encode_stored(df: DataFrame, columns: list[str], encode: Callable[[DataFrame], DataFrame], model: str, root: str) -> DataFrame:
    """``df`` with ``<column>_vec`` of each column, and ``<column>_known``: whether its vector was stored before this call.

    ``encode`` maps a frame (text) to (text, vector) and sees each text once that isn't stored yet; what it gives is
    stored. Null and blank texts have a null vector and aren't known. Columns named like the new ones are replaced.
    """
    spark = df.sparkSession
    texts = keyed(df.select(F.explode(F.array(*columns)).alias("text"))).groupBy("digest", "bucket").agg(F.any_value("text").alias("text"))
    before = lookup(spark, root, model, texts)
    missing = texts if before is None else texts.join(before, "digest", "left_anti")
    found = encode(missing.select("text"))
    publish(spark, root, model, keyed(found).select("digest", "bucket", "vector"))
    stored = lookup(spark, root, model, texts)
    out = df.drop(*[f"{c}_{x}" for c in columns for x in ("vec", "known")])
    if stored is None:
        return out.withColumns({f"{c}_vec": F.lit(None).cast(found.schema["vector"].dataType) for c in columns} | {f"{c}_known": F.lit(False) for c in columns})
    old = stored.withColumn("known", F.lit(False)) if before is None else stored.join(before.select("digest", F.lit(True).alias("known")), "digest", "left")
    for c in columns:
        named = old.select(F.col("digest").alias("__key"), F.col("vector").alias(f"{c}_vec"), F.coalesce("known", F.lit(False)).alias("__known"))
        out = out.join(named, F.md5(F.col(c)) == F.col("__key"), "left").withColumn(f"{c}_known", F.coalesce("__known", F.lit(False))).drop("__key", "__known")
    return out
