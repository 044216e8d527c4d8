"""A five-stage corpus pipeline over ``documents``; part of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and works on every document its
predecessor kept. All but the last return the columns of ``documents``.
Stages with Python in them set the session to hand it at most ``ROWS`` rows at a
time, unless it has a smaller setting, and leave it so: what a stage returns runs
when its caller writes it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markwright.llm import common, decontaminate, jaccard_join, language_id, line_dedup, piece_codec

ROWS = 2000  # texts that go to Python together; 10,000 are some 20 MB, which an executor holds several times for each task

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(stage: Stage) -> Stage:
    """``stage``, with texts going to Python at most ``ROWS`` at a time."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.keep_rows_a_batch(spark, ROWS)
        return stage(spark, docs, sf_dir)

    return run


@small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no learned language or in another one than their label says; an unlabelled one only needs a language.

    Where rows repeat an id, one acceptable row keeps all of them; documents without an id stay.
    """
    found = common.written(language_id.identify(docs.select("doc_id", "text", "lang")).select("doc_id", "lang_pred"), "languages")
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").join(found, "doc_id")
    good = (F.col("lang_pred") != "und") & F.coalesce(F.col("lang_pred") == F.col("lang"), F.lit(True))
    rejected = both.groupBy("doc_id").agg(F.max(good).alias("good")).where("not good").select("doc_id")
    return jaccard_join.without(docs, rejected)


@small_batches
def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: that with the smallest doc_id.

    Null and empty texts link with nothing and stay, as do rows without an id. Rows that repeat an id are one document
    with the links of all their texts: they stay or go together. Columns of any name pass through; an empty table stays one.
    """
    return jaccard_join.keep_one(docs)


@small_batches
def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated units; a document with nothing left goes.

    Documents of empty or blank text go, those of null text stay. The first occurrence by doc_id stays, a null doc_id ranks
    last; rows that repeat an id are told apart by a digest of their text. Columns of any name pass through, but for
    ``n_chars``, which is counted anew.
    """
    left = line_dedup.strip(docs)
    counted = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left
    return counted.where(F.col("text").isNull() | F.col("text").rlike(r"\S"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and blank texts hold none and stay, as do rows without an id. Rows that repeat an id go together if any of their
    texts has a passage. An empty benchmark or an empty table takes nothing away. Other columns pass through.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left.

    Null and empty texts have no ids. Each row is encoded for itself, so repeated and null ids change nothing. Columns named
    ids, n_tokens or round_trip, in any case, are replaced; others pass through.
    """
    return piece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), text=False)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_near_duplicates),
    ("substring dedup", dedup_substrings),
    ("benchmark decontamination", decontaminate_benchmark),
    ("SentencePiece encoding", encode_pieces),
]

#: Stages hash and segment in ways SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, f"stage-{i}")
    return docs
