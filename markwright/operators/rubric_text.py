"""Similarity of an answer to each sentence of its reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def sentence_similarities(v: DataFrame) -> DataFrame:
    """row_id, pos, concept, similarity: dice of the token sets of the answer and each reference sentence.

    An encoder's cosine replaces it where one is available; the columns are the same.
    """
    parts = v.select("row_id", F.array_distinct("s_tok").alias("s"), F.posexplode(tx.sentences(F.col("r_enc"))).alias("pos", "concept"))
    return parts.select("row_id", "pos", "concept", F.coalesce(tx.dice(F.col("s"), F.array_distinct(tx.feature_tokens(F.col("concept")))), F.lit(0.0)).alias("similarity"))


def similarities(tokens: Column, reference: Column) -> Column:
    """The similarities of ``sentence_similarities`` as an array, in order of the reference's sentences."""
    return F.get(F.transform(F.array(F.array_distinct(tokens)), lambda s: F.transform(tx.sentences(reference), lambda x: F.coalesce(tx.dice(s, F.array_distinct(tx.feature_tokens(x))), F.lit(0.0)))), F.lit(0))
