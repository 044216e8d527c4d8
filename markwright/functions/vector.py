"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(u: Column, v: Column) -> Column:
    """Cosine; 0 where either norm is 0."""
    norm = F.sqrt(dot(u, u)) * F.sqrt(dot(v, v))
    return F.when(norm > 0, dot(u, v) / F.nullif(norm, F.lit(0.0))).when(norm.isNotNull(), F.lit(0.0))


def unit(v: Column) -> Column:
    scaled = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"), lambda s: F.transform(v, lambda x: x.cast("double") / F.nullif(F.sqrt(s), F.lit(0.0))))
    return scaled  # the norm is taken once, in the fold's finish


def mean_abs_diff(u: Column, v: Column) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(u).cast("double"), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax_temperature(p: Column, t: Column | float) -> Column:
    """softmax(log(clip(p)) / t) of an array of probabilities, shifted by its maximum."""
    z = F.transform(p, lambda x: F.ln(F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0))) / t)
    e = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def corn_rank(logits: Column) -> Column:
    """Decoded rank: how many leading cumulative products of sigmoids exceed one half."""
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("rank"))
    return F.aggregate(
        logits, start, lambda a, z: F.struct((a["p"] * sigmoid(z)).alias("p"), (a["rank"] + (a["p"] * sigmoid(z) > 0.5).cast("int")).alias("rank")), lambda a: a["rank"]
    )


def coral_rank(logits: Column) -> Column:
    return F.size(F.filter(logits, lambda z: sigmoid(z) > 0.5))


def expected_rank(logits: Column) -> Column:
    return F.aggregate(logits, F.lit(0.0), lambda s, z: s + sigmoid(z))


def log_sigmoid(z: Column) -> Column:
    """ln sigmoid without overflow."""
    return F.least(z, F.lit(0.0)) - F.log1p(F.exp(-F.abs(z)))


def coral_loss(logits: Column, rank: Column) -> Column:
    """Sum of binary cross-entropies of the levels ``rank > k``."""
    terms = F.transform(logits, lambda z, k: F.when(rank > k, -log_sigmoid(z)).otherwise(-log_sigmoid(-z)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def corn_loss(logits: Column, rank: Column) -> Column:
    """Sum over the levels k whose condition ``rank >= k`` holds."""
    terms = F.transform(logits, lambda z, k: F.when(rank < k, F.lit(0.0)).when(rank > k, -log_sigmoid(z)).otherwise(-log_sigmoid(-z)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
