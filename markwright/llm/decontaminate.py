"""Benchmark decontamination with SimHash windows (operator 10), DataFrame functions only.

1. A document's 5-word shingles meet those of the benchmark items. A hit at
   document word p and item word q puts an item-sized window at p - q (moved
   inside the text). A window without a shared shingle has similarity 0, so
   only such anchored windows are fingerprinted.
2. A window's 64-bit SimHash sums its words' hash bits. Items enter an index of
   4 blocks of 16 bits, each also under its 696 values at distance 1 to 3: of two
   fingerprints within 15 bits one block differs in at most 3, so the block join
   finds every item of that size within the radius, and a window meets one item
   in 24 by chance.
3. Exact similarity verifies: 5-word shingles weighted by how often they
   occur, sum of minima over sum of maxima, at least ``threshold``.

Texts are lower-cased; words are ``[^\\x20\\x09-\\x0D]+``; items shorter than
five words count as one shingle. Null or blank texts have no words and match
nothing; null ids are kept (a null doc_id or item_id is reported as such). Rows
that repeat an id count as one document with several texts; the best match is
reported. Equal matches: the smallest start. Extra columns are ignored. Empty
tables give no matches.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SIZE = 5
BLOCKS, WIDTH, PROBE = 4, 16, 3
RADIUS = BLOCKS * (PROBE + 1) - 1  # guaranteed by blocks of distance PROBE
MASKS = [sum(1 << i for i in bits) for k in range(PROBE + 1) for bits in itertools.combinations(range(WIDTH), k)]
BROADCAST_BYTES = 32 << 20  # a table is broadcast only while it takes no more


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")


def shingles(name: str, size: int) -> Column:
    """Hashes of the ``size``-word shingles of array column ``name``, in order."""
    parts = ", ".join(f"{name}[i + {j}]" for j in range(size))
    return F.expr(f"CASE WHEN size({name}) >= {size} THEN transform(sequence(0, size({name}) - {size}), i -> xxhash64({parts})) ELSE array() END")


def sorted_shingles(name: str) -> Column:
    """The shingles that array column ``name`` is compared by, sorted."""
    short = F.when(F.size(name) > 0, F.array(F.xxhash64(name))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(name) < SIZE, short).otherwise(F.array_sort(shingles(name, SIZE)))


def bag(name: str) -> Column:
    """Sorted shingles (array column ``name``) numbered by occurrence, so that set functions count weights."""
    return F.expr(f"transform({name}, (x, k) -> struct(x AS h, k - CAST(array_position({name}, x) AS INT) AS n))")


def simhash(name: str) -> Column:
    """64-bit SimHash of a word array: bit i is set where more than half of the words' hashes have it."""
    return F.expr(
        f"aggregate(sequence(0, 63), struct(0L AS f, transform({name}, w -> xxhash64(w)) AS h),"
        " (a, i) -> struct(a.f | shiftleft(CASE WHEN 2 * aggregate(a.h, 0, (n, x) -> n + CAST(shiftrightunsigned(x, i) & 1 AS INT)) > size(a.h) THEN 1L ELSE 0L END, i) AS f, a.h AS h),"
        " a -> a.f)"
    )


def _few(df: DataFrame, row_bytes: Column | int = 64) -> DataFrame:
    """``df``, marked for broadcast if its rows take few bytes in memory; otherwise joins shuffle."""
    took = df.agg(F.coalesce(F.sum(F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes), F.lit(0))).first()[0]
    return F.broadcast(df) if took <= BROADCAST_BYTES else df.hint("merge")


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, hamming, similarity: the best window of each contaminated document and item."""
    if radius > RADIUS:
        raise ValueError(f"blocks guarantee a radius of {RADIUS} bits")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    items = written(items.select("item_id", "w", F.size("w").alias("m"), simhash("w").alias("item_fp"), sorted_shingles("w").alias("item_sh")).distinct(), "items")
    least = [r["m"] for r in items.where(f"m < {SIZE}").select("m").distinct().collect()]  # at most four
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))

    anchors = None
    for k in (SIZE, *sorted(least)):
        own = items.where(f"m >= {SIZE}" if k == SIZE else f"m = {k}")
        own = own.select("m", F.posexplode(shingles("w", k)).alias("q", "h")).distinct()
        hits = docs.select("doc_id", F.size("w").alias("n"), F.posexplode(shingles("w", k)).alias("p", "h")).join(_few(written(own, "item-shingles")), "h")
        part = hits.select("doc_id", "n", "m", F.greatest(F.lit(0), F.least(F.col("p") - F.col("q"), F.col("n") - F.col("m"))).alias("start"))
        anchors = part if anchors is None else anchors.union(part)
    anchors = written(anchors.distinct(), "anchors")

    where = F.expr("doc_id <=> d and size(w) = n")
    windows = docs.join(_few(anchors.withColumnRenamed("doc_id", "d")), where).select("doc_id", "m", "start", F.slice("w", F.col("start") + 1, F.col("m")).alias("win"))
    windows = windows.select("doc_id", "m", "start", simhash("win").alias("fp"), sorted_shingles("win").alias("win_sh"))
    windows = written(windows.repartition(F.col("doc_id"), F.col("start")), "windows")

    block = lambda fp: f"transform(sequence(0, {BLOCKS - 1}), b -> struct(b AS b, CAST(shiftrightunsigned({fp}, {WIDTH} * b) & {2**WIDTH - 1} AS INT) AS v))"
    index = items.select("m", "item_id", "item_fp", F.explode(F.expr(block("item_fp"))).alias("k"))
    masks = F.lit(MASKS).cast("array<int>")
    index = index.select("m", "item_id", "item_fp", "k.b", F.explode(F.transform(masks, lambda x: x.bitwiseXOR(F.col("k.v")))).alias("v"))
    near = windows.select("doc_id", "m", "start", "fp", F.explode(F.expr(block("fp"))).alias("k")).select("doc_id", "m", "start", "fp", "k.b", "k.v")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = near.join(_few(written(index, "block-index")), ["m", "b", "v"]).where(distance <= radius)
    near = near.select("doc_id", "m", "start", "fp", "item_id", "item_fp", distance.cast("int").alias("hamming")).distinct()

    w = windows.select(F.col("doc_id").alias("d"), F.col("m").alias("m2"), F.col("start").alias("s2"), F.col("fp").alias("f2"), "win_sh")
    full = near.join(w, F.expr("doc_id <=> d and m = m2 and start = s2 and fp = f2"))
    known = items.select(F.col("item_id").alias("i2"), F.col("m").alias("m3"), F.col("item_fp").alias("f3"), "item_sh")
    full = full.join(_few(known, 64 + 8 * F.size("item_sh")), F.expr("item_id <=> i2 and m = m3 and item_fp = f3"))
    full = full.withColumns({"win_bag": bag("win_sh"), "item_bag": bag("item_sh")})
    both = F.size(F.array_intersect("win_bag", "item_bag"))
    full = full.withColumn("similarity", both / (F.size("win_bag") + F.size("item_bag") - both)).where(F.col("similarity") >= threshold)
    best = full.groupBy("doc_id", "item_id").agg(F.min(F.struct(-F.col("similarity"), "start", F.col("m").alias("n_words"), "hamming", "similarity")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.start").alias("start_word"), "best.n_words", "best.hamming", "best.similarity")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; null ids stay, columns stay as they are."""
    found = matches(docs, benchmark, **options).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(written(found, "hits"), "doc_id", "left_anti").select(*docs.columns)
