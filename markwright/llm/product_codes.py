"""Vector code compression (operator 11): product-quantisation codes by filtering Lloyd.

Vectors of integers floor(256 * x) are cut into 16 parts. Each block of up to
``BLOCK`` vectors of a partition gets a kd-tree for every part position, whose
nodes cache bounding box, sum and count; the trees are written once in the
shared folder and read by every round. A round sends the codebooks (16 x 64
entries, a fixed size) to the blocks. There a node's box eliminates the entries
that are nowhere in it the nearest; where one is left, the whole subtree is
assigned by its cached sum and count, else the search goes on in the children
and ends among a leaf's points. Blocks return sums and counts per (part, entry),
which Spark adds up; 1024 rows reach the driver, whatever the table's size.
All arithmetic is on integers, so results are exact and the same on any number
of partitions; ties go to the lower entry.

Edge cases. Vectors that are null, or hold null or non-finite components, go.
The kept vector of the smallest vec_id whose length is a multiple of 16 sets the
length; vectors of another length go as well. Null vec_ids come last among those
that start the codebooks; equal ones go by their components. With fewer than 64
vectors the codebooks are as many entries long. Components beyond 2^27 / 256 in
absolute value count as that. Repeated rows are coded each on its own. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructType

from .common import written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK = 8192  # vectors of a kd-tree
LEAF = 16  # points of a leaf, about
LARGEST = 1 << 27


def levels(n: int) -> int:
    return max(0, int(np.log2(max(1, n) / LEAF)))


def tree(points: np.ndarray) -> dict:
    """A balanced kd-tree over n x d integers: ``order`` of the points and, level by level, each node's box, sum and count."""
    n, d = points.shape
    order, out = np.arange(n), {"lo": [], "hi": [], "sum": [], "start": []}
    for level in range(levels(n) + 1):
        start = (np.arange((1 << level) + 1) * n) >> level
        at = points[order]
        lo, hi = np.minimum.reduceat(at, start[:-1]), np.maximum.reduceat(at, start[:-1])
        for k, v in (("lo", lo), ("hi", hi), ("sum", np.add.reduceat(at.astype(np.int64), start[:-1])), ("start", start)):
            out[k].append(v)
        node = np.repeat(np.arange(1 << level), np.diff(start))
        widest = (hi - lo).argmax(1)[node]
        order = order[np.lexsort((at[np.arange(n), widest], node))]
        if level == levels(n):
            out["order"] = order.astype(np.int32)  # the last sort is within leaves
    return out


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def assign(points: np.ndarray, kd: dict, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each point, sum and count of each entry's points): the filtering algorithm, a level of the tree at a time."""
    k, d = entries.shape
    codes, sums, counts = np.zeros(len(points), np.int64), np.zeros((k, d), np.int64), np.zeros(k, np.int64)
    order, own = kd["order"], np.arange(k)
    node, left = np.zeros(1, np.int64), np.ones((1, k), bool)
    for level, start in enumerate(kd["start"]):
        lo, hi = kd["lo"][level][node].astype(np.int64)[:, None], kd["hi"][level][node].astype(np.int64)[:, None]
        far = np.where(left, squared(lo + hi, 2 * entries), np.iinfo(np.int64).max)
        best = far.argmin(1)  # nearest to the middle; a tie goes to the lower one
        star = entries[best][:, None]
        corner = np.where(entries > star, hi, lo)  # where an entry does best against the star
        lead = squared(entries, corner) - squared(star, corner)
        left &= (lead < 0) | ((lead == 0) & (own < best[:, None]))
        left[np.arange(len(node)), best] = True
        whole = left.sum(1) == 1
        np.add.at(sums, best[whole], kd["sum"][level][node[whole]])
        np.add.at(counts, best[whole], np.diff(start)[node[whole]])
        for i, entry in zip(node[whole], best[whole], strict=True):
            codes[order[start[i] : start[i + 1]]] = entry
        node, left = node[~whole], left[~whole]
        if not len(node):
            break
        if level + 1 < len(kd["start"]):
            node, left = np.repeat(node * 2, 2), np.repeat(left, 2, axis=0)
            node[1::2] += 1
            continue
        size = np.diff(start)[node]
        at = order[np.concatenate([np.arange(start[i], start[i + 1]) for i in node])]
        of = np.repeat(np.arange(len(node)), size)
        nearest = np.where(left[of], squared(points[at].astype(np.int64)[:, None], entries), np.iinfo(np.int64).max).argmin(1)
        codes[at] = nearest
        np.add.at(sums, nearest, points[at].astype(np.int64))
        np.add.at(counts, nearest, 1)
    return codes, sums, counts


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    values = np.asarray(vectors.flatten().cast(pa.float64())).reshape(-1, width)
    return np.clip(np.floor(values * 256), -LARGEST, LARGEST).astype(np.int32)


def parts_of(points: np.ndarray, p: int) -> np.ndarray:
    size = points.shape[1] // PARTS
    return points[:, p * size : (p + 1) * size]


def _built(width: int):
    def run(batches):
        for batch in (whole.slice(i, BLOCK) for whole in batches for i in range(0, whole.num_rows, BLOCK)):
            points = integers(batch.column("vector"), width)
            data = pickle.dumps((points, [tree(parts_of(points, p)) for p in range(PARTS)]), protocol=5)
            one = pa.array([0, batch.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, batch.column(c)) for c in ("vec_id", "label")] + [pa.array([data], pa.binary())], names=["vec_id", "label", "trees"])

    return run


def _summed(codebooks: np.ndarray):
    def run(batches):
        sums = np.zeros(codebooks.shape, np.int64)
        counts = np.zeros(codebooks.shape[:2], np.int64)
        for batch in batches:
            for data in batch.column("trees"):
                points, trees = pickle.loads(data.as_buffer())
                for p, kd in enumerate(trees):
                    _, s, n = assign(parts_of(points, p), kd, codebooks[p])
                    sums[p] += s
                    counts[p] += n
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "sums": pa.array(list(sums[p, e]), pa.list_(pa.int64())), "n": counts[p, e]})

    return run


def _coded(codebooks: np.ndarray):
    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column("trees")):
                points, trees = pickle.loads(data.as_buffer())
                codes = np.empty((len(points), PARTS), np.uint8)
                error = np.zeros(len(points), np.int64)
                for p, kd in enumerate(trees):
                    own = parts_of(points, p)
                    codes[:, p] = assign(own, kd, codebooks[p])[0]
                    error += squared(own.astype(np.int64), codebooks[p][codes[:, p]])
                text = codes.tobytes().hex()
                code = [text[j : j + 2 * PARTS] for j in range(0, len(text), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id")[i].values, batch.column("label")[i].values, pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of every kept vector, the final codebooks: part x entry x component)."""
    finite = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    kept = vectors.selectExpr("cast(vec_id as long) as vec_id", "label", "cast(embedding as array<double>) as vector", "embedding").where(finite).where(f"size(vector) > 0 and size(vector) % {PARTS} = 0").drop("embedding")
    out = StructType().add("vec_id", LongType()).add("label", kept.schema["label"].dataType).add("code", StringType()).add("error", LongType())
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector")
    width = next((len(r.vector) for r in first.limit(1).collect()), 0)
    if not width:
        return vectors.sparkSession.createDataFrame([], out), np.zeros((PARTS, 0, 0), np.int64)
    kept = kept.where(F.size("vector") == width)
    seed = first.where(F.size("vector") == width).select("vector").limit(ENTRIES).toArrow()["vector"].combine_chunks()
    start = integers(seed, width).astype(np.int64)
    codebooks = np.stack([parts_of(start, p) for p in range(PARTS)])
    block = StructType().add("vec_id", ArrayType(LongType())).add("label", ArrayType(kept.schema["label"].dataType)).add("trees", BinaryType())
    blocks = written(kept.mapInArrow(_built(width), block), "kd-trees")
    for _ in range(rounds):
        partial = blocks.select("trees").mapInArrow(_summed(codebooks), "part int, entry int, sums array<long>, n long")
        size = width // PARTS
        added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(size)])
        for r in added.collect():  # at most PARTS * ENTRIES rows
            codebooks[r.part, r.entry] = [r[f"s{j}"] // r.n for j in range(size)]
    return blocks.mapInArrow(_coded(codebooks), out), codebooks


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (error summed over equal labels, nulls together) and the digest of the codebooks."""
    coded, codebooks = encode(vectors)
    coded = written(coded, "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("__label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
