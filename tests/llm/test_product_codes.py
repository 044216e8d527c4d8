"""Operator 11 against plain Lloyd with all distances."""

import hashlib

import numpy as np
import pyarrow.parquet as pq

from markwright.llm import product_codes


def brute(rows):
    kept = [(i, [x for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    points = np.floor(np.array([v for _, v, _ in kept]) * 256).astype(np.int64)
    size = points.shape[1] // 16
    code, error, books = np.zeros((len(kept), 16), int), np.zeros(len(kept), int), []
    for p in range(16):
        own = points[:, p * size : (p + 1) * size]
        book = own[:64].copy()
        for r in range(3):
            far = ((own[:, None] - book) ** 2).sum(-1)
            near = far.argmin(1)
            for e in set(near.tolist()) if r < 2 else ():
                mine = own[near == e]
                book[e] = mine.sum(0) // len(mine)
        code[:, p] = near
        error += far.min(1)
        books.append(book)
    total = {}
    for (_, _, label), e in zip(kept, error, strict=True):
        total[label] = total.get(label, 0) + int(e)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in c), int(e), total[label], sha) for (i, _, label), c, e in zip(kept, code, error, strict=True)), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_plain_lloyd(spark):
    rows = [tuple(r.values()) for r in pq.read_table("/root/testdata/sf0.01/embeddings.parquet").select(["vec_id", "embedding", "label"]).to_pylist()]
    odd = [(3, None, 1), (7, rows[0][1][:-1] + [None], 2), (8, [float("nan")] * 64, None), (9, [float("-inf")] + [0.0] * 63, 1), rows[4], (None, rows[5][1], None), (2, [0.0] * 64, None)]
    assert result(product_codes.compressed(table(spark, rows + odd).repartition(3))) == brute(rows + odd)


def test_ties_few_values_and_few_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) / 256 for x in rng.integers(-2, 3, 32)], i % 3 or None) for i in range(700)]
    assert result(product_codes.compressed(table(spark, rows))) == brute(rows)
    assert result(product_codes.compressed(table(spark, rows[:20]))) == brute(rows[:20])


def test_filtering_equals_all_distances_in_one_block():
    rng = np.random.default_rng(6)
    for n, d, spread in ((1, 4, 9), (40, 1, 3), (5000, 4, 200), (3000, 2, 5)):
        points = rng.integers(-spread, spread + 1, (n, d)).astype(np.int32)
        entries = rng.integers(-spread, spread + 1, (64, d)).astype(np.int64)
        codes, sums, counts = product_codes.assign(points, product_codes.tree(points), entries)
        near = ((points[:, None].astype(np.int64) - entries) ** 2).sum(-1).argmin(1)
        assert (codes == near).all() and (counts == np.bincount(near, minlength=64)).all()
        assert (sums == np.stack([points[near == e].sum(0) for e in range(64)])).all()


def test_empty_and_other_lengths(spark):
    assert product_codes.compressed(table(spark, [])).collect() == []
    assert product_codes.compressed(table(spark, [(1, [1.0] * 7, 1), (2, [], 1)])).collect() == []
    got = product_codes.compressed(table(spark, [(1, [1.0] * 7, 1), (2, [0.5] * 16, 1), (3, [0.5] * 32, 1)])).collect()
    assert [(r.vec_id, r.code, r.error) for r in got] == [(2, "00" * 16, 0)]
