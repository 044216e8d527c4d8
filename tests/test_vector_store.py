"""The vector store: each text encoded once over all runs, other models unread, writers that don't meet, torn batches unseen."""

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from markwright.operators import vector_store as vs


class Encoder:
    """Vectors of a text's length; notes the texts it was given."""

    def __init__(self):
        self.seen = []

    def __call__(self, texts):
        self.seen.append(sorted(r.text for r in texts.collect()))
        return texts.select("text", F.array(F.length("text").cast("double")).alias("vector"))


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "s string, r string")


def test_a_second_run_encodes_nothing_and_other_models_stay_unread(spark, tmp_path):
    root, rows = str(tmp_path), [("one", "three"), ("one", None), (" ", "one"), ("", "four"), (None, None)]
    first, again, other = Encoder(), Encoder(), Encoder()
    vs.encode_stored(frame(spark, ("four", None)), ["s"], other, "an/other", root)
    got = vs.encode_stored(frame(spark, *rows), ["s", "r"], first, "m", root)
    assert first.seen == [["four", "one", "three"]]
    want = [(s, r, [float(len(s))] if s and s.strip() else None, [float(len(r))] if r else None) for s, r in rows]
    key = lambda x: [(v is not None, v) for v in x]
    assert sorted(map(tuple, got.select("s", "r", "s_vec", "r_vec").collect()), key=key) == sorted(want, key=key)
    assert not got.where("s_known or r_known").count()
    back = vs.encode_stored(frame(spark, *rows, ("new", "one")), ["s", "r"], again, "m", root)
    assert again.seen == [["new"]] and {(r.s, r.s_known) for r in back.collect()} == {("one", True), (" ", False), ("", False), (None, False), ("new", False)}
    keys = vs.keyed(spark.createDataFrame([("one",)], "text string"))
    bucket = keys.first().bucket
    files = spark.read.parquet(vs.folder(root, "m")).where(F.col("bucket") == bucket)
    assert "PartitionFilters: [isnotnull(bucket" in files._jdf.queryExecution().toString()
    plan = vs.lookup(spark, root, "m", keys)
    assert [tuple(r) for r in plan.collect()] == [(keys.first().digest, [3.0])] and "an%2Fother" not in plan._jdf.queryExecution().toString()


def test_writers_at_the_same_time_torn_batches_and_compaction(spark, tmp_path):
    root = str(tmp_path)
    texts = [[(f"text {i}", None) for i in range(k * 10, k * 10 + 20)] for k in range(4)]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda rows: vs.encode_stored(frame(spark, *rows), ["s"], Encoder(), "m", root), texts))
    torn = tmp_path / "m" / "_staged-lost" / "bucket=1"
    torn.mkdir(parents=True)
    (torn / "part-0.parquet").write_bytes(b"PAR1")
    keys = vs.keyed(spark.createDataFrame([(f"text {i}",) for i in range(60)], "text string"))
    found = lambda: sorted(tuple(r) for r in vs.lookup(spark, root, "m", keys).join(keys, "digest").select("text", "vector").collect())
    want = sorted((f"text {i}", [float(len(f"text {i}"))]) for i in range(50))
    assert found() == want
    vs.compact(spark, root, "m")
    assert found() == want and len([p for p in (tmp_path / "m").iterdir() if p.name.startswith("batch=")]) == 1
    assert spark.read.parquet(vs.folder(root, "m")).count() == 50


def test_nothing_to_encode_publishes_nothing(spark, tmp_path):
    got = vs.encode_stored(frame(spark, (None, " ")), ["s", "r"], Encoder(), "m", str(tmp_path))
    assert [(r.s_vec, r.s_known, r.r_vec, r.r_known) for r in got.collect()] == [(None, False, None, False)]
    assert vs._children(spark, vs.folder(str(tmp_path), "m"), "batch=") == []
