from pyspark.sql import functions as F

from markwright.operators import features, protocol, splits
from markwright.schema import TASKS


def test_encode_distinct_uses_its_cache(spark):
    df = spark.createDataFrame([(1, "a b", "c"), (2, "a b", ""), (3, None, "a b"), (4, " ", "d")], "row_id long, s string, r string")
    asked = []

    def encode(texts):
        asked.extend(r.text for r in texts.collect())
        return texts.select("text", F.array(F.length("text").cast("double")).alias("vector"))

    cache = spark.createDataFrame([("m", "c", [9.0]), ("x", "d", [8.0]), ("m", "unused", [7.0])], "model string, text string, vector array<double>")
    both, new = protocol.encode_distinct(df, ["s", "r"], encode, "m", cache)
    got = {r.row_id: (r.s_vec, r.r_vec) for r in both.collect()}
    assert got == {1: ([3.0], [9.0]), 2: ([3.0], None), 3: (None, [3.0]), 4: (None, [1.0])}
    assert set(asked) == {"a b", "d"} and {(r.model, r.text) for r in new.collect()} == {("m", "a b"), ("m", "d")}


def test_calibration_parts(spark):
    rows = [(i, "train" if i < 50 else "test_ud", None if i == 3 else 1.0, i % 5) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, split string, y double, fold int")
    got = {r.row_id: r.part for r in protocol.calibration_parts(df, True, "test_ud").collect()}
    key = lambda i: (i * 7919 + 42) % 2147483647 * 1103515245 + 12345
    train = sorted((i for i in range(50) if i != 3), key=lambda i: (key(i) % 2147483647, i))
    assert [i for i in train if got[i] == "val"] == train[:9] and got[3] is None and all(got[i] == "test" for i in range(50, 60))
    cv = {r.row_id: r.part for r in protocol.calibration_parts(df, False, "").collect()}
    assert (cv[0], cv[1], cv[2], cv[3]) == ("test", "val", "train", None)


def test_bootstrap_against_a_constant_arm(spark):
    rows = [(f"q{i % 6}", i % 3, i % 3 if i % 4 else 0, 1) for i in range(60)]
    df = spark.createDataFrame(rows, "question_id string, y long, head long, base long")
    r = protocol.bootstrap_counts(df, protocol.macro_f1_of_counts, 50).first()
    assert r.degenerate and r.n_boot == 50 and 0 < r.lo <= r.delta <= r.hi <= 1 and r.p == 0


def test_groups_and_tasks():
    names = [*[c for cs in features.BRANCHES.values() for c in cs], *features.NEURAL]
    v = features.variant_columns(names)
    assert len(v) == 10 and v["only_A"] == ["sem_cosine", "sem_abs_diff_mean", "sem_hadamard_mean"] and v["only_D"] == ["neural_score", "neural_pred"]
    assert {c.split("_")[0] for c in v["only_B"]} == {"lex", "len", "tfidf", "neg", "ner"} and len(v["minus_negation"]) == len(names) - 6
    assert TASKS["powergrading"].metrics == ("macro_f1", "accuracy", "qwk") and TASKS["asap_sas"].metrics == ("qwk", "accuracy")


def test_limits_of_an_unkeyed_table(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, "a", 6.0), (3, "b", 3.0), (4, None, None)], "row_id long, dataset string, score double")
    assert sorted((r.row_id, r.bin) for r in splits.binned(df, []).collect()) == [(1, 0), (2, 5), (3, 2), (4, 0)]
    assert sorted((r.row_id, r.bin) for r in splits.binned(df, ["dataset"]).collect()) == [(1, 0), (2, 5), (3, 0), (4, 0)]
