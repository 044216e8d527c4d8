import math

import pytest
from pyspark.sql import functions as F

from markwright.functions import text as tx
from markwright.operators import features as ft
from markwright.operators import validation

COLUMNS = "row_id long, dataset string, student_answer string, reference_answer string"


def frame(spark, *pairs):
    return spark.createDataFrame([(i, "d", s, r) for i, (s, r) in enumerate(pairs)], COLUMNS)


def test_lexical_values(spark):
    a, b = ft.lexical(ft.views(frame(spark, ("router forward packet", "router forward packet data"), ("router forward packet", "")))).orderBy("row_id").collect()
    assert (a.lex_token_overlap, a.lex_token_overlap_recall, a.lex_token_overlap_prec, a.len_student_tokens) == (0.75, 0.75, 1.0, 3.0)
    assert b.len_student_tokens == 3 and b.len_student_uniq_ratio == 1
    assert [k for k, v in b.asDict().items() if v is None] == list(ft.BRANCHES["lexical"][:9])


def test_negation(spark):
    rows = ft.negation(ft.views(frame(spark, ("router not forward packet", ""), ("router not forward", "router forward")))).orderBy("row_id").collect()
    assert (rows[0].neg_student_count, rows[0].neg_student_present, rows[0].neg_polarity_mismatch) == (3.0, 1.0, None)
    assert (rows[1].neg_polarity_mismatch, rows[1].neg_reference_count) == (1.0, 0.0)


def test_scope_ends_at_punctuation(spark):
    marked = spark.range(1).select(tx.negation_tokens(F.lit("It does not work, the cable is fine")).alias("m")).first().m
    assert marked == ["neg_not", "neg_work", "cable", "fine"]


def test_scope_window_and_conjunction(spark):
    one, two = spark.range(1).select(tx.negation_tokens(F.lit("never one two three four five")).alias("a"), tx.negation_tokens(F.lit("no light but heat")).alias("b")).first()
    assert one == ["neg_never", "neg_one", "neg_two", "neg_three", "neg_four", "five"]
    assert two == ["neg_no", "neg_light", "heat"]


def test_tfidf(spark):
    rows = frame(spark, *[("alpha beta gamma", r) for r in ("alpha beta gamma", "delta epsilon zeta", "")])
    got = [r.tfidf_cosine for r in ft.tfidf_cosine(ft.views(rows), "s_tok", "r_tok").orderBy("row_id").collect()]
    assert got[0] == pytest.approx(1) and got[1:] == [0.0, None]


def test_encoder_view(spark):
    texts = ["The   TCP/IP Router does NOT forward packets!", "ＡＢＣ", None, "  a b "]
    got = [r.e for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.encoder_view(F.col("t")).alias("e")).orderBy("i").collect()]
    assert got == ["The TCP/IP Router does NOT forward packets!", "ABC", "", "a b"]


def test_alignment_guard(spark):
    with pytest.raises(ValueError, match="not aligned"):
        validation.assert_aligned(spark.range(3).toDF("row_id"), spark.range(4).toDF("row_id"))
    validation.assert_aligned(spark.range(3).toDF("row_id"), spark.range(3).toDF("row_id"))


def test_near_duplicates_match_brute_force(spark):
    import itertools
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(40):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{rng.randrange(6)}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(i, f"q{i % 2}", t) for i, t in enumerate(texts)], "row_id long, question_id string, student_answer string")
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault((i % 2, frozenset(t.split())), []).append(i)
    want = set()
    for (qa, a), (qb, b) in itertools.combinations(sets, 2):
        j = len(a & b) / len(a | b)
        if qa == qb and 0.95 <= j < 1:
            x, y = sorted((min(sets[qa, a]), min(sets[qb, b])))
            want.add((x, y, len(sets[qa, a]) * len(sets[qb, b])))
    assert want and {(r.set_a, r.set_b, r.n_pairs) for r in validation.near_duplicates(df).collect()} == want


def test_dictionary_and_variants():
    names = [d["feature"] for d in ft.dictionary()]
    assert len(names) == 31 and len(set(names)) == 31
    assert len(ft.variant_columns(names)) == 10


def test_perturbations(spark):
    v = ft.views(frame(spark, ("alpha beta gamma delta", "alpha beta"), ("one two", "one")))
    assert [r.n for r in ft.perturb(v, "length_pad").select(F.size("s_tok").alias("n")).collect()] == [9, 7]
    assert ft.perturb(v, "negation_flip").where("exists(s_neg, t -> not startswith(t, 'neg_'))").isEmpty()
    sizes = [r.n for r in ft.perturb(v, "paraphrase_drop", 3).orderBy("row_id").select(F.size("s_tok").alias("n")).collect()]
    assert 1 <= sizes[0] <= 4 and sizes[1] == 2
    assert math.isclose(ft.lexical(v).where("row_id = 1").first().lex_token_overlap, 0.5)


def test_strip_takes_every_white_space(spark):
    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = ["", None, "a b", "​a​", "".join(spaces), *[f"{x} a{x}b {x}" for x in spaces]]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", tx.strip(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in found] == [t if t is None else t.strip() for t in texts]


def test_sql_of_white_space_agrees():
    import duckdb

    from markwright.plans.answer_queries import _SPACE

    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    for t in ["", "a b", "​a​", "".join(spaces), *[f"{x} a{x}b {x}" for x in spaces]]:
        full, cut = duckdb.execute(f"SELECT regexp_full_match($t, '{_SPACE}*'), regexp_replace($t, '^{_SPACE}+|{_SPACE}+$', '', 'g')", {"t": t}).fetchone()
        assert (full, cut) == (t.strip() == "", t.strip())
