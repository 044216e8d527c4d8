"""Queries over answers: validation, text, features, folds, baselines. Each has DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vector as vx
from ..operators import features as ft
from ..operators import rubric_text, splits, stats, validation
from .fixtures import ANSWERS, LEX, VIEWS, answers, jac, read, with_

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def views(spark, sf, negation=True):
    return ft.views(answers(spark, sf), normalize=False, negation=negation)


A = with_(ANSWERS)
V = with_(ANSWERS, VIEWS)
L = with_(ANSWERS, VIEWS, LEX)


@query(L + "SELECT dataset, split, count(*) AS n, round(avg(lex_token_overlap), 6) AS mean_overlap, round(avg(lex_token_overlap_recall), 6) AS mean_recall FROM lexical GROUP BY ALL")
def lexical_overlap_summary(spark, sf):
    names = ("lex_token_overlap", "lex_token_overlap_recall")
    both = ft.lexical(ft.views(answers(spark, sf), normalize=False, negation=False), names, ("dataset", "split"))
    out = both.groupBy("dataset", "split").agg(F.count("*").alias("n"), F.avg(names[0]).alias("mean_overlap"), F.avg(names[1]).alias("mean_recall"))
    return r6(out, "mean_overlap", "mean_recall")


# -- validation --


_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"  # white space of any kind


@query(
    A
    + "SELECT dataset, count(*) AS n, "
    + "".join(f"count(*) FILTER (regexp_full_match({c}, '{_SPACE}*')) AS blank_{c}, " for c in ("question", "reference_answer", "student_answer", "label"))
    + "count(*) FILTER (score IS NULL) AS null_score FROM answers GROUP BY dataset"
)
def missing_counts(spark, sf):
    return validation.missing(answers(spark, sf), ["dataset"])


@query(A + "SELECT dataset, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT dataset, question_id, student_answer, count(*) AS n FROM answers GROUP BY ALL) GROUP BY dataset")
def exact_duplicates(spark, sf):
    return validation.exact_duplicates(answers(spark, sf), ["dataset"])


@query(A + "SELECT split, label, count(*) AS n FROM answers GROUP BY ALL")
def split_counts(spark, sf):
    return answers(spark, sf).groupBy("split", "label").agg(F.count("*").alias("n"))


@query(A + "SELECT split, count(*) AS n FROM answers WHERE label <> '' GROUP BY split")
def official_split_counts(spark, sf):
    return answers(spark, sf).where("label <> ''").groupBy("split").agg(F.count("*").alias("n"))


_NORM = r"lower(trim(regexp_replace(student_answer, '\s+', ' ', 'g')))"


@query(A + f", n AS (SELECT split, {_NORM} AS norm FROM answers) SELECT split, count(*) AS n_leaked FROM n WHERE split <> 'train' AND norm <> '' AND norm IN (SELECT norm FROM n WHERE split = 'train') GROUP BY split")
def leak_answer_overlap(spark, sf):
    return validation.answer_leakage(answers(spark, sf))


@query(A + "SELECT split, count(*) AS n_rows, count(*) FILTER (question_id IN (SELECT question_id FROM answers WHERE split = 'train')) AS n_leaked FROM answers WHERE split IN ('test_uq', 'test_ud') GROUP BY split")
def leak_question_overlap(spark, sf):
    return validation.question_leakage(answers(spark, sf))


@query(
    A
    + f""", s AS (SELECT question_id, row_id, list_sort(list_distinct(regexp_extract_all({_NORM}, '[a-z0-9'']+'))) AS s FROM answers),
d AS (SELECT question_id, s, min(row_id) AS id, count(*) AS m FROM s WHERE len(s) > 0 GROUP BY ALL)
SELECT a.question_id, a.id AS set_a, b.id AS set_b, a.m * b.m AS n_pairs, round({jac("a.s", "b.s")}, 6) AS jaccard
FROM d a JOIN d b ON a.question_id = b.question_id AND a.id < b.id AND {jac("a.s", "b.s")} >= 0.95 AND {jac("a.s", "b.s")} < 1"""
)
def near_duplicate_pairs(spark, sf):
    return r6(validation.near_duplicates(answers(spark, sf)), "jaccard")


@query(
    A
    + """, m AS (SELECT *, median(score) OVER (PARTITION BY question_id, student_answer) AS med FROM answers),
k AS (SELECT *, row_number() OVER (PARTITION BY question_id, student_answer ORDER BY abs(score - med) ASC NULLS LAST, row_id) AS rn FROM m)
SELECT row_id, question_id, score, label FROM k WHERE rn = 1"""
)
def dedupe_within_question(spark, sf):
    return validation.dedupe(answers(spark, sf)).select("row_id", "question_id", "score", "label")


@query(
    A
    + """, g AS (SELECT dataset, domain, count(*) AS c FROM answers GROUP BY ALL), gm AS (SELECT dataset, domain, row_number() OVER (PARTITION BY dataset ORDER BY c DESC, domain) AS rn FROM g)
SELECT a.dataset, count(DISTINCT question_id) AS n_questions, count(*) AS n_answers, CAST(floor(avg(len(list_filter(string_split_regex(student_answer, '\\s+'), lambda x: x <> '')))) AS BIGINT) AS mean_tokens,
  min(score) AS min_score, max(score) AS max_score, array_to_string(list_sort(list_distinct(list(split))), ',') AS splits, any_value(gm.domain) AS domain
FROM answers a JOIN gm ON gm.dataset = a.dataset AND gm.rn = 1 GROUP BY a.dataset"""
)
def dataset_summary(spark, sf):
    return stats.summary(answers(spark, sf), F.size(tx.white_tokens(F.col("student_answer"))))


# -- scalar and text functions --


@query(A + r"SELECT row_id, trim(regexp_replace(student_answer, '\s+', ' ', 'g')) AS student_answer_enc, trim(regexp_replace(reference_answer, '\s+', ' ', 'g')) AS reference_answer_enc FROM answers")
def encoder_view(spark, sf):
    return answers(spark, sf).select("row_id", tx.encoder_view(F.col("student_answer")).alias("student_answer_enc"), tx.encoder_view(F.col("reference_answer")).alias("reference_answer_enc"))


@query(A + f"SELECT row_id, {_NORM} AS norm, len(list_distinct(regexp_extract_all({_NORM}, '[a-z0-9'']+'))) AS n_tokens FROM answers")
def norm_text(spark, sf):
    return answers(spark, sf).select("row_id", tx.norm_text(F.col("student_answer")).alias("norm")).withColumn("n_tokens", F.size(tx.token_set(F.col("norm"))).cast("long"))


@query(A + f"SELECT question, substr(md5(regexp_replace(question, '^{_SPACE}+|{_SPACE}+$', '', 'g')), 1, 16) AS question_hash, count(*) AS n FROM answers GROUP BY ALL")
def question_hash_id(spark, sf):
    return answers(spark, sf).groupBy("question").agg(F.count("*").alias("n")).withColumn("question_hash", tx.question_hash(F.col("question")))


@query(A + r"SELECT row_id, CASE WHEN length(t) > 220 THEN substr(t, 1, 220) || '…' ELSE t END AS short FROM (SELECT row_id, trim(regexp_replace(student_answer, '\s+', ' ', 'g')) AS t FROM answers)")
def truncate_text(spark, sf):
    return answers(spark, sf).select("row_id", tx.truncate(F.col("student_answer")).alias("short"))


@query(
    r"""SELECT u.conv_id, u.turn, CASE WHEN trim(q) <> '' AND trim(r) <> '' THEN q || ' [SEP] ' || r WHEN q <> '' THEN q ELSE r END AS premise
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM conversations WHERE role = 'user') u JOIN (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS r FROM conversations WHERE role = 'assistant') a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1"""
)
def build_premise(spark, sf):
    c = read(spark, sf, "conversations")
    u, a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("q")), c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("r"))
    return u.join(a, ["conv_id", "turn"]).select("conv_id", "turn", tx.build_premise(F.col("q"), F.col("r")).alias("premise"))


_REPLY = "'Grade: ' || (doc_id % 9) || '.5 because it is ' || CASE WHEN doc_id % 3 = 0 THEN 'Incorrect' WHEN doc_id % 3 = 1 THEN 'partially correct' ELSE 'fine' END"


@query(
    f"""SELECT doc_id, least(5.0::DOUBLE, greatest(0.0::DOUBLE, CAST(regexp_extract(reply, '-?\\d+(?:\\.\\d+)?') AS DOUBLE))) AS grade,
  CASE WHEN doc_id % 3 = 0 THEN 'incorrect' WHEN doc_id % 3 = 1 THEN 'partially correct' END AS label
FROM (SELECT doc_id, {_REPLY} AS reply FROM documents)"""
)
def parse_llm_grade(spark, sf):
    reply = read(spark, sf, "documents").select("doc_id", F.expr(_REPLY).alias("reply"))
    return reply.select("doc_id", tx.parse_grade(F.col("reply"), 0, 5).alias("grade"), tx.parse_label(F.col("reply"), ["correct", "incorrect", "partially correct"]).alias("label"))


@query(
    "SELECT a.vec_id, round(CASE WHEN sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)) > 0 THEN list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) ELSE 0 END, 6) AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1"
)
def embedding_cosine(spark, sf):
    e = read(spark, sf, "embeddings")
    both = e.select("vec_id", "embedding").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    return both.select("vec_id", F.round(vx.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"))


_BIN = "CASE WHEN score IS NULL OR hi = lo THEN 0 ELSE greatest(ceil((score - lo) / ((hi - lo) / 6)) - 1, 0) END::INT"


@query(A + f", b AS (SELECT *, min(score) OVER (PARTITION BY dataset) AS lo, max(score) OVER (PARTITION BY dataset) AS hi FROM answers) SELECT dataset, {_BIN} AS bin, count(*) AS n FROM b GROUP BY ALL")
def score_bins(spark, sf):
    return splits.binned(answers(spark, sf), ["dataset"]).groupBy("dataset", "bin").agg(F.count("*").alias("n"))


# -- feature branches --


@query(V + "SELECT row_id, array_to_string(s_tok, ' ') AS plain, array_to_string(s_neg, ' ') AS marked FROM views")
def negation_scope(spark, sf):
    return views(spark, sf).select("row_id", F.array_join("s_tok", " ").alias("plain"), F.array_join("s_neg", " ").alias("marked"))


def _rounded(names):
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(L + f"SELECT row_id, {_rounded(ft.BRANCHES['lexical'])} FROM lexical")
def lexical_features(spark, sf):
    return r6(ft.lexical(views(spark, sf)), *ft.BRANCHES["lexical"])


@query(L + "SELECT row_id, round(lex_bigram_overlap, 6) AS lex_bigram_overlap FROM lexical WHERE lex_bigram_overlap > 0")
def bigram_overlap(spark, sf):
    return r6(ft.lexical(views(spark, sf)).select("row_id", "lex_bigram_overlap").where("lex_bigram_overlap > 0"), "lex_bigram_overlap")


@query(L + f"SELECT row_id, {_rounded(ft.BRANCHES['negation'])} FROM negation")
def negation_features(spark, sf):
    return r6(ft.negation(views(spark, sf)), *ft.BRANCHES["negation"])


_TFIDF = """tt AS (SELECT row_id, dataset, 's' AS side, s_tok AS t FROM views UNION ALL SELECT row_id, dataset, 'r', r_tok FROM views),
tg AS (SELECT row_id, dataset, side, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM tt),
tf AS (SELECT row_id, dataset, side, term, count(*) AS tf FROM tg GROUP BY ALL),
df AS (SELECT dataset, term, count(*) AS df FROM tf GROUP BY ALL),
top AS (SELECT dataset, max(df) AS top FROM df GROUP BY ALL),
nd AS (SELECT dataset, 2 * count(*) AS nd FROM views GROUP BY ALL),
idf AS (SELECT dataset, term, ln((1.0::DOUBLE + nd) / (1.0::DOUBLE + df)) + 1 AS idf FROM df JOIN top USING (dataset) JOIN nd USING (dataset) WHERE df >= CASE WHEN top >= 2 THEN 2 ELSE 1 END),
w AS (SELECT row_id, side, term, tf * idf AS w FROM tf JOIN idf USING (dataset, term)),
nrm AS (SELECT row_id, side, sqrt(sum(w * w)) AS nrm FROM w GROUP BY ALL),
dots AS (SELECT a.row_id, sum(a.w * b.w) AS d FROM w a JOIN w b ON a.row_id = b.row_id AND a.term = b.term AND a.side = 's' AND b.side = 'r' GROUP BY a.row_id),
tfidf AS (SELECT v.row_id, v.dataset, v.split, v.score, v.label, CASE WHEN len(v.r_tok) > 0 THEN coalesce(d / (x.nrm * y.nrm), 0) END AS tfidf_cosine FROM views v LEFT JOIN dots USING (row_id) LEFT JOIN nrm x ON x.row_id = v.row_id AND x.side = 's' LEFT JOIN nrm y ON y.row_id = v.row_id AND y.side = 'r')"""


@query(with_(ANSWERS, VIEWS, _TFIDF) + "SELECT row_id, round(tfidf_cosine, 6) AS tfidf_cosine FROM tfidf")
def tfidf_cosine(spark, sf):
    return r6(ft.tfidf_cosine(views(spark, sf, negation=False), "s_tok", "r_tok"), "tfidf_cosine")


_MENTION = r"""list_concat(list_transform(regexp_extract_all(T, '\b(\d+(?:[.,]\d+)*)\b', 1), lambda x: 'N:' || lower(x)), list_transform(regexp_extract_all(T, '[a-z,;] ([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)*)', 1), lambda x: 'C:' || lower(x)))"""


@query(
    V
    + f""", m AS (SELECT row_id, trim(r_enc) <> '' AS ref, {_MENTION.replace("T,", "s_enc,")} AS a, {_MENTION.replace("T,", "r_enc,")} AS b FROM views),
k AS (SELECT row_id, ref, a, list_distinct(list_transform(a, lambda x: x[3:])) AS s, list_distinct(list_transform(b, lambda x: x[3:])) AS r FROM m)
SELECT row_id, len(a)::DOUBLE AS ner_student_count, len(list_distinct(list_transform(a, lambda x: x[1])))::DOUBLE AS ner_student_uniq_types, CASE WHEN ref THEN len(list_intersect(s, r))::DOUBLE END AS ner_overlap_count,
  CASE WHEN ref THEN round({jac("s", "r")}, 6) END AS ner_overlap_jaccard, CASE WHEN ref THEN round(len(list_intersect(s, r))::DOUBLE / nullif(len(r), 0), 6) END AS ner_ref_recall FROM k"""
)
def entity_features(spark, sf):
    return r6(ft.entities(views(spark, sf, negation=False)), "ner_overlap_jaccard", "ner_ref_recall")


_UNIT = "list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))"


@query(
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT vec_id, {_UNIT} AS u FROM e)
SELECT a.vec_id AS row_id, round(list_dot_product(a.u, b.u), 6) AS sem_cosine, round(list_sum(list_transform(range(1, len(a.u) + 1), lambda i: abs(a.u[i] - b.u[i]))) / len(a.u), 6) AS sem_abs_diff_mean, round(list_dot_product(a.u, b.u) / len(a.u), 6) AS sem_hadamard_mean
FROM u a JOIN u b ON b.vec_id = a.vec_id + 1"""
)
def semantic_features(spark, sf):
    e = read(spark, sf, "embeddings")
    both = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("u")).join(e.select((F.col("vec_id") - 1).alias("row_id"), F.col("embedding").alias("v")), "row_id")
    return r6(ft.semantic(both, "u", "v"), "sem_cosine", "sem_abs_diff_mean", "sem_hadamard_mean")


_SIMS = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sims AS (SELECT a.vec_id AS row_id, CAST(b.vec_id - a.vec_id - 1 AS INT) AS pos, 'concept ' || b.vec_id AS concept, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS similarity
  FROM e a JOIN e b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 5)"""


def vector_concepts(spark, sf):
    """Each vector against the five after it, as concepts: equi-joins on the shifted id."""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    want = e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("u"), F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.col("vec_id") + k)).alias("pos", "vec_id"))
    both = want.join(e, "vec_id")
    return both.select("row_id", "pos", F.concat(F.lit("concept "), "vec_id").alias("concept"), vx.cosine(F.col("u"), F.col("embedding")).alias("similarity"))


@query(with_(_SIMS) + "SELECT row_id, count(*)::DOUBLE AS rub_n_concepts, round(avg(similarity), 6) AS rub_mean_maxsim, round(min(similarity), 6) AS rub_min_maxsim, round(max(similarity), 6) AS rub_max_maxsim, round(avg((similarity >= 0.5)::INT), 6) AS rub_coverage_at_tau FROM sims GROUP BY row_id")
def rubric_coverage(spark, sf):
    return r6(ft.rubric(vector_concepts(spark, sf)), *ft.BRANCHES["rubric"][1:])


@query(with_(_SIMS) + "SELECT row_id, string_agg(concept || '=' || CAST(CAST(round(similarity, 4) * 10000 AS INT) AS VARCHAR) || ':' || CASE WHEN similarity >= 0.5 THEN 'true' ELSE 'false' END, ';' ORDER BY pos) AS concepts FROM sims GROUP BY row_id")
def concept_attribution(spark, sf):
    c = ft.concept_attribution(vector_concepts(spark, sf))
    shown = F.transform("concepts", lambda x: F.concat(x["concept"], F.lit("="), F.rint(x["similarity"] * 10000).cast("int").cast("string"), F.lit(":"), x["covered"].cast("string")))
    return c.select("row_id", F.array_join(shown, ";").alias("concepts"))


@query()
def rubric_sentences(spark, sf):
    """Sentence-level rubric coverage of answers (the reference's sentences are concepts)."""
    return r6(ft.rubric(rubric_text.sentence_similarities(views(spark, sf, negation=False))), *ft.BRANCHES["rubric"][1:])


@query()
def feature_matrix(spark, sf):
    """All 31 features of every answer."""
    return ft.matrix(answers(spark, sf))


_PAD = "['furthermore', 'generally', 'speaking', 'overall', 'basically']"


@query(with_(ANSWERS, VIEWS, f"p AS (SELECT row_id, len(r_tok) > 0 AS ref, list_distinct(list_concat(s_tok, {_PAD})) AS s, list_distinct(r_tok) AS r, len(s_tok) + 5 AS n FROM views)") + f"SELECT row_id, n::DOUBLE AS len_student_tokens, CASE WHEN ref THEN round({jac('s', 'r')}, 6) END AS lex_token_overlap FROM p")
def perturb_length_pad(spark, sf):
    out = ft.lexical(ft.perturb(views(spark, sf), "length_pad")).select("row_id", "len_student_tokens", "lex_token_overlap")
    return r6(out, "lex_token_overlap")


@query(
    with_(ANSWERS, VIEWS, "p AS (SELECT row_id, len(r_tok) > 0 AS ref, list_distinct(s_tok) AS s, list_distinct(r_tok) AS r, list_transform(s_neg, lambda x: CASE WHEN starts_with(x, 'neg_') THEN x ELSE 'neg_' || x END) AS s_neg, list_distinct(r_neg) AS rn FROM views)")
    + f"SELECT row_id, len(s_neg)::DOUBLE AS neg_student_count, CASE WHEN ref THEN round({jac('s', 'r')} - {jac('list_distinct(s_neg)', 'rn')}, 6) END AS neg_overlap_delta FROM p"
)
def perturb_negation_flip(spark, sf):
    out = ft.negation(ft.perturb(views(spark, sf), "negation_flip")).select("row_id", "neg_student_count", "neg_overlap_delta")
    return r6(out, "neg_overlap_delta")


@query()
def perturb_drop(spark, sf):
    """Random token drop by checksum of token and place."""
    return r6(ft.lexical(ft.perturb(views(spark, sf), "paraphrase_drop", seed=7)).select("row_id", "len_student_tokens", "lex_token_overlap"), "lex_token_overlap")


@query(
    with_(ANSWERS, VIEWS, f"p AS (SELECT dataset, len(r_tok) > 0 AS ref, s_tok, r_tok, list_concat(s_tok, {_PAD}) AS padded FROM views), d AS (SELECT dataset, CASE WHEN ref THEN {jac('list_distinct(padded)', 'list_distinct(r_tok)')} - {jac('list_distinct(s_tok)', 'list_distinct(r_tok)')} END AS d FROM p)")
    + "SELECT dataset, round(avg(abs(d)), 6) AS mean_abs_delta, round(avg(d), 6) AS mean_delta, round(avg((abs(d) > 1e-9)::INT), 6) AS frac_changed FROM d WHERE d IS NOT NULL GROUP BY dataset"
)
def perturbation_delta(spark, sf):
    name, sides = "lex_token_overlap", ("s_enc", "s_tok", "r_tok")
    before = ft.lexical(views(spark, sf, negation=False), (name,), ("dataset", *sides)).withColumnRenamed(name, "x")
    after = ft.lexical(ft.perturb(before, "length_pad"), (name,), ("dataset", "x"))  # the same rows, so no join
    d = after.withColumn("d", F.col(name) - F.col("x")).where("d is not null")
    return r6(d.groupBy("dataset").agg(F.avg(F.abs("d")).alias("mean_abs_delta"), F.avg("d").alias("mean_delta"), F.avg((F.abs("d") > 1e-9).cast("double")).alias("frac_changed")), "mean_abs_delta", "mean_delta", "frac_changed")


_COLS = [*ft.BRANCHES["lexical"], *ft.BRANCHES["negation"]]


@query(L + " UNION ALL ".join(f"SELECT l.dataset, '{c}' AS feature, count(*) AS n, round(count({c})::DOUBLE / count(*), 6) AS coverage FROM {'lexical' if c in ft.BRANCHES['lexical'] else 'negation'} l GROUP BY l.dataset" for c in _COLS))
def feature_coverage(spark, sf):
    both = ft.matrix(answers(spark, sf), ("lexical", "negation"), normalize=False)
    return r6(ft.coverage(both, _COLS, ["dataset"]), "coverage")


_TARGETS = "CASE WHEN score IS NOT NULL THEN score END"


@query(
    L
    + ", long AS ("
    + " UNION ALL ".join(f"SELECT dataset, '{c}' AS feature, {c} AS x, score AS y FROM lexical WHERE {c} IS NOT NULL AND score IS NOT NULL" for c in ft.BRANCHES["lexical"])
    + """), rk AS (SELECT dataset, feature, rank() OVER (PARTITION BY dataset, feature ORDER BY x) + (count(*) OVER (PARTITION BY dataset, feature, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY dataset, feature ORDER BY y) + (count(*) OVER (PARTITION BY dataset, feature, y) - 1) / 2.0::DOUBLE AS ry FROM long)
SELECT dataset, feature, count(*) AS n, round(abs(CASE WHEN stddev_pop(rx) > 1e-8 AND stddev_pop(ry) > 1e-8 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END), 6) AS association FROM rk GROUP BY ALL"""
)
def feature_target_assoc(spark, sf):
    from ..functions import metrics as mt

    v = views(spark, sf)
    both = v.select("row_id", "dataset", "score").join(ft.lexical(v), "row_id")
    long = both.unpivot(["dataset", "score"], list(ft.BRANCHES["lexical"]), "feature", "x")
    return mt.spearman(long, ["dataset", "feature"], "x", "score").select("dataset", "feature", "n", F.round(F.abs("spearman"), 6).alias("association"))


#: The features in order, and what SQL needs to tell the groups apart: written out here, apart from the operator's own lists.
_NAMES = """
lex_token_overlap lex_token_overlap_recall lex_token_overlap_prec lex_token_dice lex_bigram_overlap lex_trigram_overlap lex_content_word_overlap_neg
len_ratio_sr len_logratio_sr len_student_tokens len_student_chars len_student_uniq_ratio tfidf_cosine
neg_student_count neg_student_present neg_reference_count neg_polarity_mismatch neg_overlap_delta
ner_student_count ner_student_uniq_types ner_overlap_count ner_overlap_jaccard ner_ref_recall
sem_cosine sem_abs_diff_mean sem_hadamard_mean rub_n_concepts rub_mean_maxsim rub_min_maxsim rub_max_maxsim rub_coverage_at_tau
neural_score neural_pred""".split()
_VARIANT_SQL = f"""WITH f AS (SELECT c, i, CASE split_part(c, '_', 1) WHEN 'sem' THEN 'A' WHEN 'rub' THEN 'C' WHEN 'neural' THEN 'D' ELSE 'B' END AS g
  FROM (SELECT unnest({_NAMES!r}) AS c, generate_subscripts({_NAMES!r}, 1) AS i)),
v AS (SELECT 'full' AS variant, c, i, true AS own FROM f
  UNION ALL SELECT 'minus_' || x, c, i, g <> x FROM f, (VALUES ('A'), ('B'), ('C'), ('D')) t(x)
  UNION ALL SELECT 'only_' || x, c, i, g = x FROM f, (VALUES ('A'), ('B'), ('C'), ('D')) t(x)
  UNION ALL SELECT 'minus_negation', c, i, NOT (c LIKE 'neg\\_%' ESCAPE '\\' OR c = 'lex_content_word_overlap_neg') FROM f)
SELECT variant, count(*) FILTER (own) AS n_columns, string_agg(c, ',' ORDER BY i) FILTER (own) AS columns FROM v GROUP BY variant"""


@query(_VARIANT_SQL)
def ablation_variant_columns(spark, sf):
    names = [*[x for b in ft.BRANCHES.values() for x in b], *ft.NEURAL]
    rows = [(v, len(c), ",".join(c)) for v, c in ft.variant_columns(names).items()]
    return spark.createDataFrame(rows, "variant string, n_columns long, columns string")


@query(f"""SELECT CASE WHEN c LIKE 'lex%' OR c LIKE 'len%' THEN 'lexical' WHEN c LIKE 'tfidf%' THEN 'tfidf' WHEN c LIKE 'neg%' THEN 'negation' WHEN c LIKE 'ner%' THEN 'entities' WHEN c LIKE 'sem%' THEN 'semantic' ELSE 'rubric' END AS branch,
  c AS feature, 'double' AS dtype, c NOT LIKE 'len_student%' AND c NOT LIKE 'neg_student%' AND c NOT LIKE 'ner_student%' AS needs_reference FROM (SELECT unnest({_NAMES[:31]!r}) AS c)""")
def feature_dictionary(spark, sf):
    """Metadata of the 31 features."""
    return spark.createDataFrame(ft.dictionary(), "branch string, feature string, dtype string, needs_reference boolean")


# -- folds, baselines, priors --

_KEY = "((row_id * 7919 + {seed}) % 2147483647 * 1103515245 + 12345) % 2147483647"


@query(
    A
    + f""", b AS (SELECT *, min(score) OVER (PARTITION BY dataset) AS lo, max(score) OVER (PARTITION BY dataset) AS hi FROM answers), c AS (SELECT *, {_BIN} AS bin FROM b)
SELECT row_id, CAST((row_number() OVER (PARTITION BY dataset, bin ORDER BY {_KEY.format(seed=42)}, row_id) - 1 + bin) % 5 AS INT) AS fold FROM c"""
)
def stratified_kfold(spark, sf):
    return splits.stratified(answers(spark, sf), ["dataset"]).select("row_id", "fold")


_GROUPED = """gq AS (SELECT question_id, count(*) AS n_rows FROM answers GROUP BY ALL),
gi AS (SELECT *, row_number() OVER (ORDER BY n_rows DESC, question_id) - 1 AS i, greatest(least(count(*) OVER (), 5), 2) AS k FROM gq),
gf AS (SELECT question_id, n_rows, CAST(CASE WHEN (i // k) % 2 = 0 THEN i % k ELSE k - 1 - i % k END AS INT) AS fold FROM gi)"""


def _one(df):
    return df.withColumn("__one", F.lit(1))


def _folds(spark, sf):
    return splits.grouped(_one(answers(spark, sf)), ["__one"]).drop("__one")


@query(with_(ANSWERS, _GROUPED) + "SELECT * FROM gf")
def grouped_kfold(spark, sf):
    return _folds(spark, sf)


@query()
def grouped_stratified_kfold(spark, sf):
    """Greedy stratified assignment of whole questions."""
    return splits.grouped_stratified(answers(spark, sf)).select("row_id", "question_id", "fold")


@query(with_(ANSWERS, _GROUPED) + ", j AS (SELECT question_id, count(DISTINCT fold) AS nf FROM answers JOIN gf USING (question_id) GROUP BY ALL) SELECT count(*) AS n_questions, count(*) FILTER (nf > 1) AS n_split_questions FROM j")
def fold_leak_check(spark, sf):
    folded = answers(spark, sf).join(_folds(spark, sf).select("question_id", "fold"), "question_id")
    return splits.fold_leaks(folded, [])


@query(A + "SELECT dataset, -1 AS fold, count(*) AS n FROM answers GROUP BY dataset")
def fold_materialise(spark, sf):
    return splits.materialise(answers(spark, sf)).groupBy("dataset", "fold").agg(F.count("*").alias("n"))


@query(A + ", c AS (SELECT dataset, label, count(*) AS n FROM answers WHERE label <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, label) AS rn FROM c) SELECT dataset, label AS majority, n AS n_majority FROM k WHERE rn = 1")
def majority_baseline(spark, sf):
    return splits.mode(answers(spark, sf).where("label <> ''"), ["dataset"], "label", "majority").withColumnRenamed("n_mode", "n_majority")


@query(
    A
    + """, c AS (SELECT dataset, score, count(*) AS n FROM answers WHERE score IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, score) AS rn FROM c)
SELECT a.dataset, round(avg(a.score), 6) AS mean_score, round_even(median(a.score), 0) AS median_score, max(a.score) AS max_score, any_value(k.score) AS mode_score FROM answers a JOIN k ON k.dataset = a.dataset AND k.rn = 1 WHERE a.score IS NOT NULL GROUP BY a.dataset"""
)
def baselines(spark, sf):
    return r6(splits.constants(answers(spark, sf), ["dataset"]), "mean_score")


_SHORT = """qm AS (SELECT question_id, avg(score) AS q_mean FROM answers WHERE split = 'train' AND score IS NOT NULL GROUP BY ALL), gm AS (SELECT avg(score) AS g_mean FROM answers WHERE split = 'train'),
sc AS (SELECT a.row_id, a.question_id, a.split, a.score AS y_true, coalesce(q_mean, g_mean) AS y_pred, q_mean IS NOT NULL AS seen FROM answers a LEFT JOIN qm USING (question_id) CROSS JOIN gm WHERE a.split <> 'train' AND a.score IS NOT NULL)"""


@query(with_(ANSWERS, _SHORT) + "SELECT row_id, split, y_true, round(y_pred, 6) AS y_pred, seen FROM sc")
def question_shortcut(spark, sf):
    return r6(splits.question_shortcut(answers(spark, sf)).drop("question_id"), "y_pred")


@query(with_(ANSWERS, _SHORT) + "SELECT split, count(*) AS n, round(avg(seen::INT), 6) AS fraction_seen, round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS rmse FROM sc GROUP BY split")
def question_mean_shortcut(spark, sf):
    s = splits.question_shortcut(answers(spark, sf))
    return r6(s.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col("seen").cast("double")).alias("fraction_seen"), F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2))).alias("rmse")), "fraction_seen", "rmse")


@query(with_(ANSWERS, _SHORT) + "SELECT round(sqrt(avg((y_pred - y_true) ** 2) FILTER (NOT seen)) - sqrt(avg((y_pred - y_true) ** 2) FILTER (seen)), 6) AS gap_rmse, count(*) FILTER (seen) AS n_seen, count(*) FILTER (NOT seen) AS n_unseen FROM sc")
def generalization_gap(spark, sf):
    s = splits.question_shortcut(answers(spark, sf)).withColumn("e", F.pow(F.col("y_pred") - F.col("y_true"), 2))
    part = lambda c: F.sqrt(F.avg(F.when(c, F.col("e"))))
    return r6(s.agg((part(~F.col("seen")) - part(F.col("seen"))).alias("gap_rmse"), F.count_if("seen").alias("n_seen"), F.count_if(~F.col("seen")).alias("n_unseen")), "gap_rmse")


@query(
    A
    + """, q AS (SELECT question_id, sum(score) AS s, count(score) AS n FROM answers WHERE split = 'train' GROUP BY ALL), g AS (SELECT avg(score) AS g FROM answers WHERE split = 'train')
SELECT row_id, split, round(CASE WHEN split = 'train' THEN CASE WHEN score IS NULL THEN g ELSE coalesce((s - score) / nullif(n - 1, 0), g) END ELSE s / nullif(n, 0) END, 6) AS qprior_train_mean FROM answers LEFT JOIN q USING (question_id) CROSS JOIN g"""
)
def question_prior(spark, sf):
    return r6(splits.question_prior(answers(spark, sf)).drop("question_id"), "qprior_train_mean")


@query(
    with_(ANSWERS, _GROUPED)
    + ", x AS (SELECT row_id, fold, score FROM answers JOIN gf USING (question_id) WHERE score IS NOT NULL), t AS (SELECT f.fold, avg(x.score) AS p FROM (SELECT DISTINCT fold FROM x) f JOIN x ON x.fold <> f.fold GROUP BY f.fold) SELECT row_id, x.fold, score AS y_true, round(p, 6) AS y_pred FROM x JOIN t ON t.fold = x.fold"
)
def oof_baseline(spark, sf):
    return r6(splits.out_of_fold_means(answers(spark, sf), _folds(spark, sf).select("question_id", "fold")), "y_pred")


_BINARY = "bt AS (SELECT *, min(score) OVER (PARTITION BY dataset) AS lo, max(score) OVER (PARTITION BY dataset) AS hi FROM answers), bz AS (SELECT row_id, dataset, CASE WHEN label <> '' THEN (label = 'correct')::INT WHEN score IS NOT NULL THEN (score >= (lo + hi) / 2)::INT END AS target FROM bt)"


@query(with_(ANSWERS, _BINARY) + "SELECT * FROM bz")
def binarize_target(spark, sf):
    return splits.binarised(answers(spark, sf)).select("row_id", "dataset", "target")


@query(
    with_(ANSWERS, _BINARY)
    + ", p AS (SELECT dataset, count(*) AS n, sum(target) AS pos FROM bz WHERE target IS NOT NULL GROUP BY ALL) SELECT a.dataset AS held_out, any_value(a.n) AS n_test, CAST(sum(b.n) AS BIGINT) AS n_train, round(sum(b.pos)::DOUBLE / sum(b.n), 6) AS train_positive_rate FROM p a JOIN p b ON b.dataset <> a.dataset GROUP BY a.dataset"
)
def lodo_train_sizes(spark, sf):
    return r6(splits.leave_one_out(answers(spark, sf)), "train_positive_rate")


@query(A + f", k AS (SELECT row_id, dataset, row_number() OVER (PARTITION BY dataset ORDER BY {_KEY.format(seed=7)}, row_id) AS rn FROM answers) SELECT row_id, dataset FROM k WHERE rn <= 20")
def per_group_sample(spark, sf):
    return splits.sample(answers(spark, sf).select("row_id", "dataset"), ["dataset"], 20, 7)


@query(A + "SELECT dataset, label, CAST(dense_rank() OVER (PARTITION BY dataset ORDER BY label) - 1 AS INT) AS code FROM (SELECT DISTINCT dataset, label FROM answers WHERE label <> '')")
def label_vocab(spark, sf):
    from pyspark.sql import Window

    return answers(spark, sf).where("label <> ''").select("dataset", "label").distinct().withColumn("code", (F.dense_rank().over(Window.partitionBy("dataset").orderBy("label")) - 1).cast("int"))


# -- length statistics --

_LEN = "tl AS (SELECT dataset, 'student' AS field, len(list_filter(string_split_regex(student_answer, '\\s+'), lambda x: x <> '')) AS n_tok FROM answers UNION ALL SELECT dataset, 'reference', len(list_filter(string_split_regex(reference_answer, '\\s+'), lambda x: x <> '')) FROM answers)"
_PCT = "tp AS (SELECT dataset, field, count(*) AS n, round(avg(n_tok), 2) AS mean, max(n_tok) AS max, CAST(floor(quantile_cont(n_tok, 0.5)) AS BIGINT) AS p50, CAST(floor(quantile_cont(n_tok, 0.9)) AS BIGINT) AS p90, CAST(floor(quantile_cont(n_tok, 0.95)) AS BIGINT) AS p95, CAST(floor(quantile_cont(n_tok, 0.99)) AS BIGINT) AS p99, round(avg((n_tok > 128)::INT) * 100, 2) AS pct_over_128, round(avg((n_tok > 256)::INT) * 100, 2) AS pct_over_256 FROM tl GROUP BY ALL)"


def lengths(spark, sf):
    a = answers(spark, sf)
    part = lambda c, name: a.select("dataset", F.lit(name).alias("field"), F.size(tx.white_tokens(F.col(c))).alias("n_tok"))
    return stats.percentile_block(part("student_answer", "student").union(part("reference_answer", "reference")), ["dataset", "field"], "n_tok")


@query(with_(ANSWERS, _LEN, _PCT) + "SELECT * FROM tp")
def token_length_stats(spark, sf):
    return lengths(spark, sf)


@query(with_(ANSWERS, _LEN, _PCT) + "SELECT dataset, field AS binding_field, p99 FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p99 DESC, field) AS rn FROM tp) WHERE rn = 1")
def token_binding_field(spark, sf):
    return lengths(spark, sf).groupBy("dataset").agg(F.min_by("field", F.struct(-F.col("p99"), "field")).alias("binding_field"), F.max("p99").alias("p99"))


@query(
    with_(ANSWERS, _LEN, _PCT)
    + "SELECT dataset, CASE WHEN max(p99) <= 128 THEN 128 WHEN max(p99) <= 256 THEN 256 WHEN max(p99) <= 384 THEN 384 ELSE 512 END AS max_len, coalesce(string_agg(field, ',' ORDER BY field) FILTER (pct_over_128 > 5), '') AS outliers FROM tp GROUP BY dataset"
)
def token_recommendation(spark, sf):
    per = lengths(spark, sf).groupBy("dataset").agg(F.max("p99").alias("p99"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("pct_over_128") > 5, F.col("field")))), ",").alias("outliers"))
    return per.select("dataset", stats.ladder(F.col("p99")).alias("max_len"), "outliers")


@query(A + "SELECT label, count(score) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, min(score) AS lo, max(score) AS hi FROM answers WHERE score IS NOT NULL GROUP BY label")
def score_by_label(spark, sf):
    s = answers(spark, sf).where("score is not null")
    return r6(s.groupBy("label").agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.min("score").alias("lo"), F.max("score").alias("hi")), "mean", "std")


@query(A + ", t AS (SELECT dataset, length(student_answer)::DOUBLE AS x FROM answers) SELECT dataset, count(x) AS n, round(skewness(x), 5) AS skew FROM t GROUP BY dataset")
def score_skew(spark, sf):
    t = answers(spark, sf).select("dataset", F.length("student_answer").cast("double").alias("x"))
    return stats.skew(t, ["dataset"], "x").withColumn("skew", F.round("skew", 5))


@query(
    A
    + ", f AS (SELECT dataset, question_id, score AS x FROM answers WHERE score IS NOT NULL), q AS (SELECT dataset, question_id, count(*) AS n, avg(x) AS m FROM f GROUP BY ALL), g AS (SELECT dataset, avg(x) AS gm, count(*) AS n, var_pop(x) * count(*) AS ss FROM f GROUP BY ALL) SELECT g.dataset, count(*) AS n_groups, any_value(g.n) AS n, round(CASE WHEN count(*) > 1 AND any_value(ss) > 1e-12 THEN sum(q.n * (q.m - gm) ** 2) / any_value(ss) END, 6) AS eta2 FROM q JOIN g ON g.dataset = q.dataset GROUP BY g.dataset"
)
def between_question_eta2(spark, sf):
    return r6(stats.eta_squared(answers(spark, sf), ["dataset"]), "eta2")


@query(A + ", f AS (SELECT dataset, length(student_answer)::DOUBLE AS x, score AS y FROM answers WHERE score IS NOT NULL) SELECT dataset, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(x) > 1e-8 AND stddev_pop(y) > 1e-8 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) END, 6) AS r FROM f GROUP BY dataset")
def length_shortcut(spark, sf):
    from ..functions import metrics as mt

    f = answers(spark, sf).where("score is not null").select("dataset", F.length("student_answer").cast("double").alias("x"), F.col("score").alias("y"))
    return r6(f.groupBy("dataset").agg(F.count("*").alias("n"), mt.pearson("x", "y", 3).alias("r")), "r")


@query(with_(ANSWERS, VIEWS, LEX) + "SELECT label, count(*) AS n, round(avg(lex_token_overlap_recall), 6) AS mean_signal FROM lexical WHERE label <> '' GROUP BY label")
def signal_by_verdict(spark, sf):
    v = views(spark, sf)
    both = v.select("row_id", "label").where("label <> ''").join(ft.lexical(v).select("row_id", "lex_token_overlap_recall"), "row_id")
    return r6(both.groupBy("label").agg(F.count("*").alias("n"), F.avg("lex_token_overlap_recall").alias("mean_signal")), "mean_signal")
