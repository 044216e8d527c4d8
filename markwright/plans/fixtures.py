"""Views that turn the driver's tables into answers and predictions, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as answers: source = question, a benchmark text = reference, labels = score and label."""
    docs, labels, bench = (read(spark, sf_dir, t) for t in ("documents", "labels", "benchmark"))
    n = bench.count()  # from file footers
    d = docs.select("doc_id", "source", "lang", "text", (F.col("doc_id") % n).alias("item_id"))
    both = d.join(labels, "doc_id", "left").join(F.broadcast(bench.withColumnRenamed("text", "ref")) if n <= 100_000 else bench.withColumnRenamed("text", "ref"), "item_id")
    tenth = F.floor(F.col("doc_id") / 20).cast("long") % 10
    split = F.when(F.col("source").isin("src16", "src17"), "test_uq").when(F.col("source").isin("src18", "src19"), "test_ud").when(tenth < 6, "train").when(tenth == 6, "dev").otherwise("test_ua")
    label = F.when(F.col("quality").isNull(), "").when((F.col("quality") == 1) & (F.col("toxic") == 0), "correct").when(F.col("quality") == 1, "contradictory").otherwise("incorrect")
    return both.select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("question_id"), F.concat(F.lit("About "), "source").alias("question"), F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.col("ref")).alias("reference_answer"),
        F.col("text").alias("student_answer"), (F.col("quality") + (1 - F.col("toxic"))).cast("double").alias("score"), label.alias("label"), F.col("lang").alias("dataset"), F.col("lang").alias("domain"), split.alias("split"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions: grp, y_true, y_pred, conf, correct, question_id and a unique row_id."""
    li = read(spark, sf_dir, "lineitem")
    y = (F.col("l_linenumber") % 4).cast("int")
    p = F.least(F.lit(3), F.greatest(F.lit(0), y + (F.col("l_quantity").cast("long") % 3).cast("int") - 1))
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), F.col("l_returnflag").alias("grp"), (F.col("l_suppkey") % 40).cast("string").alias("question_id"), y.alias("y_true"), p.alias("y_pred"),
        ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11) % 101 / 100.0).alias("conf"), (y == p).cast("int").alias("correct"),
    )


ANSWERS = """answers AS (
SELECT d.doc_id AS row_id, d.source AS question_id, 'About ' || d.source AS question,
  CASE WHEN d.doc_id % 7 = 0 THEN '' ELSE b.text END AS reference_answer, d.text AS student_answer,
  CAST(l.quality + (1 - l.toxic) AS DOUBLE) AS score,
  CASE WHEN l.quality IS NULL THEN '' WHEN l.quality = 1 AND l.toxic = 0 THEN 'correct'
       WHEN l.quality = 1 THEN 'contradictory' ELSE 'incorrect' END AS label,
  d.lang AS dataset, d.lang AS domain,
  CASE WHEN d.source IN ('src16','src17') THEN 'test_uq' WHEN d.source IN ('src18','src19') THEN 'test_ud'
       WHEN CAST(floor(d.doc_id / 20) AS BIGINT) % 10 < 6 THEN 'train'
       WHEN CAST(floor(d.doc_id / 20) AS BIGINT) % 10 = 6 THEN 'dev' ELSE 'test_ua' END AS split
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark))"""

PREDS = """preds0 AS (SELECT *, CAST(l_linenumber % 4 AS INT) AS y FROM lineitem),
preds1 AS (SELECT *, least(3, greatest(0, y + CAST(CAST(l_quantity AS BIGINT) % 3 AS INT) - 1)) AS p FROM preds0),
preds AS (SELECT l_orderkey * 8 + l_linenumber AS row_id, l_returnflag AS grp, CAST(l_suppkey % 40 AS VARCHAR) AS question_id, y AS y_true, p AS y_pred,
  (l_orderkey * 37 + l_linenumber * 11) % 101 / 100.0::DOUBLE AS conf, CAST(y = p AS INT) AS correct FROM preds1)"""


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _tokens(name: str, source: str) -> str:
    """CTEs ``name`` with s_tok, r_tok, s_neg, r_neg, s_enc, r_enc of answers, from word positions instead of folds."""
    word = r"[\p{L}\p{N}_'']+"
    return rf"""{name}_enc AS (SELECT *, trim(regexp_replace(student_answer, '\s+', ' ', 'g')) AS s_enc, trim(regexp_replace(reference_answer, '\s+', ' ', 'g')) AS r_enc FROM {source}),
{name}_all AS (SELECT row_id, 's' AS side, regexp_extract_all(lower(s_enc), '{word}|[^\p{{L}}\p{{N}}_''\s]+') AS l FROM {name}_enc
  UNION ALL SELECT row_id, 'r', regexp_extract_all(lower(r_enc), '{word}|[^\p{{L}}\p{{N}}_''\s]+') FROM {name}_enc),
{name}_pos AS (SELECT row_id, side, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM {name}_all),
{name}_cls AS (SELECT *, regexp_matches(tok, '^[\p{{L}}\p{{N}}_'']') AS w, tok IN ({_list(tx.NEGATORS)}) OR ends_with(tok, 'n''t') AS neg, tok IN ({_list(tx.STOPWORDS)}) AS stop, tok IN ({_list(tx.CONJUNCTIONS)}) AS conj FROM {name}_pos),
{name}_cl AS (SELECT *, w AND (neg OR NOT stop) AS kept, sum(CASE WHEN NOT w OR conj THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, side ORDER BY pos) AS clause FROM {name}_cls),
{name}_cnt AS (SELECT *, sum(CASE WHEN kept AND NOT neg THEN 1 ELSE 0 END) OVER (PARTITION BY row_id, side, clause ORDER BY pos) AS k FROM {name}_cl),
{name}_last AS (SELECT *, max(CASE WHEN neg AND w THEN k END) OVER (PARTITION BY row_id, side, clause ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ln FROM {name}_cnt),
{name}_mark AS (SELECT row_id, side, pos, tok, CASE WHEN neg OR (ln IS NOT NULL AND k - ln <= 4) THEN 'neg_' || tok ELSE tok END AS mark FROM {name}_last WHERE kept),
{name}_agg AS (SELECT row_id, list(tok ORDER BY pos) FILTER (side = 's') AS s1, list(tok ORDER BY pos) FILTER (side = 'r') AS r1, list(mark ORDER BY pos) FILTER (side = 's') AS s2, list(mark ORDER BY pos) FILTER (side = 'r') AS r2 FROM {name}_mark GROUP BY row_id),
{name} AS (SELECT e.*, coalesce(s1, CAST([] AS VARCHAR[])) AS s_tok, coalesce(r1, CAST([] AS VARCHAR[])) AS r_tok, coalesce(s2, CAST([] AS VARCHAR[])) AS s_neg, coalesce(r2, CAST([] AS VARCHAR[])) AS r_neg
  FROM {name}_enc e LEFT JOIN {name}_agg USING (row_id))"""


VIEWS = _tokens("views", "answers")


def gram(tokens: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, len({tokens}) - {n - 2}), lambda i: " + " || ' ' || ".join(f"{tokens}[i + {k}]" for k in range(n)) + "))"


def jac(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"{both}::DOUBLE / nullif(len(list_distinct({a})) + len(list_distinct({b})) - {both}, 0)"


LEX = f"""lexsets AS (SELECT row_id, dataset, split, question_id, score, label, s_enc, s_tok, r_tok, list_distinct(s_tok) AS s, list_distinct(r_tok) AS r, list_distinct(s_neg) AS sn, list_distinct(r_neg) AS rn,
  {gram("s_tok", 2)} AS s2, {gram("r_tok", 2)} AS r2, {gram("s_tok", 3)} AS s3, {gram("r_tok", 3)} AS r3, s_neg, r_neg, len(r_tok) > 0 AS ref FROM views),
lexical AS (SELECT row_id, dataset, split, question_id, score, label,
  CASE WHEN ref THEN {jac("s", "r")} END AS lex_token_overlap,
  CASE WHEN ref THEN len(list_intersect(s, r))::DOUBLE / nullif(len(r), 0) END AS lex_token_overlap_recall,
  CASE WHEN ref THEN len(list_intersect(s, r))::DOUBLE / nullif(len(s), 0) END AS lex_token_overlap_prec,
  CASE WHEN ref THEN 2 * len(list_intersect(s, r))::DOUBLE / nullif(len(s) + len(r), 0) END AS lex_token_dice,
  CASE WHEN ref THEN {jac("s2", "r2")} END AS lex_bigram_overlap,
  CASE WHEN ref THEN {jac("s3", "r3")} END AS lex_trigram_overlap,
  CASE WHEN ref THEN {jac("sn", "rn")} END AS lex_content_word_overlap_neg,
  CASE WHEN ref THEN len(s_tok)::DOUBLE / nullif(len(r_tok), 0) END AS len_ratio_sr,
  CASE WHEN ref THEN ln((len(s_tok) + 1.0::DOUBLE) / (len(r_tok) + 1.0::DOUBLE)) END AS len_logratio_sr,
  len(s_tok)::DOUBLE AS len_student_tokens, length(s_enc)::DOUBLE AS len_student_chars, len(s)::DOUBLE / nullif(len(s_tok), 0) AS len_student_uniq_ratio FROM lexsets),
negc AS (SELECT *, len(list_filter(s_neg, lambda x: starts_with(x, 'neg_'))) AS cs, len(list_filter(r_neg, lambda x: starts_with(x, 'neg_'))) AS cr FROM lexsets),
negation AS (SELECT row_id, dataset, split, cs::DOUBLE AS neg_student_count, (cs > 0)::INT::DOUBLE AS neg_student_present, CASE WHEN ref THEN cr::DOUBLE END AS neg_reference_count,
  CASE WHEN ref THEN ((cs > 0) <> (cr > 0))::INT::DOUBLE END AS neg_polarity_mismatch, CASE WHEN ref THEN {jac("s", "r")} - {jac("sn", "rn")} END AS neg_overlap_delta FROM negc)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
