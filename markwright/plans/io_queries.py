"""Queries that write corpora in their raw formats and read them back, and queries over the protocol operators."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import metrics as mt
from ..functions import text as tx
from ..functions import vector as vx
from ..operators import features as ft
from ..operators import migration, protocol, splits, validation, vector_store
from ..schema import TASKS, coerce, column_report
from ..sources import archives, readers, sinks
from .answer_queries import _GROUPED, query, r6
from .fixtures import ANSWERS, PREDS, answers, preds, read, with_
from .storage import scratch

A, P = with_(ANSWERS), with_(PREDS)
_TRIMMED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


def _rows(spark, sf):
    """Whole texts on one line: XML readers trim and line formats split at breaks."""
    return read(spark, sf, "documents").select("doc_id", "source", "lang", tx.squeeze(F.col("text")).alias("text"))


def _questions(rows):
    answer = F.struct(F.col("text").alias("_VALUE"), F.when(F.col("doc_id") % 2 == 0, "correct").otherwise("incorrect").alias("_accuracy"), F.col("doc_id").cast("string").alias("_id"))
    reference = F.array(F.struct(F.lit("good").alias("_VALUE"), F.lit("GOOD").alias("_category"), F.lit("r1").alias("_id")), F.struct(F.concat(F.lit("best "), "doc_id").alias("_VALUE"), F.lit("BEST").alias("_category"), F.lit("r2").alias("_id")))
    return rows.select(F.concat(F.lit("Q"), "doc_id").alias("_id"), F.concat(F.lit("About "), "source").alias("questionText"), F.struct(reference.alias("referenceAnswer")).alias("referenceAnswers"), F.struct(F.array(answer).alias("studentAnswer")).alias("studentAnswers"))


@query(f"""SELECT 'Q' || doc_id AS question_id, 'About ' || source AS question, 'best ' || doc_id AS reference_answer, {_TRIMMED} AS student_answer, CAST(NULL AS DOUBLE) AS score,
  CASE WHEN doc_id % 2 = 0 THEN 'correct' ELSE 'incorrect' END AS label, 'semeval' AS dataset, CASE WHEN doc_id % 3 = 0 THEN 'beetle' ELSE 'sciEntsBank' END AS domain,
  CASE WHEN doc_id % 3 = 0 THEN 'train' ELSE 'test_ud' END AS split FROM documents WHERE text IS NOT NULL AND {_TRIMMED} <> ''""")
def source_xml(spark, sf):
    """XML of two corpora: one with ``Core`` beside ``Extra`` and ``Dependency`` copies, one with files in the split's own folder; other corpora and folders are left alone."""
    root, rows = scratch(spark, "xml"), _rows(spark, sf).where("text <> ''")
    write = lambda df, place: _questions(df).write.format("xml").option("rowTag", "question").mode("overwrite").save(f"{root}/{place}")
    for folder in ("Core", "Extra", "Dependency"):
        write(rows.where("doc_id % 3 = 0"), f"beetle/train/{folder}")
    write(rows.where("doc_id % 3 <> 0"), "sciEntsBank/test-unseen-domains")
    write(rows.where("doc_id % 3 <> 0"), "other/train/Core")
    write(rows.where("doc_id % 5 = 0"), "beetle/reliability/Core")
    return readers.xml(spark, root)


@query("SELECT substr(md5('About ' || source), 1, 16) AS question_id, 'About ' || source AS question, 'ref' AS reference_answer, text AS student_answer, CAST(doc_id % 5 AS DOUBLE) AS score, CASE WHEN doc_id % 3 = 0 THEN 'Correct' ELSE 'Incorrect' END AS label, 'saf' AS dataset, 'communication_networks' AS domain, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test_uq' END AS split FROM documents")
def source_parquet_splits(spark, sf):
    root, d = scratch(spark, "splits"), read(spark, sf, "documents")
    rows = d.select("doc_id", F.concat(F.lit("About "), "source").alias("question"), F.lit("ref").alias("reference_answer"), F.col("text").alias("provided_answer"), (F.col("doc_id") % 5).alias("score"), F.when(F.col("doc_id") % 3 == 0, "Correct").otherwise("Incorrect").alias("verification_feedback"))
    for stem, part in (("train", "doc_id % 2 = 0"), ("unseen_questions", "doc_id % 2 = 1"), ("notes", "true")):
        sinks.parquet(rows.where(part).drop("doc_id"), f"{root}/{stem}.parquet", by=None)
    return readers.parquet_splits(spark, root)


@query("SELECT substr(md5('About ' || source), 1, 16) AS question_id, 'About ' || source AS question, 'ref' AS reference_answer, text AS student_answer, CAST(doc_id % 5 AS DOUBLE) AS score, '' AS label, 'mohler' AS dataset, 'computer_science' AS domain, 'all' AS split FROM documents WHERE doc_id % 2 = 0")
def source_parquet_single(spark, sf):
    path, d = scratch(spark, "single"), read(spark, sf, "documents")
    source = F.when(F.col("doc_id") % 2 == 0, "MOHLER").otherwise("other")
    sinks.parquet(d.select(F.concat(F.lit("About "), "source").alias("question"), F.lit("ref").alias("reference_answer"), F.col("text").alias("provided_answer"), (F.col("doc_id") % 5).alias("grade"), source.alias("data_source")), path, by=None)
    return readers.parquet_single(spark, path)


_TSV = "SELECT 'set_' || (1 + doc_id % 6) AS question_id, '' AS question, '' AS reference_answer, text AS student_answer, CASE WHEN doc_id % 4 < 3 THEN CAST(doc_id % 4 AS DOUBLE) END AS score, '' AS label, 'asap_sas' AS dataset, CASE WHEN doc_id % 6 IN (4, 5) THEN 'biology' ELSE 'science' END AS domain, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test_ua' END AS split FROM documents"


def _prompts(spark, sf):
    root, d = scratch(spark, "tsv"), read(spark, sf, "documents")
    score = lambda by: F.when(F.col("doc_id") % by < 3, (F.col("doc_id") % by).cast("string")).otherwise("n/a")
    rows = d.select("doc_id", (1 + F.col("doc_id") % 6).alias("EssaySet"), score(4).alias("Score1"), score(5).alias("Score2"), F.col("text").alias("EssayText"))
    for stem, part in (("train", 0), ("test", 1)):
        sinks.csv(rows.where(f"doc_id % 2 = {part}").drop("doc_id"), f"{root}/{stem}.tsv", sep="\t")
    return root


@query(_TSV)
def source_tsv_prompts(spark, sf):
    """A quoted TSV whose texts hold line breaks and quotes."""
    return readers.tsv_prompts(spark, _prompts(spark, sf))


@query("SELECT 'set_' || (1 + doc_id % 6) AS grp, CAST(doc_id % 4 AS DOUBLE) AS y_true, CAST(doc_id % 5 AS DOUBLE) AS y_pred FROM documents WHERE doc_id % 4 < 3 AND doc_id % 5 < 3")
def source_two_raters(spark, sf):
    return readers.two_raters(spark, _prompts(spark, sf))


@query("""SELECT source AS question_id, CASE WHEN source <> 'src3' THEN 'About ' || source ELSE '' END AS question, CASE WHEN source <> 'src3' THEN 'alternate ' || source ELSE '' END AS reference_answer, text AS student_answer,
  (g / 3 + 1) / 2 AS score, CASE WHEN g > 0 THEN 'correct' ELSE 'incorrect' END AS label, 'powergrading' AS dataset, 'civics' AS domain, 'all' AS split
  FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS g FROM documents WHERE doc_id % 5 <> 0)""")
def source_graded_tsv(spark, sf):
    """Three graders and a ragged answer key (blank alternates, a missing question); rows with a grade that is no number go."""
    root, d = scratch(spark, "graded"), read(spark, sf, "documents")
    key = d.select("source").distinct().where("source <> 'src3'").select(F.concat_ws("\t", "source", F.concat(F.lit(" About "), "source"), F.lit(" "), F.concat(F.lit(" alternate "), "source"), F.lit("x")).alias("value"))
    key.union(spark.createDataFrame([("qid\tquestion\talternates",)], "value string")).write.text(f"{root}/key")
    pick = lambda *votes: F.when(F.col("doc_id") % 4 == 0, votes[0]).when(F.col("doc_id") % 4 == 1, votes[1]).otherwise(votes[2])
    rows = d.select(F.col("source").alias("Q#"), F.col("text").alias("answer"), pick("1", "1", "-1").alias("G1"), pick("1", "1", "-1").alias("G2"), F.when(F.col("doc_id") % 5 == 0, "?").otherwise(pick("1", "-1", "1")).alias("G3"))
    sinks.csv(rows, f"{root}/answers.tsv", sep="\t")
    return readers.graded_tsv(spark, f"{root}/answers.tsv", f"{root}/key")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, '' AS rationale FROM documents")
def source_json_records(spark, sf):
    path = scratch(spark, "json")
    sinks.json_lines(read(spark, sf, "documents").select("doc_id", "text", "lang"), path)
    return readers.json_records(spark, path, ("doc_id", "text", "rationale"), lines=True)


@query(A + "SELECT dataset, split, count(*) AS n, sum(score) AS total, max(length(student_answer)) AS longest FROM answers GROUP BY ALL")
def sink_parquet_partitions(spark, sf):
    """Answers partitioned by dataset, read back as one table."""
    path = scratch(spark, "answers")
    sinks.parquet(answers(spark, sf), path)
    return spark.read.parquet(path).groupBy("dataset", "split").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.max(F.length("student_answer")).alias("longest"))


@query(A + "SELECT row_id, student_answer, label FROM answers ORDER BY row_id LIMIT 50")
def sink_json_lines(spark, sf):
    """The backup of the first 50 rows (the feature's own limit)."""
    path = scratch(spark, "first")
    sinks.json_lines(answers(spark, sf).select("row_id", "student_answer", "label"), path, first=50)
    return spark.read.schema("row_id long, student_answer string, label string").json(path)


@query(A + "SELECT dataset, split, count(*) AS n, round(avg(score), 6) AS mean_score FROM answers GROUP BY ALL")
def sink_csv(spark, sf):
    path = scratch(spark, "report")
    sinks.csv(r6(answers(spark, sf).groupBy("dataset", "split").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")), "mean_score"), path)
    return spark.read.option("header", True).schema("dataset string, split string, n long, mean_score double").csv(path)


@query(A + "SELECT 'split ' || split AS item, CAST(count(*) AS DOUBLE) AS value FROM answers GROUP BY split UNION ALL SELECT 'rows', count(*) FROM answers UNION ALL SELECT 'coverage score', round(count(score) / count(*), 6) FROM answers UNION ALL SELECT 'all_null empty', 1")
def sink_sidecar(spark, sf):
    """Counts, coverage and all-null columns of the sidecar, through its JSON text."""
    side = sinks.sidecar(answers(spark, sf).withColumn("empty", F.lit(None).cast("double")), ["score", "empty"])
    side = json.loads(json.dumps(sinks.clean(side), default=str))
    rows = [(f"split {k}", float(v)) for k, v in side["splits"].items()] + [("rows", float(side["n_rows"])), ("coverage score", round(side["coverage"]["score"], 6))]
    return spark.createDataFrame(rows + [(f"all_null {c}", 1.0) for c in side["all_null"]], "item string, value double")


@query(A + """SELECT string_agg(line, chr(10) ORDER BY i, line) AS report FROM (SELECT 0 AS i, '| split | n | mean_score |' AS line UNION ALL SELECT 1, '| --- | --- | --- |'
  UNION ALL SELECT 2, '| ' || split || ' | ' || count(*) || ' | ' || coalesce(printf('%.4f', avg(score)), '—') || ' |' FROM answers GROUP BY split)""")
def sink_markdown(spark, sf):
    rows = answers(spark, sf).groupBy("split").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")).orderBy("split").collect()  # a row a split
    return spark.createDataFrame([(sinks.markdown([r.asDict() for r in rows], ["split", "n", "mean_score"]),)], "report string")


@query("SELECT md5(text) AS md5, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 0")
def checksum_groups(spark, sf):
    """Equal contents by digest, as the manifest tells changed files."""
    return read(spark, sf, "documents").where("text is not null").groupBy(F.md5("text").alias("md5")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text) AS sha256, 1 AS version, 0 AS written_again FROM documents WHERE text IS NOT NULL")
def archive_publication(spark, sf):
    """Texts packed 256 ids to an archive, published as files by two runs, of which the second writes nothing, and read back from there. A row is a file, whatever its id; rows of one id are numbered."""
    docs = read(spark, sf, "documents").where("text is not null")
    group = docs.select("doc_id", F.coalesce(F.expr("doc_id div 256").cast("string"), F.lit("none")).alias("archive"), "text").repartition("archive")
    row = F.row_number().over(Window.partitionBy("archive", "doc_id").orderBy("text"))
    named = group.select("archive", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit("."), row.cast("string"), F.lit(".txt")).alias("member"), "text")
    root, dest = scratch(spark, "archives"), scratch(spark, "published")
    archives.pack(named, root, "archive", "member", "text")
    archives.publish(spark, root, dest)
    again = archives.publish(spark, root, dest)
    back = archives.read_back(spark, dest).where("found = sha256")
    return back.select(F.regexp_extract("path", "/([^/.]+)[.][0-9]+[.]txt$", 1).try_cast("long").alias("doc_id"), F.col("found").alias("sha256"), F.col("version").cast("int").alias("version"), F.lit(again).alias("written_again"))


@query("SELECT 'missing' AS kind, unnest(['question', 'score', 'split']) AS name UNION ALL SELECT 'extra', unnest(['doc_id', 'n_chars'])")
def schema_report(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("question_id"), F.lit("").alias("reference_answer"), F.col("text").alias("student_answer"), F.lit("").alias("label"), F.col("lang").alias("dataset"), F.col("lang").alias("domain"), "n_chars")
    found = column_report(d)
    return spark.createDataFrame([(k, c) for k in ("missing", "extra") for c in found[k]], "kind string, name string")


@query("SELECT doc_id AS row_id, '' AS question_id, '' AS question, '' AS reference_answer, coalesce(text, '') AS student_answer, TRY_CAST(CASE WHEN doc_id % 3 = 0 THEN 'x' WHEN doc_id % 3 = 1 THEN CAST(doc_id AS VARCHAR) END AS DOUBLE) AS score, '' AS label, coalesce(lang, '') AS dataset, '' AS domain, '' AS split FROM documents")
def schema_coercion(spark, sf):
    score = F.when(F.col("doc_id") % 3 == 0, "x").when(F.col("doc_id") % 3 == 1, F.col("doc_id").cast("string")).when(F.col("doc_id") % 3 == 2, "NaN")
    return coerce(read(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("student_answer"), score.alias("score"), F.col("lang").alias("dataset"), "n_chars"))


@query("SELECT true AS same, false AS repeated, false AS missing")
def alignment(spark, sf):
    """Whether key sets agree: equal ones, ones with a repeated key, ones with a missing key."""
    ids = answers(spark, sf).select("row_id")

    def holds(b) -> bool:
        try:
            validation.assert_aligned(ids, b)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(holds(ids), holds(ids.union(ids.where("row_id = 1"))), holds(ids.where("row_id <> 1")))], "same boolean, repeated boolean, missing boolean")


@query(P + "SELECT grp, round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS rmse, round(avg(abs(y_pred - y_true)), 6) AS mae, round(avg((y_pred = y_true)::INT), 6) AS accuracy FROM preds GROUP BY grp")
def metric_registry(spark, sf):
    """Named metrics side by side."""
    return r6(mt.compute(preds(spark, sf), ["grp"], ["rmse", "mae", "accuracy"]), "rmse", "mae", "accuracy")


_FOLD_ALL = """, f AS (SELECT *, CASE WHEN dataset IN ('en', 'de') THEN 'all' ELSE split END AS s2 FROM answers), q AS (SELECT dataset, question_id, count(*) AS n FROM f WHERE dataset IN ('en', 'de') GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, question_id) - 1 AS i, greatest(least(count(*) OVER (PARTITION BY dataset), 5), 2) AS k FROM q)
SELECT f.dataset, f.question_id, CAST(coalesce(CASE WHEN (k.i // k.k) % 2 = 0 THEN k.i % k.k ELSE k.k - 1 - k.i % k.k END, -1) AS INT) AS fold, count(*) AS n FROM f LEFT JOIN k USING (dataset, question_id) GROUP BY ALL"""


@query(A + _FOLD_ALL)
def materialised_folds(spark, sf):
    """Folds of corpora without official splits, -1 elsewhere."""
    a = answers(spark, sf).withColumn("split", F.when(F.col("dataset").isin("en", "de"), "all").otherwise(F.col("split")))
    return splits.materialise(a).groupBy("dataset", "question_id", "fold").agg(F.count("*").alias("n"))


@query(
    A
    + ", q AS (SELECT dataset, question_id, count(*) AS n FROM answers WHERE dataset IN ('en', 'de') GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY n DESC, question_id) - 1 AS i, greatest(least(count(*) OVER (PARTITION BY dataset), 5), 2) AS k FROM q) SELECT v AS view, f.dataset, f.question_id, CAST(coalesce(CASE WHEN (k.i // k.k) % 2 = 0 THEN k.i % k.k ELSE k.k - 1 - k.i % k.k END, -1) AS INT) AS fold, count(*) AS n, round(sum(score), 6) AS total FROM answers f CROSS JOIN (VALUES ('features'), ('encoder')) t(v) LEFT JOIN k USING (dataset, question_id) GROUP BY ALL"
)
def migrated_folds(spark, sf):
    """Two stored views whose folds of two datasets are replaced in place; the other datasets keep theirs."""
    root, a = scratch(spark, "views"), answers(spark, sf).select("row_id", "question_id", "dataset", "score").withColumn("fold", F.lit(-1))
    views = {"features": f"{root}/features", "encoder": f"{root}/encoder"}
    for path in views.values():
        sinks.parquet(a, path)
    migration.migrate_folds(spark, views["features"], list(views.values()), ["en", "de"])
    both = [spark.read.schema(a.schema).parquet(path).select(F.lit(name).alias("view"), "*") for name, path in views.items()]
    return r6(both[0].union(both[1]).groupBy("view", "dataset", "question_id", "fold").agg(F.count("*").alias("n"), F.sum("score").alias("total")), "total")


@query(
    A
    + """, d AS (SELECT dataset, count(*) AS n, round(avg(score), 6) AS mean_score, row_number() OVER (ORDER BY dataset) AS i FROM answers GROUP BY dataset)
SELECT dataset AS name, CASE i WHEN 1 THEN 'partial' WHEN 2 THEN 'corrupt' ELSE 'ok' END AS status, CASE WHEN i <> 2 THEN n END AS n, CASE WHEN i > 2 THEN mean_score END AS mean_score FROM d UNION ALL SELECT 'nowhere', 'missing', NULL, NULL"""
)
def report_scan(spark, sf):
    """One JSON report a dataset, the first without a mean and the second cut short, scanned with one that isn't there."""
    rows = r6(answers(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score")), "mean_score").withColumn("i", F.row_number().over(Window.orderBy("dataset")))  # a row a dataset
    text = F.to_json(F.struct("n", F.when(F.col("i") > 1, F.col("mean_score")).alias("mean_score")))
    root = scratch(spark, "reports")
    rows.select(F.col("dataset").alias("name"), F.when(F.col("i") == 2, F.substring(text, 1, 9)).otherwise(text).alias("value")).write.partitionBy("name").text(root)
    expected = rows.select(F.col("dataset").alias("name")).union(spark.range(1).select(F.lit("nowhere")))
    return readers.json_reports(spark, root, expected, "n bigint, mean_score double")


_KEY42 = "((row_id * 7919 + 42) % 2147483647 * 1103515245 + 12345) % 2147483647"
_BINNED = """b AS (SELECT *, CASE WHEN score IS NULL OR hi = lo THEN 0 ELSE greatest(ceil((score - lo) / ((hi - lo) / 6)) - 1, 0) END::INT AS bin FROM (SELECT *, min(score) OVER () AS lo, max(score) OVER () AS hi FROM answers)),
st AS (SELECT row_id, question_id, score, CAST((row_number() OVER (PARTITION BY dataset, bin ORDER BY """ + _KEY42 + """, row_id) - 1 + bin) % 5 AS INT) AS fold FROM (SELECT * REPLACE (CASE WHEN score IS NULL OR hi = lo THEN 0 ELSE greatest(ceil((score - lo) / ((hi - lo) / 6)) - 1, 0) END::INT AS bin) FROM (SELECT * EXCLUDE (lo, hi), min(score) OVER (PARTITION BY dataset) AS lo, max(score) OVER (PARTITION BY dataset) AS hi FROM b)))"""


@query(with_(ANSWERS, _BINNED) + "SELECT fold, count(*) AS n, round(sum(score), 6) AS total FROM st GROUP BY fold")
def stratified_folds(spark, sf):
    return r6(splits.stratified(answers(spark, sf), ["dataset"]).groupBy("fold").agg(F.count("*").alias("n"), F.sum("score").alias("total")), "total")


_PROBE = """, q AS (SELECT fold, question_id, sum(score) AS s, count(*) AS n FROM st WHERE score IS NOT NULL GROUP BY ALL), t AS (SELECT question_id, sum(s) AS qs, sum(n) AS qn FROM q GROUP BY ALL), f AS (SELECT fold, sum(s) AS fs, sum(n) AS fn FROM q GROUP BY ALL), g AS (SELECT sum(s) AS ts, sum(n) AS tn FROM q),
p AS (SELECT q.fold, q.question_id, coalesce((qs - s) / nullif(qn - n, 0), (ts - fs) / nullif(tn - fn, 0)) AS y FROM q JOIN t USING (question_id) JOIN f USING (fold) CROSS JOIN g)
SELECT count(*) AS n, round(sqrt(avg((score - y) ** 2)), 6) AS rmse FROM st JOIN p USING (fold, question_id) WHERE score IS NOT NULL"""


@query(with_(ANSWERS, _BINNED) + _PROBE)
def stratified_probe(spark, sf):
    """The question-mean probe over folds that split questions: what leakage alone predicts."""
    a = answers(spark, sf)
    return r6(protocol.probe_inflation(a, splits.stratified(a, ["dataset"]).select("row_id", "fold")), "rmse")


_BOTH_PROBES = """, fo AS (SELECT 'stratified' AS kind, question_id, score, fold FROM st WHERE score IS NOT NULL UNION ALL SELECT 'grouped', question_id, score, fold FROM answers JOIN gf USING (question_id) WHERE score IS NOT NULL),
q AS (SELECT kind, fold, question_id, sum(score) AS s, count(*) AS n FROM fo GROUP BY ALL), t AS (SELECT kind, question_id, sum(s) AS qs, sum(n) AS qn FROM q GROUP BY ALL),
f AS (SELECT kind, fold, sum(s) AS fs, sum(n) AS fn FROM q GROUP BY ALL), g AS (SELECT kind, sum(s) AS ts, sum(n) AS tn FROM q GROUP BY ALL),
p AS (SELECT q.kind, q.fold, q.question_id, coalesce((qs - s) / nullif(qn - n, 0), (ts - fs) / nullif(tn - fn, 0)) AS y FROM q JOIN t USING (kind, question_id) JOIN f USING (kind, fold) JOIN g USING (kind)),
r AS (SELECT sqrt(avg((score - y) ** 2) FILTER (kind = 'stratified')) AS a, sqrt(avg((score - y) ** 2) FILTER (kind = 'grouped')) AS b FROM fo JOIN p USING (kind, fold, question_id))
SELECT round(a, 6) AS stratified, round(b, 6) AS "grouped", round(a - b, 6) AS inflation FROM r"""


@query(with_(ANSWERS, _BINNED, _GROUPED) + _BOTH_PROBES)
def shortcut_inflation(spark, sf):
    """Leakage inflation of the question-mean shortcut: its error over folds that split questions, less that over grouped folds."""
    a = answers(spark, sf)
    grouped = a.join(splits.grouped(a.withColumn("__one", F.lit(1)), ["__one"]).select("question_id", "fold"), "question_id")
    one, other = (protocol.probe_inflation(a, f.select("row_id", "fold")).select(F.col("rmse").alias(n)) for n, f in (("stratified", splits.stratified(a, ["dataset"])), ("grouped", grouped)))
    both = one.crossJoin(F.broadcast(other))  # one row each
    return r6(both.withColumn("inflation", F.col("stratified") - F.col("grouped")), "stratified", "grouped", "inflation")


@query(A + "SELECT row_id, regexp_matches(student_answer, '[^\\x00-\\x7F]') AS non_ascii FROM answers")
def non_ascii_rows(spark, sf):
    """Rows that compatibility normalisation may change; the others skip Python."""
    return answers(spark, sf).select("row_id", F.col("student_answer").rlike(r"[^\x00-\x7F]").alias("non_ascii"))


def _letter_sql(text: str) -> str:
    return "[" + ", ".join(f"CAST(length(lower(coalesce({text}, ''))) - length(replace(lower(coalesce({text}, '')), '{chr(c)}', '')) AS DOUBLE)" for c in range(97, 123)) + "]"


def _letters(texts):
    """A portable stand-in for an encoder: counts of the letters a to z."""
    low = F.lower("text")
    counts = [(F.length(low) - F.length(F.replace(low, F.lit(chr(c)), F.lit("")))).cast("double") for c in range(97, 123)]
    return texts.select("text", F.array(*counts).alias("vector"))


@query(
    with_(ANSWERS, f"e AS (SELECT row_id, reference_answer, {_letter_sql('student_answer')} AS u, {_letter_sql('reference_answer')} AS v FROM answers WHERE trim(student_answer) <> '')")
    + "SELECT row_id, CASE WHEN trim(reference_answer) <> '' THEN round(CASE WHEN list_dot_product(u, u) * list_dot_product(v, v) > 0 THEN list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))) ELSE 0 END, 6) END AS cosine FROM e"
)
def encoded_similarity(spark, sf):
    """Distinct texts are encoded once; half of them come from a cache that also holds another model's vectors."""
    a = answers(spark, sf).where("trim(student_answer) <> ''").select("row_id", "student_answer", "reference_answer")
    half = _letters(a.where("row_id % 2 = 0").select(F.col("student_answer").alias("text")).distinct())
    cache = half.select(F.lit("letters").alias("model"), "text", "vector").union(a.select(F.lit("other"), F.col("student_answer"), F.array(F.lit(1.0))))
    both, _ = protocol.encode_distinct(a, ["student_answer", "reference_answer"], _letters, "letters", cache)
    return both.select("row_id", F.round(vx.cosine(F.col("student_answer_vec"), F.col("reference_answer_vec")), 6).alias("cosine"))


_KNOWN = "trim({0}) <> '' AND {0} IN (SELECT student_answer FROM a WHERE split = 'train')"


@query(
    with_(ANSWERS, f"""a AS (SELECT * FROM answers WHERE trim(student_answer) <> ''),
e AS (SELECT row_id, reference_answer, {_KNOWN.format('student_answer')} AS student_known, {_KNOWN.format('reference_answer')} AS reference_known, {_letter_sql('student_answer')} AS u, {_letter_sql('reference_answer')} AS v FROM a)""")
    + """SELECT row_id, student_known, coalesce(reference_known, false) AS reference_known, CASE WHEN trim(reference_answer) <> '' THEN round(CASE WHEN list_dot_product(u, u) * list_dot_product(v, v) > 0
  THEN list_dot_product(u, v) / (sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v))) ELSE 0 END, 6) END AS cosine FROM e"""
)
def stored_similarity(spark, sf):
    """Two runs over one vector store, with another model's vectors in it: the training answers, then all rows; the second encodes what the first did not store."""
    root = scratch(spark, "vector-store")
    a = answers(spark, sf).where("trim(student_answer) <> ''").select("row_id", "split", "student_answer", "reference_answer")
    train = a.where("split = 'train'").select("student_answer")
    vector_store.encode_stored(train, ["student_answer"], lambda t: t.select("text", F.array(F.lit(1.0)).alias("vector")), "other", root)
    vector_store.encode_stored(train, ["student_answer"], _letters, "letters", root)
    both = vector_store.encode_stored(a, ["student_answer", "reference_answer"], _letters, "letters", root)
    cosine = F.round(vx.cosine(F.col("student_answer_vec"), F.col("reference_answer_vec")), 6).alias("cosine")
    return both.select("row_id", F.col("student_answer_known").alias("student_known"), F.col("reference_answer_known").alias("reference_known"), cosine)


@query(P + "SELECT row_id, correct, CASE WHEN row_id % 3 = 0 THEN c END AS neural_score, CASE WHEN row_id % 3 = 0 THEN y END AS neural_pred FROM preds JOIN (SELECT row_id, max(conf) AS c, CAST(max(y_pred) AS DOUBLE) AS y FROM preds GROUP BY row_id) USING (row_id)")
def oof_join(spark, sf):
    p = preds(spark, sf)
    oof = p.where("row_id % 3 = 0").groupBy("row_id").agg(F.max("conf").alias("neural_score"), F.max("y_pred").cast("double").alias("neural_pred"))
    return protocol.with_oof(p.select("row_id", "correct"), oof)


@query(
    A
    + f""", t AS (SELECT row_id, row_number() OVER (ORDER BY {_KEY42}, row_id) AS i, greatest(1, floor(count(*) OVER () * 0.2)) AS cut FROM answers WHERE split = 'train' AND score IS NOT NULL)
SELECT a.row_id, CASE WHEN t.i <= t.cut THEN 'val' WHEN t.i IS NOT NULL THEN 'train' WHEN a.split = 'test_ud' AND a.score IS NOT NULL THEN 'test' END AS part FROM answers a LEFT JOIN t USING (row_id)"""
)
def calibration_split(spark, sf):
    """Train, validation and test rows of a calibrated head under official splits."""
    return protocol.calibration_parts(answers(spark, sf).withColumn("y", F.col("score")), True, "test_ud").select("row_id", "part")


@query(
    P
    + """, v AS (SELECT conf AS x, y_true::INT AS y FROM preds WHERE y_true < 3), r AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM v),
m AS (SELECT count(*) AS n, avg(x) FILTER (y = 0) AS m0, avg(x) FILTER (y = 1) AS m1, avg(x) FILTER (y = 2) AS m2, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS rho, (sum(rx) FILTER (y = 2) - count(*) FILTER (y = 2) * (count(*) FILTER (y = 2) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 2) * count(*) FILTER (y < 2)::DOUBLE) AS auc FROM r)
SELECT n, round(m0, 6) AS mean_0, round(m1, 6) AS mean_1, round(m2, 6) AS mean_2, round(rho, 5) AS spearman, round(auc, 5) AS auc, m0 <= m1 AND m1 <= m2 AS monotonic FROM m"""
)
def verdict_validation(spark, sf):
    """A signal against ordered verdicts: means, trend, rank correlation, area."""
    p = preds(spark, sf).select(F.col("conf").alias("signal"), F.element_at(F.array(F.lit("Incorrect"), F.lit("Partially correct"), F.lit("Correct"), F.lit("other")), F.col("y_true") + 1).alias("verdict"))
    out = protocol.verdict_signal(p, ("Incorrect", "Partially correct", "Correct"))
    return r6(out, "mean_0", "mean_1", "mean_2").withColumns({"spearman": F.round("spearman", 5), "auc": F.round("auc", 5)})


@query("SELECT vec_id, CAST(rank AS INT) AS rank, feature, round(value, 6) AS value FROM (SELECT vec_id, 'f' || (i - 1) AS feature, CAST(embedding[i] AS DOUBLE) AS value, row_number() OVER (PARTITION BY vec_id ORDER BY -abs(CAST(embedding[i] AS DOUBLE)), 'f' || (i - 1)) AS rank FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)) WHERE rank <= 5")
def top_contributions(spark, sf):
    """The five largest components by absolute value of each vector, as a local explanation lists them."""
    long = read(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", F.concat(F.lit("f"), "i").alias("feature"), F.col("v").cast("double").alias("value"))
    return r6(protocol.top_contributions(long, ["vec_id"], 5, "value"), "value")


@query(P + "SELECT grp, y_pred, min(row_id) AS row_id FROM preds GROUP BY ALL")
def example_rows(spark, sf):
    return protocol.first_of_each(preds(spark, sf), ["grp"], "y_pred")


def _boot(metric: str) -> str:
    per = {
        "macro_f1": "SELECT boot, avg(coalesce(f, 0)) AS v FROM (SELECT boot, l, 2.0::DOUBLE * coalesce(sum(n) FILTER (y = l AND {c} = l), 0) / nullif(coalesce(sum(n) FILTER (y = l), 0) + coalesce(sum(n) FILTER ({c} = l), 0), 0) AS f, coalesce(sum(n) FILTER (y = l), 0) + coalesce(sum(n) FILTER ({c} = l), 0) AS m FROM d, (VALUES (0), (1), (2), (3)) t(l) GROUP BY ALL) WHERE m > 0 GROUP BY boot",
        "qwk": "SELECT boot, CASE WHEN e > 1e-12 THEN 1 - dd / e WHEN dd = 0 THEN 1 END AS v FROM (SELECT boot, sum(n * (y - {c}) * (y - {c}))::DOUBLE AS dd, (sum(n * y * y) + sum(n * {c} * {c}))::DOUBLE - 2.0::DOUBLE * sum(n * y) * sum(n * {c}) / sum(n) AS e FROM d GROUP BY boot)",
    }[metric]
    return (
        P
        + f""", q AS (SELECT question_id, row_number() OVER (ORDER BY question_id) - 1 AS pos FROM (SELECT DISTINCT question_id FROM preds)), m AS (SELECT count(*) AS n FROM q),
g AS (SELECT boot, ((boot * 7919 + i * 104729 + 42) % 2147483647 * 1103515245 + 12345) % 2147483647 % n AS pos FROM m, (SELECT unnest(range(10000)) AS boot) b, (SELECT unnest(range((SELECT n FROM m))) AS i) j),
w AS (SELECT boot, pos, count(*) AS times FROM g GROUP BY ALL), c AS (SELECT question_id, CAST(y_true AS BIGINT) AS y, CAST(y_pred AS BIGINT) AS head, CAST(round_even(conf * 3, 0) AS BIGINT) AS base, count(*) AS n FROM preds GROUP BY ALL),
d AS (SELECT boot, y, head, base, sum(n * times) AS n FROM w JOIN q USING (pos) JOIN c USING (question_id) GROUP BY ALL),
h AS ({per.format(c="head")}), b2 AS ({per.format(c="base")}), x AS (SELECT h.v - b2.v AS d FROM h JOIN b2 USING (boot))
SELECT round(avg(d), 6) AS delta, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(avg((d <= 0)::INT), 6) AS p, count(*) AS n_boot, false AS degenerate FROM x"""
    )


def _arms(spark, sf):
    return preds(spark, sf).select("question_id", F.col("y_true").cast("long").alias("y"), F.col("y_pred").cast("long").alias("head"), F.rint(F.col("conf") * 3).cast("long").alias("base"))


@query(_boot("macro_f1"))
def bootstrap_macro_f1(spark, sf):
    return r6(protocol.bootstrap_counts(_arms(spark, sf), protocol.macro_f1_of_counts, 10_000), "delta", "lo", "hi", "p")


@query(_boot("qwk"))
def bootstrap_qwk(spark, sf):
    return r6(protocol.bootstrap_counts(_arms(spark, sf), protocol.qwk_of_counts, 10_000), "delta", "lo", "hi", "p")


@query("""SELECT * FROM (VALUES ('semeval', 'test_ud', 'macro_f1', 0.25), ('saf', 'test_uq', 'pearson', 0.25), ('asap_sas', 'test_ua', 'qwk', NULL), ('mohler', 'cv', 'pearson', NULL), ('powergrading', 'cv', 'macro_f1', NULL), ('mindreading', 'cv', 'qwk', NULL)) t(dataset, split, metric, generalization_gap)""")
def headlines(spark, sf):
    """The split and metric that each corpus is judged by, for made-up values of 0.75 on seen questions and 0.5 elsewhere."""
    rows = []
    for name, task in TASKS.items():
        values = {s: {task.headline: 0.75 if s == "test_ua" else 0.5} for s in (*task.test_splits, "cv")}
        h = protocol.headline(task, values)
        rows.append((name, h["split"], h["metric"], h["generalization_gap"]))
    return spark.createDataFrame(rows, "dataset string, split string, metric string, generalization_gap double")


@query(
    P
    + "SELECT grp, round(sqrt(avg((round_even(conf * 3, 0) - y_true) ** 2)) - sqrt(avg((y_pred - y_true) ** 2)), 6) AS rmse_gain, round(avg((y_pred = y_true)::INT) - avg((round_even(conf * 3, 0) = y_true)::INT), 6) AS accuracy_gain FROM preds GROUP BY grp"
)
def signed_gains(spark, sf):
    """Gains of one arm over another, positive when better, for an error and a score."""
    arm = preds(spark, sf).select("grp", "y_true", "y_pred", F.rint(F.col("conf") * 3).alias("other"))
    rmse = lambda c: F.sqrt(F.avg(F.pow(F.col(c) - F.col("y_true"), 2)))
    hit = lambda c: F.avg((F.col(c) == F.col("y_true")).cast("double"))
    return r6(arm.groupBy("grp").agg(protocol.gain("rmse", rmse("y_pred"), rmse("other")).alias("rmse_gain"), protocol.gain("accuracy", hit("y_pred"), hit("other")).alias("accuracy_gain")), "rmse_gain", "accuracy_gain")


@query("SELECT c AS feature FROM (SELECT unnest(['sem_cosine', 'lex_token_dice', 'len_student_chars']) AS c) ORDER BY c")
def shared_feature_names(spark, sf):
    """Features that all corpora have, neural columns apart."""
    names = protocol.shared_features({"a": ["sem_cosine", "lex_token_dice", "len_student_chars", *ft.NEURAL], "b": ["len_student_chars", "lex_token_dice", "sem_cosine", "rub_n_concepts", *ft.NEURAL]})
    return spark.createDataFrame([(c,) for c in names], "feature string")
