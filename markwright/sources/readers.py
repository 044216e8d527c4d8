"""Readers of the raw corpora: XML, Parquet, TSV, ragged TSV, spreadsheets, JSON. All return the unified answers schema."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schema import coerce

#: Corpora and split folders of the XML source, file stems of the Parquet source, domains of the TSV prompts.
XML_CORPORA = ("beetle", "sciEntsBank")
XML_SPLITS = {"train": "train", "training": "train", "test-unseen-answers": "test_ua", "test-unseen-questions": "test_uq", "test-unseen-domains": "test_ud"}
PARQUET_SPLITS = {"train": "train", "validation": "dev", "unseen_answers": "test_ua", "unseen_questions": "test_uq"}
TSV_SPLITS = {"train": "train", "dev": "dev", "validation": "dev", "test": "test_ua"}
PROMPT_DOMAINS = {"1": "science", "2": "science", "5": "biology", "6": "biology"}

XML_QUESTION = (
    "_id string, questionText string, referenceAnswers struct<referenceAnswer: array<struct<_VALUE: string, _category: string, _id: string>>>, "
    "studentAnswers struct<studentAnswer: array<struct<_VALUE: string, _accuracy: string, _id: string>>>"
)


def _mapped(value, table: dict[str, str], default=None):
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.create_map(*pairs)[value]
    return F.coalesce(found, F.lit(default)) if default is not None else found


def _xml_place(path) -> list:
    """corpus, split folder, and whether a file lies in the folder's ``Core``; all empty for files elsewhere (``Extra``, deeper folders)."""
    pattern = "/(" + "|".join(XML_CORPORA) + ")/([^/]+)/(Core/)?[^/]+[.]xml$"
    return [F.regexp_extract(path, pattern, i).alias(n) for i, n in ((1, "corpus"), (2, "folder"), (3, "core"))]


def xml(spark: SparkSession, root: str, corpus: str | None = None) -> DataFrame:
    """``root/corpus/split/(Core/)*.xml``: one row a student answer; the BEST reference, else the first; malformed files give no rows.

    ``Core`` holds the primary annotation and other folders the same answers again, so a split with a file in
    ``Core`` is read from there, any other from its own folder. A question without an id takes its file's name.
    """
    options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.xml"}
    files = spark.read.format("binaryFile").options(**options).load(root).select(*_xml_place(F.col("path")))  # names only
    cored = files.where("core <> ''").select(F.col("corpus").alias("c"), F.col("folder").alias("f")).distinct()
    df = spark.read.format("xml").option("rowTag", "question").option("mode", "DROPMALFORMED").options(**options).schema(XML_QUESTION).load(root)
    df = df.select("*", F.col("_metadata.file_path").alias("path"))
    df = df.select("*", *_xml_place(F.col("path"))).withColumn("split", _mapped(F.col("folder"), XML_SPLITS)).where("corpus <> '' and split is not null")
    if corpus:
        df = df.where(F.col("corpus") == corpus)
    df = df.join(F.broadcast(cored), F.expr("corpus = c and folder = f"), "left").where("c is null or core <> ''")  # a row a corpus and split
    refs = F.col("referenceAnswers.referenceAnswer")
    best = F.coalesce(F.get(F.filter(refs, lambda r: F.upper(r["_category"]) == "BEST"), F.lit(0)), F.get(refs, F.lit(0)))
    question = F.coalesce("_id", F.regexp_extract("path", r"([^/]+)[.]xml$", 1)).alias("question_id")
    rows = df.select(question, F.trim("questionText").alias("question"), F.trim(best["_VALUE"]).alias("reference_answer"), "corpus", "split", F.explode("studentAnswers.studentAnswer").alias("a"))
    return coerce(rows.select("question_id", "question", "reference_answer", F.trim("a._VALUE").alias("student_answer"), F.col("a._accuracy").alias("label"), F.lit("semeval").alias("dataset"), F.col("corpus").alias("domain"), "split"))


def _stem(extension: str):
    """Name of a file, or of the folder that a writer put its parts in, without extension and shard numbers."""
    return F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]*?)(?:-\d+-of-\d+)?[.]{extension}(?:/[^/]+)?$", 1)


def parquet_splits(spark: SparkSession, root: str, dataset: str = "saf", domain: str = "communication_networks") -> DataFrame:
    """One Parquet file (or folder) a split; files of unknown stems are skipped; the question's MD5 prefix is its id."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(root).select("*", _stem("parquet").alias("stem")).withColumn("split", _mapped(F.col("stem"), PARQUET_SPLITS)).where("split is not null")
    return coerce(df.select(tx.question_hash(F.col("question")).alias("question_id"), "question", "reference_answer", F.col("provided_answer").alias("student_answer"), "score", F.col("verification_feedback").alias("label"), F.lit(dataset).alias("dataset"), F.lit(domain).alias("domain"), "split"))


def parquet_single(spark: SparkSession, path: str, dataset: str = "mohler", domain: str = "computer_science", source: str | None = "mohler") -> DataFrame:
    """One Parquet file with constants for dataset, domain and split; ``source`` filters data_source in the scan."""
    df = spark.read.parquet(path)
    if source and "data_source" in df.columns:
        df = df.where(F.lower("data_source") == source)
    return coerce(df.select(tx.question_hash(F.col("question")).alias("question_id"), "question", "reference_answer", F.col("provided_answer").alias("student_answer"), F.col("grade").alias("score"), F.lit(dataset).alias("dataset"), F.lit(domain).alias("domain"), F.lit("all").alias("split")))


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("sep", "\t").option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def tsv_prompts(spark: SparkSession, root: str) -> DataFrame:
    """``{split}.tsv`` with EssaySet, Score1 and EssayText; texts may hold line breaks."""
    df = _tsv(spark, root).select("*", _stem("tsv").alias("stem")).withColumn("split", _mapped(F.col("stem"), TSV_SPLITS)).where("split is not null")
    return coerce(df.select(F.concat(F.lit("set_"), "EssaySet").alias("question_id"), F.col("EssayText").alias("student_answer"), F.col("Score1").alias("score"), F.lit("asap_sas").alias("dataset"), _mapped(F.col("EssaySet"), PROMPT_DOMAINS, "science").alias("domain"), "split"))


def two_raters(spark: SparkSession, root: str) -> DataFrame:
    """Rows that both raters scored: grp, y_true, y_pred."""
    df = _tsv(spark, root).select(F.concat(F.lit("set_"), "EssaySet").alias("grp"), F.expr("try_cast(Score1 AS DOUBLE)").alias("y_true"), F.expr("try_cast(Score2 AS DOUBLE)").alias("y_pred"))
    return df.where("y_true is not null and y_pred is not null")


def answer_key(spark: SparkSession, path: str) -> DataFrame:
    """Ragged TSV: question_id, question, and the first non-blank alternative as reference; the header line is skipped."""
    parts = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(~F.lower(F.get("f", F.lit(0))).isin("qid", "q#", "question_id"))
    first = F.get(F.filter(F.slice("f", F.lit(3), F.greatest(F.size("f"), F.lit(1))), lambda x: F.trim(x) != ""), F.lit(0))
    return parts.select(F.trim(F.get("f", F.lit(0))).alias("question_id"), F.trim(F.get("f", F.lit(1))).alias("question"), F.coalesce(F.trim(first), F.lit("")).alias("reference_answer")).where("question_id <> ''")


def graded_tsv(spark: SparkSession, path: str, key_path: str) -> DataFrame:
    """Three graders: rows with a non-numeric grade go; score is (mean + 1) / 2, label correct if two of them exceed 0."""
    grades = [F.expr(f"try_cast({g} AS DOUBLE)").alias(g.lower()) for g in ("G1", "G2", "G3")]
    df = _tsv(spark, path).select(F.col("`Q#`").alias("question_id"), F.col("answer").alias("student_answer"), *grades).na.drop(subset=["g1", "g2", "g3"])
    votes = sum((F.col(g) > 0).cast("int") for g in ("g1", "g2", "g3"))
    rows = df.join(answer_key(spark, key_path), "question_id", "left")  # one row a question; Spark broadcasts it by its size
    return coerce(rows.select("question_id", "question", "reference_answer", "student_answer", ((F.col("g1") + F.col("g2") + F.col("g3")) / 3 + 1).alias("__s"), F.when(votes >= 2, "correct").otherwise("incorrect").alias("label")).withColumn("score", F.col("__s") / 2).withColumns({"dataset": F.lit("powergrading"), "domain": F.lit("civics"), "split": F.lit("all")}))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> Iterator[dict[str, str]]:
    """Rows of a workbook's first sheet as header -> text, by the standard library alone."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        sheet = ElementTree.fromstring(z.read(sorted(n for n in z.namelist() if re.match(r"xl/worksheets/sheet\d+\.xml", n))[0]))
    header: dict[str, str] = {}
    for row in sheet.iter(f"{_MAIN}row"):
        cells = {}
        for c in row.iter(f"{_MAIN}c"):
            v = c.find(f"{_MAIN}v")
            value = "".join(t.text or "" for t in c.iter(f"{_MAIN}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
            cells[re.match(r"[A-Z]+", c.get("r"))[0]] = shared[int(value)] if c.get("t") == "s" and value else value
        if not header:
            header = cells
        else:
            yield {name: cells.get(col, "") for col, name in header.items()}


def spreadsheets(spark: SparkSession, root: str, prompt: str = "Explain the mental state in task {task}.") -> DataFrame:
    """A folder of workbooks, one a task; files without Answer and Score columns are skipped."""

    def run(parts):
        for batch in parts:
            task, answer, score = [], [], []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                name = re.sub(r"\.xlsx$", "", path.rsplit("/", 1)[-1])
                rows = list(sheet_rows(content))
                if rows and {"Answer", "Score"} <= set(rows[0]):
                    task += [name] * len(rows)
                    answer += [r["Answer"] for r in rows]
                    score += [r["Score"] for r in rows]
            yield pa.RecordBatch.from_pydict({"task": pa.array(task, pa.string()), "answer": pa.array(answer, pa.string()), "score": pa.array(score, pa.string())})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(root).select("path", "content")
    rows = files.mapInArrow(run, "task string, answer string, score string")
    whole = F.expr("try_cast(try_cast(score AS DOUBLE) AS INT)")
    before, after = prompt.split("{task}")
    return coerce(rows.select(F.col("task").alias("question_id"), F.concat(F.lit(before), "task", F.lit(after)).alias("question"), F.col("answer").alias("student_answer"), "score", F.concat(F.lit("score_"), whole).alias("label"), F.lit("mindreading").alias("dataset"), F.lit("psychology").alias("domain"), F.lit("all").alias("split")))


def json_records(spark: SparkSession, path: str, columns: tuple[str, ...], lines: bool = False) -> DataFrame:
    """JSON records (arrays of them, or one a line) reduced to ``columns``; missing ones are empty."""
    df = spark.read.option("multiLine", not lines).json(path)
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """SHA-256 of every file under ``root``: sha256, path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.sha2("content", 256).alias("sha256"), "path")


def changed(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """Files whose checksum isn't in a manifest (sha256, path)."""
    return checksums(spark, root).join(manifest, ["sha256", "path"], "left_anti")


READERS = {"semeval": xml, "saf": parquet_splits, "asap_sas": tsv_prompts, "mohler": parquet_single, "powergrading": graded_tsv, "mindreading": spreadsheets}


def load_all(spark: SparkSession, sources: dict[str, tuple]) -> dict[str, DataFrame]:
    """dataset -> answers for each enabled source (name -> reader arguments)."""
    return {name: READERS[name](spark, *args) for name, args in sources.items()}


def pooled(frames: dict[str, DataFrame]) -> DataFrame:
    out = None
    for df in frames.values():
        out = df if out is None else out.unionByName(df)
    return out


def json_reports(spark: SparkSession, root: str, expected: DataFrame, fields: str) -> DataFrame:
    """A tolerant scan of ``root``/name=.../ for JSON reports: name, status, and ``fields`` (a DDL schema).

    ``expected`` has the names asked for. Status is ``ok``; ``partial`` where a field is missing or of another type (it
    is null, the others stand); ``corrupt`` where a file isn't JSON (all null); ``missing`` without a file, or
    with an empty one.
    """
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(fields)
    names = [f.name for f in schema.fields]
    files = spark.read.option("wholetext", True).schema("value string, name string").text(root)
    valid = F.try_parse_json(F.col("value"))
    parsed = files.select("name", valid.isNotNull().alias("valid"), *[F.try_variant_get(valid, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields])
    whole = F.lit(True)
    for c in names:
        whole = whole & F.col(c).isNotNull()
    status = F.when(F.col("valid").isNull(), "missing").when(~F.col("valid"), "corrupt").when(whole, "ok").otherwise("partial")
    return expected.select("name").distinct().join(parsed, "name", "left").select("name", status.alias("status"), *names)
