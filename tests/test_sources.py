import zipfile

from pyspark.sql import functions as F

from markwright.sources import readers, sinks
from markwright.streaming import answers as stream


def test_xml(spark, tmp_path):
    d = tmp_path / "beetle" / "test-unseen-answers" / "Core"
    d.mkdir(parents=True)
    (d / "a.xml").write_text('<question id="Q1"><questionText>Why?</questionText><referenceAnswers><referenceAnswer category="GOOD" id="r1">good</referenceAnswer><referenceAnswer category="BEST" id="r2">best</referenceAnswer></referenceAnswers><studentAnswers><studentAnswer accuracy="correct" id="s1">yes</studentAnswer><studentAnswer accuracy="incorrect" id="s2">no</studentAnswer></studentAnswers></question>')
    rows = readers.xml(spark, str(tmp_path)).orderBy("student_answer").collect()
    assert [(r.question_id, r.reference_answer, r.student_answer, r.label, r.split, r.domain) for r in rows] == [("Q1", "best", "no", "incorrect", "test_ua", "beetle"), ("Q1", "best", "yes", "correct", "test_ua", "beetle")]


def test_tsv_and_raters(spark, tmp_path):
    (tmp_path / "train.tsv").write_text('Id\tEssaySet\tScore1\tScore2\tEssayText\n1\t1\t2\t1\t"two\nlines"\n2\t5\tx\t1\tb\n')
    rows = readers.tsv_prompts(spark, str(tmp_path)).orderBy("question_id").collect()
    assert [(r.question_id, r.student_answer, r.score, r.domain, r.split) for r in rows] == [("set_1", "two\nlines", 2.0, "science", "train"), ("set_5", "b", None, "biology", "train")]
    assert readers.two_raters(spark, str(tmp_path)).count() == 1


def test_graded_tsv(spark, tmp_path):
    (tmp_path / "key.tsv").write_text("qid\tquestion\talt\n1\tWhat?\t\tsecond\tthird\n2\tWho?\n")
    (tmp_path / "g.tsv").write_text("Q#\tanswer\tG1\tG2\tG3\n1\tx\t1\t1\t0\n1\ty\t1\t?\t0\n9\tz\t-1\t-1\t-1\n")
    rows = readers.graded_tsv(spark, str(tmp_path / "g.tsv"), str(tmp_path / "key.tsv")).orderBy("question_id").collect()
    assert [(r.question_id, r.question, r.reference_answer, round(r.score, 4), r.label) for r in rows] == [("1", "What?", "second", round(5 / 6, 4), "correct"), ("9", "", "", 0.0, "incorrect")]


def test_spreadsheets(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Answer</t></is></c><c r="B1" t="inlineStr"><is><t>Score</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>2</v></c></row></sheetData></worksheet>'
    shared = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>because</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "SS1.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", shared)
    row = readers.spreadsheets(spark, str(tmp_path)).first()
    assert (row.question_id, row.student_answer, row.score, row.label, row.split) == ("SS1", "because", 2.0, "score_2", "all")


def test_parquet_json_and_sinks(spark, tmp_path):
    src = spark.createDataFrame([("Why?", "ref", "ans", 1.0, "Correct", "mohler")], "question string, reference_answer string, provided_answer string, score double, verification_feedback string, data_source string")
    src.toPandas().to_parquet(tmp_path / "train-00000-of-00001.parquet")
    df = readers.parquet_splits(spark, str(tmp_path))
    assert (df.first().split, len(df.first().question_id)) == ("train", 16)
    sinks.parquet(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    side = sinks.sidecar(df.withColumn("f", F.lit(None).cast("double")), ["f"])
    assert side["all_null"] == ["f"] and side["splits"] == {"train": 1}
    sinks.report({"x": float("nan")}, str(tmp_path / "r.json"))
    assert '"x": null' in (tmp_path / "r.json").read_text()
    assert sinks.markdown([{"a": 0.5, "b": None}], ["a", "b"]).endswith("| 0.5000 | — |")
    manifest = readers.checksums(spark, str(tmp_path / "out"))
    assert readers.changed(spark, str(tmp_path / "out"), manifest).isEmpty()


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta", "alpha")], "row_id long, reference_answer string, student_answer string").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("row_id long, reference_answer string, student_answer string").parquet(str(tmp_path / "in"))
    q = stream.scored_stream(s).writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert spark.table("scored").first().lex_token_overlap == 0.5


QUESTION = '<question id="{id}"><questionText>Why?</questionText><referenceAnswers><referenceAnswer category="GOOD" id="r">good</referenceAnswer></referenceAnswers><studentAnswers><studentAnswer accuracy="correct" id="s">{text}</studentAnswer></studentAnswers></question>'


def test_xml_reads_each_answer_once(spark, tmp_path):
    def put(place, text, question='id="Q"'):
        d = tmp_path / place
        d.mkdir(parents=True, exist_ok=True)
        (d / "q1.xml").write_text(QUESTION.replace('id="{id}"', question).replace("{text}", text))

    for folder in ("Core", "Extra", "Dependency"):
        put(f"beetle/train/{folder}", folder)
    put("beetle/train", "loose")
    put("sciEntsBank/test-unseen-domains", "own", "")
    put("sciEntsBank/test-unseen-domains/Extra", "extra")
    put("sciEntsBank/training/Core", "legacy")
    put("sciEntsBank/reliability/round1", "skipped")
    put("other/train/Core", "skipped")
    rows = sorted((r.domain, r.split, r.question_id, r.student_answer) for r in readers.xml(spark, str(tmp_path)).collect())
    assert rows == [("beetle", "train", "Q", "Core"), ("sciEntsBank", "test_ud", "q1", "own"), ("sciEntsBank", "train", "Q", "legacy")]
    assert readers.xml(spark, str(tmp_path), "beetle").count() == 1


def test_answer_key_takes_any_number_of_alternates(spark, tmp_path):
    (tmp_path / "key.tsv").write_text("qid\tquestion\n7\tq" + "\t" * 20_000 + "late\n")
    assert [tuple(r) for r in readers.answer_key(spark, str(tmp_path / "key.tsv")).collect()] == [("7", "q", "late")]
