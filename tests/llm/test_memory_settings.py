"""Settings that bound an executor's memory hold while an operator runs, and are the session's own again afterwards."""

import datetime

import pyarrow as pa
import pytest

from markwright.llm import change_feed, common, kneser_ney

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Seen(Exception):
    pass


def test_rows_a_batch(spark):
    def sizes(parts):
        for batch in parts:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    before = spark.conf.get(ROWS)
    with common.rows_a_batch(spark, 50):
        got = [r.n for r in spark.range(0, 1000, 1, 2).mapInArrow(sizes, "n long").collect()]
        with common.rows_a_batch(spark, 90):
            assert spark.conf.get(ROWS) == "50"
    assert max(got) == 50 and sum(got) == 1000 and spark.conf.get(ROWS) == before


def test_classifier_takes_small_batches(spark, monkeypatch):
    def seen(*_):
        raise Seen(spark.conf.get(ROWS))

    monkeypatch.setattr(kneser_ney, "train", seen)
    before = spark.conf.get(ROWS)
    docs = spark.createDataFrame([(i, "some text", "en") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(Seen, match=str(kneser_ney.ROWS)):
        kneser_ney.classify(docs, docs.select("doc_id"))
    assert spark.conf.get(ROWS) == before


def test_stores_are_closed_by_their_tasks(spark, monkeypatch):
    name = "spark.sql.streaming.stateStore.unloadOnCommit"

    def seen(*_):
        raise Seen(spark.conf.get(name))

    monkeypatch.setattr(change_feed, "run_batch", seen)
    before = spark.conf.get(name)
    changes = spark.createDataFrame(
        [(1, i, "I", datetime.datetime(2024, 1, 5), i, "a", 1.0) for i in range(5)], "client_id long, seq long, op string, valid_at timestamp, change_id long, city string, balance double"
    )
    with pytest.raises(Seen, match="true"):
        change_feed.apply_changes(changes)
    assert before == "false" and spark.conf.get(name) == before


def test_pipeline_stages_take_small_batches(spark):
    import corpus_pipeline

    def sizes(parts):
        for batch in parts:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(3)], "doc_id long, text string, lang string")
    before = spark.conf.get(ROWS)
    try:
        for _, stage in (x for x in corpus_pipeline.STAGES if x[1].__name__ != "decontaminate_benchmark"):
            spark.conf.set(ROWS, 10_000)
            stage(spark, docs, "")
            got = [r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()]  # as the stage's plan is, once its caller writes it
            assert max(got) <= corpus_pipeline.ROWS and sum(got) == 5000
        spark.conf.set(ROWS, 7)
        corpus_pipeline.encode_pieces(spark, docs, "")
        assert spark.conf.get(ROWS) == "7"
    finally:
        spark.conf.set(ROWS, before)
