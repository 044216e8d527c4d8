"""Streaming answers: the stateless feature branches and a windowed count, beyond what the batch reference offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features as ft


def scored_stream(answers: DataFrame) -> DataFrame:
    """Lexical columns of a stream of answers (row_id, reference_answer, student_answer)."""
    return ft.lexical(ft.views(answers, normalize=False))


def distinct_answers(answers: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """First arrival of each (question, answer) within the watermark."""
    return answers.withWatermark(time, delay).dropDuplicatesWithinWatermark(["question_id", "student_answer"])


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width), "event_type").agg(F.count("*").alias("n"))
