"""Spark-first analytics for short-answer grading data."""
