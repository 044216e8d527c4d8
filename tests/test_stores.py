"""Folds replaced in place, and the tolerant report scan."""

import pytest

from markwright.operators import migration
from markwright.sources import readers, sinks


def view(spark, path, rows):
    sinks.parquet(spark.createDataFrame(rows, "row_id long, question_id string, dataset string, score double, fold int"), path)


def rows_of(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("row_id", "question_id", "dataset", "score", "fold").collect())


def test_folds_are_replaced_in_the_named_datasets_only(spark, tmp_path):
    rows = [(i, f"q{i % 6}", "ab"[i % 2], i / 2, -1) for i in range(60)]
    for name in ("one", "two"):
        view(spark, str(tmp_path / name), rows)
    untouched = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "one" / "dataset=b").iterdir()}
    folds = {(r.dataset, r.question_id): r.fold for r in migration.migrate_folds(spark, str(tmp_path / "one"), [str(tmp_path / "one"), str(tmp_path / "two")], ["a"], 3).collect()}
    want = sorted((i, q, d, s, folds[d, q] if d == "a" else -1) for i, q, d, s, _ in rows)
    assert set(folds.values()) == {0, 1, 2}
    for name in ("one", "two"):
        assert rows_of(spark, str(tmp_path / name)) == want
    assert untouched == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "one" / "dataset=b").iterdir()}


@pytest.mark.parametrize("change", ["missing", "repeated", "question"])
def test_a_misaligned_view_is_refused_and_nothing_written(spark, tmp_path, change):
    rows = [(i, f"q{i % 4}", "a", 1.0, -1) for i in range(20)]
    other = {"missing": rows[1:], "repeated": rows + rows[:1], "question": [(0, "q9", "a", 1.0, -1), *rows[1:]]}[change]
    view(spark, str(tmp_path / "one"), rows)
    view(spark, str(tmp_path / "two"), other)
    with pytest.raises(ValueError):
        migration.migrate_folds(spark, str(tmp_path / "one"), [str(tmp_path / "one"), str(tmp_path / "two")], ["a"])
    assert rows_of(spark, str(tmp_path / "one")) == sorted(rows) and rows_of(spark, str(tmp_path / "two")) == sorted(other)


def test_reports_missing_corrupt_and_partial(spark, tmp_path):
    texts = {"good": '{"n": 3, "rho": 0.5, "more": [1]}', "short": '{"n": 3}', "odd": '{"n": "three", "rho": 1}', "cut": '{"n": 3, "rh', "empty": "", "list": "[1, 2]"}
    for name, text in texts.items():
        (tmp_path / f"name={name}").mkdir()
        (tmp_path / f"name={name}" / "report.json").write_text(text)
    expected = spark.createDataFrame([(n,) for n in [*texts, "none"]], "name string")
    got = {r.name: tuple(r)[1:] for r in readers.json_reports(spark, str(tmp_path), expected, "n bigint, rho double").collect()}
    assert got == {"good": ("ok", 3, 0.5), "short": ("partial", 3, None), "odd": ("partial", None, 1.0), "cut": ("corrupt", None, None), "empty": ("missing", None, None), "list": ("partial", None, None), "none": ("missing", None, None)}
