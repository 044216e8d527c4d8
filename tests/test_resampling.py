"""The blocked resample product against plain sums, over several blocks of clusters and resamples."""

import numpy as np
import pytest

from markwright.operators import protocol, stats


@pytest.mark.parametrize("clusters", [1, 7, 100])
def test_blocks_add_up_to_plain_resamples(spark, monkeypatch, clusters):
    monkeypatch.setattr(stats, "BOOTS", 4)
    monkeypatch.setattr(stats, "CLUSTERS", 16)
    rng = np.random.default_rng(clusters)
    values = rng.integers(0, 50, (clusters, 3)).astype(float)
    rows = [(i, k, float(values[i, k])) for i in range(clusters) for k in range(3)]
    got = {(r.boot, r.key): r.value for r in stats.resampled(spark.createDataFrame(rows, "at long, key int, value double"), clusters, 10, 5).collect()}
    for b in range(10):
        picks = [((b * 7919 + i * 104729 + 5) % 2147483647 * 1103515245 + 12345) % 2147483647 % clusters for i in range(clusters)]
        assert all(got.get((b, k), 0.0) == values[picks, k].sum() for k in range(3))


def test_items_are_clusters_of_their_own(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"q{i % 3}", int(y), int(y if rng.random() < 0.8 else 1 - y), 0) for i, y in enumerate(rng.integers(0, 2, 200))]
    preds = spark.createDataFrame(rows, "row_id long, question_id string, y long, head long, base long")
    out = protocol.bootstrap_counts(preds, protocol.macro_f1_of_counts, 300, cluster="row_id").first()
    assert out.n_boot == 300 and out.degenerate and out.p == 0 and 0.7 < out.lo < out.delta < out.hi < 0.9
    by_question = protocol.bootstrap_counts(preds, protocol.macro_f1_of_counts, 300).first()
    assert by_question.hi - by_question.lo != out.hi - out.lo


def test_no_resample_rows_in_the_plan(spark):
    preds = spark.createDataFrame([(f"q{i % 9}", float(i % 5), float(i % 4), float(i % 3)) for i in range(90)], "question_id string, y double, head double, base double")
    out = stats.bootstrap_pearson(preds, 10_000)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "Generate explode" not in plan
    assert out.first().n_boot == 10_000
