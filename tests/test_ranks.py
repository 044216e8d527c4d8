"""Exact ranks, positions and rank statistics of skewed groups against pandas."""

import re

import numpy as np
import pandas as pd
import pytest

from markwright.functions import metrics
from markwright.operators import ranks, splits, stats


@pytest.fixture(scope="module")
def table():
    """A group of two thirds of the rows, a null group, groups of one and two; ties and nulls."""
    rng = np.random.default_rng(8)
    n = 3000
    g = rng.choice(["hot"] * 14 + ["b", "c", None] * 2 + ["d"], n).tolist()
    rows = [(i, g[i], float(rng.integers(0, 40)) if rng.random() > 0.05 else None, float(rng.integers(0, 9)) if i % 11 else None, int(rng.integers(0, 2))) for i in range(n)]
    return rows + [(n, "one", 1.0, 2.0, 1), (n + 1, "two", 1.0, 5.0, 1), (n + 2, "two", 3.0, 4.0, 0)]


@pytest.fixture(scope="module")
def frame(spark, table):
    return spark.createDataFrame(table, "row_id long, g string, x double, y double, c int").repartition(7)


def windows(df):
    """Partitioning of every window in a plan, without those over the offsets (a row a partition and group)."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return re.findall(r"Window \[[^\n]*?\], \[([^\]]*)\], \[[^\n]*\]", plan)


def test_average_ranks(spark, table, frame):
    got = {(r.g, r.x): (r.n, r.rank) for r in ranks.average_ranks(frame, ["g"], "x").collect()}
    t = pd.DataFrame(table, columns=["row_id", "g", "x", "y", "c"]).dropna(subset="x")
    t["rank"] = t.groupby("g", dropna=False)["x"].rank()
    want = {(None if pd.isna(k[0]) else k[0], k[1]): (len(v), v["rank"].iloc[0]) for k, v in t.groupby(["g", "x"], dropna=False)}
    assert got == want


def test_dense_rank_and_positions(spark, table, frame):
    got = {r.row_id: r.d for r in ranks.dense_rank(frame, ["g"], "x", "d").collect()}
    for g in {r[1] for r in table}:
        own = [r for r in table if r[1] == g]
        place = {v: i + 1 for i, v in enumerate(sorted({r[2] for r in own}, key=lambda v: (v is not None, v or 0)))}
        assert all(got[r[0]] == place[r[2]] for r in own)
    got = {r.row_id: r.p for r in ranks.positions(frame, ["g"], ["x", "row_id"], "p").collect()}
    for g in {r[1] for r in table}:
        own = sorted((r for r in table if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        assert [got[r[0]] for r in own] == list(range(len(own)))


def test_spearman_and_auc(table, frame):
    t = pd.DataFrame(table, columns=["row_id", "g", "x", "y", "c"])
    rho = {r.g: r for r in metrics.spearman(frame, ["g"], "x", "y").collect()}
    area = {r.g: r for r in metrics.auc(frame, ["g"], "c", "x").collect()}
    for g, own in t.groupby("g", dropna=False):
        g, both = None if pd.isna(g) else g, own.dropna(subset=["x", "y"])
        want = both["x"].rank().corr(both["y"].rank())
        assert rho[g].n == len(both) and (rho[g].spearman is None if np.isnan(want) else abs(rho[g].spearman - want) < 1e-12)
        s = own.dropna(subset="x")
        pos, neg = s[s.c == 1].x.to_numpy(), s[s.c == 0].x.to_numpy()
        wins = (pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2
        assert area[g].auc is None if not len(pos) * len(neg) else abs(area[g].auc - wins / len(pos) / len(neg)) < 1e-12
    both = t.dropna(subset=["x", "y"])
    assert abs(metrics.spearman(frame, [], "x", "y").first().spearman - both["x"].rank().corr(both["y"].rank())) < 1e-12
    assert metrics.auc(frame.limit(0), ["g"], "c", "x").collect() == [] and metrics.spearman(frame.limit(0), ["g"], "x", "y").collect() == []


def test_no_window_is_over_a_whole_group(frame):
    """Windows over rows are within a range of the table; the others see offsets only."""
    graded = frame.select("row_id", "g", F_col("x", "conf"), F_col("c", "correct"), F_col("y", "score"))
    for df in (metrics.spearman(frame, ["g"], "x", "y"), metrics.auc(frame, ["g"], "c", "x"), stats.risk_coverage(graded, ["g"]), stats.spread_picks(frame, ["g"], ["x", "row_id"], 5), splits.stratified(graded, ["g"])):
        found = windows(df)
        assert any("__part" in w for w in found)
        assert sum("__part" not in w for w in found) <= 2  # that of the offsets, which two joins may read


def F_col(name, alias):
    from pyspark.sql import functions as F

    return F.col(name).alias(alias)
