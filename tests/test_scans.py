"""Two-level running totals and what is built on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import range_sorted, running_totals
from fieldloom.operators import metrics


def plain(labels, scores):
    """ROC-AUC and average precision by comparing all pairs and all thresholds."""
    pos, neg = scores[labels == 1], scores[labels == 0]
    auc = ((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()
    ap = sum((labels[scores == s] == 1).sum() * (labels[scores >= s] == 1).mean() for s in set(scores.tolist()))
    return auc, ap / len(pos)


@pytest.fixture
def ranges_stay(spark):
    """Small ranges are not joined into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_totals_of_one_group_are_many_tasks(spark, ranges_stay):
    n = 20_000
    rows = spark.range(n).select(F.lit("one").alias("g"), F.col("id").alias("x"), (F.col("id") % 7).alias("v"))
    sorted_ = range_sorted(rows, F.asc("g"), F.desc("x"))
    sizes = [r["count"] for r in sorted_.groupBy("_part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * n
    got = {r["x"]: (r["t"], r["u"]) for r in running_totals(rows, ["g"], F.desc("x"), {"t": "v", "u": "x"}).collect()}
    t = u = 0
    for x in range(n - 1, -1, -1):
        t, u = t + x % 7, u + x
        assert got[x] == (t, u)


def test_running_totals_keep_groups_apart_and_null_keys(spark, ranges_stay):
    rows = [(g, x, 1) for g in ("a", "b", None) for x in range(50)]
    d = spark.createDataFrame(rows, "g string, x int, v int")
    got = running_totals(d, ["g"], F.asc("x"), {"t": "v"})
    assert {(r["g"], r["x"]): r["t"] for r in got.collect()} == {(g, x): x + 1 for g, x, _ in rows}
    assert running_totals(d.limit(0), ["g"], F.asc("x"), {"t": "v"}).count() == 0
    assert [r["t"] for r in running_totals(d.filter("g = 'a'"), [], F.asc("x"), {"t": "v"}).orderBy("x").collect()] == [
        *range(1, 51)]


def test_ranking_equals_all_pairs(spark, ranges_stay):
    rng = np.random.default_rng(3)
    rows = [(g, int(y), float(s)) for g, levels in (("ties", 4), ("fine", 10_000), ("one class", 5)) for y, s in zip(
        rng.integers(0, 2, 300) * (g != "one class"), rng.integers(0, levels, 300) / levels)]
    got = {r["g"]: r for r in metrics.ranking(spark.createDataFrame(rows, "g string, label int, score double"),
        ["g"]).collect()}
    for g in ("ties", "fine"):
        y, s = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        auc, ap = plain(y, s)
        assert abs(got[g]["roc_auc"] - auc) < 1e-12 and abs(got[g]["pr_auc"] - ap) < 1e-12
    assert got["one class"]["roc_auc"] is None and got["one class"]["pr_auc"] is None


def test_no_window_holds_a_whole_group(spark):
    d = spark.range(1000).select((F.col("id") % 2).cast("int").alias("label"), F.rand(1).alias("score"))
    plan = metrics.ranking(d, [])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # The scores' windows stand inside a range; the only other one has a row a range.
    assert windows and sum("_place" in w for w in windows) >= 1 and not any("_s#" in w for w in windows)
