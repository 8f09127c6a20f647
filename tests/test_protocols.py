"""Several sites, the causal shift, summaries beyond tables, tree attribution and protocol edges."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import student_t_critical
from fieldloom.operators import attribution, features, healing, models, reports, splits, stats
from fieldloom.plans import protocols


def sites(spark, n_sites=10, hours=120):
    rng = np.random.default_rng(1)
    rows = [(s, h, float(rng.uniform(20, 60)), int(rng.random() < 0.3)) for s in range(n_sites) for h in range(hours)
        if rng.random() < 0.9]
    df = spark.createDataFrame(rows, "site int, h int, soil_moisture double, irrigation_event int")
    return df.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)")).drop("h")


def test_rows_of_many_sites_are_numbered_in_time_and_every_fold_has_both_sides(spark):
    rows = features.numbered(sites(spark), ["site"]).cache()
    got = [(r["ts"], r["site"], r["row_id"]) for r in rows.collect()]
    assert [r[2] for r in sorted(got)] == list(range(len(got)))
    folds = splits.rolling_origin(len(got), 5)
    table = splits.describe(splits.assign(rows.withColumnRenamed("irrigation_event", "label"),
        splits.folds_frame(spark, folds))).collect()
    assert len(table) == 5 and all(r["n_train"] and r["n_test"] and r["train_end"] <= r["test_start"] for r in table)


@pytest.mark.parametrize("shift", [1, 3])
def test_no_feature_sees_less_than_the_shift(spark, shift):
    """Blanking the last ``shift`` - 1 hours before t changes no shifted feature of t."""
    config = features.FeatureConfig(weather=(), weather_lags=(), weather_roll_hours=(), moisture_lags=(shift,),
        target_lags=(shift,), causal_shift=shift, require_full_window=False)
    base = sites(spark, 1).withColumn("site", F.lit(0))
    last = base.agg(F.max("ts")).first()[0]
    recent = F.col("ts") > F.lit(last) - F.make_dt_interval(hours=F.lit(shift))
    blank = base.withColumns({c: F.when(recent, None).otherwise(F.col(c)) for c in ("soil_moisture",
        "irrigation_event")})
    row = [features.build_features(d, ["site"], config)[0].filter(F.col("ts")
        == F.lit(last)).drop("irrigation_event").first() for d in (base, blank)]
    assert row[0] == row[1]


def test_t_values_beyond_the_table(spark):
    ns = [2, 5, 201, 202, 500, 100_000]
    got = [r["t"] for r in spark.createDataFrame([(n,) for n in ns],
        "n long").select(stats.t_value(F.col("n")).alias("t")).collect()]
    assert np.allclose(got, [student_t_critical(0.95, n - 1) for n in ns], rtol=0, atol=2e-8)


def test_p_values_have_the_resolution_of_the_draws(spark):
    p = spark.createDataFrame([(0.0,), (0.01,), (0.5,)], "p double")
    text = lambda n: [r[0] for r in p.select(reports.p_value_text(F.col("p"), n)).collect()]
    assert text(50) == ["< 2e-02", "< 2e-02", "0.5000"] and text(10_000) == ["< 1e-04", "0.0100", "0.5000"]


def test_onset_summary_counts_only_scored_folds(spark):
    rows = [("m", 1, 0.5, None, 0.1, 0.2, 10, 2), ("m", 2, None, None, 0.3, 0.2, 12, 0),
        ("m", 3, 0.7, None, 0.5, 0.2, 9, 1)]
    r = spark.createDataFrame(rows,
        "model string, fold int, pr_auc double, roc_auc double, f1 double, brier double, n_test long, n_positive long")
    got = {x["metric"]: x for x in protocols.onset_summary(r).collect()}
    assert (got["pr_auc"]["n_folds_scored"], got["roc_auc"]["n_folds_scored"], got["f1"]["n_folds_scored"]) == (2, 0, 3)
    assert got["pr_auc"]["n_folds"] == 3 and got["pr_auc"]["n_rows"] == 31 and got["pr_auc"]["n_onsets"] == 3


def test_parameters_have_the_names_of_the_profile():
    shared = {"max_depth": 2, "min_child_weight": 5}
    assert models.translated("gbt_a", shared) == shared and models.translated("gbt_b", shared) == {"max_depth": 2,
        "min_child_samples": 5}
    a, b = (models.ModelSpec(n, shared).estimator(10) for n in ("gbt_a", "gbt_b"))
    assert a.getMinInstancesPerNode() == b.getMinInstancesPerNode() == 5 and a.getMaxBins() != b.getMaxBins() and len(
        models.grid_points(models.GRID)) == 12
    with pytest.raises(ValueError):
        models.ModelSpec("gbt_b", {"leaves": 3}).estimator(10)
    assert models.skipped_rules(["soil_moisture_lag1h"]) == {"persistence": ["irrigation_event_lag1h"]}


def test_models_on_different_rows_are_not_compared(spark):
    a = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.5)], "row_id long, label int, score double")
    assert protocols.paired(a, a).count() == 2
    with pytest.raises(ValueError):
        protocols.paired(a, a.filter("row_id = 1"))


def test_tree_contributions_equal_all_subsets(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (120, 3)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] < 4) | (x[:, 2] > 4)).astype(int)
    rows = spark.createDataFrame([(i, int(t), *map(float, v)) for i, (t, v) in enumerate(zip(y, x))],
        "row_id long, label int, a double, b double, c double")
    fitted = models.fit(models.ModelSpec("gbt_a", {"n_estimators": 3, "max_depth": 3}), rows, ["a", "b", "c"])
    tree = fitted.model.stages[-1]
    leaves = attribution.tree_nodes(tree, str(tmp_path / "m"))
    got = attribution.shapley(leaves, x[:20])

    def value(row, known):
        return sum(f["value"] * math.prod(float(lo < row[k] <= hi) if k in known else share for k,
            (lo, hi, share) in f["path"].items()) for f in leaves)

    for r, g in zip(x[:20], got):
        for i in range(3):
            rest = [k for k in range(3) if k != i]
            want = sum(
                math.factorial(n) * math.factorial(2 - n) / 6 * (value(r, {*s, i}) - value(r,
                    set(s))) for n in range(3) for s in itertools.combinations(rest, n)
            )
            assert abs(g[i] - want) < 1e-9
    out = attribution.tree_contributions(tree, rows, ["a", "b", "c"],
        str(tmp_path / "n")).groupBy("row_id").agg((F.sum("contribution") + F.max("base")).alias("raw"))
    raw = fitted.model.transform(rows).select("row_id", F.expr("1").alias("_"), "probability").collect()
    raw = {r["row_id"]: math.log(r["probability"][1] / r["probability"][0]) / 2 for r in raw}
    assert all(abs(r["raw"] - raw[r["row_id"]]) < 1e-6 for r in out.collect())


def plain_evidence_ridge(x, y):
    """The same estimator from the rows themselves, by a singular value decomposition."""
    mean, level = x.mean(0), y.mean()
    x, y = x - mean, y - level
    u, s, v = np.linalg.svd(x, full_matrices=False)
    alpha, lam, old = 1 / (y.var() + np.finfo(float).eps), 1.0, None

    def coefficients():
        return v.T @ ((s / (s**2 + lam / alpha)) * (u.T @ y))

    for _ in range(300):
        w = coefficients()
        gamma = (alpha * s**2 / (lam + alpha * s**2)).sum()
        lam = (gamma + 2e-6) / ((w**2).sum() + 2e-6)
        alpha = (len(y) - gamma + 2e-6) / (((y - x @ w) ** 2).sum() + 2e-6)
        if old is not None and np.abs(old - w).sum() < 1e-3:
            break
        old = w
    w = coefficients()
    return w, level - mean @ w


def test_chained_equations_equal_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    full = 30 + rng.normal(size=(60, 3)) @ np.array([[1, 0.8, 0.3], [0, 1, 0.5], [0, 0, 1]])
    x = np.where(rng.random(full.shape) < [0.3, 0.1, 0.2], np.nan, full)
    rows = [(i, *(None if math.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)]
    d = spark.createDataFrame(rows, "i int, a double, b double, c double")
    order = np.argsort(np.isnan(x).sum(0))
    assert order.tolist() == [1, 2, 0]  # fewest gaps first
    for tolerance, most in ((0.0, 4), (1e-3, 10)):
        got = healing.mice_impute(d, ["a", "b", "c"], rounds=most, tolerance=tolerance).orderBy("i").collect()
        want, gap = np.where(np.isnan(x), np.nanmean(x, axis=0), x), np.isnan(x)
        for _ in range(most):
            was = want.copy()
            for c in order:
                rest, known = np.delete(want, c, axis=1), ~gap[:, c]
                w, level = plain_evidence_ridge(rest[known], want[known, c])
                want[gap[:, c], c] = (rest @ w + level)[gap[:, c]]
            if np.abs(want - was).max() < tolerance * np.nanmax(np.abs(x)):
                break
        assert np.allclose([list(r)[1:] for r in got], want, atol=1e-8)


def test_chained_equations_of_hard_columns(spark):
    """A column that never varies, one that copies another, one without any value, and a single column."""
    rows = [(i, float(i) if i % 4 else None, 2.0 * i, 5.0, None) for i in range(40)]
    d = spark.createDataFrame(rows, "i int, a double, b double, c double, e double")
    got = healing.mice_impute(d, ["a", "b", "c", "e"]).orderBy("i").collect()
    assert all(abs(r["a"] - r["i"]) < 1e-2 for r in got) and all(r["e"] is None and r["c"] == 5.0 for r in got)
    alone = healing.mice_impute(d, ["a"]).filter("i % 4 = 0").select("a").distinct().collect()
    assert len(alone) == 1 and abs(alone[0]["a"] - np.mean([i for i in range(40) if i % 4])) < 1e-9
    assert healing.mice_impute(d.limit(0), ["a", "b"]).count() == 0


def test_a_folder_of_logs_is_scanned_and_routed(spark, tmp_path):
    from fieldloom import sources

    (tmp_path / "Station MOISTURE a.csv").write_text(
        "moisture,time_stamp\n74.29,12-Jul-2022 00:03:51\nbad,12-Jul-2022 00:23:51\n")
    (tmp_path / "moisture_b.csv").write_text(" time_stamp , value \n2022-07-12 00:00:00,1.5\n")
    (tmp_path / "valve.txt").write_text("relay,time_stamp\n1,12-Jul-2022 00:03:51\n")
    (tmp_path / "flow.csv").write_text("1657584000,5\n".replace("1657584000,5", "t,litres\n1657584000,5"))
    (tmp_path / "notes.md").write_text("not a log")
    got = {c: [tuple(r) for r in f.collect()] for c, f in sources.read_folder(spark, str(tmp_path)).items()}
    assert [v for _, v in got["soil_moisture"]] == [1.5] and [v for _,
        v in got["irrigation_event"]] == [1.0] and str(got["flow_l_cumulative"][0][0]) == "2022-07-12 00:00:00"
    (tmp_path / "valve.txt").unlink()
    with pytest.raises(ValueError):
        sources.read_folder(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        sources.read_weather(spark, str(tmp_path / "none.json"), ["T2M"])


def test_many_logs_are_one_scan(spark, tmp_path):
    from fieldloom import sources

    want = {}
    for i in range(150):
        name, rows = f"a {i} {('moisture', 'valve', 'flow', 'x+y')[i % 4]}.{'txt' if i % 2 else 'csv'}", []
        for h in range(i % 5 + 1):
            time, value = (f"0{h + 1}-Jul-2022 00:03:51", str(h + i)) if i % 3 else (str(1657584000 + 60 * h), str(h + 5))
            rows.append(f"{value} , {time}" if i % 7 else f"{time},{value}")
        (tmp_path / name).write_text("p,q\n" + "\n".join(rows) + "\n")
        want[name] = sum(float(v) for v in ([h + i for h in range(i % 5 + 1)] if i % 3 else [h + 5 for h in range(i % 5 + 1)]))
    (tmp_path / "empty flow.csv").write_text("p,q\n")
    spark.sparkContext.setJobGroup("scan", "")
    got = sources.scan_logs(spark, str(tmp_path)).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("scan"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6
    sums, channels = {}, {}
    for r in got:
        name = r["log"].rsplit("/", 1)[-1]
        sums[name] = sums.get(name, 0.0) + r["value"]
        channels[name] = r["channel"]
        assert r["ts"].year == 2022
    assert sums == want
    assert all(channels[n] == sources.channel_of(n) for n in want) and None in channels.values()
    (tmp_path / "wide flow.csv").write_text("p,q,r\n1,2022-07-12 00:00:00,4\n")
    (tmp_path / "both flow.csv").write_text("p,q\n1,2\n")
    with pytest.raises(ValueError):
        sources.scan_logs(spark, str(tmp_path))
    assert len(sources.scan_logs(spark, str(tmp_path), doubtful="drop").collect()) == len(got)


def test_both_numeric_columns_need_one_that_reads_as_time(spark):
    from fieldloom import sources

    frame = lambda *rows: spark.createDataFrame(rows, "a string, b string")
    assert sources.column_roles(frame(("5", "1657584000"))) == ("b",
        "a") and sources.column_roles(frame(("x", "y"))) == ("a", "b")
    with pytest.raises(ValueError):
        sources.column_roles(frame(("5", "6")))
    with pytest.raises(ValueError):
        sources.column_roles(frame(("5", "6")).withColumn("c", F.lit(1)))
