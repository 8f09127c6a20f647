import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import attribution, healing, metrics, models, perturb, splits, stats
from fieldloom.plans import protocols
from tests.test_grid import hour

K = ["site"]


def test_fold_arithmetic():
    f = splits.rolling_origin(1313, 5)
    assert f[0] == (1, 0, 223, 223, 441) and f[-1][4] == 1313 and all(d - c == 218 for *_, c, d in f)
    assert splits.rolling_origin(100, 4, gap=3, sliding=True)[1] == (2, 17, 37, 40, 60)
    for bad in ((3, 5), (100, 1)):
        with pytest.raises(ValueError):
            splits.rolling_origin(*bad)
    with pytest.raises(ValueError):
        splits.assert_ordered([(1, 0, 10, 5, 12)])


def brute(y, s):
    p, n = [a for a, b in zip(s, y) if b], [a for a, b in zip(s, y) if not b]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


def test_ranking_with_ties_and_one_class(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 200).tolist(), (rng.integers(0, 9, 200) / 10).tolist()
    d = spark.createDataFrame([(1, a, b) for a, b in zip(y, s)] + [(2, 1, 0.5)], "g int, label int, score double")
    got = {r["g"]: r for r in metrics.ranking(d, ["g"]).collect()}
    assert abs(got[1]["roc_auc"] - brute(y, s)) < 1e-12 and got[2]["roc_auc"] is None
    ap, tp, seen = 0.0, 0, 0
    for v in sorted(set(s), reverse=True):
        at = [b for a, b in zip(s, y) if a == v]
        tp, seen = tp + sum(at), seen + len(at)
        ap += sum(at) * tp / seen
    assert abs(got[1]["pr_auc"] - ap / sum(y)) < 1e-12


def test_summary_interval_by_hand(spark):
    v = [0.9, 0.95, 0.99, 0.85, 0.7]
    d = spark.createDataFrame([("a", x) for x in v] + [("b", 0.5), ("a", float("nan"))], "model string, value double")
    r = {x["model"]: x for x in stats.summarise(d, ["model"]).collect()}
    half = 2.7764451 * np.std(v, ddof=1) / math.sqrt(5)
    assert abs(r["a"]["half_width"] - half) < 1e-6 and r["a"]["ci_high"] == min(1.0,
        np.mean(v) + half) and r["a"]["n"] == 5
    assert (r["b"]["std"], r["b"]["degenerate"]) == (None, None)


def test_interpolation_and_ewm_match_a_plain_loop(spark):
    x = [None, 2.0, None, None, 5.0, 1.0, None, 8.0, None] * 6
    d = spark.createDataFrame([(0, hour(i), v) for i, v in enumerate(x)], "site int, ts timestamp_ntz, x double")
    got = [r["y"] for r in healing.interpolate(d, "x", K, "y").orderBy("ts").collect()]
    known = [i for i, v in enumerate(x) if v is not None]
    assert np.allclose(got, np.interp(range(len(x)), known, [x[i] for i in known]))
    a, y, w, want = 2 / 4, None, 1.0, []
    for v in x:
        if y is None:
            y = v
        elif v is None:
            w *= 1 - a
        else:
            y, w = (w * (1 - a) * y + a * v) / (w * (1 - a) + a), 1.0
        want.append(y)
    smooth = [r["s"] for r in healing.with_ewm(d, "x", K, 3, "s", chunk=4).orderBy("ts").collect()]
    assert [s is None for s in smooth] == [w is None for w in want] and np.allclose([s for s in smooth
        if s is not None], [w for w in want if w is not None])


def test_masks_and_ramp(spark):
    d = spark.createDataFrame([(0, hour(i), 50.0, 20.0 + i % 30) for i in range(800)],
        "site int, ts timestamp_ntz, soil_moisture double, air_temp double")
    a = perturb.mask_at_random(d, "soil_moisture", 0.2, ["site", "ts"])
    b = perturb.mask_at_random(d.repartition(7), "soil_moisture", 0.2, ["site", "ts"])
    nulls = lambda x: {r["ts"] for r in x.filter("soil_moisture is null").collect()}
    assert nulls(a) == nulls(b) and 110 < len(nulls(a)) < 210
    hot = perturb.mask_in_heat(d, "soil_moisture", 0.2, ["site", "ts"]).filter("soil_moisture is null")
    assert hot.agg(F.avg("air_temp")).first()[0] > 36
    top = perturb.add_ramp(d, "soil_moisture", K).agg(F.max("soil_moisture"), F.min("soil_moisture")).first()
    assert 55.1 < top[0] < 50 + perturb.peak(rows=40) and top[1] == 50.0
    with pytest.raises(ValueError):
        perturb.mask_at_random(d, "soil_moisture", 0.5, ["ts"])


def correlated(spark, n=300):
    rng = np.random.default_rng(1)
    z = rng.normal(size=n)
    rows = [(0, hour(i), float(50 + 8 * z[i] + rng.normal() * 0.3), float(25 - 4 * z[i] + rng.normal() * 0.3),
        float(60 + 5 * z[i])) for i in range(n)]
    return spark.createDataFrame(rows,
        "site int, ts timestamp_ntz, soil_moisture double, air_temp double, humidity double")


def test_chained_equations_beat_interpolation_and_keep_known_cells(spark):
    clean = correlated(spark).cache()
    damaged = perturb.mask_at_random(clean, "soil_moisture", 0.2, ["ts"])
    healed = healing.mice_impute(damaged, ["soil_moisture", "air_temp", "humidity"], 5)
    rmse = lambda h: healing.healing_quality(clean, damaged, h, "soil_moisture", ["ts"]).first()
    a, b = rmse(healed), rmse(healing.interpolate(damaged, "soil_moisture", K))
    assert a["rmse"] < 0.2 * b["rmse"] and a["r2"] > 0.95 and healed.filter("soil_moisture is null").count() == 0
    knn = healing.knn_impute(damaged, "soil_moisture", ["air_temp", "humidity"], ["ts"])
    assert rmse(knn)["rmse"] < 0.3 * b["rmse"]
    kept = damaged.filter("soil_moisture is not null").join(healed.select("ts", F.col("soil_moisture").alias("h")),
        "ts")
    assert kept.filter("soil_moisture != h").count() == 0


def nearest_by_hand(rows, k):
    """rows: (ident, target, features). The mean of the k nearest donors by comparing all."""
    out = {}
    for i, t, x in rows:
        if t is not None:
            continue
        near = []
        for j, y, z in rows:
            both = [(a, b) for a, b in zip(x, z) if a is not None and b is not None]
            if y is not None and both:
                near.append((math.sqrt(sum((a - b) ** 2 for a, b in both) * (len(x) / len(both))), j, y))
        near = sorted(near)[:k]
        out[i] = sum(y for _, _, y in near) / len(near) if near else None
    return out


def test_nearest_donors_equal_comparing_all(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        # Values on a coarse lattice (many ties and equal donors), an outlier now and then, missing features.
        x = [float(v) for v in rng.integers(0, 7, 3)] if i % 3 else [float(v) for v in rng.normal(3, 2, 3)]
        if i % 50 == 0:
            x[0] += 1000.0
        x = [None if rng.random() < 0.12 else v for v in x]
        rows.append((i, None if rng.random() < 0.4 else float(rng.normal()), x))
    rows.append((900, None, [None] * 3))
    rows += [(1000 + i, float(i), [3.0, 3.0, 3.0]) for i in range(60)]
    d = spark.createDataFrame([(i, t, *x) for i, t, x in rows], "i int, t double, a double, b double, c double")
    got = {r["i"]: r["t"] for r in healing.knn_impute(d, "t", ["a", "b", "c"], ["i"], 5).collect()}
    want = nearest_by_hand(rows, 5)
    assert got[900] is None and want[900] is None
    assert all(abs(got[i] - v) < 1e-9 for i, v in want.items() if v is not None)
    assert all(got[i] == t for i, t, _ in rows if t is not None)


def test_nearest_donors_with_too_few_or_no_donors(spark):
    kind = "i int, t double, a double"
    fill = lambda rows: {r["i"]: r["t"] for r in healing.knn_impute(
        spark.createDataFrame(rows, kind), "t", ["a"], ["i"], 5).collect()}
    assert fill([(1, None, 1.0), (2, None, 2.0)]) == {1: None, 2: None}
    assert fill([(1, None, 1.0), (2, 4.0, 2.0), (3, 6.0, 9.0)]) == {1: 5.0, 2: 4.0, 3: 6.0}
    assert fill([]) == {}


def test_nearest_donors_meet_only_near_cells(spark):
    """No join compares all rows, and nearly every row is done at the first widths."""
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 5 == 0 else float(i), float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (1500, 2)))]
    d = spark.createDataFrame(rows, "i int, t double, a double, b double")
    seen = []
    real = healing.checkpointed

    def watched(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    healing.checkpointed = watched
    try:
        filled = healing.knn_impute(d, "t", ["a", "b"], ["i"], 3)
        assert filled.filter("t is null").count() == 0
    finally:
        healing.checkpointed = real
    assert not any("NestedLoop" in p or "Cartesian" in p for p in seen)
    assert len(seen) < 12  # a few widths


def design(spark, n=300):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        m = 50 + 15 * math.sin(i / 9) + float(rng.normal())
        rows.append((0, hour(i), i, int(m < 42), m + 0.5, float(i % 9 < 2), float(rng.normal())))
    return spark.createDataFrame(rows,
        "site int, ts timestamp_ntz, row_id long, label int, soil_moisture_lag1h double, irrigation_event_lag1h double, air_temp_lag1h double")


def test_rule_models_and_threshold(spark):
    rows = design(spark).cache()
    assigned = splits.assign(rows, splits.folds_frame(spark, splits.rolling_origin(300, 3)))
    train = [(r["soil_moisture_lag1h"], r["label"]) for r in assigned.filter("fold = 1 and role = 'train'").collect()]
    x = np.array([t[0] for t in train])
    best = max(((lambda c: 2 * sum(y for v, y in train if v < c) / max(1,
        sum(v < c for v, _ in train) + sum(y for _, y in train)))(c),
        -c) for c in np.unique(np.quantile(x, np.linspace(0, 1, 200))))
    got = models.best_threshold(assigned, "soil_moisture_lag1h").filter("fold = 1").first()
    assert abs(got["f1"] - best[0]) < 1e-9 and abs(got["threshold"] + best[1]) < 1e-6
    scores = {m: metrics.ranking(models.RULES[m][0](assigned).withColumn("m", F.lit(m)),
        ["m"]).first()["roc_auc"] for m in models.RULES}
    assert scores["moisture_threshold"] > 0.95 and models.available_rules(["air_temp_lag1h"]) == ["majority"]
    with pytest.raises(ValueError):
        models.persistence(assigned.drop("irrigation_event_lag1h"))


def test_trained_models_fit_on_training_rows_only(spark):
    rows = design(spark).repartition(2).cache()
    names = ["soil_moisture_lag1h", "air_temp_lag1h"]
    folds = [(1, 0, 200, 200, 300)]
    wild = rows.withColumn("air_temp_lag1h", F.when(F.col("row_id") >= 200, 1e6).otherwise(F.col("air_temp_lag1h")))
    a, b = (models.fit(models.ModelSpec("logistic"), d.filter("row_id < 200"), names) for d in (rows, wild))
    assert a.scale == b.scale
    out = protocols.evaluate(rows, folds, names, [models.ModelSpec("logistic"),
        models.ModelSpec("gbt_a", {"n_estimators": 5, "max_depth": 3})], rules=["majority"])
    auc = {r["model"]: r["roc_auc"] for r in out.collect()}
    assert auc["logistic"] > 0.97 and auc["gbt_a"] > 0.9 and auc["majority"] == 0.5
    assert models.fit(models.ModelSpec("logistic"), rows.withColumn("label", F.lit(0)), names).degenerate
    assert len(models.grid_points(models.GRID)) == 12
    with pytest.raises(ValueError):
        models.ModelSpec("other")


@pytest.mark.parametrize("metric", ["roc_auc", "pr_auc"])
def test_draws_in_one_piece_equal_joined_draws(spark, metric, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.random() < 0.2), float(rng.integers(0, 6) / 5), float(rng.random())) for i in range(150)]
    d = spark.createDataFrame(rows, "row_id long, label int, a double, b double")
    by = lambda f: {r["iteration"]: r["d"] for r in f(d, 150, 40, 17, 3, metric).collect()}
    one, joined = by(stats._drawn_differences), by(stats._joined_differences)
    assert len(one) == 40 and one.keys() == joined.keys() and all(abs(one[i] - joined[i]) < 1e-12 for i in one)
    # What each draw scores is what its rows score one by one.
    places = stats.block_indices(spark, 2, 150, 17, 3).filter("iteration = 1").select("row_id").collect()
    drawn = [rows[r["row_id"]] for r in places]
    assert len(drawn) == 150
    if metric == "roc_auc":
        auc = lambda k: np.mean([(p[k] > n[k]) + 0.5 * (p[k] == n[k]) for p in drawn if p[1] for n in drawn if not n[1]])
        assert abs(one[1] - (auc(2) - auc(3))) < 1e-12
    whole = stats.bootstrap_difference(d, 40, 17, seed=3, metric=metric).first()
    monkeypatch.setattr(stats, "HELD_ROWS", 10)
    beyond = stats.bootstrap_difference(d, 40, 17, seed=3, metric=metric).first()
    assert all(abs(whole[c] - beyond[c]) < 1e-12 for c in ("difference", "ci_low", "ci_high", "p_value", "n_valid"))


def test_too_few_draws_with_both_classes_are_an_error(spark):
    rows = [(i, int(i == 0), float(i), float(-i)) for i in range(200)]
    d = spark.createDataFrame(rows, "row_id long, label int, a double, b double")
    with pytest.raises(ValueError, match="draws hold both classes"):
        stats.bootstrap_difference(d, 2, 190)


def test_bootstrap(spark):
    rng = np.random.default_rng(3)
    y = (np.sin(np.arange(240) / 10) > 0.3).astype(int)
    rows = [(i, int(v), float(v + rng.normal() * 0.4), float(v + rng.normal() * 2)) for i, v in enumerate(y)]
    d = spark.createDataFrame(rows, "row_id long, label int, a double, b double").cache()
    r = stats.bootstrap_difference(d, 60, 12).first()
    assert r["difference"] > 0.1 and r["ci_low"] > 0 and r["p_value"] < 0.05 and r["n_valid"] <= 60
    same = stats.bootstrap_difference(d.withColumn("b", F.col("a")), 20, 12).first()
    assert (same["difference"], same["p_value"]) == (0.0, 1.0)
    idx = stats.block_indices(spark, 3, 50, 24)
    assert {r["n"] for r in idx.groupBy("iteration").agg(F.count("*").alias("n")).collect()} == {50} and idx.agg(
        F.max("row_id")).first()[0] < 50
    with pytest.raises(ValueError):
        stats.bootstrap_difference(d, metric="f1")


def test_attribution_tables(spark):
    rows = design(spark, 40)
    c = attribution.linear_contributions(rows, ["soil_moisture_lag1h", "air_temp_lag1h", "irrigation_event_lag1h"],
        [1.0, 2.0, 3.0]).cache()
    whole = {r["row_id"]: r["s"] for r in c.groupBy("row_id").agg(F.sum("contribution").alias("s")).collect()}
    pooled = {r["row_id"]: r["s"] for r in attribution.waterfall(c,
        1).groupBy("row_id").agg(F.sum("contribution").alias("s")).collect()}
    assert all(abs(whole[k] - pooled[k]) < 1e-9 for k in whole)
    assert attribution.waterfall(c, 1).filter("feature = '2 other features'").count() == 40
    s = spark.createDataFrame([(0, 1, 0.9), (1, 1, 0.9), (2, 0, 0.8), (3, 0, 0.45)],
        "row_id long, label int, score double").withColumn("m", F.lit("x"))
    got = {r["case"]: r["row_id"] for r in attribution.instances(s, ["m"]).collect()}
    assert got == {"true_positive": 0, "false_positive": 2, "borderline": 3}
    assert "false_positive" not in {r["case"] for r in attribution.instances(s.filter("label = 1"), ["m"]).collect()}


def test_library_does_not_need_the_llm_part():
    import pathlib

    root = pathlib.Path(__file__).parents[1] / "fieldloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p


def test_report_documents(spark):
    from fieldloom.operators import reports

    d = spark.createDataFrame([(1, 0.2857, 10), (2, None, None), (4, 0.6724, 117)],
        "fold int, dominance double, largest_episode long")
    r = reports.dominance_document(d, {"a": 310, "b": 333}).first()
    assert (r["flagged_folds"], r["largest_episode_share"]["a"], r["largest_episode_share"]["b"]) == ([4], 0.3774,
        0.3514)
    c = spark.createDataFrame([("x", "y", -0.1, 0.00001), ("x", "y", 0.1, 0.5)],
        "model_a string, model_b string, difference double, p_value double")
    assert [r["interpretation"] for r in reports.comparison_document(c).collect()] == ["y is better (p < 1e-04)",
        "no difference shown (p 0.5000)"]
