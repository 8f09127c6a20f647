"""A table on which the valve is never open, as a mean of many readings an hour makes it: one class, no episode, no last ON hour."""

import math

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import checkpointed
from fieldloom.operators import attribution, episodes, models, reports, stats
from fieldloom.plans import protocols
from fieldloom.plans.queries import NARROW, QUERIES


@pytest.fixture(scope="module")
def quiet(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("quiet"))
    kinds = F.array(*[F.lit(k) for k in ("view", "error", "signup", "purchase", "click")])
    rows = spark.range(72 * 5).select(F.col("id").alias("event_id"),
        F.expr("timestamp_ntz'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, int(id div 5))").alias("ts"),
        (F.col("id") % 7).alias("user_id"), kinds[(F.col("id") % 5).cast("int")].alias("event_type"),
        (F.col("id") * 37 % 50).cast("double").alias("value"), F.lit("{}").alias("props"))
    rows.write.parquet(f"{d}/events.parquet")
    return d


def test_too_few_rows_have_no_folds(spark):
    assert protocols.rolling_folds(spark.range(5)) == [] and len(protocols.rolling_folds(spark.range(6))) == 5


def test_ablation_trained_has_no_rows(quiet, spark):
    """No hour knows its last ON hour, so no row of the design matrix is complete."""
    got = QUERIES["ablation_trained"](spark, quiet)
    assert got.count() == 0 and {"feature_set", "model", "mean", "n_rows"} <= set(got.columns)


def test_trained_on_design_matrix_has_no_rows(quiet, spark):
    got = QUERIES["trained_on_design_matrix"](spark, quiet)
    assert got.count() == 0 and {"model", "seed", "fold", "pr_auc"} <= set(got.columns)


def test_ablation_has_no_rows(quiet, spark):
    got = QUERIES["ablation"](spark, quiet)
    assert got.count() == 0 and {"feature_set", "n_features", "model", "fold", "n_test"} <= set(got.columns)


def test_ablation_summary_has_no_rows(quiet, spark):
    got = QUERIES["ablation_summary"](spark, quiet)
    assert got.count() == 0 and {"feature_set", "model", "n_features", "n", "mean", "n_rows"} <= set(got.columns)


def test_best_against_baseline_tells_that_no_draw_holds_both_classes(quiet, spark):
    r = QUERIES["best_against_baseline"](spark, quiet).collect()
    assert [(x["model_a"], x["model_b"], x["difference"], x["ci_low"], x["ci_high"], x["p_value"], x["n_valid"])
        for x in r] == [("gbt_a", "logistic", None, None, None, 1.0, 0)]


def test_no_draws_are_an_error_only_if_strict(spark):
    one = spark.createDataFrame([(i, 0, float(i), float(-i)) for i in range(30)], "row_id long, label int, a double, b double")
    with pytest.raises(ValueError, match="one class"):
        stats.bootstrap_difference(one, 5, 4)
    for rows in (one, one.filter("row_id < 0")):
        assert stats.bootstrap_difference(rows, 5, 4, strict=False).collect() == [(None, None, None, 1.0, 0)]
    two = spark.createDataFrame([(i, int(i == 0), float(i), float(-i)) for i in range(200)],
        "row_id long, label int, a double, b double")
    r = stats.bootstrap_difference(two, 2, 190, strict=False).first()
    assert r["difference"] == -1.0 and r["n_valid"] < 2


def test_comparison_document_shows_no_difference_of_one_class(quiet, spark):
    got = QUERIES["comparison_document"](spark, quiet).collect()
    assert got == [(1.0, "no difference shown (p 1.0000)")]


def test_bootstrap_ci_of_one_class_is_undefined(quiet, spark):
    """As its SQL has it: NaN pairs, no bounds, no draw."""
    r = QUERIES["bootstrap_ci"](spark, quiet).first()
    assert math.isnan(r["difference"]) and (r["ci_low"], r["ci_high"], r["p_value"], r["n_valid"]) == (None, None, 1.0, 0)


def test_dominance_document_without_positives(quiet, spark):
    r = QUERIES["dominance_document"](spark, quiet).first()
    assert (r["by_fold"], r["flagged"], r["largest_episode"]) == (None, "", 0) and math.isnan(r["share"])
    d = spark.createDataFrame([(1, 0.5, 3)], "fold int, dominance double, largest_episode long")
    assert reports.dominance_document(d, {"a": 0, "b": 6}).first()["largest_episode_share"].asDict() == {"a": None, "b": 0.5}


def test_onset_trained_has_no_rows(quiet, spark):
    got = QUERIES["onset_trained"](spark, quiet)
    assert got.count() == 0 and {"model", "metric", "mean", "n_onsets"} <= set(got.columns)


def test_onset_protocol_has_no_rows(quiet, spark):
    got = QUERIES["onset_protocol"](spark, quiet)
    assert got.count() == 0 and {"model", "metric", "n_folds_scored", "n_rows", "n_onsets"} <= set(got.columns)


def test_tree_attribution_of_one_class_is_its_base(quiet, spark):
    got = QUERIES["tree_attribution"](spark, quiet).collect()
    # 71 complete hours: the last of five folds tests eleven.
    assert len(got) == 11 * len(NARROW) and {r["feature"] for r in got} == set(NARROW)
    assert {r["contribution"] for r in got} == {0.0} and all(r["value"] is not None for r in got)
    assert all(abs(1 / (1 + math.exp(-2 * r["base"])) - models.EDGE) < 1e-7 for r in got)


def test_contributions_of_a_fit_of_both_classes_are_those_of_its_trees(spark, tmp_path):
    rows = checkpointed(spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("label"),
        (F.col("id") % 3).cast("double").alias("x")))
    fitted = models.fit(models.ModelSpec("gbt_a", {"n_estimators": 2, "max_depth": 2}), rows, ["x"])
    a = attribution.fitted_contributions(fitted, rows, ["x"], str(tmp_path / "a"))
    b = attribution.tree_contributions(fitted.model.stages[-1], rows, ["x"], str(tmp_path / "b"))
    assert a.schema.names == b.schema.names and sorted(a.collect()) == sorted(b.collect())


def test_variant_summary_has_no_rows(quiet, spark):
    got = QUERIES["variant_summary"](spark, quiet)
    assert got.count() == 0 and {"comparison", "variant", "n_rows", "mean"} <= set(got.columns)


def test_variants_as_available_has_no_rows(quiet, spark):
    got = QUERIES["variants_as_available"](spark, quiet)
    assert got.count() == 0 and {"variant", "n_rows", "model", "fold", "comparison"} <= set(got.columns)


def test_variants_on_common_rows_has_no_rows(quiet, spark):
    got = QUERIES["variants_on_common_rows"](spark, quiet)
    assert got.count() == 0 and {"variant", "n_rows", "model", "fold", "comparison"} <= set(got.columns)


def test_variants_trained_has_no_rows(quiet, spark):
    got = QUERIES["variants_trained"](spark, quiet)
    assert got.count() == 0 and {"variant", "model", "mean", "n"} <= set(got.columns)


def test_episode_histogram_keeps_all_bins_without_episodes(quiet, spark):
    """The operator counts 0; the query has the NULL of its SQL's count_if over no rows."""
    got = QUERIES["episode_histogram"](spark, quiet).orderBy("bin").collect()
    assert [(r["site"], r["bin"], r["label"], r["n"]) for r in got] == [(0, i, n, None) for i, n in enumerate(episodes.bin_labels())]
    hours = [(s, h, s * (h % 4 != 0)) for s in (0, 1) for h in range(8)]
    two = spark.createDataFrame(hours, "site int, h int, irrigation_event int").withColumn("ts",
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, h)"))
    rows = episodes.episode_histogram(two, ["site"]).filter("n > 0 or bin = 0").orderBy("site", "bin").collect()
    assert [(r["site"], r["label"], r["n"]) for r in rows] == [(0, "1", 0), (1, "1", 0), (1, "3-5", 2)]


def test_episode_summary_without_episodes(quiet, spark):
    r = QUERIES["episode_summary"](spark, quiet).first()
    assert (r["n_episodes"], r["on_hours"], r["n_hours"], r["std_hours"], r["mean_hours"]) == (0, 0, 72, 0.0, None)
