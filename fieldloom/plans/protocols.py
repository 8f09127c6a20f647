"""Evaluation protocols: models by fold and seed, ablation, onset, nested selection, comparison."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checkpointed
from ..operators import fits, metrics, models, splits, stats
from ..operators.features import FeatureConfig, ablation_sets, build_features, closed_before, numbered, supervised

Fold = tuple[int, int, int, int, int]


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def rolling_folds(rows: DataFrame, k: int = 5) -> list[Fold]:
    """Rolling-origin folds of numbered rows; none where the rows are too few for k of them, and then nothing is scored."""
    n = rows.count()
    return splits.rolling_origin(n, k) if n > k else []


@dataclass(frozen=True)
class Task:
    """One model to train on rows ``train`` and to score on rows ``test`` (both ``lo <= row_id < hi``)."""

    spec: models.ModelSpec
    columns: tuple[str, ...]
    fold: int
    train: tuple[int, int]
    test: tuple[int, int]
    tags: tuple = ()


def tasks_of(folds: list[Fold], specs: list[models.ModelSpec], columns: list[str], *tags) -> list[Task]:
    return [Task(s, tuple(columns), f, (a, b), (c, d), tags) for s in specs for f, a, b, c, d in folds]


def scored_tasks(rows: DataFrame, tasks: list[Task], tags: dict[str, str] | None = None) -> DataFrame:
    """(tags, model, seed, fold, row_id, label, score, predicted) of every task's test rows.

    All logistic fits are trained together and so are all boosted ones. Fits that agree in rows,
    columns and parameters are one fit: fewer trees are the first ones of more trees, and a seed
    counts only where something is drawn.
    """
    tags = tags or {}
    asked: dict[str, dict[fits.Fit, int]] = {"logistic": {}, "boosted": {}}
    of: list[tuple[str, fits.Fit, int | None]] = []
    for t in tasks:
        kind, params, trees, draws = t.spec.fit_parameters()
        fit = fits.Fit(*t.train, t.columns, params, t.spec.seed if draws else 0)
        asked[kind][fit] = max(asked[kind].get(fit, 0), trees or 0)
        of.append((kind, fit, trees))
    trained: dict[str, dict[fits.Fit, object]] = {"logistic": {}, "boosted": {}}
    if asked["logistic"]:
        for c in sorted({dict(f.params)["c"] for f in asked["logistic"]}):
            some = [f for f in asked["logistic"] if dict(f.params)["c"] == c]
            trained["logistic"] |= dict(zip(some, fits.logistic(rows, some, c)))
    if asked["boosted"]:
        full = [replace(f, params=(*f.params, ("n_estimators", n))) for f, n in asked["boosted"].items()]
        trained["boosted"] = dict(zip(asked["boosted"], fits.boosted(rows, full)))
    scored = fits.scores(rows, [(trained[kind][fit], *t.test, n) for t, (kind, fit, n) in zip(tasks, of)])
    table = rows.sparkSession.createDataFrame(
        [(i, *t.tags, t.spec.name, t.spec.seed, t.fold) for i, t in enumerate(tasks)],
        ", ".join(["task int", *[f"{n} {k}" for n, k in tags.items()], "model string, seed int, fold int"]))
    # One row a task, all of which the driver made.
    return scored.join(F.broadcast(table), "task").select(*tags, "model", "seed", "fold", "row_id", "label", "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def out_of_fold(rows: DataFrame, folds: list[Fold], spec: models.ModelSpec, names: list[str]) -> DataFrame:
    """(model, seed, fold, row_id, label, score, predicted) of every test row."""
    return scored_tasks(rows, tasks_of(folds, [spec], names))


def rule_scores(rows: DataFrame, folds: list[Fold], rules: list[str]) -> DataFrame:
    """The same columns for rule models: all folds of a model in one query."""
    assigned = splits.assign(rows, splits.folds_frame(rows.sparkSession, folds))
    return union([models.RULES[m][0](assigned).select(F.lit(m).alias("model"), F.lit(0).alias("seed"),
        *models.KEPT) for m in rules])


def evaluate(rows: DataFrame, folds: list[Fold], names: list[str], specs: list[models.ModelSpec],
    rules: list[str] | None = None) -> DataFrame:
    """Metrics by (model, seed, fold) for rule models whose columns exist and for the given specs."""
    usable = [r for r in models.available_rules(names) if rules is None or r in rules]
    parts = [rule_scores(rows, folds, usable)] if usable else []
    if specs:
        parts.append(scored_tasks(rows, tasks_of(folds, specs, names)))
    return metrics.evaluate(checkpointed(union(parts)), ["model", "seed", "fold"])


def across_seeds(rows: DataFrame, folds: list[Fold], names: list[str], specs: list[models.ModelSpec], seeds: list[int],
    rules: list[str] | None = None) -> DataFrame:
    """The whole evaluation under each seed. Rule models draw nothing: they run once and count for every seed."""
    usable = [r for r in models.available_rules(names) if rules is None or r in rules]
    parts = []
    if usable:
        every = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
        parts.append(rule_scores(rows, folds, usable).select("model", every, *models.KEPT))
    if specs:
        seeded = [models.ModelSpec(s.name, s.params, seed) for s in specs for seed in seeds]
        parts.append(scored_tasks(rows, tasks_of(folds, seeded, names)))
    return metrics.evaluate(checkpointed(union(parts)), ["model", "seed", "fold"])


def ablation(rows: DataFrame, folds: list[Fold], config: FeatureConfig, specs: list[models.ModelSpec],
    rules: list[str] = []) -> DataFrame:
    """Every set of features on the same rows: metrics by (feature_set, model, fold).

    A rule model is scored once and counts for every set that holds its columns; all trained models of all sets are
    fitted together.
    """
    sets = ablation_sets(config)
    tags = {"feature_set": "string", "n_features": "int"}
    usable = {name: [r for r in models.available_rules(columns) if r in rules] for name, columns in sets.items()}
    parts = []
    if any(usable.values()):
        listed = [(name, len(sets[name]), r) for name, rs in usable.items() for r in rs]
        table = rows.sparkSession.createDataFrame(listed, "feature_set string, n_features int, model string")
        once = rule_scores(rows, folds, sorted({r for rs in usable.values() for r in rs}))
        parts.append(once.join(F.broadcast(table), "model").select(*tags, "model", "seed", *models.KEPT))
    if specs:
        tasks = [t for name, columns in sets.items() for t in tasks_of(folds, specs, columns, name, len(columns))]
        parts.append(scored_tasks(rows, tasks, tags))
    return metrics.evaluate(checkpointed(union(parts)), [*tags, "model", "seed", "fold"])


def ablation_summary(results: DataFrame, metric: str = "pr_auc") -> DataFrame:
    by = ["feature_set", "model", "n_features"]
    rows = results.groupBy(*by).agg(F.sum("n_test").alias("n_rows"))
    return stats.summarise(results, by, value=metric).join(rows, by)


def onset_protocol(merged: DataFrame, keys: list[str], config: FeatureConfig, specs: list[models.ModelSpec],
    k: int = 5) -> DataFrame:
    """Models of the start of an episode: rows that were OFF an hour ago; persistence has nothing to say there."""
    features, named = build_features(merged, keys, config)
    rows, named = closed_before(features, named)
    names = [n for part in named.values() for n in part]
    rows = checkpointed(supervised(rows, names, keys))
    return onset_summary(evaluate(rows, rolling_folds(rows, k), names, specs, rules=["majority", "moisture_threshold"]))


#: The metrics that a run reports first.
PRIMARY = ("pr_auc", "roc_auc", "f1", "brier")


def onset_summary(results: DataFrame, primary: tuple[str, ...] = PRIMARY) -> DataFrame:
    """By (model, metric): the interval over folds where the metric is known, how many those are, and the size of the test."""
    long = stats.summarise(stats.unpivot(results, ["model", "fold"], primary),
        ["model", "metric"]).withColumnRenamed("n", "n_folds_scored")
    size = results.groupBy("model").agg(F.sum("n_test").alias("n_rows"), F.count_distinct("fold").alias("n_folds"),
        F.sum("n_positive").alias("n_onsets"))
    return long.join(size, "model")


def select_parameters(rows: DataFrame, inner: dict[int, list[Fold]], name: str, names: list[str], grid: list[dict],
    metric: str = "pr_auc", seed: int = 42) -> dict[int, dict]:
    """By outer fold: the first grid point with the best mean over inner folds that can be scored; empty if none can.

    The fits of all outer folds, grid points and inner folds are trained together.
    """
    tasks = [t for outer, folds in inner.items() for i, point in enumerate(grid)
        for t in tasks_of(folds, [models.ModelSpec(name, point, seed)], names, outer, i)]
    scored = checkpointed(scored_tasks(rows, tasks, {"outer_fold": "int", "point": "int"}))
    by_fold = metrics.ranking(scored, ["outer_fold", "point", "fold"])
    means = by_fold.groupBy("outer_fold", "point").agg(F.avg(metric).alias("value")).filter("value is not null").collect()
    best: dict[int, dict] = {outer: {} for outer in inner}
    most: dict[int, float] = {}
    for r in sorted(means, key=lambda r: r["point"]):
        if r["outer_fold"] not in most or r["value"] > most[r["outer_fold"]]:
            best[r["outer_fold"]], most[r["outer_fold"]] = grid[r["point"]], r["value"]
    return best


def nested_cv(rows: DataFrame, outer: list[Fold], name: str, names: list[str], grid: list[dict], inner_k: int = 3,
    metric: str = "pr_auc", seed: int = 42) -> DataFrame:
    """Per outer fold: parameters chosen inside its training rows, and the score on its test rows."""
    inner = {fold: [(f, a + lo, b + lo, c + lo, d + lo) for f, a, b, c, d in splits.rolling_origin(hi - lo, inner_k)]
        for fold, lo, hi, _, _ in outer}
    chosen = select_parameters(rows, inner, name, names, grid, metric, seed)
    text = lambda point: ", ".join(f"{k}={v}" for k, v in sorted(point.items()))
    tasks = [t for f in outer for t in tasks_of([f], [models.ModelSpec(name, chosen[f[0]], seed)], names, text(chosen[f[0]]))]
    scored = checkpointed(scored_tasks(rows, tasks, {"selected_params": "string"}))
    return metrics.evaluate(scored, ["model", "seed", "fold", "selected_params"])


def nested_summary(results: DataFrame, metric: str = "pr_auc") -> DataFrame:
    """Interval over outer folds, with the parameters chosen in each."""
    chosen = results.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fold",
        "selected_params"))), lambda x: F.concat(x["fold"].cast("string"), F.lit(": "), x["selected_params"])),
        " | ").alias("params_by_fold"))
    return stats.summarise(results, ["model"], value=metric).join(chosen, "model")


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Scores of two models side by side (row_id, label, a, b); both must cover the same rows."""
    left = a.select("row_id", "label", F.col("score").alias("a"))
    joined = left.join(b.select("row_id", F.col("score").alias("b")), "row_id", "full")
    if joined.filter("a is null or b is null").limit(1).count():
        raise ValueError("the two models were scored on different rows")
    return joined


def compare_best(rows: DataFrame, folds: list[Fold], names: list[str], main: list[models.ModelSpec],
    baseline: list[models.ModelSpec], metric: str = "roc_auc", iterations: int = 10_000, block: int = 24) -> DataFrame:
    """The best main model against the best baseline on the same out-of-fold rows, with a block bootstrap.

    Where the rows are of one class there is nothing to draw: ``n_valid`` is 0 and the difference NULL.
    """
    best = {}
    for side, specs in (("a", main), ("b", baseline)):
        scored = {s.name: out_of_fold(rows, folds, s, names) for s in specs}
        means = {n: metrics.ranking(d, ["fold"]).agg(F.avg(metric)).first()[0] or 0.0 for n, d in scored.items()}
        top = max(means, key=lambda n: (means[n], n))
        best[side] = (top, scored[top])
    both = paired(best["a"][1], best["b"][1])
    lo = min(f[3] for f in folds)
    out = stats.bootstrap_difference(both.withColumn("row_id", F.col("row_id") - lo), iterations, block, metric=metric,
        strict=False)
    return out.withColumn("model_a", F.lit(best["a"][0])).withColumn("model_b", F.lit(best["b"][0]))


def fold_to_explain(results: DataFrame, how: str = "best", metric: str = "pr_auc") -> DataFrame:
    """The fold whose model is explained, and whether its test rate is extreme."""
    key = {"best": F.struct(F.col(metric), F.col("fold")),
        "last": F.struct(F.col("fold").alias("x"), F.col("fold"))}[how]
    return results.groupBy("model").agg(F.max_by("fold", key).alias("fold"),
        F.max_by("positive_rate", key).alias("test_rate")).withColumn("extreme",
        (F.col("test_rate") > 0.6) | (F.col("test_rate") < 0.1))


def evaluate_variants(variants: DataFrame, keys: list[str], config: FeatureConfig, specs: list[models.ModelSpec],
    k: int = 5, common: bool = False, rules: list[str] = []) -> DataFrame:
    """Metrics of each variant's own design matrix, on all its rows or on those that all variants share."""
    variants = checkpointed(variants)
    names_of = [r["variant"] for r in variants.select("variant").distinct().orderBy("variant").collect()]
    frames, names = [], None
    for v in names_of:
        features, named = build_features(variants.filter(F.col("variant") == v).drop("variant"), keys, config)
        names = [n for part in named.values() for n in part]
        frames.append(checkpointed(supervised(features, names, keys).withColumn("variant", F.lit(v))))
    if common:
        from ..operators.healing import common_rows

        shared = common_rows(union(frames), [*keys, "ts"])
        frames = [checkpointed(numbered(shared.filter(F.col("variant") == v).drop("row_id"), keys)) for v in names_of]
    out = []
    for v, rows in zip(names_of, frames):
        r = evaluate(rows, rolling_folds(rows, k), names, specs, rules=rules)
        out.append(r.withColumn("variant", F.lit(v)).withColumn("n_rows", F.lit(rows.count())).withColumn("comparison",
            F.lit("common_rows" if common else "as_available")))
    return union(out)


def variant_summary(results: DataFrame, metric: str = "pr_auc") -> DataFrame:
    return stats.summarise(results, ["comparison", "variant", "n_rows"], value=metric)
