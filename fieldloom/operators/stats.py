"""From per-fold scores to summaries: intervals, two-level means, sensitivity, bootstrap."""

from __future__ import annotations

import hashlib
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checkpointed, student_t_critical, uniform
from .metrics import ranking

METRICS = ("roc_auc", "pr_auc", "f1", "precision", "recall", "brier")
#: Deviations at or below this are rounding, not spread.
NO_SPREAD = 1e-12
#: Up to so many degrees of freedom the critical value is looked up; beyond, a series in 1/df has it to ten digits.
MAX_DF = 200


def t_value(n: Column, confidence: float = 0.95) -> Column:
    """Critical value of Student's t for ``n`` replicates: a table built on the driver, and the expansion around the normal value."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable((df,
        student_t_critical(confidence, df)) for df in range(1, MAX_DF + 1))])
    z, df = NormalDist().inv_cdf((1 + confidence) / 2), n - 1
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    series = F.lit(z) + sum((F.lit(c) / F.pow(df, F.lit(float(k))) for k, c in enumerate(terms, 1)), F.lit(0.0))
    return F.when(df > MAX_DF, series).otherwise(table[F.least(df, F.lit(MAX_DF)).cast("int")])


def wide_summary(results: DataFrame, by: list[str], metrics: tuple[str, ...]) -> DataFrame:
    """One row a model: ``<metric>_mean`` and ``<metric>_std`` of each metric."""
    return results.groupBy(*by).agg(*[f(m).alias(f"{m}_{n}") for m in metrics for n,
        f in (("mean", F.avg), ("std", F.stddev_samp))])


def unpivot(df: DataFrame, keys: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Wide scores as (keys, metric, value)."""
    return df.unpivot(keys, list(metrics), "metric", "value")


def summarise(long: DataFrame, by: list[str], confidence: float = 0.95, bounds: tuple[float, float] | None = (0.0, 1.0),
    value: str = "value") -> DataFrame:
    """Mean, deviation, t interval (clipped), half-width (not clipped), n, and whether the replicates all agree."""
    x = F.col(value)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    v = F.when(finite, x)
    s = long.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("_std"), F.count(v).alias("n"))
    std = F.when(F.col("n") < 2, None).when(F.col("_std") <= NO_SPREAD, 0.0).otherwise(F.col("_std"))
    s = s.withColumn("std", std).withColumn("half_width",
        F.when(F.col("n") >= 2, t_value(F.col("n"), confidence) * F.col("std") / F.sqrt("n")))
    low, high = F.col("mean") - F.col("half_width"), F.col("mean") + F.col("half_width")
    if bounds:
        low, high = F.when(low.isNotNull(), F.greatest(low, F.lit(bounds[0]))), F.when(high.isNotNull(),
            F.least(high, F.lit(bounds[1])))
    return s.withColumn("ci_low", low).withColumn("ci_high", high).withColumn("degenerate",
        F.when(F.col("n") >= 2, F.col("std") == 0)).drop("_std")


def aggregate_runs(results: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """By (model, metric): the interval over per-fold means, and mean, deviation and n over per-seed means."""
    long = unpivot(results, ["model", "seed", "fold"], metrics)
    mean = lambda level: long.groupBy("model", "metric", level).agg(F.avg("value").alias("value"))
    folds = summarise(mean("fold"), ["model", "metric"]).withColumnRenamed("n", "n_folds")
    seeds = summarise(mean("seed"), ["model", "metric"]).select("model", "metric", F.col("mean").alias("seed_mean"),
        F.col("std").alias("seed_std"), F.col("n").alias("n_seeds"),
        F.col("degenerate").alias("deterministic_across_seeds"))
    return folds.join(seeds, ["model", "metric"])


def collect_protocols(protocols: dict[str, DataFrame], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Per-fold scores of several protocols as one frame with a ``protocol`` column; None is left out."""
    out = None
    for name, df in protocols.items():
        if df is None:
            continue
        if lost := [c for c in ("model", "fold") if c not in df.columns]:
            raise ValueError(f"{name} has no {lost}")
        if "positive_rate" in df.columns:
            df = df.withColumnRenamed("positive_rate", "test_positive_rate")
        part = df.withColumn("protocol", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no protocol has results")
    return out


def sensitivity(per_fold: DataFrame, excluded: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Each (protocol, model, metric) over all folds and without the excluded ones (``protocol, fold``), with the change."""
    long = unpivot(per_fold, ["protocol", "model", "fold"], metrics)
    marks = F.broadcast(excluded.select("protocol", "fold").distinct().withColumn("_out", F.lit(True)))  # a few folds
    both = long.join(marks, ["protocol", "fold"], "left").withColumn("subset",
        F.explode(F.when(F.col("_out"), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("reduced")))))
    s = summarise(both, ["protocol", "model", "metric", "subset"])
    names = excluded.groupBy("protocol").agg(F.array_join(F.transform(F.array_sort(F.collect_set("fold")),
        lambda x: x.cast("string")), ",").alias("_names"))
    whole = F.max(F.when(F.col("subset") == "all", F.col("mean"))).over(Window.partitionBy("protocol", "model",
        "metric"))
    out = s.withColumn("delta", F.when(F.col("subset") == "reduced", F.col("mean") - whole)).join(names, "protocol",
        "left")
    return out.withColumn("excluded_folds", F.when(F.col("subset") == "reduced",
        F.coalesce("_names", F.lit(""))).otherwise("")).drop("_names")


def ranking_preserved(summary: DataFrame, metric: str) -> DataFrame:
    """By protocol: is the order of models by mean the same in both subsets?"""
    order = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mean")).alias("m"), "model"))),
        lambda x: x["model"]), ">")
    by = summary.filter(F.col("metric") == metric).groupBy("protocol", "subset").agg(order.alias("o"))
    return by.groupBy("protocol").agg(F.max(F.when(F.col("subset") == "all", F.col("o"))).alias("all_order"),
        F.max(F.when(F.col("subset") == "reduced", F.col("o"))).alias("reduced_order")).withColumn("preserved",
        F.col("all_order") == F.col("reduced_order"))


def against_baselines(summary: DataFrame, baselines: list[str]) -> DataFrame:
    """By (model, metric): the best main model's mean and the difference to it (smaller is better for Brier)."""
    sign = F.when(F.col("metric") == "brier", -1.0).otherwise(1.0)
    main = summary.filter(~F.col("model").isin(baselines))
    best = main.groupBy("metric").agg(F.max_by("model",
        F.struct(sign * F.col("mean"), F.col("model"))).alias("best_model"),
        F.max_by("mean", F.struct(sign * F.col("mean"), F.col("model"))).alias("best_mean"))
    return summary.join(F.broadcast(best), "metric").withColumn("delta",
        F.col("mean") - F.col("best_mean")).withColumn("is_baseline", F.col("model").isin(baselines))


def pivot_folds(results: DataFrame, metric: str, folds: list[int]) -> DataFrame:
    """Model by fold."""
    return results.groupBy("model").pivot("fold", folds).agg(F.avg(metric)).select("model",
        *[F.col(str(f)).alias(f"fold_{f}") for f in folds])


def joined_delta(a: DataFrame, b: DataFrame, on: list[str], value: str, names: tuple[str, str]) -> DataFrame:
    """Two summaries side by side and their difference (tuned and untuned, holdout and rolling)."""
    x, y = a.select(*on, F.col(value).alias(names[0])), b.select(*on, F.col(value).alias(names[1]))
    return x.join(y, on).withColumn("delta", F.col(names[0]) - F.col(names[1]))


def intervals_overlap(summary: DataFrame, by: list[str]) -> DataFrame:
    """Do all intervals of a group share a point?"""
    return summary.groupBy(*by).agg((F.max("ci_low") <= F.min("ci_high")).alias("overlap"))


def leakage_verdict(summary: DataFrame, limit: float = 0.9) -> DataFrame:
    """The worst score of the control set, and whether it says that something leaks."""
    return summary.agg(F.max("mean").alias("worst"), F.max_by("model",
        F.struct("mean", "model")).alias("model")).withColumn("verdict",
        F.when(F.col("worst") > limit, "leak suspected").otherwise("no leak seen"))


def block_indices(spark, iterations: int, n: int, block: int, seed: int = 42) -> DataFrame:
    """(iteration, place, row_id): rows drawn by whole blocks until there are n, the same in any partitioning."""
    block = max(1, min(block, n))
    starts = -(-n // block)
    drawn = spark.range(iterations * starts).select(F.expr(f"id div {starts}").alias("iteration"),
        (F.col("id") % starts).alias("_k"))
    start = F.floor(uniform(seed, "iteration", "_k") * (n - block + 1))
    rows = drawn.withColumn("_start", start).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(block - 1))))
    return rows.select("iteration", (F.col("_k") * block + F.col("_o")).alias("place"),
        (F.col("_start") + F.col("_o")).alias("row_id")).filter(F.col("place") < n)


#: Up to so many rows (some 20 bytes each) a draw is scored in one piece by the task that makes it.
HELD_ROWS = 1_000_000
DRAWN = "iteration long, d double"


def _score_steps(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows from the highest score down, and where each run of equal scores ends."""
    order = np.argsort(-scores, kind="stable")
    down = scores[order]
    return order, np.append(np.flatnonzero(down[1:] != down[:-1]), len(down) - 1)


def _ranked(metric: str, order: np.ndarray, ends: np.ndarray, label: np.ndarray, w: np.ndarray) -> float:
    """ROC-AUC or average precision of rows that count ``w`` times."""
    p, n = w * label, w * (1 - label)
    tp, fp = np.cumsum(p[order])[ends], np.cumsum(n[order])[ends]
    here_p, here_n = np.diff(tp, prepend=0), np.diff(fp, prepend=0)
    if metric == "roc_auc":
        return float((here_n * (tp - here_p / 2)).sum() / (tp[-1] * fp[-1]))
    met = tp + fp > 0
    return float((here_p[met] * tp[met] / (tp + fp)[met]).sum() / tp[-1])


def _drawn_differences(paired: DataFrame, n: int, iterations: int, block: int, seed: int, metric: str) -> DataFrame:
    """(iteration, d) of every draw with both classes. The rows travel once; a draw costs its block starts and running sums."""
    spark = paired.sparkSession
    rows = paired.select("row_id", "label", "a", "b").orderBy("row_id").toPandas()
    label = rows["label"].to_numpy(float)
    sent = spark.sparkContext.broadcast((label, *[_score_steps(rows[m].to_numpy(float)) for m in ("a", "b")]))
    block = max(1, min(block, n))
    starts = -(-n // block)

    def draw(batches):
        label, of_a, of_b = sent.value
        for batch in batches:
            kept, values = [], []
            for i in batch.column(0).to_pylist():
                lot = [int(hashlib.md5(f"{seed}:{i}:{k}".encode()).hexdigest()[:8], 16) for k in range(starts)]
                first = np.floor(np.array(lot) / 4294967296.0 * (n - block + 1)).astype(np.int64)
                end = first + block
                end[-1] = first[-1] + n - (starts - 1) * block  # the last block is cut to n rows in all
                w = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(end, minlength=n + 1))[:n].astype(float)
                positive = w @ label
                if 0 < positive < n:
                    kept.append(i)
                    values.append(_ranked(metric, *of_a, label, w) - _ranked(metric, *of_b, label, w))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(values, pa.float64())], ["iteration", "d"])

    return spark.range(iterations).mapInArrow(draw, DRAWN)


def _joined_differences(paired: DataFrame, n: int, iterations: int, block: int, seed: int, metric: str) -> DataFrame:
    """The same draws for any number of rows."""
    counts = block_indices(paired.sparkSession, iterations, n, block, seed).groupBy("iteration",
        "row_id").agg(F.count(F.lit(1)).alias("w"))
    rows = counts.join(paired, "row_id").withColumn("m",
        F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("a").alias("score")),
        F.struct(F.lit("b").alias("model"), F.col("b").alias("score")))))
    scored = ranking(rows.select("iteration", "m.model", "m.score", "label", "w"), ["iteration", "model"], weight="w")
    side = lambda m: F.max(F.when(F.col("model") == m, F.col(metric)))
    return scored.groupBy("iteration").agg((side("a") - side("b")).alias("d")).filter("d is not null")


def bootstrap_difference(paired: DataFrame, iterations: int = 10_000, block: int = 24, confidence: float = 0.95,
    seed: int = 42, metric: str = "roc_auc", strict: bool = True) -> DataFrame:
    """Paired moving-block bootstrap of ``metric`` between scores ``a`` and ``b`` (columns row_id, label, a, b).

    Up to ``HELD_ROWS`` rows a draw is a few block starts and running sums in one task, so draws cost no shuffle of
    rows; beyond, a draw is a count for each of its distinct rows, joined and ranked by shuffle. Both give the same draws.
    An iteration with one class is left out, and fewer than two others are an error. Unless ``strict``, ``n_valid`` tells
    it instead: the difference of one class and the bounds of no draws are NULL, and no draw speaks against a p-value of 1.
    """
    if metric not in ("roc_auc", "pr_auc"):
        raise ValueError(f"no metric {metric!r}")
    paired = checkpointed(paired)
    n, places = paired.agg(F.count(F.lit(1)), F.count_distinct("row_id")).first()
    one_class = paired.select("label").distinct().count() < 2
    if one_class and strict:
        raise ValueError("one class only")
    low, high = paired.agg(F.min("row_id"), F.max("row_id")).first()
    if one_class:
        d = paired.sparkSession.createDataFrame([], DRAWN)
    elif n <= HELD_ROWS and (low, high, places) == (0, n - 1, n):
        d = checkpointed(_drawn_differences(paired, n, iterations, block, seed, metric))
    else:
        d = checkpointed(_joined_differences(paired, n, iterations, block, seed, metric))
    valid = d.count()
    if valid < 2 and strict:
        raise ValueError(f"only {valid} of {iterations} draws hold both classes")
    observed = ranking(paired.withColumn("m", F.explode(F.array(F.struct(F.lit("a").alias("model"),
        F.col("a").alias("score")), F.struct(F.lit("b").alias("model"), F.col("b").alias("score"))))).select("m.*",
        "label"), ["model"])
    observed = observed.agg((F.max(F.when(F.col("model") == "a", F.col(metric))) - F.max(F.when(F.col("model") == "b",
        F.col(metric)))).alias("difference"))
    tail = (1 - confidence) / 2
    q = F.percentile("d", F.array(F.lit(tail), F.lit(1 - tail)))
    below, above = F.avg((F.col("d") <= 0).cast("double")), F.avg((F.col("d") >= 0).cast("double"))
    out = d.agg(q[0].alias("ci_low"), q[1].alias("ci_high"),
        F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p_value"), F.count(F.lit(1)).alias("n_valid"))
    return observed.join(F.broadcast(out))  # one row each
