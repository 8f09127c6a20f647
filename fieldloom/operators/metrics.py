"""Imbalance-aware classification metrics for any grouping, all in distributed passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import running_totals


def confusion(scored: DataFrame, by: list[str], label: str = "label", predicted: str = "predicted",
    score: str = "score") -> DataFrame:
    """Confusion cells, precision, recall, F1 (0 where undefined), Brier score, sizes and rate."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    c = scored.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
            F.count_if(~y & ~p).alias("tn"),
        F.avg(F.pow(F.greatest(F.least(F.col(score), F.lit(1.0)), F.lit(0.0)) - F.col(label),
            F.lit(2.0))).alias("brier"),
        F.count(F.lit(1)).alias("n_test"), F.count_if(y).alias("n_positive"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return (
        c.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
        .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
        .withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
        .withColumn("positive_rate", F.col("n_positive") / F.col("n_test"))
    )


def _by_score(scored: DataFrame, by: list[str], label: str, score: str, weight: str | None) -> DataFrame:
    """Positives and negatives at each distinct score, then running totals from the highest score down.

    The shuffle carries one row a distinct score and group, not one a scored row, and the running
    totals are two-level: a group with very many distinct scores is many tasks.
    """
    w = F.col(weight) if weight else F.lit(1)
    at = scored.groupBy(*by, F.col(score).alias("_s")).agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col(label) == 1, 0).otherwise(w)).alias("_n"))
    return running_totals(at, by, F.desc("_s"), {"_tp": "_p", "_fp": "_n"})


def ranking(scored: DataFrame, by: list[str], label: str = "label", score: str = "score",
    weight: str | None = None) -> DataFrame:
    """Tie-aware ROC-AUC and average precision (a step curve); NULL where only one class occurs."""
    steps = _by_score(scored, by, label, score, weight)
    sums = steps.groupBy(*by).agg(
        F.sum(F.col("_n") * (F.col("_tp") - F.col("_p") / 2)).alias("_a"),
            F.sum(F.col("_p") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("_ap"), F.sum("_p").alias("_P"),
            F.sum("_n").alias("_N")
    )
    both = (F.col("_P") > 0) & (F.col("_N") > 0)
    return sums.select(*by, F.when(both, F.col("_a") / (F.col("_P") * F.col("_N"))).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("_P")).alias("pr_auc"))


def evaluate(scored: DataFrame, by: list[str]) -> DataFrame:
    """All metrics of each group: one row each."""
    on = [*by]
    return confusion(scored, by).join(ranking(scored, by), on)


def recall_sweep(scored: DataFrame, by: list[str], average_over: list[str], steps: int = 99, label: str = "label",
    score: str = "score") -> DataFrame:
    """Recall at thresholds 0.01 .. 0.99 in each group, averaged over ``average_over``.

    Positives are counted by the number of thresholds they pass, so rows meet no threshold grid.
    """
    passes = F.least(F.greatest(F.floor(F.col(score) * (steps + 1) + F.lit(1e-9)), F.lit(0)), F.lit(steps)).cast("int")
    counts = scored.filter(F.col(label) == 1).groupBy(*by, passes.alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    spread = counts.withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_k")))).groupBy(*by,
        "_t").agg(F.sum("_n").alias("_hit"))
    total = spread.filter("_t = 0").select(*by, F.col("_hit").alias("_all"))
    grid = total.withColumn("_t", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    recall = grid.join(spread, [*by, "_t"], "left").withColumn("_r", F.coalesce("_hit", F.lit(0)) / F.col("_all"))
    rest = [b for b in by if b not in average_over]
    return recall.groupBy(*rest, "_t").agg(F.avg("_r").alias("recall")).select(*rest,
        (F.col("_t") / F.lit(float(steps + 1))).alias("threshold"), "recall")


def reference_points(rows: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """What no skill scores: ROC-AUC 0.5, PR-AUC the prevalence p, Brier p(1 - p)."""
    p = F.avg(label)
    return rows.groupBy(*by).agg(F.lit(0.5).alias("roc_auc"), p.alias("pr_auc"), (p * (1 - p)).alias("brier"))
