"""Result tables and documents: what a run leaves behind, as frames ready for the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attribution


def p_value_text(p: Column, iterations: int = 10_000) -> Column:
    """Four places, with the resolution of the draws as floor instead of a zero."""
    floor = 1.0 / iterations
    return F.when(p < floor, F.lit(f"< {floor:.0e}")).otherwise(F.format_string("%.4f", p))


def parameter_text(params: dict) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(params.items()))


def dominance_document(by_fold: DataFrame, totals: dict[str, int], rule: float = 0.5) -> DataFrame:
    """One row: dominance by fold, flagged folds, the largest episode and its share of each total (NULL of a total of 0)."""
    rounded = F.round("dominance", 4)
    entries = F.array_sort(F.collect_list(F.struct(F.col("fold").cast("string").alias("fold"),
        rounded.alias("dominance"))))
    flagged = F.array_sort(F.collect_list(F.when(F.col("dominance") > rule, F.col("fold"))))
    out = by_fold.agg(F.map_from_entries(entries).alias("dominance_by_fold"), flagged.alias("flagged_folds"),
        F.max("largest_episode").alias("largest_episode"))
    shares = [(F.round(F.col("largest_episode") / F.lit(float(n)), 4) if n else F.lit(None).cast("double")).alias(name)
        for name, n in totals.items()]
    return out.withColumn("largest_episode_share", F.struct(*shares)).withColumn("rule",
        F.lit(rule)) if shares else out.withColumn("rule", F.lit(rule))


def comparison_document(compared: DataFrame, alpha: float = 0.05, iterations: int = 10_000) -> DataFrame:
    """The bootstrap comparison with its verdict in words."""
    better = F.when(F.col("difference") > 0, F.col("model_a")).otherwise(F.col("model_b"))
    verdict = F.when(F.col("p_value") < alpha, F.concat(better, F.lit(" is better (p "),
        p_value_text(F.col("p_value"), iterations), F.lit(")"))).otherwise(
        F.concat(F.lit("no difference shown (p "), p_value_text(F.col("p_value"), iterations), F.lit(")"))
    )
    return compared.withColumn("interpretation", verdict)


def baseline_table(summary: DataFrame, reference: DataFrame, baselines: list[str]) -> DataFrame:
    """Baseline rows beside the best main model and the no-skill value of their metric (``metric, no_skill``)."""
    from .stats import against_baselines

    rows = against_baselines(summary, baselines).filter("is_baseline").drop("is_baseline")
    return rows.join(F.broadcast(reference), "metric", "left").withColumn("above_no_skill",
        F.col("mean") - F.col("no_skill"))


def explanation_manifest(contributions: DataFrame, scored: DataFrame, feature_blocks: dict[str, list[str]], model: str,
    fold: int, k: int = 3) -> DataFrame:
    """One row: the top features, the importance of all, and the instances to explain."""
    importance = attribution.importance_table(contributions, feature_blocks, model, fold)
    chosen = attribution.instances(scored.withColumn("model", F.lit(model)), ["model"])
    a = importance.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature", "mean_abs", "block"))),
            lambda x: x.dropFields("rank")).alias("importance"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "feature")))),
            lambda x: x["feature"]).alias("top_features"),
    )
    b = chosen.agg(F.array_sort(F.collect_list(F.struct("case", "row_id", "score"))).alias("instances"))
    return a.join(F.broadcast(b)).select(F.lit(model).alias("model"), F.lit(fold).alias("fold"), "top_features",
        "importance", "instances")  # one row each


def master_summary(by_protocol: DataFrame, notes: dict[str, str]) -> DataFrame:
    """All summaries in a fixed order (metric, then mean from the top), with a note on each model."""
    pairs = [F.lit(x) for kv in notes.items() for x in kv]
    note = F.create_map(*pairs)[F.col("model")] if pairs else F.lit(None).cast("string")
    return by_protocol.withColumn("note", note).orderBy("metric", F.desc("mean"), "model")
