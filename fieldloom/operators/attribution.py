"""Tables on per-row feature contributions: importances, instances, pooled top-N rows."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def mean_abs(contributions: DataFrame) -> DataFrame:
    """(feature, mean_abs) of a long frame (row_id, feature, contribution)."""
    return contributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"))


def importance_table(contributions: DataFrame, feature_blocks: dict[str, list[str]], model: str,
    fold: int) -> DataFrame:
    """Rank, mean absolute contribution and block of each feature."""
    pairs = [(n, b) for b, names in feature_blocks.items() for n in names]
    tags = contributions.sparkSession.createDataFrame(pairs, "feature string, block string")
    ranked = mean_abs(contributions).withColumn("rank",
        F.row_number().over(Window.orderBy(F.desc("mean_abs"), "feature")))  # one row a feature
    return ranked.join(F.broadcast(tags), "feature", "left").select("rank", "feature", "mean_abs", "block",
        F.lit(model).alias("model"), F.lit(fold).alias("fold"))


def top_features(contributions: DataFrame, k: int = 3) -> DataFrame:
    return mean_abs(contributions).orderBy(F.desc("mean_abs"), "feature").limit(k)


def waterfall(contributions: DataFrame, n: int) -> DataFrame:
    """Each row's n largest contributions and one row for all others; their sum is unchanged."""
    w = Window.partitionBy("row_id").orderBy(F.desc(F.abs("contribution")), "feature")
    ranked = contributions.withColumn("place", F.row_number().over(w))
    place = F.when(F.col("place") <= n, F.col("place")).otherwise(n + 1)
    pooled = ranked.groupBy("row_id", place.alias("place")).agg(F.sum("contribution").alias("contribution"),
        F.count(F.lit(1)).alias("_n"), F.min("feature").alias("_f"))
    name = F.when(F.col("place") <= n, F.col("_f")).otherwise(F.concat(F.col("_n").cast("string"),
        F.lit(" other features")))
    return pooled.select("row_id", "place", name.alias("feature"), "contribution")


def instances(scored: DataFrame, by: list[str], threshold: float = 0.5, label: str = "label",
    score: str = "score") -> DataFrame:
    """The most confident true and false positive and the row nearest the threshold; the first row wins ties, a case without rows has none."""
    p = F.col(score)
    first = lambda cost: F.struct(cost.alias("cost"), F.col("row_id"), p.alias("score"))
    hit = p >= threshold
    agg = scored.groupBy(*by).agg(
        F.min(F.when(hit & (F.col(label) == 1), first(-p))).alias("true_positive"),
        F.min(F.when(hit & (F.col(label) == 0), first(-p))).alias("false_positive"),
        F.min(first(F.abs(p - threshold))).alias("borderline"),
    )
    cases = F.array(*[F.struct(F.lit(c).alias("case"), F.col(c).alias("x")) for c in ("true_positive", "false_positive",
        "borderline")])
    return agg.select(*by, F.explode(cases).alias("c")).filter("c.x is not null").select(*by, "c.case", "c.x.row_id",
        "c.x.score")


def linear_contributions(rows: DataFrame, names: list[str], coefficients: list[float]) -> DataFrame:
    """``coef * (x - mean)`` of each feature: exact for a linear score, and they sum to score minus base."""
    means = F.broadcast(rows.agg(*[F.avg(n).alias(f"_m_{n}") for n in names]))  # one row
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value"),
        (F.lit(float(c)) * (F.col(n) - F.col(f"_m_{n}"))).alias("contribution")) for n, c in zip(names, coefficients)])
    return rows.join(means).select("row_id", F.explode(parts).alias("c")).select("row_id", "c.*")


def tree_nodes(model, folder: str) -> list[dict]:
    """Leaves of a boosted model: value times the tree's weight, and by feature on the path (low, high, share of rows that follow).

    The saved model is read back as a table; a model of 200 trees of depth six has at most 12,800 leaves.
    """
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(folder)
    rows = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect()
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for tree, nodes in sorted(trees.items()):
        weight = float(model.treeWeights[tree])
        todo: list[tuple[int, dict]] = [(0, {})]
        while todo:
            at, path = todo.pop()
            n = nodes[at]
            if n["leftChild"] < 0:
                out.append({"value": weight * n["prediction"], "path": path})
                continue
            f, cut = n["split"]["featureIndex"], n["split"]["leftCategoriesOrThreshold"][0]
            for child, lo, hi in ((n["leftChild"], -np.inf, cut), (n["rightChild"], cut, np.inf)):
                was = path.get(f, (-np.inf, np.inf, 1.0))
                share = nodes[child]["rawCount"] / n["rawCount"]
                todo.append((child, {**path, f: (max(was[0], lo), min(was[1], hi), was[2] * share)}))
    return out


def shapley(leaves: list[dict], x: np.ndarray) -> np.ndarray:
    """Path-dependent Shapley values (rows by features), and the base in a last column.

    A leaf's game is a product over the features of its path: 1 or 0 where the feature is known, the
    share of training rows that follow where it is not. Its Shapley values are sums over the number of
    known features, so polynomials stand for all subsets.
    """
    out = np.zeros((len(x), x.shape[1] + 1))
    for leaf in leaves:
        path = list(leaf["path"].items())
        n = len(path)
        hit = [(x[:, f] > lo) & (x[:, f] <= hi) for f, (lo, hi, _) in path]
        share = [s for _, (_, _, s) in path]
        out[:, -1] += leaf["value"] * np.prod(share)
        for i, (f, _) in enumerate(path):
            poly = np.zeros((n, len(x)))  # by number of known features among the others
            poly[0] = 1
            for j in range(n):
                if j != i:
                    poly[1:] = poly[1:] * share[j] + poly[:-1] * hit[j]
                    poly[0] *= share[j]
            weight = [math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) for k in range(n)]
            out[:, f] += leaf["value"] * (hit[i] - share[i]) * (np.array(weight) @ poly)
    return out


def tree_contributions(model, rows: DataFrame, names: list[str], folder: str) -> DataFrame:
    """(row_id, feature, value, contribution, base) of a boosted model's raw score, exact for the trees as conditional games."""
    leaves = rows.sparkSession.sparkContext.broadcast(tree_nodes(model, folder))

    def run(frames):
        import pandas as pd

        for frame in frames:
            x = frame[names].to_numpy(float)
            got = shapley(leaves.value, x)
            yield pd.DataFrame({
                "row_id": np.repeat(frame["row_id"].to_numpy(), len(names)), "feature": np.tile(names, len(frame)),
                    "value": x.ravel(),
                "contribution": got[:, :-1].ravel(), "base": np.repeat(got[:, -1], len(names)),
            })

    return rows.select("row_id", *names).mapInPandas(run,
        "row_id long, feature string, value double, contribution double, base double")


def fitted_contributions(fitted, rows: DataFrame, names: list[str], folder: str) -> DataFrame:
    """The same of what ``models.fit`` returns: a fit of one class moves with no feature, so the base is its raw score."""
    if not fitted.degenerate:
        return tree_contributions(fitted.model.stages[-1], rows, names, folder)
    # Boosted trees give the probability 1 / (1 + exp(-2 * raw)).
    raw = math.log(fitted.constant / (1 - fitted.constant)) / 2
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    return rows.select("row_id", F.explode(parts).alias("c")).select("row_id", "c.*", F.lit(0.0).alias("contribution"),
        F.lit(raw).alias("base"))


def column_medians(rows: DataFrame, names: list[str]) -> DataFrame:
    """(feature, median), exact, in one pass."""
    parts = F.array(*[F.struct(F.lit(n).alias("feature"), F.percentile(n, F.lit(0.5)).alias("median")) for n in names])
    return rows.agg(parts.alias("m")).select(F.explode("m").alias("m")).select("m.*")


def annotated_waterfall(contributions: DataFrame, medians: DataFrame, n: int) -> DataFrame:
    """Waterfall rows with the value and the training median in the label."""
    values = contributions.select("row_id", "feature", "value")
    w = waterfall(contributions, n).join(values, ["row_id", "feature"], "left").join(F.broadcast(medians), "feature",
        "left")
    text = F.when(F.col("value").isNotNull(), F.format_string("%s = %.2f (median %.2f)", "feature", "value",
        "median")).otherwise(F.col("feature"))
    return w.select("row_id", "place", text.alias("label"), "contribution")
