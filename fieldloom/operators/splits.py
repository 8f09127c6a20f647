"""Time-ordered folds as a small table of row bounds, and what each fold holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = "fold int, train_lo long, train_hi long, test_lo long, test_hi long"


def rolling_origin(n: int, k: int = 5, gap: int = 0, sliding: bool = False) -> list[tuple[int, int, int, int, int]]:
    """k folds of ``n div (k + 1)`` test rows at the end; each trains on what precedes its test rows less ``gap``."""
    if k < 2:
        raise ValueError("at least two folds")
    if n < k + 1:
        raise ValueError(f"{n} rows are too few for {k} folds")
    size, out = n // (k + 1), []
    for fold in range(1, k + 1):
        lo = n - (k - fold + 1) * size
        end = lo - gap
        start = max(0, end - size) if sliding else 0
        if end <= start:
            raise ValueError(f"fold {fold} has no training rows")
        out.append((fold, start, end, lo, lo + size))
    return out


def holdout(n: int, share: float = 0.8) -> list[tuple[int, int, int, int, int]]:
    """One fold: the first ``int(n * share)`` rows train."""
    cut = int(n * share)
    if not 0 < cut < n:
        raise ValueError("both sides need rows")
    return [(1, 0, cut, cut, n)]


def assert_ordered(folds: list[tuple[int, int, int, int, int]]) -> None:
    """Every fold trains on rows that precede its test rows, and neither side is empty."""
    for fold, a, b, c, d in folds:
        if not (a < b and c < d):
            raise ValueError(f"fold {fold} is empty on one side")
        if b > c:
            raise ValueError(f"fold {fold} trains on rows at or after its test rows")


def folds_frame(spark: SparkSession, folds: list[tuple[int, int, int, int, int]]) -> DataFrame:
    assert_ordered(folds)
    return spark.createDataFrame(folds, FOLDS)


def assign(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once for every fold and role it has. The folds are at most a few dozen rows, so a broadcast range join is right."""
    r = F.col("row_id")
    train = (r >= F.col("train_lo")) & (r < F.col("train_hi"))
    test = (r >= F.col("test_lo")) & (r < F.col("test_hi"))
    joined = rows.join(F.broadcast(folds), train | test)
    return joined.withColumn("role", F.when(train, "train").otherwise("test")).drop("train_lo", "train_hi", "test_lo",
        "test_hi")


def describe(assigned: DataFrame, label: str = "label", episode: str | None = None, min_positives: int = 5,
    max_share: float = 0.5) -> DataFrame:
    """Sizes, positives, rates, periods and, if episodes are given, the dominance of each fold's test rows."""
    train, test, y = F.col("role") == "train", F.col("role") == "test", F.col(label) == 1
    by = assigned.groupBy("fold").agg(
        F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"),
            F.count_if(train & y).alias("train_positive"), F.count_if(test & y).alias("test_positive"),
        F.min(F.when(train, F.col("ts"))).alias("train_start"), F.max(F.when(train, F.col("ts"))).alias("train_end"),
        F.min(F.when(test, F.col("ts"))).alias("test_start"), F.max(F.when(test, F.col("ts"))).alias("test_end"),
    )
    out = by.withColumn("train_rate", F.col("train_positive") / F.col("n_train")).withColumn("test_rate",
        F.col("test_positive") / F.col("n_test"))
    out = out.withColumn("sufficient_positives", (F.col("train_positive") >= min_positives)
        & (F.col("test_positive") >= min_positives))
    if episode:
        from .episodes import dominance

        d = dominance(assigned.filter(test).select("fold", episode), ["fold"], episode)
        out = out.join(d, "fold", "left").withColumn("dominated",
            F.coalesce(F.col("dominance") > max_share, F.lit(False)))
    return out


def dominated_folds(table: DataFrame) -> DataFrame:
    return table.filter("dominated").select("fold")


def rate_spread(table: DataFrame, limit: float = 0.25) -> DataFrame:
    """Spread of the test rates, and whether it asks for a warning."""
    return table.agg((F.max("test_rate") - F.min("test_rate")).alias("spread")).withColumn("warn",
        F.col("spread") > limit)
