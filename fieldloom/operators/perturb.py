"""Repeatable damage to a sensor column: masks and a sawtooth ramp. Draws depend on keys, not on partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by_time, clip, logistic, uniform

RATES = (0.05, 0.30)


def _check(rate: float) -> None:
    if not RATES[0] <= rate <= RATES[1]:
        raise ValueError(f"rate must be within {RATES}")


def mask_at_random(df: DataFrame, column: str, rate: float, key: list[str], seed: int = 42) -> DataFrame:
    """Sets a value to NULL with the same probability everywhere."""
    _check(rate)
    return df.withColumn(column, F.when(uniform(seed, *key) >= rate, F.col(column)))


def mask_in_heat(df: DataFrame, column: str, rate: float, key: list[str], seed: int = 42, covariate: str = "air_temp",
    midpoint: float = 35.0, slope: float = 0.3) -> DataFrame:
    """Sets a value to NULL with a probability that rises with a covariate and averages ``rate``; never where that is unknown."""
    _check(rate)
    raw = logistic(F.lit(slope) * (F.col(covariate) - midpoint))
    mean = F.broadcast(df.agg(F.avg(raw).alias("_mean")))  # one row
    p = clip(raw * F.lit(rate) / F.col("_mean"), 0.0, 1.0)
    return df.join(mean).withColumn(column, F.when(F.coalesce(uniform(seed, *key) >= p, F.lit(True)),
        F.col(column))).drop("_mean")


def reset_intervals(df: DataFrame, keys: list[str], shortest: int = 35, longest: int = 40, seed: int = 42) -> DataFrame:
    """(keys, start): the rows at which the ramp restarts, from hashed interval lengths and a running sum."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    each = n.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor(F.col("_n") / shortest).cast("int") + 1)))
    length = F.lit(shortest) + F.floor(uniform(seed, *keys, "_k") * (longest - shortest + 1))
    w = by_time(keys, "_k").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("start", F.coalesce(F.sum(length).over(w),
        F.lit(0)).cast("long")).filter(F.col("start") < F.col("_n")).select(*keys, "start")


def add_ramp(df: DataFrame, column: str, keys: list[str], a: float = 5.545, b: float = 0.08, seed: int = 42,
    conductivity: float | None = None, factor: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Adds ``a (1 - exp(-b t))``, t rows since the last restart; NULL stays NULL."""
    pos = df.withColumn("_pos", (F.row_number().over(by_time(keys)) - 1).cast("long"))
    marks = reset_intervals(df, keys, seed=seed).withColumn("_reset", F.col("start")).withColumnRenamed("start", "_pos")
    w = by_time(keys, "_pos").rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("_pos") - F.last("_reset", ignorenulls=True).over(w)
    ramp = F.lit(a) * (1 - F.exp(F.lit(-b) * t))
    if conductivity is not None:
        ramp = ramp * (1 + F.lit(factor) * F.lit(conductivity) * F.lit(scale))
    return pos.join(marks, [*keys, "_pos"], "left").withColumn(column, F.col(column) + ramp).drop("_pos", "_reset")


def peak(a: float = 5.545, b: float = 0.08, rows: int = 39) -> float:
    """The ramp's highest value if it runs for ``rows`` rows."""
    return a * (1 - math.exp(-b * rows))


def build_variants(clean: DataFrame, column: str, keys: list[str], impute: list[str], rate: float = 0.2, seed: int = 42,
    rounds: int = 10) -> DataFrame:
    """clean, masked, corrupted (masked and ramped), healed (imputed) and compensated frames as one, by ``variant``.

    The target and the flow meter never take part in imputation.
    """
    from .healing import compensate_drift, mice_impute

    if bad := {"irrigation_event", "flow_l", "flow_l_cumulative"} & set(impute):
        raise ValueError(f"{sorted(bad)} may not be imputed from")
    masked = mask_in_heat(clean, column, rate, [*keys, "ts"], seed)
    corrupted = add_ramp(masked, column, keys, seed=seed)
    healed = mice_impute(corrupted, impute, rounds)
    compensated = compensate_drift(healed, column, keys)
    out = None
    for name, d in (("clean", clean), ("masked", masked), ("corrupted", corrupted), ("healed", healed),
        ("compensated", compensated)):
        part = d.select(F.lit(name).alias("variant"), *clean.columns)
        out = part if out is None else out.unionByName(part)
    return out
