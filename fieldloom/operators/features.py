"""Strictly causal features: every value at t comes from t-1 and before, or from the clock."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import by_time

# The names of channels, and with them the patterns of feature names (``<channel>_lag<h>h`` and so on).
MOISTURE, TARGET, FLOW = "soil_moisture", "irrigation_event", ("flow_l", "flow_l_cumulative")
WEATHER = ("air_temp", "humidity", "wind_speed", "solar_radiation")


@dataclass(frozen=True)
class FeatureConfig:
    """Options of the design matrix; the defaults give 40 columns in four blocks."""

    moisture_lags: tuple[int, ...] = (1, 2, 3, 6, 12, 24)
    diff_hours: tuple[int, ...] = (1, 3)
    roll_hours: tuple[int, ...] = (6, 24)
    weather_lags: tuple[int, ...] = (1, 3, 24)
    weather_roll_hours: tuple[int, ...] = (6,)
    target_lags: tuple[int, ...] = (1, 2, 3, 24)
    weather: tuple[str, ...] = WEATHER
    causal_shift: int = 1
    require_full_window: bool = True
    forbidden: tuple[str, ...] = field(default=FLOW)

    def __post_init__(self):
        if self.causal_shift < 1:
            raise ValueError("causal_shift must be at least 1: a feature may not see its own hour")
        for name in ("moisture_lags", "weather_lags", "target_lags", "diff_hours", "roll_hours"):
            if any(h < 1 for h in getattr(self, name)):
                raise ValueError(f"{name} must be at least 1")


def lag(c: str, h: int, keys: list[str]) -> Column:
    return F.lag(c, h).over(by_time(keys)).alias(f"{c}_lag{h}h")


def diff(c: str, h: int, keys: list[str], shift: int = 1) -> Column:
    """Change over h hours that ended ``shift`` hours ago."""
    w = by_time(keys)
    return (F.lag(c, shift).over(w) - F.lag(c, shift + h).over(w)).alias(f"{c}_diff{h}h")


def rolling(c: str, hours: int, stat: str, keys: list[str], shift: int = 1, full: bool = True) -> Column:
    """A statistic over ``hours`` rows that end ``shift`` rows ago; NULL unless all (or any) are known."""
    frame = by_time(keys).rowsBetween(-(hours - 1) - shift, -shift)
    agg = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}[stat](c).over(frame)
    least = hours if full else 1
    return F.when(F.count(c).over(frame) >= least, agg).alias(f"{c}_roll{hours}h_{stat}")


def with_hours_since_on(df: DataFrame, keys: list[str], target: str = TARGET, shift: int = 1) -> DataFrame:
    """Adds hours since the last ON hour at least ``shift`` hours ago; NULL before the first."""
    w = by_time(keys)
    at = df.withColumn("_pos", F.row_number().over(w))
    last = F.last(F.when(F.col(target) == 1, F.col("_pos")),
        ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -shift))
    return at.withColumn("hours_since_last_irrigation", (F.col("_pos") - last).cast("double")).drop("_pos")


def calendar(keys: list[str]) -> list[Column]:
    """Hour of day on the circle, and days since the key's first row."""
    angle = F.hour("ts") * F.lit(2 * math.pi / 24)
    first = F.min("ts").over(Window.partitionBy(*keys))
    return [F.sin(angle).alias("hour_sin"), F.cos(angle).alias("hour_cos"),
        (F.timestamp_diff("SECOND", first, F.col("ts")) / 86400.0).alias("days_elapsed")]


def blocks(config: FeatureConfig = FeatureConfig()) -> dict[str, list[str]]:
    """Feature names by block, in order; no data is read."""
    c = config
    moisture = [f"{MOISTURE}_lag{h}h" for h in c.moisture_lags] + [f"{MOISTURE}_diff{h}h"
        for h in c.diff_hours] + [f"{MOISTURE}_roll{w}h_{s}" for w in c.roll_hours for s in ("mean", "min", "max",
        "std")]
    weather = [n for x in c.weather for n in (*[f"{x}_lag{h}h" for h in c.weather_lags],
        *[f"{x}_roll{w}h_mean" for w in c.weather_roll_hours])]
    return {"moisture": moisture, "weather": weather, "calendar": ["hour_sin", "hour_cos", "days_elapsed"],
        "irrigation": [*[f"{TARGET}_lag{h}h" for h in c.target_lags], "hours_since_last_irrigation"]}


def assert_allowed(names: list[str], config: FeatureConfig = FeatureConfig()) -> None:
    """No forbidden column and nothing derived from one may be a feature."""
    bad = [n for n in names for f in (*config.forbidden, TARGET, MOISTURE,
        *config.weather) if n == f or (f in config.forbidden and n.startswith(f"{f}_"))]
    if bad:
        raise ValueError(f"forbidden features: {sorted(set(bad))}")


def ablation_sets(config: FeatureConfig = FeatureConfig()) -> dict[str, list[str]]:
    """Nested sets of one matrix: A moisture, B + weather, C + calendar, D + irrigation; E weather alone."""
    b = blocks(config)
    a = b["moisture"]
    return {"A": a, "B": a + b["weather"], "C": a + b["weather"] + b["calendar"],
        "D": [n for part in b.values() for n in part], "E": list(b["weather"])}


def build_features(df: DataFrame, keys: list[str], config: FeatureConfig = FeatureConfig()) -> tuple[DataFrame,
    dict[str, list[str]]]:
    """All features beside the key, time and target. One window order, so one sort for a key."""
    lost = [x for x in ("ts", MOISTURE, TARGET, *config.weather) if x not in df.columns]
    if lost:
        raise ValueError(f"missing columns {lost}")
    c, shift = config, config.causal_shift
    base = with_hours_since_on(df, keys, shift=shift)
    exprs: list[Column] = [lag(MOISTURE, h, keys) for h in c.moisture_lags] + [diff(MOISTURE, h, keys,
        shift) for h in c.diff_hours]
    exprs += [rolling(MOISTURE, w, s, keys, shift, c.require_full_window) for w in c.roll_hours for s in ("mean", "min",
        "max", "std")]
    for x in c.weather:
        exprs += [lag(x, h, keys) for h in c.weather_lags] + [rolling(x, w, "mean", keys, shift,
            c.require_full_window) for w in c.weather_roll_hours]
    exprs += calendar(keys) + [lag(TARGET, h, keys) for h in c.target_lags]
    out = base.select(*keys, "ts", TARGET, *exprs, "hours_since_last_irrigation")
    named = blocks(config)
    assert_allowed([n for part in named.values() for n in part], config)
    return out, named


def numbered(rows: DataFrame, keys: list[str], out: str = "row_id") -> DataFrame:
    """Numbers rows from 0 by (ts, keys) over all keys together, so that a cut by number is a cut in time.

    Days are numbered apart and then moved by the rows of the days before; only one row a day meets in one task.
    """
    rows = rows.withColumn("_day", F.to_date("ts"))
    counts = rows.groupBy("_day").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_day").orderBy("ts", *keys))
    return rows.withColumn("_own", own).join(F.broadcast(starts), "_day").withColumn(out,
        (F.col("_start") + F.col("_own") - 1).cast("long")).drop("_day", "_own", "_start")


def supervised(features: DataFrame, names: list[str], keys: list[str], target: str = TARGET) -> DataFrame:
    """Rows without NULL among the chosen features and target, numbered by time over all keys."""
    rows = features.select(*keys, "ts", F.col(target).cast("int").alias("label"),
        *names).dropna(subset=["label", *names])
    return numbered(rows, keys)


def closed_before(df: DataFrame, named: dict[str, list[str]], target: str = TARGET) -> tuple[DataFrame,
    dict[str, list[str]]]:
    """Rows that were OFF an hour ago, without the then constant column."""
    constant = f"{target}_lag1h"
    return df.filter(F.col(constant) == 0).drop(constant), {k: [n for n in v if n != constant] for k,
        v in named.items()}
