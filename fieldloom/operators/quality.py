"""Validation of the merged frame: schema, ranges, diurnal alignment, missing counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expected_peak_hour, hour_distance
from .timegrid import MERGED

#: Physical range of each column, and whether it may be NULL.
RANGES = {
    "soil_moisture": (0.0, 100.0, True),
    "air_temp": (-50.0, 60.0, False),
    "humidity": (0.0, 100.0, False),
    "wind_speed": (0.0, 50.0, False),
    "solar_radiation": (0.0, 1200.0, False),
    "flow_l": (0.0, None, True),
    "flow_l_cumulative": (0.0, None, True),
}


class ValidationError(ValueError):
    """All violations of a frame at once."""


def violations(df: DataFrame, ranges: dict = RANGES, binary: str = "irrigation_event") -> DataFrame:
    """(column, rule, n, extreme) of every broken rule, from one pass over the data."""
    have = set(df.columns)
    rules = []
    for c, (low, high, nullable) in ranges.items():
        if c not in have:
            continue
        x = F.col(c)
        if not nullable:
            rules.append((c, "null", x.isNull(), None))
        rules.append((c, "below", x < low, F.min(x)))
        if high is not None:
            rules.append((c, "above", x > high, F.max(x)))
    if binary in have:
        rules.append((binary, "not_binary", ~F.col(binary).isin(0, 1), None))
    if "ts" in have:
        rules.append(("ts", "null", F.col("ts").isNull(), None))
    parts = [F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.count_if(bad).alias("n"),
        (F.lit(None) if x is None else x).cast("double").alias("extreme")) for c, r, bad, x in rules]
    return df.agg(F.array(*parts).alias("v")).select(F.explode("v").alias("v")).select("v.*").filter("n > 0")


def validate(df: DataFrame) -> DataFrame:
    """The frame itself, or one error that lists all violations."""
    lost = [c for c, _ in MERGED if c not in df.columns]
    found = [f"{c}: missing" for c in lost] + [f"{r['column']}: {r['n']} rows {r['rule']} (extreme {r['extreme']})"
        for r in violations(df).collect()]
    if found:
        raise ValidationError("; ".join(found))
    return df


def diurnal_profile(df: DataFrame, column: str = "solar_radiation", keys: list[str] | None = None) -> DataFrame:
    """Mean by hour of day."""
    return df.groupBy(*(keys or []), F.hour("ts").alias("hour")).agg(F.avg(column).alias("mean"))


def diurnal_alignment(df: DataFrame, utc_offset_hours: float, column: str = "solar_radiation",
    keys: list[str] | None = None) -> DataFrame:
    """Peak hour, its distance around the clock from local noon, and the three highest hours."""
    profile = diurnal_profile(df, column, keys).filter("mean is not null")
    order = F.struct(F.col("mean"), -F.col("hour"))
    top = F.slice(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("mean")).alias("m"), "hour"))),
        lambda x: x["hour"]), 1, 3)
    peak = profile.groupBy(*(keys or [])).agg(F.max_by("hour", order).alias("peak_hour"), top.alias("top"))
    return peak.withColumn("distance", hour_distance(F.col("peak_hour"),
        expected_peak_hour(utc_offset_hours))).withColumn("top_hours",
        F.array_join(F.transform("top", lambda x: x.cast("string")), ",")).drop("top")


def validate_alignment(df: DataFrame, utc_offset_hours: float, tolerance_hours: float = 2.0,
    column: str = "solar_radiation") -> float:
    """The distance, or an error when it exceeds the tolerance."""
    row = diurnal_alignment(df, utc_offset_hours, column).first()
    if row is None or row["peak_hour"] is None:
        raise ValidationError(f"{column} has no values")
    if row["distance"] > tolerance_hours:
        raise ValidationError(
            f"{column} peaks at {row['peak_hour']} UTC, {row['distance']} h from local noon (highest hours {row['top_hours']})")
    return float(row["distance"])


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, n) of each column in one pass."""
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("n_missing"),
        F.count(F.lit(1)).alias("n")) for c in columns]
    return df.agg(F.array(*parts).alias("v")).select(F.explode("v").alias("v")).select("v.*")
