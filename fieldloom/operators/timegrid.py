"""From raw channel readings to one dense hourly frame for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import by_time, clip, hours

#: The merged schema, in order.
MERGED = (
    ("ts", "timestamp_ntz"),
    ("soil_moisture", "double"),
    ("air_temp", "double"),
    ("humidity", "double"),
    ("wind_speed", "double"),
    ("solar_radiation", "double"),
    ("irrigation_event", "int"),
    ("flow_l", "double"),
    ("flow_l_cumulative", "double"),
)
#: Names of the weather service's parameters, and MJ/m2/h in W/m2.
WEATHER_NAMES = {"T2M": "air_temp", "RH2M": "humidity", "WS2M": "wind_speed", "ALLSKY_SFC_SW_DWN": "solar_radiation"}
MJ_PER_HOUR_IN_WATTS = 277.78


def to_utc(df: DataFrame, utc_offset_hours: float, column: str = "ts") -> DataFrame:
    """Shifts local time to UTC; fractions of hours count to the second."""
    if column not in df.columns:
        raise ValueError(f"no column {column!r}; there are {df.columns}")
    shift = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(utc_offset_hours) * 3600))
    return df.withColumn(column, F.col(column) - shift)


def hourly(df: DataFrame, keys: list[str], value: str, how: str, ts: str = "ts",
    order: list[str] | None = None) -> DataFrame:
    """One row an hour that has readings: mean, max or the last non-null value.

    Raw readings meet a partial aggregation only, never a window. ``order`` breaks ties of
    ``ts`` for ``last``.
    """
    v = F.col(value)
    last = F.max_by(v, F.struct(ts, *(order or []))) if how == "last" else None
    agg = {"mean": F.avg(v), "max": F.max(v), "last": last}[how]
    rows = df.filter(v.isNotNull()) if how == "last" else df
    return rows.groupBy(*keys, hours(F.col(ts)).alias("ts")).agg(agg.alias(value))


def dense_hours(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Every hour from a key's first to its last."""
    span = df.groupBy(*keys).agg(F.min(hours(F.col(ts))).alias("_lo"), F.max(hours(F.col(ts))).alias("_hi"))
    return span.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr("interval 1 hour"))).alias("ts"))


def on_grid(hourly_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Hourly rows with the empty hours between them as NULL."""
    return dense_hours(hourly_rows, keys).join(hourly_rows, [*keys, "ts"], "left")


def rename_weather(df: DataFrame) -> DataFrame:
    """Weather parameters under their schema names, radiation in W/m2."""
    out = df.withColumnsRenamed({k: v for k, v in WEATHER_NAMES.items() if k in df.columns})
    if "ALLSKY_SFC_SW_DWN" in df.columns:
        out = out.withColumn("solar_radiation", F.col("solar_radiation") * F.lit(MJ_PER_HOUR_IN_WATTS))
    return out


def positive_difference(c: str, keys: list[str]) -> Column:
    """Step of a cumulative meter, never below 0; NULL where a neighbour is."""
    x = F.col(c)
    return clip(x - F.lag(x).over(by_time(keys)), low=0.0)


def to_schema(df: DataFrame, keys: list[str]) -> DataFrame:
    """The merged columns in order, missing ones as NULL."""
    return df.select(*keys, *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in MERGED])


def merge_channels(moisture: DataFrame, weather: DataFrame, valve: DataFrame, flow: DataFrame,
    keys: list[str]) -> DataFrame:
    """Hourly channels on the dense grid of moisture: weather inner, valve and flow left."""
    on = [*keys, "ts"]
    merged = on_grid(moisture, keys).join(weather, on).join(valve, on, "left").join(flow, on, "left")
    merged = merged.withColumn("flow_l", positive_difference("flow_l_cumulative", keys))
    return to_schema(merged, keys)
