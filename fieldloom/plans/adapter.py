"""Reads the star-schema tables as field channels and as scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hours
from ..operators import timegrid

KEYS = ["site"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str, kind: str, by_user: bool = False) -> DataFrame:
    """Readings of one event type; one site, or ten by user."""
    site = F.pmod("user_id", F.lit(10)).cast("int") if by_user else F.lit(0)
    return table(spark, d, "events").filter(F.col("event_type") == kind).select(site.alias("site"), "ts", "event_id",
        "value")


def moisture(spark, d, by_user=False) -> DataFrame:
    return timegrid.hourly(events(spark, d, "view", by_user).withColumnRenamed("value", "soil_moisture"), KEYS,
        "soil_moisture", "mean")


def valve(spark, d, by_user=False) -> DataFrame:
    h = timegrid.hourly(events(spark, d, "error", by_user), KEYS, "value", "mean")
    return h.select("site", "ts", (F.col("value") > 55).cast("int").alias("irrigation_event"))


def flow(spark, d) -> DataFrame:
    """The meter: a running total of hourly sums (one row an hour meets the window, not the readings)."""
    h = events(spark, d, "click").groupBy("site", hours(F.col("ts")).alias("ts")).agg(F.sum("value").alias("_s"))
    return h.select("site", "ts", F.sum("_s").over(Window.partitionBy("site").orderBy("ts")).alias("flow_l_cumulative"))


def weather(spark, d) -> DataFrame:
    rows = table(spark, d, "events").select(F.lit(0).alias("site"), "ts", "event_type", "value")
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    wide = rows.groupBy("site", hours(F.col("ts")).alias("ts")).agg(mean("signup").alias("T2M"),
        mean("purchase").alias("RH2M"))
    wide = wide.withColumn("WS2M", F.col("T2M") / 2).withColumn("ALLSKY_SFC_SW_DWN", F.col("RH2M") / 30)
    return timegrid.on_grid(timegrid.rename_weather(wide), KEYS)


def merged_by_channel(spark, d) -> DataFrame:
    """The merged table from channels that landed apart, as a site's own files would."""
    return timegrid.merge_channels(moisture(spark, d), weather(spark, d), valve(spark, d), flow(spark, d), KEYS)


def merged(spark, d, by_user: bool = False) -> DataFrame:
    """The same table from one pass over ``events``: all channels are conditional aggregates of one shuffle by site and hour.

    Hours between a site's first and last moisture reading are all there; an empty hour follows the one before it.
    """
    site = F.pmod("user_id", F.lit(10)).cast("int") if by_user else F.lit(0)
    kind = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    base = table(spark, d, "events").groupBy(site.alias("site"), hours(F.col("ts")).alias("ts")).agg(
        F.avg(kind("view")).alias("soil_moisture"), F.avg(kind("signup")).alias("air_temp"),
            F.avg(kind("purchase")).alias("humidity"),
        (F.avg(kind("error")) > 55).cast("int").alias("irrigation_event"), F.sum(kind("click")).alias("_click"),
    )
    w = Window.partitionBy("site").orderBy("ts")
    known = F.when(F.col("soil_moisture").isNotNull(), F.col("ts"))
    rows = base.select(
        "*", F.when(F.col("_click").isNotNull(), F.sum("_click").over(w)).alias("flow_l_cumulative"),
            F.lead("ts").over(w).alias("_next"),
        F.min(known).over(Window.partitionBy("site")).alias("_lo"),
            F.max(known).over(Window.partitionBy("site")).alias("_hi"),
    )
    hour = F.expr("interval 1 hour")
    every = F.explode(F.coalesce(F.sequence("ts", F.col("_next") - hour, hour), F.array("ts"))).alias("_at")
    values = ["soil_moisture", "air_temp", "humidity", "irrigation_event", "flow_l_cumulative"]
    dense = rows.select("site", "ts", "_lo", "_hi", every,
        *values).filter(F.col("_at").between(F.col("_lo"), F.col("_hi")))
    dense = dense.select("site", F.col("_at").alias("ts"),
        *[F.when(F.col("_at") == F.col("ts"), F.col(c)).alias(c) for c in values])
    dense = dense.withColumn("wind_speed", F.col("air_temp") / 2).withColumn("solar_radiation",
        F.col("humidity") / 30 * F.lit(timegrid.MJ_PER_HOUR_IN_WATTS))
    return timegrid.to_schema(dense.withColumn("flow_l", timegrid.positive_difference("flow_l_cumulative", KEYS)), KEYS)


def scored(spark, d) -> DataFrame:
    """(model, seed, fold, row_id, label, score, predicted): three columns of lineitem as scores of a return."""
    li = table(spark, d, "lineitem")
    scores = {"discount": F.col("l_discount") * 10, "tax": F.col("l_tax") * 12, "quantity": F.col("l_quantity") / 50}
    models = F.array(*[F.struct(F.lit(n).alias("model"), F.round(s.cast("double"), 6).alias("score")) for n,
        s in scores.items()])
    rows = li.select(
        F.pmod("l_suppkey", F.lit(3)).cast("int").alias("seed"),
            F.pmod("l_orderkey", F.lit(5)).cast("int").alias("fold"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"),
            (F.col("l_returnflag") == "R").cast("int").alias("label"), F.explode(models).alias("m"),
    )
    return rows.select("m.model", "seed", "fold", "row_id", "label", "m.score",
        (F.col("m.score") >= 0.5).cast("int").alias("predicted"))
