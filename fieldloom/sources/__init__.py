"""Readers of sensor logs, weather files and merged tables, and writers of results."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timegrid import MERGED

#: Timestamp formats tried in order; a log may mix them.
FORMATS = ("dd-MMM-yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm",
    "yyyy-MM-dd HH:mm")
#: The first word found in a file's name gives its channel.
CHANNELS = (("moisture", "soil_moisture"), ("valve", "irrigation_event"), ("flow", "flow_l_cumulative"))
FILL = -999.0


def parsed_time(c):
    """The first format that fits, as a timestamp without zone; NULL if none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in FORMATS]).cast("timestamp_ntz")


def column_roles(df: DataFrame) -> tuple[str, str]:
    """(time column, value column) of a two-column text log, from one aggregate over both.

    A fully numeric column is the value. If both are, the one whose values read as dates after
    2000 is the time; if neither is, the first is.
    """
    if len(df.columns) != 2:
        raise ValueError(f"two columns are expected, not {df.columns}")
    a, b = df.columns
    numeric = lambda c: F.bool_and(F.col(c).isNull() | F.expr(f"try_cast(`{c}` as double)").isNotNull()) & (
        F.count(c) > 0)
    year = lambda c: F.percentile(F.year(F.timestamp_seconds(F.expr(f"try_cast(`{c}` as double)"))),
        F.lit(0.5))
    r = df.agg(numeric(a).alias("a"), numeric(b).alias("b"), year(a).alias("ya"), year(b).alias("yb")).first()
    if r["a"] and r["b"]:
        late_a, late_b = (r["ya"] or 0) > 2000, (r["yb"] or 0) > 2000
        if late_a == late_b:
            raise ValueError("both columns are numeric and no single one reads as time")
        return (a, b) if late_a else (b, a)
    return (b, a) if r["a"] and not r["b"] else (a, b)


def read_log(spark: SparkSession, path: str | list[str], value: str = "value") -> DataFrame:
    """(ts, value) of a two-column log with a header; values that are no numbers are NULL."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    time, val = column_roles(raw)
    numeric_time = F.timestamp_seconds(F.expr(f"try_cast(`{time}` as double)")).cast("timestamp_ntz")
    return raw.select(F.coalesce(parsed_time(F.col(time)), numeric_time).alias("ts"),
        F.expr(f"try_cast(`{val}` as double)").alias(value))


def channel_of(name: str) -> str | None:
    """The channel a file name routes to; the first word that occurs decides."""
    stem = name.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    return next((c for word, c in CHANNELS if word in stem), None)


def scan_logs(spark: SparkSession, paths: str | list[str], doubtful: str = "raise") -> DataFrame:
    """(log, channel, ts, value) of any number of two-column logs in one read; ``channel`` is NULL where the name has no word.

    A log is a file, or a folder ``*.txt`` or ``*.csv`` of parts. The roles of its columns come from one aggregate by
    log (as ``column_roles`` has them), so the number of jobs does not depend on the number of logs. Logs of another
    width, or with two numeric columns of which no single one reads as time, are an error, or left out with
    ``doubtful="drop"``. A log without rows has none here either.
    """
    # Three columns are asked for, so that a row of three shows; headers are skipped in every file.
    raw = spark.read.schema("a string, b string, c string").csv(paths, header=True, ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True)
    file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    folder = F.regexp_extract(file, r"^(.*\.(?:txt|csv))/part-[^/]*$", 1)
    raw = raw.select("a", "b", "c", F.when(folder != "", folder).otherwise(file).alias("log"))
    number = {c: F.expr(f"try_cast({c} as double)") for c in "ab"}
    numeric = lambda c: F.bool_and(F.col(c).isNull() | number[c].isNotNull()) & (F.count(c) > 0)
    late = lambda c: F.coalesce(F.percentile(F.year(F.timestamp_seconds(number[c])), F.lit(0.5)) > 2000, F.lit(False))
    said = raw.groupBy("log").agg(numeric("a").alias("_a"), numeric("b").alias("_b"), late("a").alias("_ya"),
        late("b").alias("_yb"), F.count("c").alias("_c"), F.count("b").alias("_n"))
    both = F.col("_a") & F.col("_b")
    bad = (F.col("_c") > 0) | (F.col("_n") == 0) | both & (F.col("_ya") == F.col("_yb"))
    roles = said.select(F.col("log").alias("_log"), bad.alias("_bad"), F.when(both, F.col("_ya")).otherwise(
        ~(F.col("_a") & ~F.col("_b"))).alias("_time_first"))
    if doubtful == "raise":
        lost = [r["_log"] for r in roles.filter("_bad").limit(10).collect()]
        if lost:
            raise ValueError(f"no single column reads as time in {lost}")
    # One row a log; Spark broadcasts them while they are few and joins by shuffle beyond.
    rows = raw.join(roles.filter("not _bad"), F.col("log") == F.col("_log"))
    time, value = (F.when(F.col("_time_first") == first, F.col("a")).otherwise(F.col("b")) for first in (True, False))
    stem = F.lower(F.regexp_replace(F.regexp_extract("log", r"([^/]*)$", 1), r"\.[^.]*$", ""))
    channel = F.coalesce(*[F.when(F.contains(stem, F.lit(word)), F.lit(c)) for word, c in CHANNELS])
    number_of_time = F.timestamp_seconds(time.try_cast("double")).cast("timestamp_ntz")
    return rows.select("log", channel.alias("channel"), F.coalesce(parsed_time(time), number_of_time).alias("ts"),
        value.try_cast("double").alias("value"))


def read_channels(spark: SparkSession, files: list[str]) -> dict[str, DataFrame]:
    """One frame a channel; *.txt before *.csv, each sorted, a later file of a channel replaces an earlier one."""
    order = sorted((f for f in files if f.endswith(".txt"))) + sorted(f for f in files if f.endswith(".csv"))
    routed = {c: f for f in order if (c := channel_of(f))}
    if lost := [c for _, c in CHANNELS if c not in routed]:
        raise ValueError(f"no file for {lost}")
    return {c: read_log(spark, f, c) for c, f in routed.items()}


def read_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The channels of all text and CSV logs in a folder; file names are listed by Spark, contents are not read for it."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,csv}").load(folder).select("path")
    return read_channels(spark, [r["path"] for r in listed.collect()])  # one short row a file


def weather_path(folder: str, lat: float, lon: float, start: str, end: str) -> str:
    """Where a landed weather file of a site and period lies; another site cannot match."""
    return f"{folder}/weather_{lat:.4f}_{lon:.4f}_{start}_{end}.json"


def weather_rows(documents: DataFrame, column: str = "value", fill: float = FILL) -> DataFrame:
    """A row an hour from JSON texts of parameter -> yyyyMMddHH -> value; the file's own fill value or the default is NULL."""
    schema = "struct<header:struct<fill_value:double>, properties:struct<parameter:map<string,map<string,double>>>>"
    d = documents.select(F.from_json(column, schema).alias("j"))
    d = d.select(F.coalesce("j.header.fill_value", F.lit(fill)).alias("fill"),
        F.explode("j.properties.parameter").alias("name", "hours"))
    d = d.select("fill", "name", F.explode("hours").alias("hour", "v"))
    at = F.try_to_timestamp("hour", F.lit("yyyyMMddHH")).cast("timestamp_ntz")
    return d.select(at.alias("ts"), "name", F.nullif("v", F.col("fill")).alias("v"))


def read_weather(spark: SparkSession, path: str, parameters: list[str]) -> DataFrame:
    """Weather wide by parameter; the first parameter's hours drive the rows, and a missing file is an error."""
    try:
        landed = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        raise FileNotFoundError(f"no weather file at {path}: files are landed beforehand, nothing is downloaded") from e
    rows = weather_rows(landed)
    hours = rows.filter(F.col("name") == parameters[0]).select("ts").distinct()
    wide = rows.groupBy("ts").pivot("name", parameters).agg(F.max("v"))
    return hours.join(wide, "ts", "left")


def request_window(channels: list[DataFrame]) -> DataFrame:
    """(start, end) as yyyyMMdd over the union of all channels' times."""
    ts = None
    for c in channels:
        part = c.select("ts")
        ts = part if ts is None else ts.union(part)
    return ts.agg(F.date_format(F.min("ts"), "yyyyMMdd").alias("start"),
        F.date_format(F.max("ts"), "yyyyMMdd").alias("end"))


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The merged hourly table, from Parquet or CSV."""
    schema = ", ".join(f"{c} {t}" for c, t in MERGED)
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, schema=schema)
    return spark.read.parquet(path).select(*[F.col(c).cast(t).alias(c) for c, t in MERGED])


def unknown_hours(merged: DataFrame) -> int:
    """Hours whose valve state is not known."""
    return merged.filter(F.col("irrigation_event").isNull()).count()


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> str:
    w = df.write.mode("overwrite")
    w.csv(path, header=True) if kind == "csv" else w.parquet(path)
    return path


def write_document(df: DataFrame, path: str) -> str:
    """A frame as one JSON document a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
    return path


def export_all(tables: dict[str, DataFrame], documents: dict[str, DataFrame], folder: str,
    kind: str = "parquet") -> dict[str, str]:
    """Writes every table and document; returns name -> path."""
    out = {n: write_table(d, f"{folder}/{n}", kind) for n, d in tables.items()}
    return out | {n: write_document(d, f"{folder}/{n}") for n, d in documents.items()}
