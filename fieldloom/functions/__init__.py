"""Column expressions shared by the operators."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounds a value and keeps NULL (``greatest`` and ``least`` alone would skip it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def hours(ts: Column) -> Column:
    """The hour a timestamp falls in, without a time zone."""
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the seed and keys alone, not on partitions.

    md5 rather than a faster hash so that any SQL engine can reproduce a draw.
    """
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def expected_peak_hour(utc_offset_hours: float) -> float:
    """UTC hour of local noon."""
    return (12 - utc_offset_hours) % 24


def hour_distance(a: Column, b: Column | float) -> Column:
    """Distance of two hours around the clock."""
    d = F.pmod(a - b, F.lit(24.0))
    return F.least(d, F.lit(24.0) - d)


def by_time(keys: list[str], ts: str = "ts") -> Window:
    """Rows of each key in time order."""
    return Window.partitionBy(*keys).orderBy(ts)


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def student_t_critical(confidence: float, df: int) -> float:
    """Two-sided critical value of Student's t, by bisection on its regularised incomplete beta."""
    tail = (1 - confidence) / 2

    def upper(t: float) -> float:
        return 0.5 * _incomplete_beta(df / (df + t * t), df / 2, 0.5)

    lo, hi = 0.0, 1.0
    while upper(hi) > tail:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if upper(mid) > tail else (lo, mid)
    return (lo + hi) / 2


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised I_x(a, b) by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    total = d
    for m in range(1, 500):
        before = total
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            total *= c * d
        if abs(total - before) < 1e-15 * abs(total):
            break
    return front * total


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only a session that names neither (a local one, as in tests) gets a temporary folder, which it keeps.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """A frame that is worked out once: written to the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def range_sorted(df: DataFrame, *order: Column) -> DataFrame:
    """Rows sorted over all partitions, with ``_part`` (the range) and ``_place`` (inside it, from 0), written once.

    A key with most of the rows is as many ranges as it fills, if ``order`` tells its rows apart.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order)
                          .withColumn("_id", F.monotonically_increasing_id()))
    inside = (1 << 33) - 1
    return placed.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND(inside)}).drop("_id")


def running_totals(df: DataFrame, by: list[str], order: Column, totals: dict[str, str]) -> DataFrame:
    """Running sums (``out: column``) of each group in ``order``, in two levels; rows of a group need distinct places.

    The rows are range-sorted by group and place, each range sums its own rows, and what the
    ranges before it hold is added: one row a range and group. So no window holds a whole group.
    """
    placed = range_sorted(df, *[F.col(c).asc() for c in by], order)
    own = Window.partitionBy("_part", *by)
    inside = own.orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    parts = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_all_{out}") for out, c in totals.items()])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_part").alias("_before_part"),
        *[F.coalesce(F.sum(f"_all_{out}").over(earlier), F.lit(0)).alias(f"_before_{out}") for out in totals])
    same = F.col("_part") == F.col("_before_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    summed = placed.withColumns({f"_in_{out}": F.sum(c).over(inside) for out, c in totals.items()}).join(parts, same)
    return summed.select(*df.columns, *[(F.col(f"_in_{out}") + F.col(f"_before_{out}")).alias(out) for out in totals])
