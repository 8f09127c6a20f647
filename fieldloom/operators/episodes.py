"""ON runs of a binary column: episodes, labels, onsets, summaries, dominance.

A NULL is an unknown hour: it breaks a run and never counts as OFF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import by_time

#: Left edges of the duration histogram; the last bin is open.
EDGES = (1, 2, 3, 6, 12, 24, 48, 96)


def _on(c: str) -> Column:
    return F.coalesce(F.col(c) == 1, F.lit(False))


def with_labels(df: DataFrame, keys: list[str], target: str = "irrigation_event") -> DataFrame:
    """Adds ``episode``: the 0-based number of the ON run, NULL when not ON, and ``pos`` in the key."""
    w = by_time(keys)
    starts = df.withColumn("pos", (F.row_number().over(w) - 1).cast("long")).withColumn("_start",
        _on(target) & ~F.coalesce(F.lag(_on(target)).over(w), F.lit(False)))
    number = F.sum(F.col("_start").cast("int")).over(w)
    return starts.withColumn("episode", F.when(_on(target), (number - 1).cast("long"))).drop("_start")


def episodes(df: DataFrame, keys: list[str], target: str = "irrigation_event") -> DataFrame:
    """One row a maximal ON run: start, end (inclusive), length and times."""
    runs = with_labels(df, keys, target).filter("episode is not null")
    return runs.groupBy(*keys, "episode").agg(
        F.min("pos").alias("start_index"), F.max("pos").alias("end_index"), F.count(F.lit(1)).alias("length_hours"),
            F.min("ts").alias("start_time"), F.max("ts").alias("end_time")
    )


def episode_summary(df: DataFrame, keys: list[str], target: str = "irrigation_event") -> DataFrame:
    """Counts and length statistics of each key's episodes; the deviation of one episode or none is 0."""
    found = episodes(df, keys, target)
    n = F.col("length_hours")
    q = F.percentile(n, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    lengths = found.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_episodes"), F.min(n).alias("min_hours"), q[0].alias("q25_hours"),
            q[1].alias("median_hours"), q[2].alias("q75_hours"), F.max(n).alias("max_hours"),
        F.avg(n).alias("mean_hours"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp(n)).otherwise(0.0).alias("std_hours"),
    )
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hours"), F.count_if(_on(target)).alias("on_hours"),
        F.count_if(F.col(target).isNull()).alias("unknown_hours"))
    return total.join(lengths, keys, "left").withColumns({"n_episodes": F.coalesce("n_episodes", F.lit(0)),
        "std_hours": F.coalesce("std_hours", F.lit(0.0))})


def bin_labels(edges: tuple[int, ...] = EDGES) -> list[str]:
    names = [str(a) if b == a + 1 else f"{a}-{b - 1}" for a, b in zip(edges, edges[1:])]
    return [*names, f"{edges[-1]}+"]


def episode_histogram(df: DataFrame, keys: list[str], target: str = "irrigation_event",
    edges: tuple[int, ...] = EDGES) -> DataFrame:
    """Each key's episodes by duration bin, empty bins and keys without episodes included: conditional counts, then unpivoted."""
    # The hours that are not ON are a group as well: it keeps the key and falls in no bin.
    runs = with_labels(df, keys, target).groupBy(*keys, "episode").agg(F.count("episode").alias("length_hours"))
    n = F.col("length_hours")
    bins = [F.struct(F.lit(i).alias("bin"), F.lit(label).alias("label"),
        F.count_if((n >= a) & ((n < edges[i + 1]) if i + 1 < len(edges) else F.lit(True))).alias("n")) for i,
        (a, label) in enumerate(zip(edges, bin_labels(edges)))]
    counted = runs.groupBy(*keys).agg(F.array(*bins).alias("b"))
    return counted.select(*keys, F.explode("b").alias("b")).select(*keys, "b.*")


def onset(keys: list[str], target: str = "irrigation_event", shift: int = 1) -> Column:
    """1 if ON now and OFF ``shift`` hours ago, NULL if either is unknown."""
    now, then = F.col(target), F.lag(target, shift).over(by_time(keys))
    return F.when(now.isNull() | then.isNull(), None).otherwise(((now == 1) & (then == 0)).cast("int"))


def dominance(labels: DataFrame, group: list[str], episode: str = "episode") -> DataFrame:
    """Largest share of one episode among a group's ON hours; NULL without any."""
    sizes = labels.groupBy(*group, episode).agg(F.count(episode).alias("_n"))
    out = sizes.groupBy(*group).agg(F.max("_n").alias("_m"), F.sum("_n").alias("_s"),
        F.count_if(F.col(episode).isNotNull()).alias("n_episodes"))
    return out.select(*group, F.when(F.col("_s") > 0, F.col("_m") / F.col("_s")).alias("dominance"),
        F.col("_m").alias("largest_episode"), "n_episodes")
