"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

1. A document's size is its number of words. Targets share ``share`` of all words by
   weight, capped at ``cap`` times the source's own words; the excess is reshared. That
   water level is found in closed form: with sources sorted by cap/weight, the first one
   whose cap lies above the level of the rest fixes it.
2. Words are dealt in blocks of equal size, ``BLOCKS`` of them over the whole corpus (at
   most ``MAX_BLOCK`` words each). Highest quotients ``v / (2 s + 1)`` give each source an
   integer number of blocks, and then each of its shards. Only quotients next to the
   rounded share can win or lose a seat, so a party lists a few of them, not all. A source
   whose target is under ``LEAST`` such blocks is dealt in smaller blocks of its own, so
   that rounding costs it no more than 1 / (2 * LEAST) of its target, or half a word.
3. A shard holds about ``SHARD_BLOCKS`` blocks of documents in seeded order. Its quota of q
   over its b blocks is q div b whole passes and q mod b more blocks, chosen by seeded hash.
   A document's ``taken`` is its overlap with the chosen blocks, so at most ``cap`` times
   its size.

Shards are balanced by a hash of the document, so a source with a third of all rows is many
window groups. Seats go to groups of ``GROUP`` shards first and then to the shards of each group, so
no task ranks more than that many shards, or a source's groups (one row for some 10**9 words).
Only the sources meet in one task, one row each.

Edge cases: a null text has size 0 and is taken 0 times; a null source is a source of its
own, sorted last; a repeated row (equal doc_id) is a document of its own; a null doc_id is
kept; an empty table gives an empty result; other columns are ignored: a row of
the result has the document's id and source and the figures named in ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

WEIGHTS = (3, 1, 2)
SHARE, CAP, SEED = 1.5, 2, 17
BLOCKS, MAX_BLOCK, SHARD_BLOCKS, LEAST, GROUP = 1 << 16, 4096, 256, 256, 1024


def word_count(text: Column) -> Column:
    """Number of runs of anything but x20 and x09-x0D; a null text has none."""
    parts = F.split(text, "[\\x20\\x09-\\x0D]+")
    edge = F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0) + F.when(text.rlike("[\\x20\\x09-\\x0D]\\z"),
        1).otherwise(0)
    return F.when(text.isNull() | ~text.rlike("[^\\x20\\x09-\\x0D]"), 0).otherwise(F.size(parts) - edge).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
    cap: float = CAP) -> DataFrame:
    """Adds ``_sid`` (place), ``weight`` and ``target`` to one row a source (``source``, ``source_size``)."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sources.withColumn("_sid", place).withColumn("weight",
        F.element_at(w, F.pmod(F.col("_sid") - 1, F.lit(len(weights))).cast("int") + 1))
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.sum("source_size").over(every) * F.lit(float(share))
    level = (whole - F.lit(float(cap)) * F.coalesce(F.sum("source_size").over(before),
        F.lit(0))) / F.sum("weight").over(rest)
    own = F.lit(float(cap)) * F.col("source_size")
    fits = F.when(level * F.col("weight") <= own, level)
    return (
        ranked.withColumn("_fits", fits)
        .withColumn("_level", F.first("_fits", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding,
            Window.unboundedFollowing)))
        .withColumn("target", F.coalesce(F.least(own, F.col("_level") * F.col("weight")), own))
        .drop("_fits", "_level")
    )


def apportion(parties: DataFrame, keys: list[str], party: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Lague seats (``quota``) of each party within ``keys``; equal ``seats`` in a key's rows.

    Rounding votes/divisor gives the right seats up to a surplus or lack of d in total. Adding
    (or taking) d seats by highest (or lowest) quotient can touch at most d quotients of a party,
    so only those next to its rounded share are ranked.
    """
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    share = F.when(F.sum(votes).over(group) > 0, F.col(votes) * F.col(seats) / F.sum(votes).over(group)).otherwise(0.0)
    base = parties.withColumn("_base", F.round(share).cast("long")).withColumn("_lack",
        (F.col(seats) - F.sum("_base").over(group)).cast("long"))
    near = F.when(F.col("_lack") > 0, F.sequence(F.lit(1).cast("long"), F.col("_lack"))).when(
        F.col("_lack") < 0, F.sequence(F.lit(0).cast("long"), F.col("_lack") + 1)
    )
    # Seat number _base + k for k >= 1 may be won; seat _base + k for k <= 0 may be lost.
    seat = base.filter(F.col("_lack") != 0).withColumn("_k", F.explode(near)).withColumn("_seat",
        F.col("_base") + F.col("_k")).filter("_seat >= 1")
    quotient = F.col(votes) / (2 * F.col("_seat") - 1)
    rank = F.row_number().over(group.orderBy(F.when(F.col("_lack") > 0, -quotient).otherwise(quotient),
        *[F.col(p).asc_nulls_last() for p in party]))
    moved = (
        seat.withColumn("_rank", rank)
        .filter(F.col("_rank") <= F.abs("_lack"))
        .groupBy(*keys, *[p for p in party if p not in keys])
        .agg(F.sum(F.signum("_lack")).cast("long").alias("_moved"))
    )
    on = list(dict.fromkeys([*keys, *party]))
    return base.join(moved, on, "left").select(*parties.columns,
        (F.col("_base") + F.coalesce("_moved", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP,
    seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: one row a document."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_h"))
    sized = checkpointed(sized)
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    total = sized.agg(F.sum("size")).first()[0] or 0
    block = min(MAX_BLOCK, max(1, total // BLOCKS))
    sources = sources.withColumn("_seats", F.lit(round(total * share / block)))
    sources = apportion(sources, [], ["_sid"], "target", "_seats").drop("_seats").withColumnRenamed("quota", "_seats")
    sources = sources.withColumn("_block", F.least(F.lit(block),
        F.greatest(F.lit(1), F.floor(F.col("target") / LEAST))).cast("long"))
    sources = sources.withColumn("_seats", F.when(F.col("_block") < block,
        F.round(F.col("target") / F.col("_block")).cast("long")).otherwise(F.col("_seats")))
    sources = checkpointed(sources.withColumn("_shards",
        F.ceil(F.greatest("source_size", F.lit(1)) / (block * SHARD_BLOCKS)).cast("int")))
    # One row a source: a few bytes for each of some dozens of sources; a corpus with very many is joined by shuffle.
    named = sources.withColumnRenamed("source", "_source")
    few = F.broadcast(named) if named.count() <= 10_000 else named
    dealt = sized.join(few, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_shard", F.pmod("_h", "_shards"))
    order = Window.partitionBy("_sid", "_shard").orderBy("_h", "doc_id")
    placed = dealt.withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding,
        0))).withColumn("_start", F.col("_end") - F.col("size"))
    placed = checkpointed(placed.withColumn("_row", F.monotonically_increasing_id()))
    shard = ["_sid", "_shard"]
    shards = placed.groupBy(*shard).agg(F.sum("size").alias("_words"), F.first("_seats").alias("_seats"),
        F.first("_block").alias("_block"))
    group = ["_sid", "_group"]
    shards = shards.withColumn("_group", F.floor(F.col("_shard") / GROUP))
    groups = shards.groupBy(*group).agg(F.sum("_words").alias("_words"), F.first("_seats").alias("_seats"))
    groups = apportion(groups, ["_sid"], group, "_words", "_seats").select(*group, F.col("quota").alias("_seats"))
    shards = apportion(shards.drop("_seats").join(groups, group), group, [*group, "_shard"], "_words", "_seats")
    # A shard's b blocks share its words evenly: block k begins at floor(k * words / b).
    shards = checkpointed(
        shards.withColumn("_b", F.greatest(F.lit(1), F.round(F.col("_words")
            / F.col("_block"))).cast("long")).withColumn("_q", F.least("quota", cap * F.col("_b")))
    )
    blocks = shards.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    lot = F.xxhash64(F.lit(seed), *shard, "_k")
    edge = lambda k: F.expr(f"({k}) * _words div _b")
    chosen = blocks.withColumn("_lot", F.row_number().over(Window.partitionBy(*shard).orderBy(lot, "_k"))).select(
        *shard, "_k", edge("_k").alias("_from"), edge("_k + 1").alias("_to"),
        (F.expr("_q div _b") + F.when(F.col("_lot") <= F.pmod("_q", "_b"), 1).otherwise(0)).alias("_times"),
    )
    # The block of a word may be one off where the division rounds; the overlap below is exact.
    at = lambda x: F.expr(f"{x} * _b div greatest(_words, 1)")
    touched = F.sequence(F.greatest(at("_start") - 1, F.lit(0)), F.least(at("_end") + 1, F.col("_b") - 1))
    parts = placed.join(shards.select(*shard, "_words", "_b"), shard).withColumn("_k", F.explode(touched))
    over = F.greatest(F.least("_end", "_to") - F.greatest("_start", "_from"), F.lit(0)) * F.col("_times")
    document = ["doc_id", "source", "size", "source_size", "target", "_row"]
    return (
        parts.join(chosen, [*shard, "_k"])
        .groupBy(*document)
        .agg(F.sum(over).cast("long").alias("taken"))
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )
