"""Benchmark decontamination with SimHash windows (DataFrame operations only).

1. Anchors: every 5-word shingle of every document is looked up among the items' shingles.
   A window whose shingle similarity to an item is 0.75 or more shares shingles with it, and a
   document whose shingles cover less than 0.75 of an item's weight holds no such window.
2. Windows of the item's size stand for all windows of that size: moving a window right to its
   first shingle that the item has loses none of them, so some window that begins at such a
   shingle is at least as similar, wherever the item's parts stand. Windows with too few met
   shingles for the similarity are left out. Nothing that could match is.
3. Fingerprints: the SimHash of a window's shingles has ``LANES`` * ``LANE`` = 63 bits, each the
   majority of that bit in the shingles' hashes. Items' fingerprints are cut into ``RADIUS`` + 1
   blocks; two fingerprints within ``RADIUS`` bits agree in one block at least, so the index of
   (item, block, bits) finds all windows within the radius. The anchor's item is part of the key,
   which keeps blocks of two or three bits selective. At a similarity of 0.75 the distance is
   8 to 11 on average with a deviation of 3.0 (6 to 200 shingles); in 520,000 trials it was 25 at
   most, so a radius of 28 loses nothing that verification would accept.
4. Verification: weighted-shingle (multiset) similarity of window and item, exactly,
   ``100 * common >= 75 * all``, where ``all`` is the size of the multiset union.

A word is a run of anything but x20 and x09-x0D, in lower case. An item of fewer than five
words is one shingle of all its words.

Edge cases: null or blank texts and items match nothing; equal items are all reported; a row
that repeats another's id and text adds nothing; rows that share an id but not the text are
searched apart and reported together; a null doc_id is reported as null and its row
is never dropped; an item of 2**20 shingles or more skips the fingerprint and is verified
right away; empty tables give an empty result; other columns are ignored by ``contaminated`` and
kept by ``decontaminate``. Of equally similar windows the last one is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

SHINGLE, SIMILARITY = 5, 75
#: Rows of an item or id table that may be broadcast (at most 64 bytes each).
BROADCAST_ROWS = 250_000
#: A long counts three bits of all shingles at a time, in lanes of 21 bits.
LANES, LANE, RADIUS = 3, 21, 28
#: Two hashes name a row by its id and text; 64 bits would collide among 10**10 rows.
ROW = ["row", "row2"]


def _words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingles(hashes: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array column of word hashes, in order."""
    at = lambda x, i: F.xxhash64(x, *[F.get(F.col(hashes), i + j) for j in range(1, k)])
    n = F.size(hashes)
    return F.when(n >= k, F.slice(F.transform(F.col(hashes), at), F.lit(1), n - (k - 1)))


def _majority(totals: Column, shift: int, one: int, n: Column) -> Column:
    return F.transform(totals, lambda t: (2 * F.shiftrightunsigned(t, shift).bitwiseAND(F.lit(one)) > n).cast("long"))


def fingerprint(s: str) -> Column:
    """SimHash of an array column of shingle hashes: bit j is set if more than half of them have it."""
    every, one = sum(1 << (LANE * i) for i in range(LANES)), (1 << LANE) - 1

    def total(j: int) -> Column:
        """How many hashes have the bits j, j + LANE and so on, a lane each."""
        return F.aggregate(F.col(s), F.lit(0).cast("long"), lambda a,
            x: a + F.shiftrightunsigned(x, j).bitwiseAND(F.lit(every)))

    totals = F.array(*[total(j) for j in range(LANE)])
    # The totals are worked out once: they are the argument of a lambda.
    bits = F.element_at(F.transform(F.array(totals), lambda ts: F.concat(*[_majority(ts, LANE * i, one,
        F.size(s)) for i in range(LANES)])), 1)
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def block_masks(radius: int = RADIUS, bits: int = LANES * LANE) -> list[int]:
    """``radius`` + 1 masks of as many bits each as fit; together they cover all bits."""
    cuts = [bits * i // (radius + 1) for i in range(radius + 2)]
    return [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]


def _blocks(fp: str) -> Column:
    """(block, its bits) of a fingerprint column, one entry a block."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.col(fp).bitwiseAND(F.lit(m)).alias("bits")) for i,
        m in enumerate(block_masks())])


def within_radius(windows: DataFrame, items: DataFrame) -> DataFrame:
    """The windows (item_id, fp) whose fingerprint is within ``RADIUS`` of the item's (item_id, fp), by the multi-index."""
    index = items.select("item_id", F.col("fp").alias("_fp"), F.explode(_blocks("fp")).alias("_b")).select("item_id",
        "_fp", "_b.*")
    probes = windows.select("*", F.explode(_blocks("fp")).alias("_b")).select(*windows.columns, "_b.*")
    differ = F.col("fp").bitwiseXOR(F.col("_fp"))
    # A pair meets in every block where it agrees; the first of them stands for all.
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(block_masks())])
    met = probes.join(_small(index), ["item_id", "block",
        "bits"]).filter((F.col("block") == first) & (F.bit_count(differ) <= RADIUS))
    return met.select(*windows.columns)


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has been counted to be small, else joined by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each document for each item it holds."""
    items = items.select("item_id", _hashes(_words(F.col("text"))).alias("h")).filter("h is not null").distinct()
    items = items.withColumn("n", F.size("h")).withColumn("k", F.least("n", F.lit(SHINGLE)))
    items = items.withColumn("s", F.coalesce(*[F.when(F.col("k") == k, _shingles("h", k)) for k in range(1,
        SHINGLE + 1)]))
    items = checkpointed(items.withColumn("weight", F.size("s")).withColumn("fp", fingerprint("s")).drop("h"))
    lengths = sorted(r["k"] for r in items.select("k").distinct().collect())  # at most five
    parts = checkpointed(items.select("item_id", "n", "k", "weight", F.posexplode("s").alias("offset", "shingle")))
    hits = None
    names = [F.xxhash64(F.lit(i), "doc_id", "text").alias(c) for i, c in enumerate(ROW)]
    hashed = docs.select("doc_id", *names, _hashes(_words(F.col("text"))).alias("h")).filter("h is not null")
    for k in lengths:
        places = hashed.select("doc_id", *ROW, F.size("h").alias("words"),
            F.posexplode(_shingles("h", k)).alias("at", "shingle"))
        met = places.join(_small(parts.filter(F.col("k") == k).drop("k")), "shingle").select("doc_id", *ROW, "words",
            "item_id", "n", "weight", "at", "offset")
        hits = met if hits is None else hits.union(met)
    if hits is None:
        none = [F.lit(0).cast("long").alias("item_id"), F.lit(0).alias("start_word"), F.lit(0).alias("n_words"),
            F.lit(0.0).alias("similarity")]
        return docs.limit(0).select("doc_id", *none)
    hits = checkpointed(hits)
    pair = ["doc_id", *ROW, "words", "item_id", "n", "weight"]
    met = hits.groupBy(*pair).agg(F.array_sort(F.collect_set("at")).alias("met"),
        F.size(F.collect_set("offset")).alias("covered"))
    met = met.filter(100 * F.col("covered") >= SIMILARITY * F.col("weight")).select("*",
        F.posexplode("met").alias("i", "start"))
    # A window of v shingles and an item of weight w need 0.75 / 1.75 * (v + w) in common.
    v = F.least("weight", F.col("words") - (F.col("n") - F.col("weight")) - F.col("start"))
    last = F.get("met", F.col("i") + F.ceil((v + F.col("weight")) * SIMILARITY / (100 + SIMILARITY)).cast("int") - 1)
    windows = checkpointed(met.filter(last < F.col("start") + F.col("weight")).select("doc_id", *ROW, "item_id", "n",
        "start"))
    rows = _small(checkpointed(windows.select(*ROW).distinct()))
    texts = hashed.select(*ROW, "h").join(rows, ROW, "left_semi").dropDuplicates(ROW)
    windows = windows.join(texts, ROW).select("doc_id", "item_id", "n", "start",
        F.slice("h", F.col("start") + 1, F.col("n")).alias("h"))
    windows = windows.join(_small(items.select("item_id", "k")), "item_id")
    windows = windows.withColumn("w", F.coalesce(*[F.when(F.col("k") == k,
        _shingles("h", k)) for k in lengths])).filter("w is not null").drop("h", "k")
    huge = F.col("weight") >= (1 << (LANE - 1))
    found = within_radius(windows.withColumn("fp", fingerprint("w")),
        items.filter(~huge).select("item_id", "fp")).drop("fp")
    found = found.union(windows.join(_small(items.filter(huge).select("item_id")), "item_id",
        "left_semi").select(*found.columns))
    pairs = found.join(_small(items.select("item_id", "s", "weight")), "item_id")
    times = lambda a, x: F.size(F.filter(F.col(a), lambda y: y == x))
    common = F.aggregate(F.array_distinct("w"), F.lit(0), lambda c, x: c + F.least(times("w", x), times("s", x)))
    # Sets meet by hash; only a shingle that stands twice needs counts.
    single = (F.size(F.array_distinct("w")) == F.size("w")) | (F.size(F.array_distinct("s")) == F.col("weight"))
    common = F.when(single, F.size(F.array_intersect("w", "s"))).otherwise(common)
    pairs = pairs.withColumn("common", common).withColumn("all", F.size("w") + F.col("weight") - F.col("common"))
    pairs = pairs.filter(100 * F.col("common") >= SIMILARITY * F.col("all"))
    best = F.max(F.struct((F.col("common") / F.col("all")).alias("s"), "start", "n")).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", F.col("best.start").cast("int").alias("start_word"), F.col("best.n").alias("n_words"),
            F.round("best.s", 6).alias("similarity")
    )


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all columns."""
    gone = checkpointed(contaminated(docs, items).select("doc_id").filter("doc_id is not null").distinct())
    return docs.join(_small(gone), "doc_id", "left_anti").select(*docs.columns)


#: The same result from all windows of every item's size, without fingerprints: documents that cover less than
#: 0.75 of an item's shingles hold no such window, so their windows need not be listed.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'),
  lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, len(w) AS m, p AS pos, array_to_string(w[p:p+4], ' ') AS s FROM (SELECT doc_id, w,
  unnest(range(1, len(w) - 3)) AS p FROM d)),
its AS (SELECT item_id, n, p AS off, array_to_string(w[p:p+4], ' ') AS s FROM (SELECT item_id, w, len(w) AS n,
  unnest(range(1, len(w) - 3)) AS p FROM i)),
cov AS (SELECT doc_id, item_id, n, any_value(m) AS m FROM ds JOIN its USING (s) GROUP BY doc_id, item_id,
  n HAVING 100 * count(DISTINCT off) >= 75 * (n - 4)),
win AS (SELECT doc_id, item_id, n, unnest(range(0, m - 4)) AS start FROM cov),
ws AS (SELECT doc_id, item_id, win.n, start, s, count(*) AS c FROM win JOIN ds USING (doc_id)
  WHERE pos > start AND pos + 4 <= start + win.n GROUP BY ALL),
isc AS (SELECT item_id, s, count(*) AS c FROM its GROUP BY ALL),
sim AS (SELECT doc_id, item_id, n, start, sum(least(ws.c, coalesce(isc.c, 0))) AS common, sum(ws.c) AS t FROM ws LEFT
  JOIN isc USING (item_id, s) GROUP BY ALL)
SELECT doc_id, item_id, CAST(start AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_words,
  round(CAST(common / (t + n - 4 - common) AS DOUBLE), 6) AS similarity
FROM sim WHERE 100 * common >= 75 * (t + n - 4 - common)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / (t + n - 4 - common) DESC, start DESC) = 1
"""
