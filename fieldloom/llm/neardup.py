"""Near-duplicates: SuperMinHash signatures, banding, exact verification, connected components.

1. A document is the set of its distinct 5-word shingles. Documents with equal sets form a
   class, so a group of copies is one node however large it is.
2. SuperMinHash draws a correlated permutation rank for each element: in step j an element
   puts ``j + r`` at one more position of its own permutation. All elements of a chunk take
   step j at once, and a document stops as soon as its whole signature is below j + 1.
3. ``BANDS`` bands of ``ROWS`` values are bucket keys. At a similarity of 0.75 two documents
   share no bucket with probability (1 - 0.75**4)**32 = 5e-6.
4. In each bucket every member is verified on full sets against the bucket's smallest id;
   components follow. That settles groups of near copies with one pair a member.
5. What is left is exact too: in a bucket that still spans several components, members
   outside its largest component are compared with all members of other components, in
   blocks of at most about ``BLOCK`` by ``BLOCK`` sets. A block counts intersections with a
   matrix product and hands on one link for each document and component, never its pairs.

No bucket, group or partner count is capped, and no link or component meets the driver.

A class of equal sets is a node with a number of its own; ids only name the result. So rows that
share a doc_id but not the text are documents of their own.

Edge cases: a null, empty or blank text has an empty set and is its own component; a component is
named by the smallest doc_id of its rows (null if none has one); a null doc_id links others like
any row; equal rows are copies of each other, and ``drop_near_duplicates`` keeps exactly one row of a
component (the smallest doc_id, nulls last; then by a hash of the text) and every row with an empty
set; an empty table gives an empty result; other columns, whatever their names, are ignored by
``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed

SIZE, ROWS, BANDS = 128, 4, 32
SHINGLE, SIMILARITY = 5, 75
#: A block compares at most about so many sets, of so many shingles in all, with as many others.
BLOCK, BLOCK_SHINGLES = 1000, 400_000
#: Keys (24 bytes) that may be broadcast; beyond that the join shuffles.
BROADCAST_KEYS = 1_000_000
#: Two hashes of a text stand for it.
TEXT = ["t1", "t2"]


def _draw(values: np.ndarray, j: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank j + r as (j, 24 bits of r), and the place in [j, m) that step j swaps to j."""
    u = K.mix64(values + np.uint64((j + 1) * int(K.GOLDEN) % (1 << 64)))
    rank = (u >> np.uint64(40)).astype(np.uint32) | np.uint32(j << 24)
    return rank, j + ((u & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)


def superminhash(values: np.ndarray, rows: np.ndarray, n: int, m: int = SIZE) -> np.ndarray:
    """Signatures (n, m) of row-sorted sets of 64-bit values; rows without values stay at the maximum."""
    sig = np.full(n * m, 0xFFFFFFFF, np.uint32)
    swaps = []
    for j in (0, 1):
        rank, k = _draw(values, j, m)
        # After the swap of step 0 the place k0 holds 0 and every other place itself.
        place = k if j == 0 else np.where(k == swaps[0], 0, k)
        np.minimum.at(sig, rows * m + place, rank)
        swaps.append(k)
    open_rows = (sig.reshape(n, m) >> 24).max(axis=1) > 1
    active = open_rows[rows] if len(rows) else np.zeros(0, bool)
    values, rows, swaps = values[active], rows[active], [k[active] for k in swaps]
    p = np.tile(np.arange(m, dtype=np.uint8), (len(values), 1))
    at = np.arange(len(values))
    for j, k in enumerate(swaps):
        p[at, j], p[at, k] = p[at, k], p[at, j].copy()
    for j in range(2, m):
        if not len(values):
            break
        rank, k = _draw(values, j, m)
        place = p[at, k]
        p[at, k] = p[at, j]
        np.minimum.at(sig, rows * m + place, rank)
        done = (sig.reshape(n, m) >> 24).max(axis=1) <= j
        active = ~done[rows]
        if not active.all():
            values, rows, p = values[active], rows[active], p[active]
            at = np.arange(len(values))
    return sig.reshape(n, m)


def bands(sig: np.ndarray) -> np.ndarray:
    """Bucket keys (n, BANDS)."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.zeros((len(sig), BANDS), np.uint64)
    for j in range(ROWS):
        key = K.mix64(key * np.uint64(3) + s[:, :, j] + K.GOLDEN)
    return K.mix64(key + np.arange(BANDS, dtype=np.uint64)[None, :])


def _shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    value, row, _ = K.distinct_by_row(*K.shingles(*K.words(*K.text_bytes(column)), SHINGLE))
    return value, row


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.chunks(batches):
        n = batch.num_rows
        value, row = _shingle_sets(batch.column("text"))
        size = np.bincount(row, minlength=n)
        keys = []
        for salt in (1, 2):  # sums of hashed elements: the same for equal sets, in any order
            total = np.concatenate((np.zeros(1, np.uint64),
                np.cumsum(K.mix64(value + np.uint64(salt)), dtype=np.uint64)))
            ends = np.searchsorted(row, np.arange(n + 1))
            keys.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
        full = size > 0
        key = bands(superminhash(value, row, n)).view(np.int64)[full]
        offs = pa.array(np.concatenate(([0], np.cumsum(full * BANDS))).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, ("doc_id", *TEXT)), pa.array(size), pa.array(keys[0]), pa.array(keys[1]),
                pa.ListArray.from_arrays(offs, pa.array(key.ravel()))],
            names=["doc_id", *TEXT, "n_shingles", "k1", "k2", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.chunks(batches):
        value, row = _shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("node"),
            K.list_array(value.view(np.int64), row, batch.num_rows, pa.int64())], names=["id", "items"])


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id reachable.

    Each round takes the smallest label among neighbours and then the label's own label, so
    labels travel twice as far from round to round; a checkpoint ends each.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"),
        F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"),
        F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"),
            "b").groupBy("a").agg(F.min("component").alias("m")).withColumnRenamed("a", "id")
        step = labels.join(near, "id").select("id", F.col("component").alias("old"),
            F.least("component", "m").alias("to"))
        further = labels.select(F.col("id").alias("to"), F.col("component").alias("jump"))
        moved = checkpointed(step.join(further, "to", "left").select("id", "old",
            F.least("to", F.coalesce("jump", "to")).alias("component")))
        labels = moved.select("id", "component")
        if moved.filter("component < old").isEmpty():
            return labels


def _linked(a: str, b: str, common) -> object:
    return 100 * common >= SIMILARITY * (F.col(a) + F.col(b) - common)


def _compare(key, rows):
    """Links of one block: role 0 asks, role 1 answers; one link an asker and foreign component."""
    import pandas as pd

    ask, answer = rows[rows["role"] == 0], rows[rows["role"] == 1]
    none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    if not len(ask) or not len(answer):
        return none
    x, y = list(ask["items"]), list(answer["items"])
    nx, ny = np.array([len(v) for v in x]), np.array([len(v) for v in y])
    vx, vy = np.concatenate(x), np.concatenate(y)
    rx, ry = np.repeat(np.arange(len(x)), nx), np.repeat(np.arange(len(y)), ny)
    shared = np.intersect1d(vx, vy)
    common = np.zeros((len(x), len(y)), np.float32)
    ix, iy = np.searchsorted(shared, vx), np.searchsorted(shared, vy)
    okx = (ix < len(shared)) & (shared[np.minimum(ix, len(shared) - 1)] == vx) if len(shared) else np.zeros(len(vx),
        bool)
    oky = (iy < len(shared)) & (shared[np.minimum(iy, len(shared) - 1)] == vy) if len(shared) else np.zeros(len(vy),
        bool)
    for lo in range(0, len(shared), 2048):
        mx, my = np.zeros((len(x), 2048), np.float32), np.zeros((len(y), 2048), np.float32)
        for m, ok, i, r in ((mx, okx, ix, rx), (my, oky, iy, ry)):
            use = ok & (i >= lo) & (i < lo + 2048)
            m[r[use], i[use] - lo] = 1
        common += mx @ my.T
    cx, cy = ask["component"].to_numpy(), answer["component"].to_numpy()
    hit = (100 * common >= SIMILARITY * (nx[:, None] + ny[None, :] - common)) & (cx[:, None] != cy[None, :])
    i, j = np.nonzero(hit)
    links = pd.DataFrame({"a": cx[i], "b": cy[j]})
    return links.drop_duplicates()


def _text_hashes() -> list:
    return [F.xxhash64(F.lit(i), "text").alias(c) for i, c in enumerate(TEXT)]


def _small(df: DataFrame) -> DataFrame:
    """A counted table: broadcast if small, else joined by shuffle."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _star_links(crowded: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between each member and the first one of its buckets."""
    sizes = crowded.select(F.col("id").alias("first"), F.col("n").alias("n_first")).distinct()
    pairs = crowded.filter("id > first").select("first", "id", "n").distinct().join(sizes, "first")
    alike = (100 * F.col("n") >= SIMILARITY * F.col("n_first")) & (100 * F.col("n_first") >= SIMILARITY * F.col("n"))
    x, y = sets.withColumnRenamed("items", "x"), sets.select(F.col("id").alias("first"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.filter(alike).join(x, "id").join(y, "first").filter(_linked("n", "n_first",
        common)).select(F.col("first").alias("a"), F.col("id").alias("b"))


def _block_links(crowded: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the components that buckets still span. One of two members is settled, and
    buckets with the same members need one look."""
    placed = checkpointed(crowded.join(found, "id", "left").select("bucket", "id", "n",
        F.coalesce("component", "id").alias("component")))
    who = F.sum(F.xxhash64("id").cast("decimal(20,0)"))
    spread = (
        placed.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"),
            who.alias("who"))
        .filter((F.col("lo") < F.col("hi")) & (F.col("m") > 2))
        .groupBy("m", "who").agg(F.min("bucket").alias("bucket"))
    )
    inside = checkpointed(placed.join(checkpointed(spread.select("bucket")), "bucket"))
    parts = inside.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    main = parts.groupBy("bucket").agg(
        F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("_all"),
            F.max("c").alias("_most"), F.sum("w").alias("_work"),
            F.max_by("w", F.struct("c", "component")).alias("_main_work")
    )
    inside = inside.join(checkpointed(main), "bucket").join(sets, "id")
    blocks = lambda count, work: F.greatest(F.lit(1), F.ceil(count / F.lit(float(BLOCK))),
        F.ceil(work / F.lit(float(BLOCK_SHINGLES)))).cast("int")
    across, down = blocks(F.col("_all"), F.col("_work")), blocks(F.col("_all") - F.col("_most"),
        F.col("_work") - F.col("_main_work"))
    one = lambda n: F.array(F.pmod(F.xxhash64("id"), n).cast("int"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    asks = inside.filter("component != main").select("bucket", "id", "component", "items", F.lit(0).alias("role"),
        one(down).alias("r"), every(across).alias("c"))
    answers = inside.select("bucket", "id", "component", "items", F.lit(1).alias("role"), every(down).alias("r"),
        one(across).alias("c"))
    dealt = asks.union(answers).withColumn("r", F.explode("r")).withColumn("c", F.explode("c"))
    return dealt.groupBy("bucket", "r", "c").applyInPandas(_compare, "a long, b long").distinct()


def _placed(docs: DataFrame) -> DataFrame:
    """One row a row of ``docs``: doc_id, t1, t2, n_shingles, component_id and the key ``first`` of the row that stands for its component."""
    texts = docs.select("doc_id", *_text_hashes(), "text")
    sig = checkpointed(texts.mapInArrow(_signatures,
        "doc_id long, t1 long, t2 long, n_shingles long, k1 long, k2 long, bands array<long>"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *TEXT)
    classes = sig.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min(key).alias("first"),
        F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = checkpointed(classes.withColumn("id", F.monotonically_increasing_id()))
    buckets = classes.select("id", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("id").alias("first"),
        F.max("id").alias("last")).filter(F.col("first") < F.col("last"))
    # Cut here, the join below meets two plain shuffles, and adaptive execution splits a crowded bucket.
    crowded = checkpointed(buckets.join(checkpointed(shared.select("bucket", "first")), "bucket").select("bucket", "id",
        "n", "first"))
    members = crowded.select("id").distinct().join(classes.select("id", "first.t1", "first.t2"),
        "id").select(F.col("id").alias("node"), *TEXT)
    sets = texts.join(_small(members), TEXT).select("node", "text").mapInArrow(_sets, "id long, items array<long>")
    sets = checkpointed(sets.dropDuplicates(["id"]))
    found = components(checkpointed(_star_links(crowded, sets)))
    joined = components(_block_links(crowded, found, sets)).select(F.col("id").alias("component"),
        F.col("component").alias("final"))
    found = found.join(joined, "component", "left").select("id",
        F.coalesce("final", "component").alias("component")).union(
        joined.join(found, joined["component"] == found["id"], "left_anti").select(F.col("component").alias("id"),
            F.col("final").alias("component"))
    )
    named = checkpointed(classes.join(found, "id", "left").select("k1", "k2", "first",
        F.coalesce("component", "id").alias("component")))
    names = named.groupBy("component").agg(F.min("first").alias("first"))
    by_class = named.select("k1", "k2", "component").join(names, "component").drop("component")
    out = sig.drop("bands").join(by_class, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", *TEXT, "n_shingles", component.alias("component_id"), "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a row of ``docs``."""
    return _placed(docs).select("doc_id", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component, and those without words; all columns stay."""
    placed = _placed(docs).filter("n_shingles > 0")
    key = ["doc_id", *TEXT]
    stands = F.lit(True)
    for c in key:
        stands = stands & F.col(c).eqNullSafe(F.col(f"first.{c}"))
    rows = checkpointed(placed.groupBy(*key).agg(F.first(stands).alias("stands"), F.count(F.lit(1)).alias("times")))
    own = K.fresh_names(docs.columns, *TEXT)
    hashed = docs.select("*", *[c.alias(n) for c, n in zip(_text_hashes(), own)])

    def meets(other: DataFrame, how: str) -> DataFrame:
        other = _small(other.select(*[F.col(c).alias(f"_other_{i}") for i, c in enumerate(key)]))
        same = F.lit(True)
        for i, c in enumerate(["doc_id", *own]):
            same = same & hashed[c].eqNullSafe(other[f"_other_{i}"])
        return hashed.join(other, same, how)

    once = meets(rows.filter("not stands or times > 1"), "left_anti")
    repeated = meets(rows.filter("stands and times > 1"), "left_semi").dropDuplicates(["doc_id", *own])
    return once.union(repeated).select(*docs.columns)


#: The same components from all shared shingles, without signatures.
ORACLE_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[p:p+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1,
  greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
ln AS (SELECT x, y FROM pr JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
bo AS (SELECT x, y FROM ln UNION ALL SELECT y, x FROM ln),
re AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT re.id, bo.y FROM re JOIN bo ON re.r = bo.x),
co AS (SELECT id, min(r) AS component_id FROM re GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT
  JOIN n USING (doc_id) JOIN co ON co.id = d.doc_id
"""
