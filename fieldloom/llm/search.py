"""Ranked lexical search over a length-stratified index.

1. *Statistics.* One pass over all texts counts each document's terms with repeats and keeps, as
   one row a document, the terms that the queries hold with their frequencies (a few numbers; texts
   are not kept). The same rows give N, L and every term's document frequency.
2. *Index.* Rows are range-sorted by the normaliser m, so equal m stand together; a stratum is up
   to ``STRATUM`` documents of equal m. A hot m spreads over tasks, as ties are cut anywhere.
   Inside a stratum the postings of a term are sorted by tf, and an impact
   ``(10**9 tf) div (1000 tf + 20 m)`` is worked out once for each tf of the stratum.
3. *Search.* A term's best impact in a stratum times its weight bounds what it can add there, and
   the sum over a query's terms bounds every document of the stratum. Each task visits its strata
   by falling bound, keeps the best ``k`` of each query, and skips a stratum for the queries whose
   k-th score lies above its bound (an equal bound is visited, since a lower doc_id may win).
   The best k of each task meet in one ranking.

The result is exact: bounds are true bounds, and nothing is sampled or capped. Weights travel to
the tasks as one number for each distinct query term; a query set with more than ``TERMS`` of them
is answered in several passes of whole queries, so what is broadcast is bounded. A task holds
``SEGMENT`` postings at most (or one stratum), and nothing but the k best of its documents leaves it.

Edge cases: a null text has no term, is not counted in N and never ranks; a document without
a query term scores 0 and never ranks; a null or blank query gives no row; a query that is listed
twice is answered twice; a repeated document is a document of its own, so equal (score, doc_id)
rows get successive ranks; a null doc_id ranks after the others of its score; an empty table gives
an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpointed
from .kernels import chunks, text_bytes

K, STRATUM, SEGMENT, TERMS = 50, 512, 4_000_000, 1_000_000
#: Fixed values of the ranking: scale and saturation of tf, scale of the weight, share of the length.
SCALE, TF, LENGTH, WEIGHT, SHARE = 1_000_000_000, 1000, 20, 1000, 50
#: Bytes of terms (letters and digits of ASCII with A-Z lowered, and all of other scripts); the rest separates.
TERM = np.full(256, 0x20, np.uint8)
TERM[0x30:0x3A] = np.arange(0x30, 0x3A)
TERM[0x41:0x5B] = np.arange(0x61, 0x7B)
TERM[0x61:0x7B] = np.arange(0x61, 0x7B)
TERM[0x80:] = np.arange(0x80, 0x100)

ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS u, doc_id,
         regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT u, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
p AS (SELECT u, term, count(*) AS tf FROM t GROUP BY u, term),
sizes AS (SELECT u, doc_id, CAST(len(words) AS BIGINT) AS n FROM d WHERE len(words) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM sizes),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM p CROSS JOIN s GROUP BY term, nn),
q AS (
  SELECT DISTINCT i, item_id, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT row_number() OVER () AS i, item_id,
               regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM benchmark)),
scored AS (
  SELECT i, item_id, u, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN sizes USING (u) CROSS JOIN s GROUP BY i, item_id, u, doc_id),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST, u) AS INTEGER) AS rank,
         doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


def split_terms(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All terms of a chunk, as a dictionary, and each row's place among them."""
    raw, offs = text_bytes(column)
    if not len(column):
        return pa.array([], pa.large_string()).dictionary_encode(), np.zeros(1, np.int64)
    # Bytes are replaced one for one, so the row offsets stay.
    texts = pa.Array.from_buffers(pa.large_string(), len(column),
                                  [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(TERM[raw])])
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten()
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate(([0], np.cumsum(filled)))
    return flat.filter(pa.array(filled)).dictionary_encode(), before[np.asarray(parts.offsets)]


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, ``_i`` (a number of its own for each row) and the distinct terms of its text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            terms, bounds = split_terms(batch.column(2))
            words, at = terms.dictionary.to_pylist(), np.asarray(terms.indices)
            lists = [sorted({words[j] for j in at[bounds[r] : bounds[r + 1]]}) for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                pa.array(lists, pa.list_(pa.string()))], ["_i", "item_id", "terms"])

    kind = items.schema["item_id"].dataType.simpleString()
    return (items.select(F.monotonically_increasing_id().alias("_i"), "item_id", "text")
            .mapInArrow(split, f"_i long, item_id {kind}, terms array<string>").filter("size(terms) > 0"))


def documents_of_terms(docs: DataFrame, words: list[str]) -> DataFrame:
    """One row a document that has terms: doc_id, ``n`` terms with repeats, and those of ``words`` by place with tf."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(known.value, pa.large_string())
        for batch in chunks(batches, limit=4 << 20):
            terms, bounds = split_terms(batch.column(1))
            place = np.asarray(pc.index_in(terms.dictionary, wanted).fill_null(-1), np.int64)
            at = place[np.asarray(terms.indices)] if len(terms) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            hit = at >= 0
            pair, tf = np.unique(row[hit] * len(wanted) + at[hit], return_counts=True)
            ends = np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(wanted)).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32()))
            n = np.diff(bounds)
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists(pair % max(len(wanted), 1)),
                lists(tf)], ["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    known = docs.sparkSession.sparkContext.broadcast(words)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


class Stratum:
    """Documents of equal m with their postings, by term, then tf."""

    def __init__(self, m: int, docs: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        order = np.lexsort((tf, term))
        self.docs, self.doc, term, tf = docs, doc[order], term[order], tf[order]
        steps, at = np.unique(tf, return_inverse=True)
        impact = (SCALE * steps) // (TF * steps + LENGTH * m)
        self.adds = weights[term] * impact[at]
        new = np.concatenate(([True], term[1:] != term[:-1]))
        self.terms, self.row = term[new], np.cumsum(new) - 1
        # The last posting of a term has its highest tf, so its best impact.
        self.best = self.adds[np.append(np.flatnonzero(new)[1:], len(term)) - 1]

    def bounds(self, terms: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """The most that any document here can score, for each query."""
        most = np.zeros(size, np.int64)
        most[self.terms] = np.maximum(self.best, 0)
        return np.add.reduceat(most[terms], starts)

    def table(self) -> np.ndarray:
        """What each term (row) adds to each document (column)."""
        out = np.zeros((len(self.terms), len(self.docs)), np.int64)
        out[self.row, self.doc] = self.adds
        return out


def search(docs: DataFrame, items: DataFrame, k: int = K, terms_at_once: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the best ``k`` documents of every query."""
    queries = checkpointed(query_terms(items))
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, math.ceil(total / terms_at_once))
    found = [_pass(docs, queries.filter(F.pmod(F.xxhash64("_i"), F.lit(passes)) == i), k) for i in range(passes)]
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("_i").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return (best.withColumn("rank", rank).filter(F.col("rank") <= k)
            .join(queries.select("_i", "item_id"), "_i").select("item_id", "rank", "doc_id", "score"))


def _pass(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.select("_i", "terms").collect()
    words = sorted({t for r in rows for t in r["terms"]})
    place = {t: j for j, t in enumerate(words)}
    flat = np.array([place[t] for r in rows for t in r["terms"]], np.int64)
    starts = np.cumsum([0, *[len(r["terms"]) for r in rows]])[:-1]
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = checkpointed(documents_of_terms(docs, words))
    n, length = held.agg(F.count("*"), F.sum("n")).first()
    weights = np.zeros(len(words), np.int64)
    for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        weights[r["t"]] = math.floor(WEIGHT * math.log((2 * n + 2) / (2 * r["count"] + 1)))
    if not words or not n:
        return docs.sparkSession.createDataFrame([], f"_i long, doc_id {kind}, score long")
    sent = docs.sparkSession.sparkContext.broadcast((np.array([r["_i"] for r in rows]), flat, starts, weights))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, begins, weight = sent.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in names]
        kept: list[np.ndarray] = []  # doc_id as given, beside numbers that keep their order
        for segment in _segments(batches):
            best, kept = _visit(segment, best, kept, terms, begins, weight, k)
        ids = pa.concat_arrays([pa.array([], doc_type), *kept]) if kept else pa.array([], doc_type)
        where = np.concatenate([b[1] for b in best])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(b[0]) for b in best])), ids.take(pa.array(where)),
            pa.array(np.concatenate([b[0] for b in best]))], ["_i", "doc_id", "score"])

    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)
    m = F.expr(f"{100 - SHARE} + ({SHARE} * n * {n}L) div {length}L")
    # The sort of a range shuffle keeps equal m together; ties are cut by doc_id and by chance, so a hot m spreads.
    spread = F.xxhash64("doc_id", "terms", F.monotonically_increasing_id())
    indexed = held.filter("size(terms) > 0").select(m.alias("m"), "doc_id", "terms", "tfs", spread.alias("_s"))
    sorted_ = indexed.repartitionByRange("m", "_s").sortWithinPartitions("m").drop("_s")
    return sorted_.mapInArrow(visit, f"_i long, doc_id {kind}, score long")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in pieces of about ``SEGMENT`` postings."""
    held, size = [], 0
    for batch in batches:
        at = 0
        ends = np.cumsum(np.asarray(pc.list_value_length(batch.column(2))))
        while at < batch.num_rows:
            room = SEGMENT - size + (ends[at - 1] if at else 0)
            to = max(at + 1, int(np.searchsorted(ends, room, side="right")))
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - (ends[at - 1] if at else 0))
            at = to
            if size >= SEGMENT:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _visit(table: pa.Table, best: list, kept: list, terms: np.ndarray, begins: np.ndarray, weight: np.ndarray, k: int):
    """One segment's strata by falling bound; the best k of each query so far, as (scores, places in ``kept``)."""
    table = table.combine_chunks()
    ids = table.column("doc_id").combine_chunks()
    m = np.asarray(table.column("m"))
    lists, tfs = table.column("terms").combine_chunks(), table.column("tfs").combine_chunks()
    ends = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    term, tf = np.asarray(lists.flatten(), np.int64), np.asarray(tfs.flatten(), np.int64)
    seen = sum(len(x) for x in kept)
    cut = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
    cut = np.unique(np.concatenate([cut, *[np.arange(a, b, STRATUM) for a, b in zip(cut, np.append(cut[1:], len(m)),
        strict=True)]]))
    strata = []
    for a, b in zip(cut, np.append(cut[1:], len(m)), strict=True):
        lo, hi = ends[a], ends[b]
        doc = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
        strata.append(Stratum(int(m[a]), np.arange(a, b), doc, term[lo:hi], tf[lo:hi], weight))
    bounds = np.array([s.bounds(terms, begins, len(weight)) for s in strata])
    stops = np.append(begins[1:], len(terms))
    scores = [[b[0]] for b in best]
    places = [[b[1]] for b in best]
    least = np.array([b[0].min() if len(b[0]) >= k else 0 for b in best], np.int64)
    pending = [len(b[0]) for b in best]
    for s in np.argsort(-bounds.sum(axis=1), kind="stable"):
        stratum = strata[s]
        adds = None
        for q in np.flatnonzero((bounds[s] > 0) & (bounds[s] >= least)):
            if adds is None:
                adds = stratum.table()
                row_of = np.full(len(weight), -1)
                row_of[stratum.terms] = np.arange(len(stratum.terms))
            rows = row_of[terms[begins[q] : stops[q]]]
            score = adds[rows[rows >= 0]].sum(axis=0)
            good = np.flatnonzero((score > 0) & (score >= least[q]))
            if not len(good):
                continue
            scores[q].append(score[good])
            places[q].append(seen + stratum.docs[good])
            pending[q] += len(good)
            if pending[q] > 4 * k or (least[q] == 0 and pending[q] >= k):
                _keep(scores, places, q, k, kept, ids)
                pending[q] = len(scores[q][0])
                if pending[q] >= k:
                    least[q] = scores[q][0].min()
    for q in range(len(best)):
        _keep(scores, places, q, k, kept, ids)
    # Only ids of kept documents stay.
    used = np.unique(np.concatenate([p[0] for p in places])) if places else np.zeros(0, np.int64)
    every = pa.concat_arrays([*kept, ids])
    out = [(s[0], np.searchsorted(used, p[0])) for s, p in zip(scores, places, strict=True)]
    return out, [every.take(pa.array(used))]


def _keep(scores: list, places: list, q: int, k: int, kept: list, ids: pa.Array) -> None:
    """Cuts a query's candidates to the best k by score, then doc_id (nulls last)."""
    score, place = np.concatenate(scores[q]), np.concatenate(places[q])
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        sure, tied = np.flatnonzero(score > edge), np.flatnonzero(score == edge)
        if len(sure) + len(tied) > k:
            every = pa.concat_arrays([*kept, ids]) if kept else ids
            by_id = np.asarray(pc.sort_indices(every.take(pa.array(place[tied])), null_placement="at_end"))
            tied = tied[by_id[: k - len(sure)]]
        chosen = np.concatenate((sure, tied))
        score, place = score[chosen], place[chosen]
    scores[q], places[q] = [score], [place]
