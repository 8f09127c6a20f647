"""Personal data: base patterns plus information-theoretic disclosure of other terms.

The base detector finds emails, IP addresses, cards and phone numbers: the protected
entities. The method then asks which *other* words give an entity away. Over whole texts it
counts in how many documents a term (a run of letters and digits outside base spans) occurs
together with an entity, n(t, e), and in how many it occurs at all, n(t). Its disclosure is
the pointwise mutual information with the entity as a share of what the entity itself says::

    PMI(t, e) / IC(e) = log2(n(t, e) * N / (n(t) * n(e))) / log2(N / n(e))

A term is disclosed when that share reaches ``disclosure`` for some entity and at least
``support`` documents show the pair. Every occurrence of a disclosed term in any text is
added as a span of kind ``term``; base spans are never dropped. ``sanitise`` generalises
both: base spans to the name of their kind, terms to the kind of the entity they give away
(or removes terms).

Counts are pre-aggregated inside tasks, so an entity in a third of all documents sends one
partial count a term and task. A row's spans come from its own text, never by a join on its id.

Edge cases: a null text yields a row without spans and stays null; a null or repeated
doc_id is kept, and every row counts as a document; an empty table gives an empty result;
other columns, whatever their names, are ignored by ``find_personal_data`` and kept by
``sanitise``; numbers of any length are read as text; time is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed

# The order of kinds, and the patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that fails at the head of a run of digits fails at each later digit of it too,
#: so looking behind changes no match and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W_]+")
NON_DIGIT = re.compile(r"[^0-9]")

SUPPORT, DISCLOSURE = 2, 0.95
MASKS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>"}
TERM_MASKS = ("<EMAIL TERM>", "<IP TERM>", "<CARD TERM>", "<PHONE TERM>")
#: Entities (8 bytes each) and disclosed terms that may be broadcast; beyond, they are joined by shuffle.
BROADCAST_ENTITIES, BROADCAST_TERMS = 2_000_000, 200_000
#: Distinct keys that a task counts before it hands partial counts to the shuffle.
FLUSH = 200_000


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, walking from one @ to the next instead of trying every letter."""
    floor, at = 0, text.find("@")
    while at >= 0:
        head = text[floor:at]
        start = at - (len(head) - len(head.rstrip(LOCAL)))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        floor = m.end() if m else at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every base span, in order."""
    found = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NON_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(NON_DIGIT.sub("", m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def entities(text: str, spans: list[tuple[int, int, int]]) -> set[str]:
    """Distinct protected entities of a text: rank of the kind and spelling (emails in lower case)."""
    return {f"{k}:{text[s:e].lower() if k == 0 else text[s:e]}" for s, k, e in spans}


def blanked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with base spans as spaces; places stay."""
    parts, at = [], 0
    for start, _, end in spans:
        if end > at:
            start = max(start, at)
            parts += [text[at:start], " " * (end - start)]
            at = end
    return "".join(parts) + text[at:] if parts else text


def terms_of(text: str) -> set[str]:
    """Distinct terms of a text that has been blanked."""
    return {w.lower() for w in set(TERM.findall(text))}


def _counted(batches: Iterator[pa.RecordBatch], keys, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the key tuples that ``keys(text)`` gives; flushed before they grow large."""
    counts: dict[tuple, int] = {}

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, pa.string()) for c in zip(*counts)] or [pa.array([], pa.string())] * len(names)
        out = pa.RecordBatch.from_arrays([*columns, pa.array(counts.values(), pa.int64())], names=[*names, "n"])
        counts.clear()
        return out

    for batch in K.chunks(batches):
        for text in K.strings(batch.column(0)):
            for key in keys(text or ""):
                counts[key] = counts.get(key, 0) + 1
            if len(counts) > FLUSH:
                yield flush()
    yield flush()


def shared_entities(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """entity, n of the entities that at least ``support`` documents hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, lambda text: ((e,) for e in entities(text, base_spans(text))), ["entity"])

    found = docs.select("text").mapInArrow(run, "entity string, n long")
    return checkpointed(found.groupBy("entity").agg(F.sum("n").alias("n")).filter(F.col("n") >= support))


def disclosed(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, share) of the pairs by which the corpus shows a term to give an entity away."""
    spark = docs.sparkSession
    shared = shared_entities(docs, support)
    known = None  # a filter of what is counted; without it the result is the same
    if shared.count() <= BROADCAST_ENTITIES:
        known = spark.sparkContext.broadcast(frozenset(shared.select("entity").toArrow().column(0).to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = known.value if known else None

        def keys(text: str) -> Iterator[tuple]:
            spans = base_spans(text)
            terms = terms_of(blanked(text, spans))
            for e in entities(text, spans):
                if every is None or e in every:
                    yield from ((e, t) for t in terms)
            yield from ((None, t) for t in terms)

        yield from _counted(batches, keys, ["entity", "term"])

    counts = docs.select("text").mapInArrow(run, "entity string, term string, n long").groupBy("entity",
        "term").agg(F.sum("n").alias("n"))
    counts = checkpointed(counts.filter(F.col("n") >= support))
    total = float(max(docs.count(), 1))
    pairs = counts.filter("entity is not null").withColumnRenamed("n",
        "n_both").join(shared.withColumnRenamed("n", "n_entity"), "entity")
    pairs = pairs.join(counts.filter("entity is null").select("term", F.col("n").alias("n_term")), "term")
    pmi = F.log2(F.col("n_both") * F.lit(total) / (F.col("n_term") * F.col("n_entity")))
    ic = F.log2(F.lit(total) / F.col("n_entity"))
    share = F.when(ic > 0, pmi / ic)
    return pairs.select("entity", "term", share.alias("share")).filter(F.col("share") >= disclosure)


def term_spans(text: str, spans: list[tuple[int, int, int]], known: dict[str, int]) -> list[tuple[int, int, int]]:
    """(start, rank of the kind that it gives away, end) of every disclosed term outside base spans."""
    if not known:
        return []
    text = blanked(text, spans)
    if known.keys().isdisjoint(terms_of(text)):
        return []
    return [(m.start(), known[w], m.end()) for m in TERM.finditer(text) if (w := m.group().lower()) in known]


def _with_terms(docs: DataFrame, support: int, disclosure: float, each, schema) -> DataFrame:
    """``each(batch, known)`` over all rows, where ``known(i)`` has the disclosed terms that may occur in row i.

    A counted, small table of terms is broadcast. A larger one meets each row's distinct terms in a
    shuffle, and the rows get back their own under an id that a checkpoint fixes.
    """
    kinds = disclosed(docs, support, disclosure).groupBy("term").agg(F.min(F.substring("entity", 1,
        1).cast("int")).alias("kind"))
    kinds = checkpointed(kinds)
    if kinds.count() <= BROADCAST_TERMS:
        got = kinds.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(dict(zip(got.column("term").to_pylist(),
            got.column("kind").to_pylist())))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in K.chunks(batches):
                yield each(batch, lambda i: shared.value)

        return docs.mapInArrow(run, schema)

    row, own = K.fresh_names(docs.columns, "row", "terms")
    docs = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches):
            terms = [sorted(terms_of(blanked(t or "", base_spans(t or "")))) for t in K.strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))],
                names=["row", "terms"])

    held = docs.select(F.col(row).alias("row"), "text").mapInArrow(explode,
        "row long, terms array<string>").select("row", F.explode("terms").alias("term"))
    held = held.join(kinds, "term").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term",
        "kind"))).alias(own)).withColumnRenamed("row", row)

    def run_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches):
            terms = batch.column(own).to_pylist()
            yield each(batch.drop_columns([own]), lambda i: dict(terms[i] or ()))

    return docs.join(held, row, "left").drop(row).mapInArrow(run_own, schema)


FOUND = "doc_id long, spans array<struct<start:int,kind:int,end:int>>, terms array<struct<start:int,kind:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def find_personal_data(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, spans (start, kind, end) of the base detector, and terms disclosed by the corpus (kind: of the entity)."""

    def each(batch: pa.RecordBatch, known) -> pa.RecordBatch:
        spans, terms = [], []
        for i, text in enumerate(K.strings(batch.column("text"))):
            spans.append(base_spans(text or ""))
            terms.append(term_spans(text or "", spans[-1], known(i)))
        columns = [pa.array([[dict(zip(("start", "kind", "end"), x)) for x in row] for row in c],
            _SPANS) for c in (spans, terms)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "spans", "terms"])

    return _with_terms(docs.select("doc_id", "text"), support, disclosure, each, FOUND)


def masked(text: str, spans: list[tuple[int, int, int]], terms: list[tuple[int, int, int]],
    remove: bool = False) -> str:
    """The text with base spans and terms generalised; where spans overlap, the first one stands for all it touches."""
    marks = [(s, e, MASKS[KINDS[k]]) for s, k, e in spans] + [(s, e, "" if remove else TERM_MASKS[k]) for s, k,
        e in terms]
    parts, at = [], 0
    for start, end, mark in sorted(marks):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def sanitise(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE,
    remove_terms: bool = False) -> DataFrame:
    """The documents with base spans and disclosed terms generalised; all columns and rows stay."""

    def each(batch: pa.RecordBatch, known) -> pa.RecordBatch:
        out = []
        for i, text in enumerate(K.strings(batch.column("text"))):
            spans = base_spans(text or "")
            out.append(None if text is None else masked(text, spans, term_spans(text, spans, known(i)), remove_terms))
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return _with_terms(docs, support, disclosure, each, docs.schema)


def op1_query(docs: DataFrame) -> DataFrame:
    """The contract's columns: counts, digest of the base spans, and all spans."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for d, spans, terms in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "spans", "terms"))):
                base = [(x["start"], x["kind"], x["end"]) for x in spans]
                n = np.bincount([k for _, k, _ in base], minlength=4) if base else (0, 0, 0, 0)
                every = sorted(base + [(x["start"], 4, x["end"]) for x in terms])
                text = [",".join(f"{(*KINDS, 'term')[k]}:{s}:{e}" for s, k, e in x) for x in (base, every)]
                rows.append((d, *map(int, n), hashlib.sha256(text[0].encode()).hexdigest(), text[1], len(terms)))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))
    return find_personal_data(docs).mapInArrow(
        digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long"
    )
