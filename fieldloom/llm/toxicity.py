"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is a bag: itself and its character n-grams of ``NGRAMS`` bytes with the borders marked.
The bag's embeddings are averaged and a linear softmax of two classes reads the average, so a
misspelling never seen shares the vectors of the n-grams it keeps. Labels stand for whole
documents, so a document is toxic if any of its words is: its probability is one minus the
product of its words' clean probabilities. Embeddings and softmax are trained together through
that product, which blames the telling words of a toxic document and leaves the others alone.
Evidence adds up over the distinct words and is never diluted, so a long document with a few
toxic words still stands out. A logistic calibration is fitted on a fifth of the sample; it takes part of
the labels for wrong (a share that is fitted along), so a few mislabelled documents don't flatten it.

Learning uses a bounded sample: the ``SAMPLE`` labelled rows with the smallest hash of the id, and the
first ``EACH`` of either class in that order, so a rare class is never absent; the calibration is
shifted back to the share of toxic rows among all labels. Of documents that share an id the
smallest text counts. Words of fewer than ``LEAST`` sampled documents teach nothing of their own (a
parameter; their n-grams are learnt from other words). Scoring reads every whole text in Spark tasks; the model is ``DIM`` floats.

Edge cases: a null or empty text has no evidence and gets the calibrated base score; a label
that is null, or whose document is missing, teaches nothing; repeated labels count once
each; without labels every score is 0; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import fold, give_back

BITS, NGRAMS = 18, (4, 6)
DIM, WIDTH = 1 << BITS, 4
SAMPLE, EACH, LEAST, THRESHOLD = 6000, 500, 2, 0.7
EPOCHS, RATE, DECAY, START = 40, 0.05, 1e-4, -6.0

#: At most this share of a class's labels is taken for wrong.
MISLABELLED = 0.1
#: Keeps the logarithm of no evidence finite.
FAINT = 1e-3
#: A word is a run of letters and digits: ASCII ones, and all bytes of longer characters.
LETTER = np.zeros(256, bool)
LETTER[128:] = True
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = True


def lowered(raw: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 capitals (bytes C3 80-9E without 97)."""
    low = K.LOWER[raw]
    if len(raw) > 1:
        tail = low[1:]
        capital = (low[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        tail[capital] += 32
    return low


@dataclass
class Words:
    """Distinct words of a chunk, and where they occur."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    which: np.ndarray  # distinct word of each (row, word)
    row: np.ndarray


def chunk_words(raw: np.ndarray, offs: np.ndarray) -> Words:
    low = lowered(raw)
    starts, ends, rows = K.runs(LETTER[low], offs)
    hashes = K.span_hashes(low, starts, ends)
    value, row, _ = K.distinct_by_row(hashes, rows)
    known, first = np.unique(hashes, return_index=True)
    return Words(low, starts[first], ends[first], np.searchsorted(known, value), row)


def bags(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word of every n-gram of ``<word>`` and of each whole word."""
    n = len(starts)
    size = ends - starts + 2
    offs = np.concatenate(([0], np.cumsum(size)))
    flat = np.empty(offs[-1], np.uint8)
    inner = np.ones(offs[-1], bool)
    inner[offs[:-1]] = inner[offs[1:] - 1] = False
    flat[offs[:-1]], flat[offs[1:] - 1] = 0x3C, 0x3E
    source = np.repeat(starts - offs[:-1] - 1, size) + np.arange(offs[-1])
    flat[inner] = low[source[inner]]
    word = np.repeat(np.arange(n), size)
    ends_at = np.repeat(offs[1:], size)
    out, where = [], []
    code = flat.astype(np.uint64) + np.uint64(1)
    for k in NGRAMS:
        m = max(0, len(flat) - k + 1)
        h = np.full(m, np.uint64(k))
        for j in range(k):
            h = h * np.uint64(257) + code[j : j + m]
        keep = np.arange(m) + k <= ends_at[:m]
        out.append(h[keep])
        where.append(word[:m][keep])
    out.append(K.span_hashes(flat, offs[:-1], offs[1:]) if n else np.zeros(0, np.uint64))
    where.append(np.arange(n))
    bucket = (K.mix64(np.concatenate(out)) >> np.uint64(64 - BITS)).astype(np.int32)
    word = np.concatenate(where).astype(np.int32)
    order = np.argsort(word, kind="stable")
    return bucket[order], word[order]


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each sampled document."""
    for batch in K.chunks(batches):
        w = chunk_words(*K.text_bytes(batch.column(2)))
        text = [w.low[s:e].tobytes() for s, e in zip(w.starts, w.ends)]
        words = pa.array(text, pa.binary()).take(pa.array(w.which))
        offs = pa.array(np.searchsorted(w.row, np.arange(batch.num_rows + 1)).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offs, words)],
                names=["doc_id", "toxic", "words"]
        )


@dataclass
class ToxicityModel:
    table: np.ndarray  # log-odds of each bucket; a word's are the mean of its bag
    shift: float
    a: float
    b: float


def word_scores(m: ToxicityModel, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    bucket, word = bags(low, starts, ends)
    n = len(starts)
    return np.bincount(word, m.table[bucket], minlength=n) / np.maximum(np.bincount(word, minlength=n), 1) + m.shift


def evidence(scores: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Minus the log of the probability that all distinct words of a row are clean."""
    return np.bincount(row, np.logaddexp(0, scores), minlength=n)


def _fit(bucket: np.ndarray, word: np.ndarray, n_words: int, doc_word: np.ndarray, doc_row: np.ndarray,
    toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Embeddings and softmax by Adam on the documents' likelihood; returns the log-odds of each bucket and a shift."""
    rng = np.random.default_rng(1)
    used, inner = np.unique(bucket, return_inverse=True)
    inner = inner.astype(np.int32)
    offs = np.searchsorted(word, np.arange(n_words))
    size = np.bincount(word, minlength=n_words).astype(np.float32)[:, None]
    by_bucket = np.argsort(inner, kind="stable")
    starts, owner = np.searchsorted(inner[by_bucket], np.arange(len(used))), word[by_bucket]
    del bucket, word, by_bucket
    params = [rng.normal(0, 0.3, (len(used), WIDTH)).astype(np.float32), rng.normal(0, 0.3, WIDTH).astype(np.float32),
        np.full(1, START, np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, EPOCHS + 1):
        e, v, shift = params
        x = np.add.reduceat(e[inner], offs) / size
        score = x @ v + shift
        rate = np.bincount(doc_row, np.logaddexp(0, score)[doc_word], minlength=len(toxic))
        slope = np.where(toxic, -1 / np.expm1(np.maximum(rate, 1e-2)), 1.0)
        g = (np.bincount(doc_word, slope[doc_row], minlength=n_words) / (1 + np.exp(-score))).astype(np.float32)
        by_word = g[:, None] * v / size
        grads = [np.add.reduceat(by_word[owner], starts) + DECAY * e, x.T @ g + DECAY * v, g.sum(keepdims=True)]
        for p, grad, m1, m2 in zip(params, grads, first, second):
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            p -= RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-4)
    table = np.zeros(DIM, np.float32)
    table[used] = params[0] @ params[1]
    return table, float(params[2][0])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 3,
    held: int = 1) -> ToxicityModel | None:
    """Learns from labelled rows whose fold is not ``held``; None without both classes."""
    model = _learn(docs, labels, sample, folds, held)
    give_back()
    return model


def _learn(docs: DataFrame, labels: DataFrame, sample: int, folds: int, held: int) -> ToxicityModel | None:
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held))
    ids = usable.select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("_toxic"))
    n_labels, n_toxic = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    first = lambda x, n: x.orderBy(F.xxhash64("_id"), "_id", "_toxic").limit(n)
    ids = first(ids, sample).union(first(ids.filter("_toxic = 1"), EACH)).union(first(ids.filter("_toxic = 0"),
        EACH)).distinct()  # at most sample + 2 * EACH rows
    rows = docs.join(F.broadcast(ids), docs["doc_id"] == ids["_id"]).groupBy("_id",
        "_toxic").agg(F.min("text").alias("text"))
    rows = rows.select(F.col("_id").alias("doc_id"), F.col("_toxic").alias("toxic"), "text")
    # Arrow on the driver: a sampled word is a few bytes and a code, never a Python object.
    got = rows.mapInArrow(_sample_words, "doc_id long, toxic int, words array<binary>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("toxic", "ascending")]).combine_chunks()
    toxic = got["toxic"].to_numpy() > 0
    n = len(toxic)
    if n == 0 or toxic.all() or not toxic.any():
        return None
    lists = got["words"].combine_chunks()
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    encoded = lists.flatten().dictionary_encode()
    code, dictionary = encoded.indices.to_numpy(), encoded.dictionary
    del got, lists, encoded
    held = np.zeros(n, bool)
    held[np.random.default_rng(3).permutation(n)[: n // 5]] = True
    learning = ~held[row]
    documents = np.bincount(code[learning], minlength=len(dictionary))
    kept = np.flatnonzero(documents >= min(LEAST, n))
    if not len(kept):
        return None
    place = np.full(len(dictionary), -1)
    place[kept] = np.arange(len(kept))
    use = learning & (place[code] >= 0)
    doc = np.cumsum(~held) - 1
    table, shift = _fit(*bags(*_flat(dictionary.take(pa.array(kept)))), len(kept), place[code[use]], doc[row[use]],
        toxic[~held])
    model = ToxicityModel(table, shift, 1.0, 0.0)
    seen, inner = np.unique(code[~learning], return_inverse=True)
    x = np.zeros(int(held.sum()))
    if len(seen):
        score = word_scores(model, *_flat(dictionary.take(pa.array(seen))))
        x = evidence(score[inner], (np.cumsum(held) - 1)[row[~learning]], len(x))
    model.a, model.b = _calibrated(np.log(x + FAINT), toxic[held].astype(float))
    odds = lambda k, m: math.log((k + 0.5) / (m - k + 0.5))
    model.b += odds(n_toxic, n_labels) - odds(int(toxic.sum()), n)
    return model


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a binary array, and where each word starts and ends in them."""
    words = words.cast(pa.large_binary())
    _, offsets, data = words.buffers()
    offs = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data, np.uint8), offs[:-1], offs[1:]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and intercept by damped Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        r = p * (1 - p) + 1e-6
        g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum() + 0.1 * b])
        h = np.array([[(r * x * x).sum() + 0.1, (r * x).sum()], [(r * x).sum(), r.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(float(a), 0.0), float(b)


def _calibrated(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and intercept of the true class where a share of the labels of either class is wrong (EM)."""
    wrong = np.array([0.02, 0.02])  # of labels whose true class is 0 and 1
    a, b = _logistic(x, y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        one = p * np.where(y > 0, 1 - wrong[1], wrong[1])
        true = one / (one + (1 - p) * np.where(y > 0, wrong[0], 1 - wrong[0]))
        flips = np.array([((1 - true) * y).sum(), (true * (1 - y)).sum()])
        wrong = np.minimum((flips + 0.02) / (np.array([(1 - true).sum(), true.sum()]) + 1), MISLABELLED)
        a, b = _logistic(x, true)
    return a, b


SCORED = "doc_id long, held_out boolean, score double, predicted int"


def scores(docs: DataFrame, model: ToxicityModel | None, keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; with ``keep``, the rows of ``docs`` that are not predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM floats

    def of(column: pa.Array) -> np.ndarray:
        m = shared.value
        if m is None:
            return np.zeros(len(column))
        w = chunk_words(*K.text_bytes(column))
        s = word_scores(m, w.low, w.starts, w.ends)
        return 1 / (1 + np.exp(-(m.a * np.log(evidence(s[w.which], w.row, len(column)) + FAINT) + m.b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches):
            score = of(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score),
                pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.chunks(batches):
            yield batch.filter(pa.array(of(batch.column(batch.schema.get_field_index("text"))) < THRESHOLD))

    if keep:
        return docs.mapInArrow(clean, docs.schema)
    return docs.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "text").mapInArrow(run, SCORED)


def op4_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(docs, train(docs, labels))
