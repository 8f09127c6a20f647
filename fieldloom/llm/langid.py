"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

* Features: 2- and 3-grams of characters (code points in lower case; whatever is neither a letter nor
  a mark is a blank), hashed into ``DIM`` buckets. Inverse document frequencies come from all
  training documents; a feature's value is its share of the text's n-grams times its IDF.
* Training: follow-the-regularised-leader with L1 and L2 penalties, on the driver, over a
  bounded sample: at most ``SAMPLE`` documents of each language and ``TOTAL`` over all, but ``LEAST``
  of every language (or all it has), so none is left out. A hash of the id chooses them.
* Calibration: one temperature, chosen on a fifth of that sample that training does not see.

Prediction reads whole texts in Spark tasks; the model is a table of ``DIM`` floats a language.

Edge cases: a null text or one without a letter is ``und`` with score 0; without any labelled
training row all are ``und``; rows with a null lang train nothing but are predicted; repeated
rows are predicted alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import fold

BITS = 15
DIM = 1 << BITS
SAMPLE, TOTAL, LEAST = 800, 4000, 8
ALPHA, BETA, L1, L2, EPOCHS, BATCH = 1.0, 1.0, 0.002, 0.0005, 10, 32
#: Shares of n-grams are small numbers; this brings features near 1, so few steps suffice.
SCALE = 20.0

#: Letters of all scripts lie below this code point.
PLANES = 0x33480
BLANK = 0x20


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: its lower case (a blank if it is no letter or mark), and whether it is a letter."""
    chars = [chr(c) for c in range(PLANES)] + [" "]
    low = [x if len(x) == 1 else c for c, x in zip(chars, map(str.lower, chars))]
    kept = [unicodedata.category(c)[0] in "LM" for c in chars]
    folded = np.where(kept, np.fromiter(map(ord, low), np.uint64, len(low)), np.uint64(BLANK))
    return folded, np.fromiter(map(str.isalpha, chars), bool, len(chars))


def code_points(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes (at most ``PLANES``) and the row offsets into them."""
    lead = (raw & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = raw[at].astype(np.int64)
    width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
    point = np.where(width == 1, first, first & (0x7F >> width))
    padded = np.concatenate((raw, np.zeros(3, np.uint8)))
    for k in range(1, 4):
        longer = np.flatnonzero(width > k)
        point[longer] = point[longer] << 6 | padded[at[longer] + k] & 63
    return np.minimum(point, PLANES), np.concatenate(([0], np.cumsum(lead)))[offs]


def ngrams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every 2- and 3-gram of characters that lies inside a row; 2-grams first."""
    points, offs = code_points(raw, offs)
    low = _characters()[0][points]
    ends = np.repeat(offs[1:], np.diff(offs))
    rows = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    out, where = [], []
    for n in (2, 3):
        m = max(0, len(low) - n + 1)
        gram = low[:m].copy()
        for j in range(1, n):
            gram = gram << np.uint64(21) | low[j : j + m]
        inside = np.arange(m) + n <= ends[:m]
        out.append((K.mix64(gram[inside] + np.uint64(n) * K.GOLDEN) >> np.uint64(64 - BITS)).astype(np.int32))
        where.append(rows[:m][inside])
    return np.concatenate(out), np.concatenate(where)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial row a task: the number of documents and, by bucket, of those that hold it."""
    counts, n = np.zeros(DIM, np.int64), 0
    for batch in K.chunks(batches):
        grams, rows = ngrams(*K.text_bytes(batch.column(0)))
        key = np.unique(rows.astype(np.int64) << BITS | grams)
        counts += np.bincount(key & (DIM - 1), minlength=DIM)
        n += batch.num_rows
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1), pa.int32()),
        pa.array(np.append(counts[used], n), pa.int64())], names=["bucket", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.chunks(batches):
        grams, rows = ngrams(*K.text_bytes(batch.column(2)))
        key, count = np.unique(rows.astype(np.int64) << BITS | grams, return_counts=True)
        rows = key >> BITS
        lists = [K.list_array(x.astype(np.int32), rows, batch.num_rows, pa.int32()) for x in (key & (DIM - 1), count)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists],
            names=["lang", "key", "bucket", "n"])


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # (languages, DIM): IDF times weight
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Ftrl:
    """Per-coordinate FTRL-proximal for a multinomial logit over sparse rows."""

    def __init__(self, dim: int, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1,
        l2: float = L2):
        self.z, self.n = np.zeros((dim, classes)), np.zeros((dim, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def step(self, index: np.ndarray, value: np.ndarray, row: np.ndarray, label: np.ndarray) -> None:
        used, inner = np.unique(index, return_inverse=True)
        w = self.weights(used)
        logits = np.stack([np.bincount(row, value * w[inner, k], minlength=len(label)) for k in range(w.shape[1])],
            axis=1)
        error = _softmax(logits)
        error[np.arange(len(label)), label] -= 1
        g = np.stack([np.bincount(inner, value * error[row, k], minlength=len(used)) for k in range(w.shape[1])],
            axis=1)
        sigma = (np.sqrt(self.n[used] + g * g) - np.sqrt(self.n[used])) / self.alpha
        self.z[used] += g - sigma * w
        self.n[used] += g * g


def _rows(sample: pa.Table, langs: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coordinates (the last one is the bias), values and rows of the sample's features, and the labels."""
    lists = sample["bucket"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    i, n = lists.flatten().to_numpy(), sample["n"].combine_chunks().flatten().to_numpy().astype(float)
    row = np.repeat(np.arange(len(sizes)), sizes)
    total = np.maximum(np.bincount(row, n, minlength=len(sizes)), 1)
    index, value = np.append(i, np.full(len(sizes), DIM)), np.append(n / total[row] * idf[i], np.ones(len(sizes)))
    row = np.append(row, np.arange(len(sizes)))
    order = np.argsort(row, kind="stable")
    label = np.searchsorted(langs, np.array(sample["lang"].to_pylist(), object)) if len(sizes) else np.zeros(0, int)
    return index[order], value[order], row[order], label


def _sample(rows: DataFrame, sample: int) -> pa.Table:
    """Features of the chosen documents, ordered by content and then by a fixed draw."""
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_count"))
    n_langs = max(counts.count(), 1)
    quota = max(LEAST, min(sample, TOTAL // n_langs))
    # Twice the quota by a cheap filter first; it leaves a language without rows with probability exp(-2 * LEAST).
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    some = rows.join(F.broadcast(counts), "lang").filter(uniform * F.col("_count") < 2 * quota)  # one row a language
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text")))
    chosen = some.withColumn("_rank", rank).filter(F.col("_rank") <= quota)
    got = chosen.select("lang", F.xxhash64("text").alias("key"), "text").mapInArrow(_features,
        "lang string, key long, bucket array<int>, n array<int>").toArrow()
    got = got.sort_by([("key", "ascending"), ("lang", "ascending")])
    return got.take(pa.array(np.random.default_rng(5).permutation(len(got))))


def train(docs: DataFrame, sample: int = SAMPLE, folds: int = 5) -> LanguageModel | None:
    """Learns from rows with a lang whose fold is not 0; None if there are none."""
    rows = docs.filter(F.col("lang").isNotNull() & (fold("doc_id", folds) != 0)).select("doc_id", "lang", "text")
    got = _sample(rows, sample)
    langs = sorted(set(got["lang"].to_pylist()))
    if not langs:
        return None
    partial = rows.select("text").mapInArrow(_document_frequencies,
        "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = partial["bucket"].to_numpy(), partial["n"].to_numpy()
    df = np.zeros(DIM)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    idf = SCALE * (np.log((1 + n[bucket < 0].sum()) / (1 + df)) + 1)
    fifth = np.arange(len(got)) % 5 == 0
    calibration, learning = got.filter(pa.array(fifth)), got.filter(pa.array(~fifth))
    model = Ftrl(DIM + 1, len(langs))
    rng = np.random.default_rng(7)
    if len(learning):
        index, value, row, label = _rows(learning, langs, idf)
        starts = np.searchsorted(row, np.arange(len(learning) + 1))
        for _ in range(EPOCHS):
            order = rng.permutation(len(learning))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                take = np.concatenate([np.arange(starts[r], starts[r + 1]) for r in part])
                local = np.repeat(np.arange(len(part)), starts[part + 1] - starts[part])
                model.step(index[take], value[take], local, label[part])
    w = model.weights()
    index, value, row, label = _rows(calibration, langs, idf)
    logits = np.stack([np.bincount(row, value * w[index, k], minlength=len(label)) for k in range(len(langs))], axis=1)
    grid = np.exp(np.linspace(-3, 3, 121))
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(label)), label], 1e-12)).mean() for t in grid]
    return LanguageModel(langs, (w[:DIM] * idf[:, None]).T.astype(np.float32).copy(), w[DIM],
        float(grid[int(np.argmin(loss))]))


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def identify(docs: DataFrame, model: LanguageModel | None, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x DIM floats, a fixed bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in K.chunks(batches):
            column = batch.column(2)
            raw, offs = K.text_bytes(column)
            n = batch.num_rows
            lang, score = np.full(n, "und", object), np.zeros(n)
            points, at = code_points(raw, offs)
            letters = np.bincount(np.searchsorted(at, np.flatnonzero(_characters()[1][points]), side="right") - 1,
                minlength=n) > 0
            if m is not None:
                grams, rows = ngrams(raw, offs)
                count = np.maximum(np.bincount(rows, minlength=n), 1)
                logits = np.stack([np.bincount(rows, t[grams], minlength=n) / count for t in m.table], axis=1) + m.bias
                p = _softmax(logits / m.temperature)
                best = p.argmax(axis=1)
                lang[letters] = np.array(m.langs, object)[best[letters]]
                score[letters] = p[np.arange(n), best][letters]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()),
                pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", F.coalesce(fold("doc_id", folds) == 0, F.lit(False)).alias("held_out"),
        "text").mapInArrow(run, PREDICTED)


def op2_query(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
