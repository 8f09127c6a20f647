"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period q, at least ``max(MIN_LENGTH, 2 q)`` long,
that no neighbouring word extends. For every power of two the dictionary names the factors of
that many words (equal factors of one text, equal names):

1. Level k looks for periods from 2**k to 2**(k+1) - 1. The first words of such a run are a
   factor u of 2**k words that stands again q words on, so within twice its length.
2. Occurrences of u that follow one another by at most half of its length are one arithmetic
   progression, whose difference is the smallest period of u (Fine and Wilf). Twice the length
   of u meets at most four later progressions. Two occurrences of one progression give no
   primitive period, so a run shows as a pair of progressions: from any occurrence to the first
   of a later progression, or from the last of one to the last of the other. Those distances
   are the proposals.
3. Each proposal is extended both ways by comparing names from the highest level to the lowest,
   short ones go, and of equal stretches the smallest period stays.

A factor that stands once in its text gets a name of its own and leaves the sorting at all
higher levels, so ordinary prose costs a few sorts of few words. Names are ranks, not hashes:
the result is exact.

Texts are worked on in the tasks that read them, many at once (``CHUNK_BYTES`` of text); nothing
is shuffled. Memory is some 150 bytes a word of a chunk or of the longest single text.

Edge cases: a null or blank text has no words and no run; a text of any length is worked on
whole; a repeated row gives its own row; a null doc_id leaves the text as it is; an empty table
gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .kernels import chunks, text_bytes

MIN_LENGTH = 12
RUNS = "doc_id long, start long, length long, period long"
DIGEST = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a chunk, as bytes, and each row's place among them."""
    raw, offs = text_bytes(column)
    texts = pa.Array.from_buffers(pa.large_string(), len(column),
                                  [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    parts = pc.ascii_split_whitespace(texts)
    flat = parts.flatten().cast(pa.large_binary())
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0))
    before = np.concatenate(([0], np.cumsum(filled)))
    bounds = before[np.asarray(parts.offsets)] if len(column) else np.zeros(1, np.int64)
    return flat.filter(pa.array(filled)), bounds


def basic_factors(words: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Names of the factors of 1, 2, 4, ... words at each place.

    ``words`` holds a number for each word; rows end at ``bounds``. Places whose factor stands
    once, or crosses the end of its row, have names that no other place has.
    """
    n = len(words)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][row]
    alone = np.arange(n, dtype=np.int64) + n
    levels: list[np.ndarray] = []
    first, second, live = words.astype(np.int64), row, np.arange(n)
    half = 0
    longest = int(np.diff(bounds).max(initial=0))
    while True:
        names = alone.copy()
        if len(live):
            order = np.lexsort((second, first))
            a, b = first[order], second[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            rank = np.cumsum(new) - 1
            many = np.bincount(rank)[rank] > 1
            live, rank = live[order][many], rank[many]
            names[live] = rank
        levels.append(names)
        half = 1 << (len(levels) - 1)
        if not len(live) or 2 * half > longest:
            return levels
        live = np.sort(live)
        live = live[live + 2 * half <= end[live]]
        live = live[names[live + half] < n]
        first, second = names[live], names[live + half]


def proposals(names: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods that one level proposes."""
    n, size = len(names), 1 << level
    at = np.flatnonzero(names < n)
    at = at[np.argsort(names[at], kind="stable")]
    if len(at) < 2:
        return at[:0], at[:0]
    m = len(at)
    same = names[at[1:]] == names[at[:-1]]
    gap = np.diff(at)
    breaks = np.concatenate(([True], ~same | (2 * gap > size)))
    cluster = np.cumsum(breaks) - 1
    head = np.flatnonzero(breaks)
    tail = np.append(head[1:], m) - 1
    starts, periods = [], []
    for step in range(1, 5):
        other = cluster + step
        ok = np.flatnonzero(other < len(head))
        to = head[other[ok]]
        apart = at[to] - at[ok]
        good = (names[at[to]] == names[at[ok]]) & (apart >= size) & (apart < 2 * size)
        starts.append(at[ok][good])
        periods.append(apart[good])
        if step < len(head):
            a, b = at[tail[:-step]], at[tail[step:]]
            good = (names[a] == names[b]) & (b - a >= size) & (b - a < 2 * size)
            starts.append(a[good])
            periods.append((b - a)[good])
    return np.concatenate(starts), np.concatenate(periods)


def extend(levels: list[np.ndarray], at: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches around ``at`` that keep ``period``."""
    n = len(levels[0])
    right, left = at.copy(), at.copy()
    # A stretch may be many times the highest level's size, so that level is compared until it differs.
    for k in range(len(levels) - 1, -1, -1):
        names, size, todo = levels[k], 1 << k, np.arange(len(at))
        while len(todo):
            a = right[todo]
            b = a + period[todo]
            ok = b < n
            ok[ok] = names[a[ok]] == names[b[ok]]
            todo = todo[ok]
            right[todo] += size
        todo = np.arange(len(at))
        while len(todo):
            a = left[todo] - size
            b = a + period[todo]
            ok = a >= 0
            ok[ok] = names[a[ok]] == names[b[ok]]
            todo = todo[ok]
            left[todo] -= size
    return left, right + period


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs of a chunk, by start, then period."""
    levels = basic_factors(words, bounds)
    found = [proposals(names, k) for k, names in enumerate(levels)]
    at, period = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    if len(at):
        # Places of one stretch that follow each other propose the same period: one of them is extended.
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        first = np.concatenate(([True], (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)))
        at, period = at[first], period[first]
    start, end = extend(levels, at, period)
    keep = end - start >= np.maximum(least, 2 * period)
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    if len(start):
        new = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])))
        start, end, period = start[new], end[new], period[new]
        order = np.lexsort((period, start))
        start, end, period = start[order], end[order], period[order]
    return start, end, period


def repeat_tails(ids: list[int | None], bounds: np.ndarray) -> np.ndarray:
    """For each word, the word that takes its place: a tenth of the rows end in a repeated stretch."""
    source = np.arange(bounds[-1])
    for row, doc_id in enumerate(ids):
        n = int(bounds[row + 1] - bounds[row])
        if doc_id is None or not n:
            continue
        h = zlib.crc32(str(doc_id).encode())
        if h % 10:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        source[bounds[row] + a : bounds[row + 1]] = bounds[row] + a + np.arange(n - a) % p
    return source


def _chunk(batch: pa.RecordBatch, planted: bool, least: int):
    ids = batch.column(0)
    words, bounds = split_words(batch.column(1))
    source = repeat_tails(ids.to_pylist(), bounds) if planted else np.arange(bounds[-1])
    numbers = np.asarray(words.dictionary_encode().indices)[source].astype(np.int64)
    start, end, period = find_runs(numbers, bounds, least)
    row = np.searchsorted(bounds, start, side="right") - 1
    return ids, words, bounds, source, start, end, period, row


def runs(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """One row a run: doc_id, start, length and period in words."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, _, bounds, _, start, end, period, row = _chunk(batch, False, least)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)).cast(pa.int64()), pa.array(start - bounds[row]),
                pa.array(end - start), pa.array(period)], ["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(find, RUNS)


def dropped(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Words that some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change)[:n] > 0


def collapse(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """doc_id and text, its words joined by one space and every run cut to its first period."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, words, bounds, source, start, end, period, _ = _chunk(batch, False, least)
            text = _joined(words, bounds, source, dropped(bounds[-1], start, end, period)).cast(pa.large_string(), safe=False)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), text.cast(pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, text string")


def _joined(words: pa.Array, bounds: np.ndarray, source: np.ndarray, out: np.ndarray) -> pa.Array:
    """The words of each row that stay, joined by one space."""
    kept = np.concatenate(([0], np.cumsum(~out)))
    lists = pa.LargeListArray.from_arrays(pa.array(kept[bounds]), words.take(pa.array(source[~out])))
    return pc.binary_join(lists, pa.scalar(b" ", pa.large_binary()))


def op13_query(docs: DataFrame) -> DataFrame:
    """The digest of each document's runs, its tail repeated where the contract says so."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            ids, words, bounds, source, start, end, period, row = _chunk(batch, True, MIN_LENGTH)
            texts = _joined(words, bounds, source, dropped(bounds[-1], start, end, period))
            begin, length, n = start - bounds[row], end - start, batch.num_rows
            place = np.searchsorted(row, np.arange(n + 1))
            best = np.full(n, -1)
            order = np.lexsort((period, begin, -length, row))
            best[row[order][::-1]] = order[::-1]
            blank = pa.array(best < 0)
            of = lambda x: pc.if_else(blank, pa.scalar(None, pa.int64()), pa.array(
                x[best] if len(x) else np.zeros(n, np.int64), pa.int64()))
            listed = ["".join(f"{a},{b},{c}\n" for a, b, c in zip(*(x[place[i] : place[i + 1]].tolist()
                for x in (begin, length, period)), strict=True)) for i in range(n)]
            sha = lambda b: hashlib.sha256(b).hexdigest()
            yield pa.RecordBatch.from_arrays([
                ids.cast(pa.int64()), pa.array(np.diff(place)), of(begin), of(length), of(period),
                of(1000 * length // period), pa.array([sha(x.encode()) for x in listed]),
                pa.array([sha(x.as_buffer()) for x in texts]),
            ], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digest, DIGEST)
