"""Vectorised helpers shared by the operators that run numpy inside Spark tasks.

Every helper works on one chunk of rows that Spark handed to the task, so memory is
bounded by ``CHUNK_BYTES`` plus the longest single text, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
#: White space as the contracts define it: x20 and x09-x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Only A-Z change case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, np.uint64(base), dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, in one of few sizes."""
    size = CHUNK_BYTES + 4096
    while size < n:
        size *= 2
    return _powers(size)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the row offsets into them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary() if pa.types.is_string(column.type)
        else column.type).cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def strings(column: pa.Array) -> list[str | None]:
    """Python strings of a column; bytes that are not UTF-8 become U+FFFD instead of an error."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that no column of ``taken`` has, in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name in used:
            name = f"_{name}"
        used.add(name)
        out.append(name)
    return out


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
    limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches between rows so that no piece holds much more than ``limit`` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ``mask`` that do not cross a row's border."""
    if not len(mask):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    inner = offs[(offs > 0) & (offs < len(mask))]
    before[inner] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(mask & ~after) + 1
    rows = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one prefix sum over the chunk."""
    up, down = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[raw] * up[: len(raw)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every white-space-separated word (A-Z lowered), and word offsets by row."""
    low = LOWER[raw]
    starts, ends, rows = runs(~SPACE[low], offs)
    return span_hashes(low, starts, ends), rows, np.searchsorted(rows, np.arange(len(offs)))


def shingles(hashes: np.ndarray, rows: np.ndarray, word_offs: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every k-word shingle; a shorter row is one shingle of all its words."""
    n = len(hashes)
    if n == 0:
        return hashes, rows
    end = word_offs[rows + 1]
    at = np.arange(n)
    first = at == word_offs[rows]
    full = at + k <= end
    keep = full | (first & (end - at < k))
    total = np.zeros(n, np.uint64)
    factor = 1
    for j in range(k):
        inside = at + j < end
        step = np.zeros(n, np.uint64)
        step[: max(n - j, 0)] = hashes[j:]
        total += np.where(inside, step, np.uint64(0)) * np.uint64(factor)
        factor = factor * int(_M1) % (1 << 64)
    total = mix64(total + np.minimum(end - at, k).astype(np.uint64))
    return total[keep], rows[keep]


def distinct_by_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each row, sorted inside it, their rows and their counts."""
    if not len(values):
        return values, rows, np.zeros(0, np.int64)
    order = np.argsort(values)
    order = order[np.argsort(rows[order].astype(np.uint16 if rows.max() < 65536 else np.int64), kind="stable")]
    v, r = values[order], rows[order]
    new = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (r[1:] != r[:-1]))))
    return v[new], r[new], np.diff(np.append(new, len(v)))


def list_array(values: np.ndarray, rows: np.ndarray, n: int, kind: pa.DataType) -> pa.ListArray:
    """One list a row from row-sorted values."""
    offs = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
