"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

*Tokens.* A document is its token ids and one end id; only a document longer than ``CAPACITY`` is
cut, into full pieces and a rest. The vocabulary splits at white space, so each distinct word of a
chunk is encoded once and its ids are put back in place by array.

*Rounds.* Full pieces are sequences of their own. The others are range-sorted by falling length
and numbered once. Each round takes the next band of lengths, ``low`` to ``high``:

1. Gaps (open sequences) of ``low`` or more are range-sorted by size and numbered. A gap of at least
   ``high`` offers ``gap div high`` slots, a smaller one offers one slot of its own size.
2. Documents and slots meet by a successor sweep in rising order: document number j of the band
   takes slot ``j + max over i <= j of (succ(i) - i)``, where succ(i) counts the slots that are
   smaller than document i. That is the smallest free slot that fits, and the rank j settles
   who gets it where several want one. Rows of one length share succ, so the running maximum
   needs one row a length (4095 at most) and travels to the tasks; the match itself is an
   equi-join of numbered rows.
3. Documents beyond the last slot open new sequences, ``CAPACITY div high`` to each.
4. Gaps shrink by what they took, and the next band begins.

Bands are narrow where a bad fit would cost most, and end at halves and thirds of the capacity, so
that new sequences are filled by whole documents. Every document is placed in the one round of its
band, and a sequence leaves the table of gaps once no document fits it any more.

A round's tables are checkpoints: lost executors cost one round. The driver holds counts by size
and by partition only. One length with most rows is many range partitions, as ties are
numbered by row; no window is wider than the documents of one sequence.

Edge cases: a null text is an empty one (a piece of its end id only); a repeated row is packed
each time; a null doc_id is kept; an empty table gives an empty result; other columns are ignored
whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed
from .kernels import chunks, strings

CAPACITY, END = 4096, 1
CHUNK, KNOWN = 8 << 20, 400_000
#: Rows of a partition in the tables of a round.
ROWS = 100_000
#: Band widths (low over high) by the band's upper end, as a share of the capacity.
WIDE, NARROW, LAST = (1 / 3, 0.5), (1 / 20, 0.9), 0.6
PIECES = "doc_id {0}, piece int, start long, length long, ids_crc32 long"
#: A letter that stands before ASCII punctuation ends a word of the vocabulary (the apostrophe and
#: the bar belong to patterns of their own).
BORDER = "([a-zA-ZÀ-ÖØ-öø-ÿ])([!-&(-/:-@\\[-`{}~])"
MARK = "\x01"
#: Words of lower-case Latin letters in composed form: normalising changes nothing and no pattern splits them.
SIMPLE = re.compile("[a-zß-öø-ÿ]+").fullmatch


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, one for words that its normaliser and patterns leave alone, and the words met so far."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    told["normalizer"], told["pre_tokenizer"]["pretokenizers"][0] = None, {"type": "WhitespaceSplit"}
    return Tokenizer.from_file(path), Tokenizer.from_str(json.dumps(told)), {}


def _encode_words(tokenizer, words: list[str], known: dict[str, bytes]) -> None:
    """Adds the ids of ``words``, many at once: a mark ends each of them, and its id stands nowhere else."""
    mark = tokenizer.encode(MARK, add_special_tokens=False).ids[-1]
    texts = [f" {MARK} ".join([*words[at : at + 64], ""]) for at in range(0, len(words), 64)]
    for at in range(0, len(texts), 1024):
        coded = tokenizer.encode_batch_fast(texts[at : at + 1024], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in coded), np.uint32)
        ends = 4 * np.flatnonzero(ids == mark)
        raw, starts = ids.tobytes(), [0, *(ends + 4).tolist()]
        for word, a, b in zip(words[64 * at : 64 * (at + 1024)], starts, ends.tolist(), strict=False):
            known[word] = raw[a:b]


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of a chunk and each row's place among them; equal to encoding every text as a whole."""
    tokenizer, plain, known = _tokenizer(path)
    if not pc.any(pc.match_substring(texts, "<|")).as_py():
        texts = pc.ascii_lower(texts)
    parts = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, BORDER, "\\1 \\2"))
    words = parts.flatten().dictionary_encode()
    listed = words.dictionary.to_pylist()
    if len(known) + len(listed) > KNOWN:
        known.clear()
    new = [w for w in listed if w not in known]
    simple = {w for w in new if SIMPLE(w)}
    _encode_words(plain, list(simple), known)
    _encode_words(tokenizer, [w for w in new if w not in simple and MARK not in w], known)
    for word in new:
        if MARK in word:
            known[word] = np.array(tokenizer.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()
    coded = [known[w] for w in listed]
    size = np.fromiter((len(c) >> 2 for c in coded), np.int64, len(coded))
    flat = np.frombuffer(b"".join(coded), np.uint32)
    begin, at = np.concatenate(([0], np.cumsum(size))), np.asarray(words.indices)
    count = size[at] if len(at) else np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(count)))
    source = np.repeat(begin[at] - ends[:-1], count) + np.arange(ends[-1]) if len(at) else np.zeros(0, np.int64)
    return flat[source], ends[np.asarray(parts.offsets)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``): one row a piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, limit=CHUNK):
            texts = pa.array([x or "" for x in strings(batch.column(1))]) if batch.column(1).null_count else batch.column(1)
            ids, bounds = encode(texts, path)
            length = np.diff(bounds) + 1
            many = -(-length // capacity)
            row = np.repeat(np.arange(len(length)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            size = np.minimum(length[row] - start, capacity)
            whole = np.insert(ids, bounds[1:], np.uint32(END)).astype("<u4", copy=False)
            begin = bounds[:-1][row] + row + start
            each = [whole[a : a + n] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size),
                       pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(each, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES.format(docs.schema["doc_id"].dataType.simpleString()) + (", ids array<long>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def bands(capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Ranges of lengths, from the longest to the shortest, that cover 1 to capacity - 1."""
    out, high = [], capacity - 1
    while high >= 1:
        share = high / capacity
        width = WIDE[1] if share > WIDE[0] else NARROW[1] if share > NARROW[0] else LAST
        low = int(high * width) + 1
        low = min(high, max([low, *(c for c in (capacity // 2 + 1, capacity // 3 + 1) if low <= c <= high)]))
        out.append((low, high))
        high = low - 1
    return out


def _parts(rows: int) -> int:
    return 1 + rows // ROWS


def numbered(df: DataFrame, *order, size: str, rows: int) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """Range-sorts rows and adds ``_part`` and ``_place`` (in the part).

    Also returns the rows before each part, and how many rows have each ``size``. The sort is
    written before it is counted, so a repeated task can't change it; about ``rows`` rows are few files.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = checkpointed(placed.coalesce(_parts(rows)))
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_place": F.col("_id").bitwiseAND((1 << 33) - 1)}).drop("_id")
    held = placed.groupBy("_part", size).count().collect()
    before = np.zeros(max([r["_part"] for r in held], default=-1) + 2, np.int64)
    sizes: dict[int, int] = {}
    for r in held:
        before[r["_part"] + 1] += r["count"]
        sizes[r[size]] = sizes.get(r[size], 0) + r["count"]
    return placed, np.cumsum(before), sizes


def _lookup(keys, values, key, otherwise: int = 0):
    """A column that maps ``key`` to one of few numbers."""
    if not len(keys):
        return F.lit(otherwise).cast("long")
    table = dict(zip(np.asarray(keys).tolist(), np.asarray(values).tolist(), strict=True))
    first, last = min(table), max(table)
    held = F.expr(f"array({','.join(f'{table.get(x, otherwise)}L' for x in range(first, last + 1))})")
    return F.coalesce(F.get(held, (key - F.lit(first)).cast("int")), F.lit(otherwise).cast("long"))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of at most ``capacity``."""
    cut = checkpointed(cut.withColumn("_u", F.monotonically_increasing_id()))
    full = cut.filter(F.col("length") == capacity).select(*[c for c in cut.columns if c != "_u"],
        (-1 - F.col("_u")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    docs, before, counts = numbered(cut.filter(F.col("length") < capacity), F.desc("length"), F.asc("_u"), size="length",
                                    rows=cut.count())
    columns = [c for c in cut.columns if c != "_u"]
    docs = docs.withColumn("_x", _lookup(range(len(before)), before, F.col("_part")) + F.col("_place")).drop("_part", "_place", "_u")
    shortest = min(counts, default=1)
    out, gaps, opened, placed_before = full, None, 0, 0
    for low, high in bands(capacity):
        lengths = np.array([x for x in range(low, high + 1) if x in counts], np.int64)
        if not len(lengths):
            continue
        many = np.array([counts[x] for x in lengths.tolist()], np.int64)
        n = int(many.sum())
        band = docs.filter(F.col("length").between(low, high))
        # Number in rising order of length; rows of one length are in any order.
        band = band.withColumn("_j", F.lit(placed_before + n - 1) - F.col("_x"))
        first = np.cumsum(many) - many
        sizes, bins, offers, slots = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        if gaps is not None:
            sorted_gaps, ahead, held = numbered(gaps, F.asc("gap"), F.asc("sequence_id"), size="gap", rows=opened)
            sizes = np.array(sorted(held), np.int64)
            bins = np.array([held[x] for x in sizes.tolist()], np.int64)
            offers = np.where(sizes < low, 0, np.maximum(1, sizes // high))
            slots = int((bins * offers).sum())
        slot_start, bin_start = np.cumsum(bins * offers) - bins * offers, np.cumsum(bins) - bins
        # succ: slots smaller than each length; shift: the running maximum of succ(i) - i.
        succ = np.append(slot_start, slots)[np.searchsorted(sizes, lengths)]
        shift = np.maximum.accumulate(succ - first)
        last = n - 1 + int(shift[-1])
        band = band.withColumn("_slot", F.col("_j") + _lookup(lengths, shift, F.col("length")))
        fresh = capacity // high
        # The first document beyond the last slot has number ``slots``, and those after it follow without holes.
        added = -(-max(0, last + 1 - slots) // fresh)
        taken = []
        if slots:
            place = _lookup(range(len(ahead)), ahead, F.col("_part")) + F.col("_place")
            offer = F.greatest(F.lit(1), F.floor(F.col("gap") / high))
            start = _lookup(sizes, slot_start, F.col("gap")) + (place - _lookup(sizes, bin_start, F.col("gap"))) * offer
            offered = sorted_gaps.filter(F.col("gap") >= low).withColumn("_start", start)
            offered = offered.filter(F.col("_start") <= min(last, slots - 1))
            offered = offered.withColumn("_slot", F.explode(F.sequence(F.col("_start"),
                F.least(F.col("_start") + offer - 1, F.lit(min(last, slots - 1))))))
            taken.append(band.filter(F.col("_slot") < slots).join(offered.select("_slot", "sequence_id", "gap"), "_slot"))
        if last >= slots:
            beyond = F.col("_slot") - F.lit(slots)
            taken.append(band.filter(F.col("_slot") >= slots).withColumns({
                "sequence_id": F.floor(beyond / fresh) + F.lit(opened), "gap": F.lit(capacity).cast("long")}))
        joined = taken[0] if len(taken) == 1 else taken[0].unionByName(taken[1])
        earlier = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        placed = joined.select(*columns, F.col("sequence_id").cast("long").alias("sequence_id"),
            (F.lit(capacity) - F.col("gap") + F.coalesce(F.sum("length").over(earlier), F.lit(0))).cast("long").alias("offset"))
        placed = checkpointed(placed.coalesce(_parts(n)))
        out = out.unionByName(placed)
        used = placed.groupBy("sequence_id").agg(F.max(F.col("offset") + F.col("length")).alias("_end"))
        used = used.select("sequence_id", (F.lit(capacity) - F.col("_end")).alias("gap"))
        # A sequence only ever fills up: its smallest gap is its present one.
        gaps = used if gaps is None else sorted_gaps.select("sequence_id", "gap").unionByName(used).groupBy(
            "sequence_id").agg(F.min("gap").alias("gap"))
        gaps = gaps.filter(F.col("gap") >= shortest)
        opened += added
        placed_before += n
    return out


def op11_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
