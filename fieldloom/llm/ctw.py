"""Language-model scoring by context-tree weighting over bytes.

The model is a context tree of the last ``ORDER`` bytes; each byte is decomposed into eight
binary choices, and every (context, bit prefix) has a Krichevsky-Trofimov estimate from its
zeros and ones in the training text. With P_e a node's KT probability of all it has seen, the
weighted probability is ``P_w = (P_e + product of P_w over longer contexts) / 2`` and
``P_w = P_e`` at the deepest ones, so the share of a node in a prediction is
``P_e / (2 P_w)`` and the rest goes to the longer context. Mixed bottom-up over all depths that
gives one table: the log-probability of each byte after each context. A text's score is the
sum over its bytes and an end mark; the code length per byte follows from it.

Texts are packed where they are read into parts of about ``PART`` bytes, written once. Each part counts its distinct
(context, byte) grams of ``ORDER`` bytes once, and packs them by the last ``TOP + 1`` bytes of
the context into shards. A shard merges the parts' counts and weights the contexts longer than
``TOP``; every observed context has a node, however rare, so the model grows with the corpus.
Grams of held-out texts travel with count 0: they add nothing and get their probability in the
same pass. Weights of contexts of up to ``TOP`` bytes (at most 2**16 of them) meet on the
driver. Each part then gets back the log-probabilities of its own grams and scores its texts;
no task holds the whole model.

``train``, ``ByteModel`` and ``log10_probability`` are a second form with a table of fixed size
for callers who need one in memory: there, contexts longer than two bytes with less than one in
``2**RARE_BITS`` of all training bytes share a branch. The query does not use it.

``base``: the unigram model of the contract. Word counts are exact over the training text. They
go the way of the grams: a part has each of its words once, as a 64-bit hash, shards by ranges
of the hash add the parts' counts up, and each part gets back the counts of its own words.

Edge cases: a null text is empty (only the end token); repeated rows count each; a null doc_id
is in no fold, trains nothing and is scored; with nothing to learn from, every byte has
probability 1/256; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed, fold

#: Depth and pooling of the table of fixed size.
DEPTH, RARE_BITS = 5, 16
#: Bytes of context of the query's tree; contexts of up to ``TOP`` are weighted on the driver.
ORDER, TOP = 6, 2
#: Bytes of text that are counted and scored together.
PART = 8 << 20
#: Grams that a task holds before it hands partial counts to the shuffle.
HELD = 1_500_000
#: Text that a task scores or counts at a time.
PIECE = 1 << 19
#: A byte that no UTF-8 text holds: the context before a text and the mark after it.
END = 0xFF
#: The hash under which the end token is counted; words have other hashes (up to 2**-64).
END_HASH = 1


def _framed(raw: np.ndarray, offs: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Lowered texts with ``depth`` marks before and one after each; positions of the predicted bytes."""
    n, size = len(offs) - 1, np.diff(offs)
    new = offs + (depth + 1) * np.arange(n + 1)
    flat = np.full(new[-1], END, np.uint8)
    at = np.arange(len(raw)) + np.repeat((depth + 1) * np.arange(n) + depth, size)
    flat[at] = K.LOWER[raw]
    predicted = np.ones(len(flat), bool)
    for j in range(depth):
        predicted[new[:-1] + j] = False
    return flat, np.flatnonzero(predicted)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of grams: the byte in the low bits, then the last byte before it, and so on up."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def merged() -> pa.RecordBatch:
        keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(np.add.reduceat(n, new, dtype=np.int64))],
            names=["gram", "n"])

    for batch in K.chunks(batches, limit=PIECE):
        flat, at = _framed(*K.text_bytes(batch.column(0)))
        if not len(at):
            continue
        f = flat.astype(np.int64)
        gram = f[at]
        for j in range(1, DEPTH + 1):
            gram |= f[at - j] << (8 * j)
        gram.sort()
        new = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
        parts.append((gram[new], np.diff(np.append(new, len(gram))).astype(np.int32)))
        held += len(new)
        if held > HELD:
            yield merged()
            parts, held = [], 0
    if parts:
        yield merged()


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) by Stirling's series, shifted up by 8 for small n."""
    x = n + 8.5
    s = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    for j in range(8):
        s -= np.log(n + 0.5 + j)
    return s


def _log_gamma_whole(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1)."""
    x = n + 9.0
    s = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    for j in range(8):
        s -= np.log(n + 1.0 + j)
    return s


def _bits(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at the 255 binary nodes of each row of 256 byte counts; node 2**d - 1 + prefix."""
    rows = len(counts)
    zeros, ones = np.empty((rows, 255)), np.empty((rows, 255))
    for d in range(8):
        halves = counts.reshape(rows, 2 << d, 256 >> (d + 1)).sum(axis=2)
        zeros[:, (1 << d) - 1 : (2 << d) - 1] = halves[:, ::2]
        ones[:, (1 << d) - 1 : (2 << d) - 1] = halves[:, 1::2]
    return zeros, ones


def _kt(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of all seen, and the predictive probability of a one."""
    log_seen = _log_gamma_half(zeros) + _log_gamma_half(ones) - _log_gamma_whole(zeros + ones) - math.log(math.pi)
    return log_seen, (ones + 0.5) / (zeros + ones + 1)


def _nodes(counts: np.ndarray, below: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted log probability, own share and own prediction at the 255 binary nodes of each row of counts.

    ``below`` is what the longer contexts weigh; without it a row is a leaf and keeps its own estimate.
    Slices of rows keep the temporaries small.
    """
    n = len(counts)
    weight, share, one = np.empty((n, 255)), np.ones((n, 255), np.float32), np.empty((n, 255))
    for i in range(0, n, 512):
        part = slice(i, i + 512)
        seen, one[part] = _kt(*_bits(counts[part]))
        if below is None:
            weight[part] = seen
        else:
            weight[part] = np.logaddexp(seen, below[part]) - math.log(2)
            share[part] = np.exp(seen - math.log(2) - weight[part])
    return weight, share, one


OTHER = 256
NODES = "path array<int>, kind string, v binary"


def _weigh(key, rows):
    """The tree of one last byte: its weighted log probability, its counts, and the prediction at each of its contexts.

    ``path`` holds the context's bytes, last first; OTHER ends it where rarer ones share a branch.
    """
    import pandas as pd

    paths = np.array(rows["path"].tolist(), np.int64)  # one row a (leaf, byte), padded with -1 after OTHER
    leaves, at = np.unique(paths, axis=0, return_inverse=True)
    counts = np.zeros((len(leaves), 256))
    np.add.at(counts, (at.ravel(), rows["byte"].to_numpy()), rows["n"].to_numpy())
    weight, _, one = _nodes(counts)
    out = []
    level = leaves
    for depth in range(DEPTH - 1, 0, -1):
        # Contexts of ``depth`` bytes; rows of ``level`` that end before are passed on as they are.
        longer = (level[:, depth] != -1)
        parents, parent = np.unique(level[longer, :depth], axis=0, return_inverse=True)
        parent = parent.ravel()
        if depth == DEPTH - 1:
            kept = level[longer & (level[:, depth] != OTHER)]
            out += list(zip(kept.tolist(), one[longer & (level[:, depth] != OTHER)]))
        total, below = np.zeros((len(parents), 256)), np.zeros((len(parents), 255))
        np.add.at(total, parent, counts[longer])
        np.add.at(below, parent, weight[longer])
        mixed, share, own = _nodes(total, below)
        rest = np.full((len(parents), 255), 0.5)
        other = longer & (level[:, depth] == OTHER)
        rest[parent[other[longer]]] = one[other]
        # What was found for longer contexts now gets this depth's share.
        place = {tuple(p): i for i, p in enumerate(parents.tolist())}
        out = [(p, share[i] * own[i] + (1 - share[i]) * v) for p, v in out for i in (place[tuple(p[:depth])],)]
        out += [(p, share[i] * own[i] + (1 - share[i]) * rest[i]) for i, p in enumerate(parents.tolist())]
        padded = np.full((len(parents), DEPTH), -1, np.int64)
        padded[:, :depth] = parents
        level = np.concatenate((level[~longer], padded))
        counts, weight, one = (np.concatenate((x[~longer], y)) for x,
            y in ((counts, total), (weight, mixed), (one, own)))
    c1 = int(key[0])
    rows_out = [([c1], "top", weight[0].tobytes()), ([c1], "counts", counts[0].tobytes())]
    # Log-odds keep a probability next to 1 apart from 1 in single precision.
    rows_out += [([x for x in p if x >= 0], "row", (np.log(v) - np.log1p(-v)).astype(np.float32).tobytes()) for p,
        v in out]
    return pd.DataFrame(rows_out, columns=["path", "kind", "v"])


class ByteModel:
    """log10 probabilities of the next byte by context, and the trie from contexts to them.

    ``pairs`` gives the node of the last two bytes. ``child[inner[node], byte]`` is the node of
    the context that is longer by ``byte``, or 0; ``inner`` is 0 for nodes without longer ones.
    """

    def __init__(self, paths: list[tuple[int, ...]], table: np.ndarray):
        self.table = table  # row 0: nothing known
        node = {p: i + 1 for i, p in enumerate(paths)}
        self.pairs = np.zeros(65536, np.int32)
        for c1 in range(256):
            self.pairs[c1::256] = node.get((c1,), 0)
        for p, i in node.items():
            if len(p) == 2:
                self.pairs[p[1] << 8 | p[0]] = i
        inner = sorted({p[:-1] for p in paths if len(p) > 2})
        self.inner = np.zeros(len(paths) + 1, np.int32)
        self.child = np.zeros((len(inner) + 1, 256), np.int32)
        for k, p in enumerate(inner):
            self.inner[node[p]] = k + 1
        for p, i in node.items():
            if len(p) > 2:
                self.child[self.inner[node[p[:-1]]], p[-1]] = i

    def nodes(self, f: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The longest context of each position."""
        found = self.pairs[f[at - 2] << 8 | f[at - 1]]
        inner = self.inner[found]
        for j in range(3, DEPTH + 1):
            longer = self.child[inner, f[at - j]]
            found = np.where(longer > 0, longer, found)
            inner = self.inner[longer]
        return found


def _bytes_of_bits(one: np.ndarray) -> np.ndarray:
    """log10 probabilities of 256 bytes from 255 bit predictions a row."""
    p = np.zeros((len(one), 256))
    byte = np.arange(256)
    for d in range(8):
        node = (1 << d) - 1 + (byte >> (8 - d))
        p += np.log10(np.where(byte >> (7 - d) & 1, one[:, node], 1 - one[:, node]))
    return p.astype(np.float16)


def train(texts: DataFrame) -> ByteModel:
    """Counts the grams of a text column, weights the tree and lays out the table."""
    uniform = np.full((1, 256), -math.log10(256), np.float16)
    grams = checkpointed(texts.mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = grams.agg(F.sum("n")).first()[0] or 0
    if total == 0:
        return ByteModel([], uniform)
    byte = lambda j: F.shiftright("gram", 8 * j).bitwiseAND(255).cast("int")
    # Counts of the longest contexts first; each shorter length is summed from the one before.
    contexts = grams.groupBy(F.shiftright("gram", 8).alias("x")).agg(F.sum("n").alias("m"))
    split, open_ = grams, F.lit(True)
    steps = [byte(1), byte(2)]
    for depth in range(DEPTH, 2, -1):
        mask = (1 << (8 * depth)) - 1
        if depth < DEPTH:
            contexts = contexts.groupBy(F.col("x").bitwiseAND(F.lit(mask)).alias("x")).agg(F.sum("m").alias("m"))
        often = contexts.filter(F.col("m") * F.lit(1 << RARE_BITS)
            >= F.lit(total)).select(F.col("x").alias(f"x{depth}"), F.lit(True).alias(f"often{depth}"))
        split = split.join(F.broadcast(often), F.shiftright("gram", 8).bitwiseAND(F.lit(mask)) == F.col(f"x{depth}"),
            "left")  # at most 2**RARE_BITS rows
    for depth in range(3, DEPTH + 1):
        steps.append(F.when(~open_, F.lit(-1)).when(F.col(f"often{depth}"), byte(depth)).otherwise(OTHER))
        open_ = open_ & F.coalesce(F.col(f"often{depth}"), F.lit(False))
    split = split.select(F.array(*steps).alias("path"), byte(0).alias("byte"), "n").groupBy("path",
        "byte").agg(F.sum("n").alias("n"))
    nodes = checkpointed(split.groupBy(F.col("path")[0].alias("c1")).applyInPandas(_weigh, NODES))
    tops, counts, paths, ones = np.zeros(255), np.zeros(256), [], []
    for r in nodes.toLocalIterator():
        if r["kind"] == "top":
            tops += np.frombuffer(r["v"])
        elif r["kind"] == "counts":
            counts += np.frombuffer(r["v"])
        else:
            paths.append(tuple(r["path"]))
            ones.append(np.frombuffer(r["v"], np.float32))
    _, share, own = _nodes(counts[None, :], tops[None, :])
    below = np.stack([np.zeros(255, np.float32), *ones])
    ones.clear()
    chance = lambda z: 1 / (1 + np.exp(-z.astype(float)))
    table = [_bytes_of_bits(share * own + (1 - share) * chance(below[i : i + 1024])) for i in range(0, len(below),
        1024)]
    return ByteModel(paths, np.concatenate(table))


def log10_probability(model: ByteModel, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of each row's bytes and end mark."""
    flat, at = _framed(raw, offs)
    if not len(at):
        return np.zeros(len(offs) - 1)
    f = flat.astype(np.int32)
    p = model.table[model.nodes(f, at), f[at]]
    return np.add.reduceat(p.astype(np.float64), offs[:-1] + np.arange(len(offs) - 1))


# ---- every observed context has its node ------------------------------------------------


def _unique(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(n, new, dtype=np.int64)


def _keys(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The context, last byte on top, and the byte after it in the lowest bits."""
    f = flat.astype(np.int64)
    key = f[at - 1]
    for j in range(2, ORDER + 1):
        key = key << 8 | f[at - j]
    return key << 8 | f[at]


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    """Contexts with the same last ``TOP + 1`` bytes stand together."""
    return (K.mix64((keys >> (8 * (ORDER - TOP))).astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _pack_planes(x: np.ndarray) -> bytes:
    """For values whose high bytes say little: all first bytes, then all second ones, and so on."""
    return _pack(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T)


def _unpack_planes(raw: bytes, n: int, kind) -> np.ndarray:
    planes = _unpack(raw, n * np.dtype(kind).itemsize, np.uint8)
    return np.ascontiguousarray(planes.reshape(-1, n).T).view(kind).ravel() if n else np.zeros(0, kind)


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every token: the words, then an end a row."""
    rows = len(offs) - 1
    hashes, row, _ = K.words(raw, offs)
    return (np.concatenate((hashes.view(np.int64), np.full(rows, END_HASH))),
        np.concatenate((row, np.arange(rows))))


def _word_shard(words: np.ndarray, shards: int) -> np.ndarray:
    """Shards of words are ranges of their hashes; they are numbered after those of the grams."""
    return shards + (((words >> 32) + (1 << 31)) * shards >> 32)


def _counted(shards: int):
    """Distinct grams and words of a part of the texts, with their counts in training texts, packed by shard."""

    def counted(part: int, texts: bytes) -> pa.RecordBatch:
        parts, tokens = [], []
        for batch in _pieces(texts):
            raw, offs = K.text_bytes(batch.column(batch.schema.get_field_index("text")))
            flat, at = _framed(raw, offs, ORDER)
            learns = batch.column(batch.schema.get_field_index("train")).to_numpy(zero_copy_only=False)
            gram = _keys(flat, at) << 1 | np.repeat(learns, np.diff(offs) + 1)
            gram.sort()
            new = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            parts.append((gram[new], np.diff(np.append(new, len(gram)))))
            words, row = _words(raw, offs)
            tokens.append(_unique(words, learns[row]))
        keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        keys, n = _unique(keys >> 1, n * (keys & 1))
        shard = _shard(keys, shards)
        order = np.argsort(shard, kind="stable")
        ids, begin = np.unique(shard[order], return_index=True)
        out = [(int(s), part, len(x), _pack(np.diff(keys[x], prepend=0)), _pack(n[x].astype(np.int32))) for s,
            x in zip(ids, np.split(order, begin[1:]))]
        words, n = _unique(*(np.concatenate(x) for x in zip(*tokens)))
        ids, begin = np.unique(_word_shard(words, shards), return_index=True)
        out += [(int(s), part, len(w), _pack_planes(np.diff(w, prepend=0)), _pack(c.astype(np.int32))) for s, w,
            c in zip(ids, np.split(words, begin[1:]), np.split(n, begin[1:]))]
        return pa.RecordBatch.from_pylist([dict(zip(_COUNTED.names, r)) for r in out], schema=_COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield counted(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())

    return run


_COUNTED = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("size", pa.int64()), ("grams", pa.binary()),
    ("n", pa.binary())])
_SHARDS = pa.schema(
    [("shard", pa.int64()), ("size", pa.int64()), ("tokens", pa.int64()), ("known", pa.int64()), ("grams", pa.binary()),
        ("n", pa.binary())]
    + [("tops", pa.int64()), ("node", pa.binary()), ("below", pa.binary()), ("zeros", pa.binary()),
        ("ones", pa.binary())]
    + [("parts", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))]
)


class _Levels:
    """Weighted binary nodes of the contexts of ``TOP + 1`` to ``ORDER`` bytes in one shard; only observed ones exist."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, down = keys, np.arange(len(keys))
        self.levels = []  # longest contexts first: place of each gram, and by bit (group, share, zeros, ones)
        weight, inverse, self.up = None, None, None
        for depth in range(ORDER, TOP, -1):
            if depth < ORDER:
                keys, inverse = np.unique(keys >> 16 << 8 | keys & 255, return_inverse=True)
                n = np.bincount(inverse, n, minlength=len(keys)).astype(np.int64)
                down = inverse[down]
            bits, weights = [], []
            for j in range(8):
                new = np.concatenate(([True], np.diff(keys >> (8 - j)) != 0))
                group, first = np.cumsum(new) - 1, np.flatnonzero(new)
                ones = np.add.reduceat(n * (keys >> (7 - j) & 1), first)
                zeros = np.add.reduceat(n, first) - ones
                seen, _ = _kt(zeros, ones)
                share, w = np.ones(len(first)), seen
                if weight is not None:
                    child_first, child_weight = weight[j]
                    below = np.bincount(group[inverse[child_first]], child_weight, minlength=len(first))
                    w = np.logaddexp(seen, below) - math.log(2)
                    share = np.exp(seen - math.log(2) - w)
                bits.append((group, share, zeros, ones))
                weights.append((first, w))
            weight = weights
            self.levels.append((down, bits))
        self.top_keys, self.weight = keys, weight

    def summary(self) -> tuple[np.ndarray, ...]:
        """Of the contexts of ``TOP`` bytes: binary node, weight below it, zeros and ones."""
        found = []
        for j, ((first, w), (_, _, zeros, ones)) in enumerate(zip(self.weight, self.levels[-1][1])):
            found.append((_node(self.top_keys[first] >> 16, self.top_keys[first] & 255, j), w, zeros, ones))
        node, below, zeros, ones = (np.concatenate(x) for x in zip(*found))
        at, inverse = np.unique(node, return_inverse=True)
        return at, *(np.bincount(inverse, x, minlength=len(at)) for x in (below, zeros, ones))

    def log10(self, top: tuple[np.ndarray, ...]) -> np.ndarray:
        """log10 probability of each gram; ``top`` has what contexts of up to ``TOP`` bytes say of a zero, of a one, and the rest."""
        out, byte, node, zero, one, left = np.zeros(len(self.keys)), self.keys & 255, *top
        for j in range(8):
            bit, p = byte >> (7 - j) & 1, None
            for down, bits in self.levels:
                group, share, zeros, ones = bits[j]
                own = (np.stack((zeros, ones)) + 0.5) / (zeros + ones + 1)
                g = group[down]
                p = own[bit, g] if p is None else share[g] * own[bit, g] + (1 - share[g]) * p
            at = np.searchsorted(node, _node(self.keys >> (8 * (ORDER - TOP + 1)), byte, j))
            out += np.log10(np.where(bit, one[at], zero[at]) + left[at] * p)
        return out


def _node(context: np.ndarray, byte: np.ndarray, j: int) -> np.ndarray:
    return context << 8 | ((1 << j) - 1 + (byte >> (8 - j)))


def _sharded(shards: int):
    """All of a shard in one row: its grams or words with their counts, what its trees weigh, and which of them each part has."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        shard, nothing = rows[0]["shard"], np.zeros(0)
        unpack = _unpack if shard < shards else _unpack_planes
        found = [np.cumsum(unpack(r["grams"], r["size"], np.int64)) for r in rows]
        keys, n = _unique(np.concatenate(found), np.concatenate([_unpack(r["n"], r["size"], np.int32) for r in rows]))
        places = [_pack(np.diff(np.searchsorted(keys, x), prepend=0).astype(np.int32)) for x in found]
        if shard < shards:
            node, *sums = _Levels(keys, n).summary()
            row = [shard, len(keys), 0, 0, _pack(np.diff(keys, prepend=0)), _pack(n)]
        else:
            node, *sums = [nothing] * 4
            row = [shard, len(keys), int(n.sum()), int(np.count_nonzero(n)), b"", _pack(n)]
        row += [len(node), _pack(node), *map(_pack, sums)]
        row += [[r["part"] for r in rows], [r["size"] for r in rows], places]
        return pa.Table.from_pylist([dict(zip(_SHARDS.names, row))], schema=_SHARDS)

    return run


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            columns = [_unpack(r[c], r["tops"], np.int64 if c == "node" else float) for c in ("node", "below", "zeros",
                "ones")]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["node", "below", "zeros", "ones"])


def _short_contexts(node: np.ndarray, below: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weighs contexts of ``TOP`` bytes down to none; then what all of them together say, at each node of ``TOP`` bytes."""
    place, levels = np.arange(len(node)), []
    for depth in range(TOP, -1, -1):
        seen, _ = _kt(zeros, ones)
        weight = np.logaddexp(seen, below) - math.log(2)
        levels.append((place, np.exp(seen - math.log(2) - weight), (zeros + 0.5) / (zeros + ones + 1),
            (ones + 0.5) / (zeros + ones + 1)))
        if depth:
            shorter, inverse = np.unique(node >> 16 << 8 | node & 255, return_inverse=True)
            place = inverse[place]
            below, zeros, ones = (np.bincount(inverse, x, minlength=len(shorter)) for x in (weight, zeros, ones))
            node = shorter
    zero, one, left = 0.0, 0.0, 1.0
    for place, share, no, yes in reversed(levels):
        zero, one, left = zero + left * share[place] * no[place], one + left * share[place] * yes[place], left * (1
            - share[place])
    return zero, one, left


def _scored(top, shards: int):
    """What each part gets from a shard, in the order of its keys: log10 probabilities of grams, or counts of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                values = _unpack(r["n"], r["size"], np.int64)
                if r["shard"] < shards:
                    keys = np.cumsum(_unpack(r["grams"], r["size"], np.int64))
                    values = _Levels(keys, values).log10(top.value).astype(np.float32)
                for part, size, places in zip(r["parts"], r["sizes"], r["places"]):
                    at = np.cumsum(_unpack(places, size, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([r["shard"]]), pa.array([size]),
                        pa.array([_pack_planes(values[at])], pa.binary())], names=["part", "shard", "size", "v"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of about ``PART`` bytes of text together, compressed: a part holds its rows as one value."""

    def pack(held: list[pa.RecordBatch], size: int) -> pa.RecordBatch:
        sink, options = pa.BufferOutputStream(), pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
            out.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([size]), pa.array([sink.getvalue().to_pybytes()], pa.binary())],
            names=["bytes", "texts"])

    held, size = [], 0
    for batch in K.chunks(batches, limit=PIECE):
        held.append(batch)
        size += int(K.text_bytes(batch.column(batch.schema.get_field_index("text")))[1][-1])
        if size >= PART:
            yield pack(held, size)
            held, size = [], 0
    if held:
        yield pack(held, size)


def _parted(docs: DataFrame, held_out, train) -> tuple[DataFrame, int]:
    """part, bytes, texts: the rows in parts of about ``PART`` bytes of text, and the number of shards for them."""
    rows = docs.select("doc_id", held_out.alias("held_out"), train.alias("train"), "text")
    parted = checkpointed(rows.mapInArrow(_packed, "bytes long, texts binary").select(
        F.monotonically_increasing_id().alias("part"), "bytes", "texts"))
    return parted, (parted.agg(F.sum("bytes")).first()[0] or 0) // PART + 1


def _pieces(texts: bytes) -> Iterator[pa.RecordBatch]:
    yield from K.chunks(pa.ipc.open_stream(texts), limit=PIECE)


def sharded(parted: DataFrame, parts: int) -> DataFrame:
    """A row a shard, written once: grams and words of all texts with their counts in training texts."""
    counted = parted.select("part", "texts").mapInArrow(_counted(parts),
        "shard long, part long, size long, grams binary, n binary")
    return checkpointed(counted.groupBy("shard").applyInArrow(_sharded(parts),
        "shard long, size long, tokens long, known long, grams binary, n binary, tops long, node binary, below binary, zeros binary, ones binary, parts array<long>, sizes array<long>, places array<binary>"
    ))


def part_values(shards: DataFrame, parts: int) -> DataFrame:
    """part, shard, size, v: log10 probabilities of a part's grams under the tree of all training texts, and counts of its words."""
    # At most 2**16 contexts of two bytes with 255 binary nodes each; only those that occur.
    tops = shards.filter(F.col("shard") < parts).select("tops", "node", "below", "zeros", "ones").mapInArrow(_tops,
        "node long, below double, zeros double, ones double")
    tops = tops.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("below", "zeros", "ones")]).toArrow().sort_by("node")
    columns = [tops.column(c).to_numpy() for c in ("node", "below", "zeros", "ones")]
    top = shards.sparkSession.sparkContext.broadcast((columns[0], *_short_contexts(*columns)))
    return shards.select("shard", "size", "grams", "n", "parts", "sizes", "places").mapInArrow(_scored(top, parts),
        "part long, shard long, size long, v binary")


def _indexed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.empty(len(values), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], place


def _distinct(sorted_pieces: list[np.ndarray]) -> np.ndarray:
    every = np.sort(np.concatenate(sorted_pieces))
    return every[np.concatenate(([True], every[1:] != every[:-1]))]


def _looked_up(texts: bytes, values: pa.Table, shards: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of a part with the log10 probability of each framed byte, and row and count of each token.

    A piece asks for each of its keys once and in their order: lookups in the order of the text would miss the cache.
    """
    pieces = []
    for batch in _pieces(texts):
        raw, offs = K.text_bytes(batch.column(batch.schema.get_field_index("text")))
        words, row = _words(raw, offs)
        pieces.append((batch, _indexed(_keys(*_framed(raw, offs, ORDER))), _indexed(words), row))
    got = sorted(values.select(["shard", "size", "v"]).to_pylist(), key=lambda r: r["shard"])
    grams, words = _distinct([p[1][0] for p in pieces]), _distinct([p[2][0] for p in pieces])
    p = np.empty(len(grams), np.float32)
    p[np.argsort(_shard(grams, shards), kind="stable")] = np.concatenate([_unpack_planes(r["v"], r["size"], np.float32) for r in got
        if r["shard"] < shards])
    c = np.concatenate([_unpack_planes(r["v"], r["size"], np.int64) for r in got if r["shard"] >= shards])
    for batch, (own, place), (own_words, token), row in pieces:
        yield (batch, p[np.searchsorted(grams, own)].astype(float)[place], row,
            c[np.searchsorted(words, own_words)][token])


def op8_query(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), bits_per_byte."""
    parted, parts = _parted(docs, F.coalesce(fold("doc_id", folds) == held, F.lit(False)),
        F.coalesce(fold("doc_id", folds) != held, F.lit(False)))
    shards = sharded(parted, parts)
    n, v = shards.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    norm = math.log10(n + 1 * (v + 1))

    def run(part: pa.Table, values: pa.Table) -> pa.Table:
        done = []
        for batch, p, row, c in _looked_up(part["texts"][0].as_py(), values, parts):
            _, offs = K.text_bytes(batch.column(3))
            rows = batch.num_rows
            tokens, known = np.bincount(row, minlength=rows), np.bincount(row[c > 0], minlength=rows)
            base = np.bincount(row, np.log10(c + 1) - norm, minlength=rows)
            score = np.add.reduceat(p, offs[:-1] + np.arange(rows))
            done.append(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), pa.array(known),
                pa.array(base), pa.array(score), pa.array(np.diff(offs))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"]))
        return pa.Table.from_batches(done)

    scored = parted.select("part", "texts").groupBy("part").cogroup(part_values(shards, parts).groupBy("part")).applyInArrow(run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score",
        "score", (-F.col("score") / F.lit(math.log10(2)) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
