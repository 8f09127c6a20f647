"""What op8_ctw ships: compressed parts of texts, and each gram and word of a part once."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from fieldloom.llm import ctw
from fieldloom.llm import kernels as K

TEXTS = ["the cat sat on the mat", None, "", "The CAT and the dog é", "a b c a b c", "mat " * 40]


def batches():
    for i in range(0, len(TEXTS), 2):
        ids = list(range(i, i + 2))
        yield pa.RecordBatch.from_pydict({"doc_id": ids, "held_out": [x == 3 for x in ids], "train": [x != 3 for x in ids],
            "text": pa.array(TEXTS[i : i + 2], pa.string())})


def test_no_row_a_document_and_word_is_shuffled(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    plan = ctw.op8_query(d)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "Generate" not in plan and "Join" not in plan


def test_parts_keep_every_row_in_order(monkeypatch):
    for size, parts in ((30, 4), (1 << 20, 1)):
        monkeypatch.setattr(ctw, "PART", size)
        packed = [r for b in ctw._packed(batches()) for r in b.to_pylist()]
        rows = [r for p in packed for piece in ctw._pieces(p["texts"]) for r in piece.to_pylist()]
        assert len(packed) <= parts and sum(p["bytes"] for p in packed) == sum(len((t or "").encode()) for t in TEXTS)
        assert [r["doc_id"] for r in rows] == list(range(len(TEXTS))) and [r["text"] for r in rows] == TEXTS
        assert [r["held_out"] for r in rows] == [r == 3 for r in range(len(TEXTS))]


def test_a_part_counts_each_word_once():
    """Words of held-out texts come with count 0, and an end counts once a training text."""
    packed = next(ctw._packed(batches()))
    part = pa.RecordBatch.from_arrays([pa.array([7]), packed.column(1)], names=["part", "texts"])
    shards = 3
    rows = [r for b in ctw._counted(shards)(iter([part])) for r in b.to_pylist() if r["shard"] >= shards]
    got = {}
    for r in rows:
        assert r["part"] == 7 and r["shard"] < 2 * shards
        words = np.cumsum(ctw._unpack_planes(r["grams"], r["size"], np.int64))
        assert len({*words.tolist()} & got.keys()) == 0
        got |= dict(zip(words.tolist(), ctw._unpack(r["n"], r["size"], np.int32).tolist()))
    want = Counter({ctw.END_HASH: len(TEXTS) - 1})
    for i, t in enumerate(TEXTS):
        for w in (t or "").lower().split():
            h = K.words(*K.text_bytes(pa.array([w])))[0].view(np.int64)[0]
            want[int(h)] += i != 3
    assert got == dict(want) and 0 in got.values()


def test_planes_give_back_all_values():
    rng = np.random.default_rng(1)
    for x in (rng.integers(-(1 << 63), (1 << 63) - 1, 100), np.zeros(0, np.int64), rng.random(9).astype(np.float32)):
        assert np.array_equal(ctw._unpack_planes(ctw._pack_planes(x), len(x), x.dtype), x)
    hashes = np.array([-(1 << 63), -1, 0, 1, (1 << 63) - 1])
    assert ctw._word_shard(hashes, 4).tolist() == [4, 5, 6, 6, 7]


def test_scores_of_a_text_do_not_depend_on_its_partition(spark):
    rows = [(i, f"{zlib.crc32(str(i).encode())} word{i % 7} the mat") for i in range(60)]
    one, many = (spark.createDataFrame(rows, "doc_id long, text string").repartition(n) for n in (1, 9))
    a, b = ({r["doc_id"]: r for r in ctw.op8_query(d).collect()} for d in (one, many))
    assert a.keys() == b.keys() == set(range(60))
    for i in a:
        assert a[i][:5] == b[i][:5] and abs(a[i]["score"] - b[i]["score"]) < 1e-4
        assert abs(a[i]["base_score"] - b[i]["base_score"]) < 1e-9
