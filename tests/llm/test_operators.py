import hashlib
import json
import math
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import ctw, decontam, gif, html, langid, mixing, neardup, pii, toolcalls, toxicity
from fieldloom.llm import kernels as K

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, ties, a repeated row, a very long text and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    rows = [(1, None, None, None, 0), (2, "", "en", "b", 0), (3, " \t\n ", "en", None, 0), (4, "one two", "en", "a", 0),
        (4, "one two", "en", "a", 0), (5, long, "de", "a", 0), (None, "one two", None, "a", 0),
        (6, "É ß 中文 \U0001f600", "fr", "b", 0)]
    return spark.createDataFrame(rows, DOC).selectExpr("*", "1 as score", "2 as size", "3 as spans", "4 as bands")


def empty(spark):
    return spark.createDataFrame([], DOC)


# ---- op1 ----


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda s: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda s: 14 <= len(re.sub(r"\D", "",
        s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda s: 10 <= len(re.sub(r"\D", "", s)) <= 15),
]


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, (_, r, ok) in enumerate(BASE) for m in r.finditer(text) if ok(m.group())]
    return sorted(found)


def test_base_spans_equal_plain_patterns(docs):
    rng = np.random.default_rng(0)
    texts = [r["text"] for r in docs.collect()] + ["".join(rng.choice(list("ab1295@.-+ ()"), 60)) for _ in range(3000)]
    texts += ["a@b.c@d.e", "@a.b", "x@y", "1.2.3.4.5.6.7.8", "999.1.1.1", "4" * 30, "+1 (234) 555-0199",
        "a@b.co. z@q.r-"]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_personal_data_query_and_disclosure(spark, odd):
    rows = [(i, f"call Zweibrunn now at bob@x.org and of the rest {i}", "en", "a", 0) for i in range(3)] + [(10 + i,
        "of the now and rest at call", "en", "a", 0) for i in range(60)]
    d = spark.createDataFrame(rows, DOC)
    got = {r["doc_id"]: r for r in pii.op1_query(d).collect()}
    assert got[0]["n_email"] == 1 and "term:5:14" in got[0]["spans"] and got[0]["n_terms"] == 1 and got[10][
        "spans"] == ""
    base = "email:22:31"
    assert got[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(d).collect()}
    assert clean[1] == "call <EMAIL TERM> now at <EMAIL> and of the rest 1" and clean[10] == rows[3][1]
    assert pii.op1_query(odd).count() == 8 and pii.op1_query(empty(spark)).count() == 0
    assert pii.sanitise(odd).columns == odd.columns


# ---- op2 ----


def test_language_held_out(docs, spark, odd):
    got = {r["doc_id"]: r for r in langid.op2_query(docs).collect()}
    held = [r for r in docs.collect() if got[r["doc_id"]]["held_out"]]
    assert all(got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in docs.collect())
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.9
    out = [r for r in langid.op2_query(odd).collect()]
    assert [r["lang_pred"] for r in out if r["doc_id"] in (1, 2,
        3)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in out)
    assert langid.op2_query(empty(spark)).count() == 0


# ---- op3 ----


def small_lzw(samples, bits):
    """A plain encoder with growing codes, for the decoder's table."""
    clear, codes, width, nxt, table, p = 1 << bits, [], bits + 1, (1 << bits) + 2, {}, None
    codes.append((clear, width))
    for s in samples:
        if p is None:
            p = (s,)
        elif p + (s,) in table:
            p += (s,)
        else:
            codes.append((table.get(p, p[0]), width))
            if nxt < 4096:
                table[p + (s,)] = nxt
                if nxt == 1 << width and width < 12:
                    width += 1
                nxt += 1
            else:
                codes.append((clear, width))
                width, nxt, table = bits + 1, (1 << bits) + 2, {}
            p = (s,)
    codes.append((table.get(p, p[0]), width))
    if nxt == 1 << width and width < 12:
        width += 1
    codes.append((clear + 1, width))
    out, acc, have = bytearray(), 0, 0
    for c, w in codes:
        acc |= c << have
        have += w
        while have >= 8:
            out.append(acc & 255)
            acc >>= 8
            have -= 8
    out.append(acc & 255)
    return bytes(out)


def block(data):
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def picture(frames, w=4, h=2):
    palette = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    out = b"GIF89a" + struct.pack("<HHBBB", w, h, 0x81, 0, 0) + palette
    for delay, disposal, through, box, samples in frames:
        out += b"\x21\xf9\x04" + bytes([disposal << 2 | (through is not None)]) + struct.pack("<HBB", delay,
            through or 0, 0) + b"\x2c" + struct.pack("<HHHHB", *box, 0) + b"\x02" + block(small_lzw(samples, 2))
    return out + b"\x3b"


def test_gif_frames_disposal_and_transparency(spark):
    full, dot = (0, 0, 4, 2), (1, 0, 2, 1)
    data = picture([(5, 0, None, full, [0] * 8), (7, 3, 3, dot, [1, 3]), (9, 2, None, dot, [2, 2]),
        (1, 0, 3, dot, [3, 3])])
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no")), (3, None)], "id long, content binary")
    rows = gif.gif_frames(files).orderBy("id", "frame").collect()
    shown = [[struct.unpack("<8I", bytes(r["rgba"]))[i] for i in range(8)] for r in rows if r["id"] == 1]
    red, green, blue = 0xFF0000FF, 0xFF00FF00, 0xFFFF0000
    assert shown[1][:4] == [red, green, red, red] and shown[2][:4] == [red, blue, blue, red] and shown[3][:4] == [red,
        0, 0, red]
    assert [r["delay_cs"] for r in rows if r["id"] == 1] == [5, 7, 9, 1] and sum(rows[0]["histogram"]) == 8
    assert [r["error"] is not None for r in rows if r["id"] != 1] == [True, True]


@pytest.mark.parametrize("n", [1, 2, 254, 255, 256, 300, 5000, 70_000])
def test_lzw_round_trips(n):
    s = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    assert gif.lzw_decode(gif.lzw_encode(s.tobytes()), 8,
        n).tobytes() == s.tobytes() and gif.lzw_encode(s.tobytes()).rstrip(b"\0") == small_lzw(s.tolist(),
        8).rstrip(b"\0")
    rep = (s % 3).astype(np.uint8)
    assert gif.lzw_decode(gif.lzw_encode(rep.tobytes()), 8, n).tobytes() == rep.tobytes()
    assert gif.lzw_decode(small_lzw(rep.tolist(), 8), 8, n).tobytes() == rep.tobytes()


def test_stored_texts(odd, spark):
    rows = gif.op3_query(odd).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    for r, t in zip(rows, texts):
        raw = t.encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p),
            hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_sha256"] == hashlib.sha256(gif.store_text(t.encode())).hexdigest()
    assert rows[5]["n_frames"] > 1 and gif.op3_query(empty(spark)).count() == 0


# ---- op4 ----


def test_toxicity_held_out_and_misspellings(spark, odd):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(["the", "on", "er", "ti", "sh", "re"], 2)) for _ in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        w = list(rng.choice(words, 60))
        if toxic:
            w[3:5] = [f"grubble{rng.choice(words)}", f"grubble{rng.choice(words)}"]
        rows.append((i, " ".join(w), "en", "a", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(9000, " ".join(list(rng.choice(words, 40)) + ["grubbleononer", "Grubbletishre"]), "en", "a", 0),
        (9001, " ".join(rng.choice(words, 40)), "en", "a", 0)]
    d, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels + [(77777, 1, 1), (None, 0, 1),
        (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    got = {r["doc_id"]: r for r in toxicity.scores(d, model).collect()}
    held = [i for i in range(600) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.97
    assert got[9000]["predicted"] == 1 and got[9001]["predicted"] == 0
    kept = toxicity.scores(d, model, keep=True)
    assert kept.columns == d.columns and kept.count() == sum(r["predicted"] == 0 for r in got.values())
    assert toxicity.scores(odd, model).count() == 8 and toxicity.op4_query(empty(spark), lab).count() == 0


# ---- op5 ----


def plain_components(rows):
    sets, out = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75
        * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_equal_brute_force(spark, odd):
    rng = np.random.default_rng(4)
    base = [f"b{rng.integers(0, 500)}" for _ in range(60)]
    rows = []
    for i in range(90):  # a cloud of near copies around one text, and texts that share a passage
        w = list(base)
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, 60)] = f"c{rng.integers(0, 9999)}"
        rows.append((i, " ".join(w)))
    passage = [f"p{j}" for j in range(40)]
    rows += [(100 + i, " ".join(passage + [f"q{rng.integers(0, 10**6)}" for _ in range(25)])) for i in range(60)]
    rows += [(200, rows[5][1].upper()), (201, "a b"), (202, "A  b"), (203, ""), (204, None), (205, "a b c d e"),
        (206, "a b c d e")]
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOC)
    old = neardup.BLOCK, neardup.BLOCK_SHINGLES
    neardup.BLOCK, neardup.BLOCK_SHINGLES = 20, 1200  # several blocks
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(d).collect()}
    finally:
        neardup.BLOCK, neardup.BLOCK_SHINGLES = old
    assert got == plain_components(rows)
    kept = neardup.drop_near_duplicates(d)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i,
        (_, c) in got.items() if i == c}
    assert neardup.near_duplicates(odd).count() == 8 and neardup.near_duplicates(empty(spark)).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(5)
    v = rng.integers(0, 1 << 63, 700).astype(np.uint64)
    sig = neardup.superminhash(np.concatenate((np.sort(v[:500]), np.sort(v[100:600]))), np.repeat([0, 1], 500), 2)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.12
    one = neardup.superminhash(v[:1], np.zeros(1, int), 1)
    assert sorted((one[0] >> 24).tolist()) == list(range(128))  # one element ranks every place once


# ---- op6 ----


def test_tool_calls(spark):
    m = "conv_id long, turn long, role string, call_id string, name string, arguments string, depends_on array<string>, content string"
    call = lambda c, t, i, dep=(), name="search", a='{"query": "x", "limit": 2.0}': (c, t, "call", i, name, a,
        list(dep), None)
    result = lambda c, t, i, x: (c, t, "result", i, None, None, None, x)
    rows = [call(1, 5, "c", ["a", "b"]), call(1, 1, "a"), call(1, 3, "b", ["a"], a='{"limit": 500}'),
        result(1, 9, "a", "late"), result(1, 2, "a", "first"), result(1, 4, "zz", "orphan")]
    rows += [call(2, 0, "x", ["y"]), call(2, 1, "y", ["x"]), call(2, 2, "z", ["gone"]), call(2, 3, "w", a="{not json"),
        call(2, 4, "w"), call(2, 6, "v", name="other"), call(None, 1, None), call(3, 1, "n", a=None)]
    schemas = spark.createDataFrame([(n, json.dumps(s)) for n, s in toolcalls.SCHEMAS], "name string, schema string")
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.link_tool_calls(spark.createDataFrame(rows, m),
        schemas).collect()}
    assert len(got) == 10
    assert [(got[1, i]["level"], got[1, i]["position"]) for i in "abc"] == [(0, 0), (1, 1), (2, 2)]
    assert got[1, "a"][
        "message"] == '{"arguments":{"limit":2,"query":"x"},"id":"a","name":"search","result":{"content":"first","turn":2}}'
    assert got[1, "b"]["problems"] == ["$.query: missing", "$.limit: above maximum"] and got[1,
        "b"]["result_turn"] is None
    assert [got[2, i]["level"] for i in "xyz"] == [None] * 3 and got[2, "w"]["problems"] == ["$: not JSON"] and got[2,
        "v"]["problems"] == ["$: unknown tool"]
    assert not got[3, "n"]["valid"] and got[None, None]["level"] is None
    assert toolcalls.link_tool_calls(spark.createDataFrame([], m), schemas).count() == 0


# ---- op7 ----


def plain_targets(sizes, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while True:
        level = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if level[s] > cap * sizes[s]}
        if not over:
            return out | level
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over


def test_mixing(docs, spark, odd):
    for d in (docs, odd):
        got = mixing.mix(d).collect()
        want = Counter()
        for r in d.collect():
            want[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        target = plain_targets(want)
        taken = Counter()
        for r in got:
            assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1,
                r["target"]) and r["source_size"] == want[r["source"]] and 0 <= r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]) for s in target), (taken, target)
        assert len(got) == d.count()
    assert sorted(map(tuple, mixing.mix(docs).collect())) == sorted(map(tuple,
        mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty(spark)).count() == 0


def test_a_tiny_source_in_a_large_corpus_gets_its_target(spark, monkeypatch):
    """Targets below half a block of the whole corpus."""
    monkeypatch.setattr(mixing, "BLOCKS", 64)
    sizes = {"large": 400, "other": 200, "small": 3, "tiny": 1}  # documents of 200 words
    rows = [(i, f"{s}{i} " * 200, "en", s, 0) for i, s in enumerate(x for x, n in sizes.items() for _ in range(n))]
    taken, target = Counter(), {}
    for r in mixing.mix(spark.createDataFrame(rows, DOC)).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]) for s in ("small", "tiny")), (taken, target)
    assert all(abs(taken[s] - target[s]) <= 200 * 604 // 64 for s in ("large", "other")), (taken, target)


def test_apportionment_equals_highest_quotients(spark):
    rng = np.random.default_rng(6)
    for n, seats in ((1, 7), (9, 40), (30, 11), (12, 0)):
        votes = rng.random(n) ** 3
        won = Counter()
        for _ in range(seats):
            best = max(range(n), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
            won[best] += 1
        d = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "p int, v double, s int")
        got = {r["p"]: r["quota"] for r in mixing.apportion(d, [], ["p"], "v", "s").collect()}
        assert got == {i: won[i] for i in range(n)}


# ---- op8 ----


def test_context_tree_equals_plain_sums(docs):
    rows = docs.limit(60).collect()
    model = ctw.train(docs.filter("doc_id % 2 = 0").select("text"))
    assert np.allclose((10.0 ** model.table.astype(float)).sum(axis=1), 1, atol=0.05)
    texts = [r["text"] for r in rows]
    raw, offs = K.text_bytes(pa.array(texts))
    got = ctw.log10_probability(model, raw, offs)
    for t, g in list(zip(texts, got))[:5]:
        b = b"\xff" * ctw.DEPTH + t.encode().translate(bytes(K.LOWER)) + b"\xff"
        f = np.frombuffer(b, np.uint8).astype(np.int32)
        want = sum(float(model.table[model.nodes(f, np.array([i]))[0], f[i]]) for i in range(ctw.DEPTH, len(f)))
        assert abs(want - g) < 1e-6 * abs(want)
    noise = "".join(np.random.default_rng(0).permutation(list(texts[0])))
    n = ctw.log10_probability(model, *K.text_bytes(pa.array([noise])))[0]
    assert n < got[0]


def test_weighting_mixes_all_depths_by_kt():
    """One last byte, tiny counts: the tree's weights against the definition, by exact recursion."""
    import pandas as pd

    paths = [([97, 98, 99, 100, 101], 97, 3), ([97, 98, 99, 100, 101], 98, 1), ([97, 98, ctw.OTHER, -1, -1], 97, 2),
        ([97, 99, ctw.OTHER, -1, -1], 98, 5)]
    rows = pd.DataFrame(paths, columns=["path", "byte", "n"])
    out = ctw._weigh((97,), rows)
    top = np.frombuffer(out[out.kind == "top"]["v"].iloc[0])
    pe = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b
        + 1) - math.log(math.pi)

    def weigh(leaves, depth):  # leaves: (path, zeros, ones) at the root binary node
        a, b = sum(x[1] for x in leaves), sum(x[2] for x in leaves)
        own = pe(a, b)
        if depth == ctw.DEPTH or leaves[0][0][depth - 1] == ctw.OTHER:
            return own
        groups = {}
        for x in leaves:
            groups.setdefault(x[0][depth], []).append(x)
        return np.logaddexp(own, sum(weigh(g, depth + 1) for g in groups.values())) - math.log(2)

    # At the last bit (97 = ...0001 before 98 = ...0010 differ earlier): use the first node, all zeros.
    total = {}
    for p, byte, n in paths:
        total.setdefault(tuple(p), [0, 0])[byte >> 7] += n
    assert abs(top[0] - weigh([(p, a, b) for p, (a, b) in total.items()], 1)) < 1e-6


def test_base_scores_equal_plain_counts(docs, odd, spark):
    for d in (docs, odd):
        c, rows = Counter(), d.collect()
        for r in rows:
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
                c.update((r["text"] or "").encode().lower().split() + [None])
        n, norm = sum(c.values()), math.log10(sum(c.values()) + len(c) + 1)
        want = sorted((len(w), sum(c[x] > 0 for x in w),
            round(sum(math.log10(c[x] + 1) - norm for x in w),
            6)) for w in ((r["text"] or "").encode().lower().split() + [None] for r in rows))
        got = ctw.op8_query(d).collect()
        assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"],
            6)) for r in got) == want and {r["train_tokens"] for r in got} == {n}
    assert ctw.op8_query(empty(spark)).count() == 0


def plain_tree_scores(train, texts, depth):
    """log10 of each text under context-tree weighting with a node for every observed context."""
    seen, frame = Counter(), lambda t: b"\xff" * depth + t.encode().lower() + b"\xff"
    grams = lambda t: [(frame(t)[i - depth : i][::-1], frame(t)[i]) for i in range(depth, len(frame(t)))]
    for t in train:
        seen.update(grams(t))
    counts = {}
    for (c, b), n in seen.items():
        for d in range(depth + 1):
            for j in range(8):
                counts.setdefault((c[:d], j, b >> (8 - j)), [0, 0])[b >> (7 - j) & 1] += n
    pe = {k: math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi) for k,
        (z, o) in counts.items()}
    weight, below = {}, Counter()
    for k in sorted(counts, key=lambda k: -len(k[0])):
        weight[k] = pe[k] if len(k[0]) == depth else np.logaddexp(pe[k], below[k]) - math.log(2)
        if k[0]:
            below[(k[0][:-1], *k[1:])] += weight[k]

    def bit(c, j, prefix, x, d=0):
        k = (c[:d], j, prefix)
        if k not in counts:
            return 0.5
        own = (counts[k][x] + 0.5) / (sum(counts[k]) + 1)
        if d == depth:
            return own
        share = math.exp(pe[k] - math.log(2) - weight[k])
        return share * own + (1 - share) * bit(c, j, prefix, x, d + 1)

    return [sum(math.log10(bit(c, j, b >> (8 - j), b >> (7 - j) & 1)) for c,
        b in grams(t) for j in range(8)) for t in texts]


def test_rare_contexts_keep_their_nodes(spark):
    """A context below one in 2**16 of all bytes still predicts as its own node says."""
    rng = np.random.default_rng(4)
    texts = ["the cat sat on the mat " * 400 for _ in range(10)] + ["xq zebra7 Quagga9 é"] + [
        "".join(rng.choice(list("abcd "), 60)) for _ in range(6)] + ["xq zebra7 new"]
    d = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], DOC)
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    assert sum(map(len, learned)) > 1 << 16 and texts[10] in learned
    got = {r["doc_id"]: r["score"] for r in ctw.op8_query(d).collect()}
    want = plain_tree_scores(learned, texts, ctw.ORDER)
    assert all(abs(got[i] - w) < 1e-4 * abs(w) for i, w in enumerate(want))


# ---- op9 ----


def test_decontamination(spark, odd):
    rng = np.random.default_rng(8)
    word = lambda: f"v{rng.integers(0, 4000)}"
    items = [[word() for _ in range(int(rng.integers(12, 50)))] for _ in range(30)] + [["only", "three", "words"], []]
    rows = []
    for i in range(120):
        w = [word() for _ in range(80)]
        if i % 4 == 0:
            x = list(items[i % 32])
            if i % 8 == 0 and len(x) > 40:
                x[len(x) - 1] = "edited"
            w[20:20] = x
        rows.append((i, "  ".join(w).upper() if i % 3 else " \n".join(w), "en", "a", 0))
    d = spark.createDataFrame(rows, DOC)
    it = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)] + [(99, None)],
        "item_id long, text string")

    def shingles(w, k):
        return Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))

    want = set()
    for i, t, *_ in rows:
        w = t.lower().split()
        for j, x in enumerate(items):
            k = min(5, len(x))
            if not x:
                continue
            s = shingles(x, k)
            for at in range(len(w) - len(x) + 1):
                v = shingles(w[at : at + len(x)], k)
                both = sum((s & v).values())
                if 100 * both >= 75 * (sum(s.values()) + sum(v.values()) - both):
                    want.add((i, j))
                    break
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, it).collect()}
    assert got == want and len(want) > 20
    kept = decontam.decontaminate(d, it)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {i for i,
        _ in want}
    assert decontam.decontaminate(odd, it).count() == 8 and decontam.contaminated(empty(spark), it).count() == 0
    assert decontam.contaminated(d, it.limit(0)).count() == 0


def test_decontamination_at_the_threshold_equals_brute_force(spark):
    """Head lost, cut at the document's end, edited in the middle, and parts in another order, just at and below 0.75."""
    rng = np.random.default_rng(21)
    word = lambda: f"u{rng.integers(0, 100_000)}"
    rows, items = [], []
    for j in range(240):
        n = int(rng.integers(40, 90))
        x, w = [word() for _ in range(n)], n - 4
        m = w // 7 + (j % 5 == 4)  # a seventh of the shingles may break; one more is too many
        lead = [word() for _ in range(25)]
        if j % 4 == 0:
            t = lead + [word() for _ in range(m)] + x[m:] + [word() for _ in range(30)]
        elif j % 4 == 1:
            t = lead + x[: n - w // 4 - (j % 5 == 4)]
        elif j % 4 == 2:
            t = lead + x[:20] + [word() for _ in range(max(1, m - 4))] + x[20 + max(1,
                m - 4) :] + [word() for _ in range(30)]
        else:
            t = lead + x[n // 2 :] + x[: n // 2] + [word() for _ in range(30)]
        items.append(x)
        rows.append((j, " ".join(t), "en", "a", 0))
    k = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for (j, t, *_), x in zip(rows, items):
        w, s, best = t.split(), k(x), 0
        for at in range(len(w) - 4):
            v = k(w[at : at + len(x)])
            both = sum((s & v).values())
            every = sum(s.values()) + sum(v.values()) - both
            best = max(best, both / every if 100 * both >= 75 * every else 0)
        if best:
            want[j, j] = round(best, 6)
    d = spark.createDataFrame(rows, DOC)
    it = spark.createDataFrame([(j, " ".join(x)) for j, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(d, it).collect()}
    assert got == want and 150 < len(want) < 240 and all((j, j) in want for j in range(3, 240, 20))


# ---- op10 ----


def test_main_text():
    page = """<html><head><title>T</title><script>var a="</p>"</script></head><body><div class="cookie-notice">We use cookies</div><nav><a href=/>Home</a></nav>
    <div id=main><h1>Head &amp; line</h1><p>First  paragraph, with <b>bold</b> and <a href=x>a link</a>, and more text to count.<p>Second &lt;one&gt;, long enough, with commas, to score.<br>same block</p></div>
    <aside>Other stories</aside><div class="comments"><p>A reader, who says, things, at length, again, and, again.</p></div><form><p>Subscribe, please, now</p></form><footer>&copy; site</footer></body></html>"""
    assert html.main_text(
        page) == "Head & line\nFirst paragraph, with bold and a link, and more text to count.\nSecond <one>, long enough, with commas, to score. same block"
    assert html.main_text(None) == "" == html.main_text("") and html.main_text("plain words") == "plain words"
    assert html.main_text("<div>" * 20000 + "deep") == "deep"
    assert html.main_text("<p>open <b>bold<p>next</b> one<!-- x") == "open bold\nnext one"


def test_pages_query(spark):
    rows = [(1, "u", None), (2, None, "<p>x</p>"), (None, "v", ""), (2, None, "<p>x</p>")]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*",
        "5 as text")).collect()
    assert [(r["text"], r["n_chars"]) for r in got] == [("", 0), ("x", 1), ("", 0), ("x", 1)]


def test_byte_probabilities_stay_above_zero_in_long_runs():
    import pandas as pd

    rows = pd.DataFrame([([97, 97, 97, 97, 97], 97, 10**10)], columns=["path", "byte", "n"])
    z = [np.frombuffer(v, np.float32) for v in ctw._weigh((97,), rows).query("kind == 'row'")["v"]]
    table = ctw._bytes_of_bits(1 / (1 + np.exp(-np.stack(z).astype(float))))
    assert np.isfinite(table).all() and table[:, 97].max() > -0.01
