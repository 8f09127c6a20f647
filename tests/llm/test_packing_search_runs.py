"""Packing, ranked search and periodic runs against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldloom.llm import packing, runs, search

DOC = "doc_id long, text string, lang string, source string, n_chars long"
PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
ODD = [(1, None, None, None, 0), (2, "", "en", "b", 0), (3, " \t\n ", "en", None, 0), (4, "one two", "en", "a", 0),
       (4, "one two", "en", "a", 0), (5, LONG, "de", "a", 0), (None, "one two", None, "a", 0),
       (6, "É ß 中文 \U0001f600", "fr", "b", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOC).selectExpr("*", "1 as score", "2 as length", "3 as m", "4 as rank", "5 as piece",
                                                      "6 as terms", "7 as sequence_id")


# ---- op11 ----


STRANGE = ["don't STOP's x<|endoftext|>y <|ENDOFTEXT|> á. é! é'S a'T 12.5 n.'s a≠b x.́y", "",
           "\x01 a\x01b \x01", "ﬁ ǅ Ω K İ ß ẞ ÿ Ÿ × ÷ a×b ª º µ", "日本語 テスト 한국어가", "tab\x0bvt\x1cfs nbsp\xa0x y\x85z", "a" * 5000]


def whole(texts):
    """Ids of each text, encoded as a whole."""
    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(list(texts), add_special_tokens=False)]


def test_words_give_the_ids_of_whole_texts(docs):
    texts = [r["text"] or "" for r in docs.collect()] + STRANGE
    for chunk in (texts, STRANGE, STRANGE[:1], texts[:3]):
        ids, bounds = packing.encode(pa.array(chunk), PATH)
        for i, want in enumerate(whole(chunk)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abZ's.<|!é́\x01 \n0≠ß-"), max_size=30), min_size=1, max_size=4))
def test_words_of_any_text_give_its_ids(texts):
    ids, bounds = packing.encode(pa.array(texts), PATH)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole(texts)


def packed_well(rows, capacity):
    """Checks that rows fill their sequences without gap or overlap; returns the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places_of_the_query(spark, docs):
    got = packing.op11_query(docs).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = {d: [*x, packing.END] for d, x in zip(texts, whole(texts.values()))}
    assert {(r["doc_id"], r["piece"]) for r in got} == {(d, p) for d, x in ids.items() for p in range(-(-len(x) // 4096))}
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 4096 * r["piece"] and len(part) == r["length"]
        assert r["length"] == 4096 or r["start"] + r["length"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    least = -(-sum(r["length"] for r in got) // 4096)
    assert packed_well(got, 4096) <= math.ceil(1.02 * least) + 1


def first_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in range(len(gaps)) if gaps[g] >= n), key=lambda g: gaps[g], default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[fit] -= n
    return len(gaps)


@pytest.mark.parametrize("name", ["even", "large", "small", "equal", "halves"])
def test_bulk_rounds_are_close_to_best_fit(spark, name):
    rng = np.random.default_rng(7)
    lengths = {"even": rng.integers(1, 65, 800), "large": rng.integers(30, 60, 400), "small": rng.integers(1, 9, 2000),
               "equal": np.full(500, 21), "halves": rng.choice([32, 33, 31, 1], 500)}[name]
    d = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long")
    got = packing.pack(d, 64).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(lengths)))
    assert packed_well(got, 64) <= 1.03 * first_fit_decreasing(lengths.tolist(), 64) + 1


def test_bands_cover_every_length_once():
    for capacity in (2, 3, 7, 64, 1000, 4096):
        covered = [x for low, high in packing.bands(capacity) for x in range(low, high + 1)]
        assert sorted(covered) == list(range(1, capacity)) and len(packing.bands(capacity)) < 45


def test_packing_of_odd_and_empty_tables(spark, odd):
    got = packing.op11_query(odd).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in ODD)
    assert [r["length"] for r in got if r["doc_id"] in (1, 2, 3)] == [1, 1, 1] and packed_well(got, 4096) >= 1
    assert packing.op11_query(odd.limit(0)).count() == 0
    held = packing.pieces(odd, PATH, with_ids=True).filter("doc_id = 4").first()
    assert held["ids"] == [*whole(["one two"])[0], 1]


# ---- op12 ----


TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERMS.findall(text or "")]


def ranked(docs, items, k=50):
    """Every document against every item."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if c[t])
            if s > 0:
                found.append((-s, i is None, i if i is not None else 0, i))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k], 1)]
    return out


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_ranking_equals_scoring_all_documents(spark, docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows_of(search.search(docs, items)) == sorted(want, key=str)
    # Whole queries in several passes.
    assert rows_of(search.search(docs, items, terms_at_once=300)) == sorted(want, key=str)


def test_small_strata_and_segments_give_the_same_ranking(spark, monkeypatch):
    """Ties, many documents of one length, repeated documents; strata are skipped by their bounds."""
    rng = np.random.default_rng(11)
    words = [f"t{i}" for i in range(40)]
    texts = [(i, " ".join(rng.choice(words, int(rng.choice([3, 5, 5, 5, 12])), p=np.arange(1, 41) / 820))) for i in range(600)]
    texts += [(700, "t39 t38 t37")] * 70 + [(None, "t39 t38 t37")] * 3
    items = [(i, " ".join(rng.choice(words, 6))) for i in range(12)] + [(50, "t39 T38, t37 t39"), (51, None), (52, "zz"), (53, "...")]
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = rows_of(search.search(d, q))
    assert got == sorted(ranked(texts, items), key=str) and not {51, 52, 53} & {r[0] for r in got}
    assert rows_of(search.search(d, q, k=3)) == sorted(ranked(texts, items, 3), key=str)


def test_bounds_hold_and_strata_are_skipped():
    rng = np.random.default_rng(2)
    for _ in range(50):
        doc, term = np.repeat(np.arange(20), 5), np.concatenate([rng.choice(30, 5, replace=False) for _ in range(20)])
        weights = rng.integers(0, 9000, 30)
        s = search.Stratum(int(rng.integers(50, 300)), np.arange(20), doc, term, rng.integers(1, 6, 100), weights)
        query = np.sort(rng.choice(30, 8, replace=False))
        row = {t: r for r, t in enumerate(s.terms)}
        score = s.table()[[row[t] for t in query if t in row]].sum(axis=0)
        assert s.bounds(query, np.array([0]), 30)[0] >= score.max()


def test_search_of_odd_and_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "one TWO 中文"), (1, "one")], "item_id long, text string").selectExpr("*", "1 as doc_id", "2 as m")
    got = search.search(odd, items).collect()
    assert Counter(r["item_id"] for r in got) == {1: 7} and all(r["doc_id"] in (4, 6, None) for r in got)
    assert search.search(odd.limit(0), items).count() == 0 and search.search(odd, items.limit(0)).count() == 0
    assert search.search(odd.filter("doc_id < 4"), items).count() == 0


# ---- op13 ----


def plain_runs(words, least=12):
    """Every period by comparing words that far apart."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if n and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_runs_of_the_query_equal_comparing_all_periods(docs):
    short = docs.filter("n_chars < 6000")
    texts = {r["doc_id"]: r["text"] for r in short.collect()}
    got = runs.op13_query(short).collect()
    assert len(got) == len(texts) and sum(r["n_runs"] > 0 for r in got) >= 5
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == digest(r["doc_id"], texts[r["doc_id"]]), r["doc_id"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.lists(st.integers(0, 2), max_size=50),
    st.builds(lambda root, n, head, tail: head + (root * n)[: n + len(root)] + tail, st.lists(st.integers(0, 1), min_size=1, max_size=9),
              st.integers(0, 40), st.lists(st.integers(0, 1), max_size=8), st.lists(st.integers(0, 1), max_size=8)),
), min_size=1, max_size=3), st.sampled_from([2, 5, 12]))
def test_all_runs_are_found(rows, least):
    bounds = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    start, end, period = runs.find_runs(np.array(sum(rows, []), np.int64), bounds, least)
    want = [(a + bounds[i], a + n + bounds[i], q) for i, r in enumerate(rows) for a, n, q in plain_runs(r, least)]
    assert list(zip(start.tolist(), end.tolist(), period.tolist())) == want


def test_words_of_periodic_sequences():
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    words = "".join("b" if bin(i).count("1") % 2 else "a" for i in range(300))
    for text in (fib[-1], words, "ab" * 100 + "a" + "ab" * 90, "a" * 500, ("aab" * 7 + "c") * 9):
        start, end, period = runs.find_runs(np.array([ord(c) for c in text], np.int64), np.array([0, len(text)]), 2)
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == plain_runs(text, 2)


def test_runs_and_collapse_of_odd_and_empty_tables(spark, odd):
    got = {(r["doc_id"], r["n_runs"]): r for r in runs.op13_query(odd).collect()}
    assert runs.op13_query(odd).count() == 8
    for i, text, *_ in ODD:
        if i != 5:
            want = digest(i, text)
            assert tuple(got[i, want[0]][c] for c in COLUMNS) == want
    assert runs.op13_query(odd.limit(0)).count() == 0
    d = spark.createDataFrame([(1, "x " + "say it again " * 6 + "end"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in runs.runs(d).collect()] == [(1, 1, 18, 3)]
    assert {r["doc_id"]: r["text"] for r in runs.collapse(d).collect()} == {1: "x say it again end", 2: ""}
