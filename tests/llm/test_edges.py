"""Hostile but legal input: repeated ids with different texts, clashing names, extreme values."""

import json
import struct
from collections import Counter

import numpy as np
import pytest

from fieldloom.llm import decontam, gif, html, neardup, pii, toolcalls
from fieldloom.llm import kernels as K

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "terms row _row spans score size h id items bucket component part taken target held_out predicted words".split(
    )


def frame(spark, rows):
    """Rows (doc_id, text) as documents with extra columns under names that operators use."""
    return spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOC).selectExpr("*",
        *[f"'x' as {c}" for c in CLASHES])


# ---- op1 ----


def test_long_digit_runs_are_text():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 1, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == [] and pii.base_spans("+1" + "2" * 9000) == []


def plain_disclosed(texts, support, disclosure):
    """Terms by definition, from all pairs of entity and term in all documents."""
    n_e, n_t, both = Counter(), Counter(), Counter()
    for t in texts:
        spans = pii.base_spans(t)
        held, terms = pii.entities(t, spans), pii.terms_of(pii.blanked(t, spans))
        n_e.update(held)
        n_t.update(terms)
        both.update((e, w) for e in held for w in terms)
    share = lambda e, w: np.log2(both[e, w] * len(texts) / (n_t[w] * n_e[e])) / np.log2(len(texts)
        / n_e[e])
    return {w for (e, w), n in both.items() if n >= support and n_e[e] < len(texts) and share(e, w) >= disclosure}


@pytest.mark.parametrize("broadcast", [True, False])
def test_terms_far_from_an_entity_are_found_and_masked_everywhere(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(pii, "BROADCAST_TERMS", -1)
        monkeypatch.setattr(pii, "BROADCAST_ENTITIES", -1)
    rng = np.random.default_rng(3)
    some = lambda n: " ".join(rng.choice([f"w{i}" for i in range(30)], n))
    rows = [(i, f"Zweibrunn {some(300)} bob{i % 5}@x.org q7") for i in range(15)] + [(100 + i,
        some(40)) for i in range(40)]
    rows += [(0, "short"), (0, f"{some(5)} ZWEIBRUNN once more"), (None, None), (None, "10.0.0.1 and 10.0.0.1"),
        (7, "")]
    d = frame(spark, rows)
    want = plain_disclosed([t or "" for _, t in rows], 2, 0.5)
    assert {r["term"] for r in pii.disclosed(d, 2, 0.5).select("term").distinct().collect()} == want
    got = pii.find_personal_data(d, 2, 0.5).collect()
    assert len(got) == len(rows)
    clean = pii.sanitise(d, 2, 0.5)
    assert clean.columns == d.columns
    texts = [r["text"] for r in clean.collect()]
    for (_, t), r, c in zip(rows, got, texts) if broadcast else []:
        found = {t[x["start"] : x["end"]].lower() for x in r["terms"]}
        assert found == {w for w in pii.terms_of(pii.blanked(t or "", pii.base_spans(t or ""))) if w in want}
        assert (c is None) == (t is None) and not (c and want & pii.terms_of(c.replace("<EMAIL TERM>", "")))
    assert sorted(map(str, texts)) == sorted(str(t if t is None else pii.masked(t, s := pii.base_spans(t),
        pii.term_spans(t, s, dict.fromkeys(want, 0)))) for _, t in rows)
    assert pii.op1_query(frame(spark, [])).count() == 0 and pii.sanitise(frame(spark, [])).count() == 0


def test_bytes_that_are_not_utf8_do_not_stop_a_task(spark):
    d = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF40622E63' AS STRING) AS text")
    assert pii.op1_query(d).collect()[0]["n_email"] in (0, 1) and K.fresh_names(["Row"], "row", "row") == ["_row",
        "__row"]


# ---- op3 ----


def plain_lzw(data, min_size):
    """A decoder by the book, bit by bit."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, at, width, table, last, out = 1 << min_size, 0, min_size + 1, {}, None, b""
    while at + width <= len(bits):
        code, at = int(bits[at : at + width][::-1], 2), at + width
        if code == clear + 1:
            break
        if code == clear:
            table, width, last = {i: bytes([i]) for i in range(clear)}, min_size + 1, None
            continue
        s = table[code] if code in table else last + last[:1]
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = last + s[:1]
            if len(table) + 2 == 1 << width and width < 12:
                width += 1
        out, last = out + s, s
    return out


def test_stored_streams_decode_by_the_book():
    rng = np.random.default_rng(5)
    for n, k in ((1, 3), (3000, 4), (40_000, 26), (9000, 256)):
        s = rng.integers(0, k, n).astype(np.uint8).tobytes()
        assert plain_lzw(gif.lzw_encode(s), 8) == s and gif.lzw_decode(gif.lzw_encode(s), 8, n).tobytes() == s
    text = (" ".join(rng.choice(["the", "and", "of", "moist"], 20_000))).encode()
    assert len(gif.store_text(text)) < len(text) / 2 and gif.read_back(gif.store_text(text))[0].rstrip(b"\0") == text
    for raw in (b"\0\xff\0", b"a\0b", b""):  # a byte 255 leaves no index for transparency
        assert gif.read_back(gif.store_text(raw))[0][: max(len(raw), 1)] == (raw or b"\0")


def test_hostile_gifs_give_an_error_row(spark):
    head = lambda w, h: b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80, 0, 0) + bytes(6)
    image = lambda w, h, size, data: b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h,
        0) + bytes([size, len(data)]) + data + b"\0"
    bad = [head(65535, 65535) + image(1, 1, 2, b"\x44\x01"), head(2, 2) + image(65535, 65535, 2, b"\x44"),
        head(2, 2) + image(2, 2, 40, b"\x44"), head(2, 2) + image(2, 2, 0, b"\x44"),
           head(2, 2) + image(2, 2, 2, b"\xfc\xff"), head(2, 2) + b"\x2c\0", head(2, 2), b"GIF89a",
               head(2, 2) + b"\x21\xf9\xff", head(2, 2)[:-3]]
    good = head(2, 2) + image(2, 2, 2, b"\x04\x00\x50") + b"\x3b"
    files = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate([*bad, good])], "id long, content binary")
    rows = gif.gif_frames(files).collect()
    assert {r["id"] for r in rows if r["error"]} == set(range(len(bad))) and [r["error"] for r in rows if r["id"]
        == len(bad)] == [None]


# ---- op9 ----


def test_fingerprints_within_the_radius_are_all_found(spark):
    masks = decontam.block_masks()
    assert len(masks) == decontam.RADIUS + 1 and sum(masks) == (1 << 63) - 1
    rng = np.random.default_rng(9)
    base = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    near = [(i, b ^ int(sum(1 << int(j) for j in rng.choice(63, k, replace=False))), k) for i,
        b in enumerate(base) for k in (0, 1, 20, 27, 28, 29, 40)]
    windows = spark.createDataFrame(near, "item_id long, fp long, k int")
    items = spark.createDataFrame(list(enumerate(base)), "item_id long, fp long")
    got = Counter((r["item_id"], r["k"]) for r in decontam.within_radius(windows, items).collect())
    assert got == Counter({(i, k): 1 for i in range(40) for k in (0, 1, 20, 27, 28)})


def test_fingerprint_is_the_majority_of_bits(spark):
    rng = np.random.default_rng(10)
    sets = [[int(x) for x in rng.integers(-(1 << 62), 1 << 62, n)] for n in (1, 2, 5, 46, 200)]
    got = [r["fp"] for r in spark.createDataFrame([(x,) for x in sets],
        "s array<long>").select(decontam.fingerprint("s").alias("fp")).collect()]
    # Bit j + 21 * lane of the hashes is bit number 62 - (21 * lane + j) of the fingerprint.
    want = [sum((2 * sum(x >> j & 1 for x in s) > len(s)) << (62 - j) for j in range(63)) for s in sets]
    assert got == want


def test_leaks_in_rows_with_one_id_and_halves_swapped(spark):
    item = [f"i{j}" for j in range(40)]
    swapped = " ".join(item[20:] + item[:20])
    rows = [(1, "nothing here at all to see"), (1, f"before {swapped} after"), (2, " ".join(item)),
        (None, " ".join(item)), (3, None), (4, ""), (5, " ".join(f"z{j}" for j in range(90_000)) + " "
        + " ".join(item)), (2, " ".join(item))]
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, ""), (10, None)],
        "item_id long, text string").selectExpr("*", "'x' as h", "1 as n")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"],
        r["similarity"]) for r in decontam.contaminated(frame(spark, rows), items).collect()}
    assert {i for i, _ in got} == {1, 2, 5, None} and got[1, 7] == (1, 0.8) and got[5, 8] == (90_000,
        1.0) and len(got) == 8
    kept = decontam.decontaminate(frame(spark, rows), items)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "4", "None"]


# ---- op5 ----


@pytest.mark.parametrize("broadcast", [True, False])
def test_one_row_of_a_component_stays_whatever_its_ids(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(neardup, "BROADCAST_KEYS", -1)
    x = " ".join(f"x{j}" for j in range(40))
    near = x.replace("x39", "other")
    own, alone = " ".join(f"y{j}" for j in range(30)), " ".join(f"n{j}" for j in range(30))
    rows = [(1, x), (1, x), (5, x), (5, own), (5, x.upper()), (None, near), (None, alone), (None, alone), (1, near),
        (8, None), (8, ""), (None, " ")]
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    by_text = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)
    assert by_text == Counter({(1, 36, 1, True): 3, (5, 36, 1, False): 2, (5, 26, 5, True): 1, (None, 36, 1, False): 1,
        (None, 26, None, True): 2, (8, 0, 8, True): 2, (None, 0, None, True): 1})
    d = frame(spark, rows)
    kept = neardup.drop_near_duplicates(d)
    texts = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == d.columns and sum(n for (i, t), n in texts.items() if t in (x, near)) == 1
    assert texts[5, own] == 1 and texts[None, alone] == 1 and texts[5, x] == texts[None, near] == 0 and texts[8,
        None] == texts[8, ""] == texts[None, " "] == 1
    assert neardup.drop_near_duplicates(frame(spark, [])).count() == 0


# ---- op6 ----

MESSAGES = "conv_id long, turn long, role string, call_id string, name string, arguments string, depends_on array<string>, content string"


def test_hostile_arguments_are_invalid_not_fatal(spark):
    schema = json.dumps({"type": "object", "properties": {"n": {"type": "integer", "minimum": 0}}})
    bad = {
        "a": '{"n": 1e999}', "b": '{"n": NaN}', "c": '{"n": -Infinity}', "d": "[" * 3000 + "]" * 3000,
            "e": "[" * 100_000, "f": "9" * 5000, "g": "", "h": None, "i": '{"n": -1.0}', "j": "[" * 300 + "]" * 300,
    }
    good = {"k": '{"n": 2.0, "s": "\\ud800"}', "l": '{"n": 12345678901234567890, "t": "' + "x" * 3_000_000 + '"}',
        "m": '{"n": 1e3}'}
    rows = [(1, i, "call", c, "t", a, None, None) for i, (c, a) in enumerate([*bad.items(), *good.items()])]
    rows += [(1, None, "call", "n", "odd", "{}", ["k", None, "k"], None),
        (1, 99, "call", "o", "text", "{}", None, None), (1, 5, "result", "k", None, None, None, None)]
    schemas = spark.createDataFrame([("t", schema), ("t", "~"), ("odd", '{"properties": 3}'), ("text", "not json"),
        (None, None)], "name string, schema string")
    got = {r["call_id"]: r for r in toolcalls.link_tool_calls(spark.createDataFrame(rows, MESSAGES).selectExpr("*",
        "1 as level", "2 as answered"), schemas).collect()}
    assert [c for c in got if got[c]["valid"]] == sorted(good, key=list(got).index) and len(got) == 15
    assert {c: got[c]["problems"][0] for c in "abdef"} == {"a": "$: number out of range", "b": "$: not JSON",
        "d": "$: nested too deep", "e": "$: nested too deep", "f": "$: not JSON"}
    assert got["n"]["problems"] == ["$: bad schema"] and got["n"]["level"] == 1 and got["o"]["problems"] == [
        "$: unknown tool"]
    assert json.loads(got["k"]["message"])["result"] == {"content": None,
        "turn": 5} and '"n":2' in got["k"]["message"] and '"n":1000' in got["m"]["message"]


@pytest.mark.parametrize("calls", [4096, 6])
def test_long_chains_need_few_rounds(spark, monkeypatch, calls):
    monkeypatch.setattr(toolcalls, "BLOCK_CALLS", calls)
    rng = np.random.default_rng(2)
    n = 2500 if calls == 4096 else 10
    needs = [[f"c{i - 1}"] * (i > 0) + [f"c{int(j)}" for j in rng.integers(0, max(i, 1), 2) if j < i] for i in range(n)]
    rows = [(1, i, "call", f"c{i}", "t", "{}", needs[i], None) for i in range(n)] + [(1, n, "call", "x", "t", "{}",
        ["y"], None), (1, n + 1, "call", "y", "t", "{}", ["x", "c5"], None),
        (1, n + 2, "call", "z", "t", "{}", ["z"], None)]
    rounds, plain = [], toolcalls.checkpointed
    monkeypatch.setattr(toolcalls, "checkpointed", lambda df: rounds.append(1) or plain(df))
    calls_ = spark.createDataFrame(rows, MESSAGES)
    got = {r["call_id"]: r["level"] for r in toolcalls._levels(calls_).collect()}
    assert got == {f"c{i}": i for i in range(n)} and (len(rounds) <= 5 or calls == 6)


def test_calls_are_read_by_the_identifiers_in_turns(spark):
    rows = [
        (1, 0, "user", "find it"),
            (1, 1, "assistant",
                '{"tool_calls": [{"id": "q1", "name": "search", "arguments": {"query": "x", "limit": 3}}, {"id": "q2", "name": "search", "arguments": "{\\"limit\\": 0}", "depends_on": ["q1"]}]}'),
        (1, 2, "tool", '{"tool_call_id": "q2", "content": "second"}'),
            (1, 3, "tool", ' {"tool_call_id": "q1", "content": "first"}'), (1, 4, "assistant", "{broken"),
            (2, 0, "assistant", None), (None, 1, "assistant", "prose"),
    ]
    got = {(r["conv_id"], r["call_id"]): r for r in toolcalls.op6_query(spark,
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1, "q1"]["result_turn"] == 3 and got[1, "q1"]["valid"] and (got[1, "q2"]["result_turn"],
        got[1, "q2"]["level"]) == (2, 1)
    assert got[1, "q2"]["problems"] == "$.query: missing; $.limit: below minimum" and set(got) == {(1, "q1"), (1, "q2"),
        (1, "call_4"), (2, "call_0"), (None, "call_1")}  # what only begins like JSON is prose


# ---- op10 ----

TALK = "One, two, and three things that are said at length here, so that it reads like prose."


@pytest.mark.parametrize("names", ["content no-sidebar", "post legal", "has-nav", "related", "search", "share", "legal",
    "notice", "page with-menu", "Entry-Content"])
def test_names_of_layouts_do_not_drop_an_article(names):
    page = f"<body><nav><a href=/>Home</a></nav><div class='{names}'><h1>Head</h1><p>{TALK}</p><h2>Sub</h2><p>End.</p></div><div class=sidebar><p>{TALK}</p></div></body>"
    assert html.main_text(page) == f"Head\n{TALK}\nSub\nEnd."


@pytest.mark.parametrize("names", ["comments", "site-footer", "ad", "cookie-notice", "share", "related posts-list",
    "nav-menu", "side-bar", "sponsored"])
def test_furniture_by_name_goes(names):
    page = f"<body><div id=x><p>{TALK}</p><p>{TALK}</p><p>Short.</p><div class='{names}'><p>Not this, at all, ever.</p></div></div></body>"
    assert html.main_text(page) == f"{TALK}\n{TALK}\nShort."


def test_short_blocks_beside_a_strong_container_stay():
    page = f"<body><div class=lead><p>{TALK}</p><p>{TALK}</p><p>{TALK}</p></div><h2>Next</h2><p>Short end.</p><ul><li>one</li></ul><div><a href=1>more</a> <a href=2>links</a></div></body>"
    assert html.main_text(page) == f"{TALK}\n{TALK}\n{TALK}\nNext\nShort end.\none"


def test_deep_pages_take_linear_time():
    import time

    def seconds(n):
        page = "".join(f"<div>text {i}, and more of it" for i in range(n)) + "</b></i></span>" * n
        began = time.process_time()
        html.main_text(page)
        return time.process_time() - began

    assert seconds(16_000) < 12 * max(seconds(4000), 0.02)


def test_pages_of_the_table_equal_the_article_element(spark):
    """All pages of the table have one article; a parser of the standard library reads it."""
    from html.parser import HTMLParser

    class Article(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks, self.line = 0, [], []

        def flush(self):
            text = " ".join("".join(self.line).split())
            self.blocks += [text] if text else []
            self.line = []

        def handle_starttag(self, tag, attrs):
            self.inside += tag == "article"
            self.line += [" "] * (tag == "br")
            if tag not in ("b", "br", "a", "i"):
                self.flush()

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "i"):
                self.flush()
            self.inside -= tag == "article"

        def handle_data(self, data):
            self.line += [data] * (self.inside > 0)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(pages).collect()}
    for r in pages.collect():
        a = Article()
        a.feed(r["html"] or "")
        a.flush()
        assert got[r["page_id"]] == "\n".join(a.blocks), r["page_id"]
