"""Turns that look like envelopes and are none are kept as prose."""

import json

import pytest

from fieldloom.llm import toolcalls

TURN = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("text", ['{"hello": 1}', "{broken", '{"k": 2}', '{"tool_calls": {"id": "x"}}', '{"tool_calls": []}',
                                  '{"tool_calls": [null]}', '{"tool_call_id": null}', "{}", "  { a set }"])
def test_other_json_is_prose(spark, text):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", text), (1, 2, "user", "next"), (1, 3, "assistant", "then")]
    d = spark.createDataFrame(rows, TURN)
    assert toolcalls.read_messages(d).count() == 0
    got = {r["call_id"]: r for r in toolcalls.op6_query(spark, d).collect()}
    assert set(got) == {"call_1", "call_3"} and got["call_1"]["result_turn"] == 2 and got["call_1"]["level"] == 0
    # The call that depends on it has a level too.
    plain = spark.createDataFrame([(c, t, r, "words" if t == 1 else x) for c, t, r, x in rows], TURN)
    levels = lambda q: {r["call_id"]: r["level"] for r in toolcalls.op6_query(spark, q).collect()}
    assert levels(d) == levels(plain)


def test_envelopes_are_not_prose(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q", "limit": 1}}]})
    answer = json.dumps({"tool_call_id": "a", "content": "found"})
    d = spark.createDataFrame([(1, 0, "assistant", call), (1, 1, "user", answer), (1, 2, "user", "{x}")], TURN)
    got = toolcalls.op6_query(spark, d).collect()
    assert [(r["call_id"], r["result_turn"]) for r in got] == [("a", 1)]
