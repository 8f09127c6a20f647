"""Tool-call linking: calls meet their results, in dependency order, validated and canonical.

Input of ``link_tool_calls``: one row a message with ``conv_id, turn, role`` (``call`` or
``result``), ``call_id, name, arguments`` (JSON text), ``depends_on`` (ids of earlier calls) and
``content``; and a table of schemas (``name, schema`` as JSON). One row a call comes back:

* its result by a hash join on (conv_id, call_id); the first result by turn answers;
* ``level``, its depth in the dependency order. Blocks of a conversation's turns resolve in one
  task each what they can; then blocks tell each other the calls that became known, and so on.
  The number of rounds is how often a chain of dependencies leaves a block, not its length. A
  call that waits on a missing id or a cycle keeps a null level. ``position`` numbers calls by
  (level, turn, call_id);
* ``valid`` and ``problems`` of the arguments against the schema of the call's name;
* ``message``, canonical JSON: keys sorted by code point, no spaces, numbers in shortest form.

Rows are spread by conversation *and* block of turns wherever order within a conversation is
needed, and a block with very many calls of one turn is dealt by id, so one conversation with a
third of all messages is many tasks. Arguments and contents are read in chunks of bounded size.

Edge cases: null arguments, text that is not JSON (NaN and Infinity are not), numbers beyond a
double and values nested deeper than ``MAX_DEPTH`` are invalid and serialised as null; a lone
surrogate is serialised as its escape; a repeated (conv_id, call_id) keeps its first row by turn;
a result without a call and a call without a conv_id or call_id give no link (the former no row,
the latter a row with a null level); an unknown name, or one whose schema is not a JSON object,
is invalid; a turn of JSON that names no call and answers none is prose like any other; of several schemas for one name the smallest text counts; a null turn sorts first;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import checkpointed

BLOCK_TURNS, BLOCK_CALLS = 1024, 4096
#: Schemas that may be broadcast to meet the calls; beyond, they are joined by shuffle.
BROADCAST_SCHEMAS = 1_000
#: Levels of brackets; a parameter that keeps the stack of a task small.
MAX_DEPTH = 200
# JSON Schema's names of types.
TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value: object) -> str:
    """RFC 8785 style: keys sorted, no spaces, whole floats as integers."""

    def plain(v: object) -> object:
        if isinstance(v, float):
            return int(v) if v.is_integer() and abs(v) < 1e16 else v
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    text = json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return text.encode("utf-8", "backslashreplace").decode()


def _number(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise OverflowError(text[:40])
    return value


def _constant(text: str) -> float:
    raise ValueError(text)


def _depth(value: object) -> int:
    level, at = [value], 0
    while level:
        level = [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]
        at += 1
    return at


def parse(text: str | None) -> tuple[object, list[str]]:
    """The value of a JSON text and what is wrong with it; a wrong one has no value."""
    if text is None:
        return None, ["$: no arguments"]
    try:
        value = json.loads(text, parse_float=_number, parse_constant=_constant)
    except OverflowError:
        return None, ["$: number out of range"]
    except RecursionError:
        return None, ["$: nested too deep"]
    except ValueError:
        return None, ["$: not JSON"]
    return (value, []) if _depth(value) <= MAX_DEPTH else (None, ["$: nested too deep"])


@lru_cache(maxsize=4096)
def _schema(text: str | None) -> dict | None:
    value = parse(text)[0]
    return value if isinstance(value, dict) else None


def check(value: object, schema: dict | None) -> list[str]:
    if schema is None:
        return ["$: unknown tool"]
    try:
        return problems(value, schema)
    except (TypeError, AttributeError):
        return ["$: bad schema"]


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, TYPES.get(kind, object))


def problems(value: object, schema: dict, path: str = "$") -> list[str]:
    """What in a value breaks a schema: type, required, enum, bounds, items, unknown keys."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{path}: below minimum"] * ("minimum" in schema and value < schema["minimum"])
        out += [f"{path}: above maximum"] * ("maximum" in schema and value > schema["maximum"])
    if isinstance(value, str):
        out += [f"{path}: too short"] * (len(value) < schema.get("minLength", 0))
        out += [f"{path}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known):
            if k in value:
                out += problems(value[k], known[k], f"{path}.{k}")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for i, v in enumerate(value):
            out += problems(v, schema["items"], f"{path}[{i}]")
    return out


def _peel(rows):
    """Resolves the calls of some blocks whose needs are met, and those that they meet, and so on."""
    keys = list(zip(rows["conv_id"], rows["call_id"]))
    level = dict(zip(keys, rows["level"]))
    needs = {k: set(n) for k, n in zip(keys, rows["needs"])}
    waits: dict[tuple, list[tuple]] = {}
    for k, n in needs.items():
        for x in n:
            waits.setdefault((k[0], x), []).append(k)
    ready = [k for k, n in needs.items() if not n]
    for k in ready:  # grows while it is read
        for d in waits.get(k, ()):
            level[d] = max(level[d], level[k] + 1)
            needs[d].discard(k[1])
            if not needs[d]:
                ready.append(d)
    out = rows.copy()
    out["level"] = [level[k] for k in keys]
    out["needs"] = [sorted(needs[k]) for k in keys]
    out["done"] = [not needs[k] for k in keys]
    return out


def _levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call whose dependencies can be met."""
    key, block = ["conv_id", "call_id"], F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-1)).alias("b")
    needs = F.array_distinct(F.filter(F.coalesce("depends_on", F.array()), lambda x: x.isNotNull()))
    pending = calls.select(*key, block, needs.alias("needs"), F.lit(0).alias("level"))
    sizes = pending.groupBy("conv_id", "b").agg(F.ceil(F.count(F.lit(1)) / BLOCK_CALLS).alias("s"))
    # A task takes many small blocks at once, some BLOCK_CALLS calls; a block of more is dealt by id.
    groups = max(1, calls.count() // BLOCK_CALLS)
    salt = F.pmod(F.xxhash64("call_id"), F.col("s"))
    pending = pending.join(sizes, ["conv_id", "b"]).select(*key, "needs", "level",
        F.pmod(F.xxhash64("conv_id", "b", salt), F.lit(groups)).alias("g"))
    kind = "conv_id long, call_id string, needs array<string>, level int, g long, done boolean"
    found = None
    while True:
        ran = checkpointed(pending.groupBy("g").applyInPandas(_peel, kind))
        fresh, waiting = ran.filter("done").select(*key, "level"), ran.filter("not done").drop("done")
        found = fresh if found is None else found.union(fresh)
        if fresh.isEmpty() or waiting.isEmpty():
            return found
        asked = waiting.select(*key, F.explode("needs").alias("need"))
        known = fresh.select("conv_id", F.col("call_id").alias("need"), F.col("level").alias("at"))
        met = asked.join(known, ["conv_id", "need"]).groupBy(*key).agg(F.collect_list("need").alias("met"),
            F.max("at").alias("at"))
        left = F.when(F.col("met").isNull(), F.col("needs")).otherwise(F.array_except("needs", "met"))
        pending = waiting.join(met, key, "left").select(*key, left.alias("needs"),
            F.greatest("level", F.coalesce(F.col("at") + 1, F.lit(0))).alias("level"), "g")


def _positions(calls: DataFrame) -> DataFrame:
    """Adds ``position`` by (level, turn, call_id) in each conversation, ordering one block of turns at a time."""
    inner = Window.partitionBy("conv_id", "level", "_b").orderBy("turn", "call_id")
    block = calls.withColumn("_b", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-1))).withColumn("_in",
        F.row_number().over(inner))
    block = checkpointed(block)
    sizes = block.filter("level is not null").groupBy("conv_id", "level", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("level", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = block.join(starts, ["conv_id", "level", "_b"], "left").withColumn("position",
        (F.col("_start") + F.col("_in") - 1).cast("long"))
    return placed.drop("_b", "_in", "_start")


LINKED = (
    "conv_id long, turn long, call_id string, name string, level int, position long, result_turn long, "
    "valid boolean, problems array<string>, message string"
)


def _serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in LINKED.split(", ")]
    for batch in K.chunks(K.chunks(batches, "arguments"), "content"):
        out = []
        columns = [K.strings(batch.column(c)) if c in ("arguments", "content", "call_id", "name",
            "schema") else batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "schema",
            "result_turn", "content", "answered")]
        for call_id, name, arguments, schema, turn, content, answered in zip(*columns):
            value, wrong = parse(arguments)
            wrong = wrong or check(value, _schema(schema))
            result = {"turn": turn, "content": content} if answered else None
            out.append((not wrong, [w.encode("utf-8", "backslashreplace").decode() for w in wrong],
                canonical({"id": call_id, "name": name, "arguments": value, "result": result})))
        valid, wrong, message = zip(*out)
        made = [pa.array(valid, pa.bool_()), pa.array(wrong, pa.list_(pa.string())), pa.array(message, pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:7]), *made], names=names)


def link_tool_calls(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    key = ["conv_id", "call_id"]
    first = F.min_by(F.struct("turn", "name", "arguments", "depends_on"), F.struct("turn", "arguments", "name"))
    every = messages.filter("role = 'call'")
    calls = every.filter("conv_id is not null and call_id is not null").groupBy(*key).agg(first.alias("c")).select(*key,
        "c.*")
    calls = checkpointed(calls)
    results = messages.filter("role = 'result'").groupBy(*key).agg(F.min_by(F.struct("turn", "content"),
        F.struct("turn", "content")).alias("r"))
    placed = _positions(calls.join(_levels(calls), key, "left").drop("depends_on"))
    none = [F.lit(None).cast("int").alias("level"), F.lit(None).cast("long").alias("position")]
    loose = every.filter("conv_id is null or call_id is null").select(*key, "turn", "name", "arguments", *none)
    known = schemas.groupBy("name").agg(F.min("schema").alias("schema"))
    known = F.broadcast(known) if known.count() <= BROADCAST_SCHEMAS else known
    linked = placed.unionByName(loose).join(results, key, "left").join(known, "name", "left")
    linked = linked.select("conv_id", "turn", "call_id", "name", "level", "position",
        F.col("r.turn").alias("result_turn"), F.col("r").isNotNull().alias("answered"),
        F.col("r.content").alias("content"), "arguments", "schema")
    return linked.mapInArrow(_serialise, LINKED)


SCHEMAS = [
    (
        "search",
        {
            "type": "object", "required": ["query", "limit"], "additionalProperties": False,
            "properties": {"query": {"type": "string", "minLength": 1},
                "limit": {"type": "integer", "minimum": 1, "maximum": 200}},
        },
    ),
    ("summarise", {"type": "object", "required": ["text"],
        "properties": {"text": {"type": "string"}, "ratio": {"type": "number", "minimum": 0, "maximum": 1}}}),
]
#: A turn that is JSON with calls, or with the identifier of the call that it answers.
ENVELOPE = "tool_calls array<struct<id:string, name:string, arguments:string, depends_on:array<string>>>, tool_call_id string, content string"


def with_envelope(conversations: DataFrame) -> DataFrame:
    """Adds ``_m``, what a turn's JSON says of calls or of a call that it answers; NULL where the turn is no envelope.

    A turn that begins with a brace but holds neither calls nor an identifier (other JSON, or none at all) is prose.
    """
    said = F.when(F.col("text").rlike("^\\s*\\{"), F.from_json("text", ENVELOPE))
    calls = F.size(F.filter(F.coalesce("_m.tool_calls", F.array()), lambda c: c.isNotNull()))
    rows = conversations.select("conv_id", "turn", "role", "text", said.alias("_m"))
    return rows.withColumn("_m", F.when(F.col("_m.tool_call_id").isNotNull() | (calls > 0), F.col("_m")))


def read_messages(conversations: DataFrame) -> DataFrame:
    """Calls and results by the identifiers that turns hold (``conv_id, turn, role, text``).

    A turn whose text is ``{"tool_calls": [{"id", "name", "arguments", "depends_on"}]}`` makes calls (arguments
    are an object or a JSON string); one that is ``{"tool_call_id", "content"}`` answers the call of that id.
    """
    turns = with_envelope(conversations).select("conv_id", "turn", F.col("_m").alias("m"))
    calls = turns.select("conv_id", "turn", F.explode("m.tool_calls").alias("c")).select("conv_id", "turn",
        F.lit("call").alias("role"), F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.depends_on",
        F.lit(None).cast("string").alias("content"))
    none = F.lit(None).cast("string")
    results = turns.filter("m.tool_call_id is not null").select("conv_id", "turn", F.lit("result").alias("role"),
        F.col("m.tool_call_id").alias("call_id"), none.alias("name"), none.alias("arguments"),
        F.lit(None).cast("array<string>").alias("depends_on"), "m.content")
    return calls.union(results)


def messages_of(conversations: DataFrame) -> DataFrame:
    """Prose turns as tool traffic, for tables without any: an assistant's turn calls a tool with its whole
    text, the turn after it is the result, and the k-th call needs the call at half its place."""
    turn = F.col("turn")
    name = F.when(F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(7)) == 0,
        "browse").when(F.pmod(turn, F.lit(4)) < 2, "search").otherwise("summarise")
    size = F.size(F.split("text", " "))
    arguments = F.when(F.col("text").isNull(), None).when(name == "search",
        F.to_json(F.struct(size.alias("limit"), F.col("text").alias("query")))).otherwise(
        F.to_json(F.struct((size / 400).alias("ratio"), F.col("text").alias("text")))
    )
    id_of = lambda t: F.concat(F.lit("call_"), t.cast("long").cast("string"))
    half = F.floor(turn / 4) * 2 + F.pmod(turn, F.lit(2))
    needs = F.when((turn >= 2) & (half < turn), F.array(id_of(half))).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("string")
    calls = conversations.filter("role = 'assistant'").select(
        "conv_id", "turn", F.lit("call").alias("role"), id_of(turn).alias("call_id"), name.alias("name"),
            arguments.alias("arguments"), needs.alias("depends_on"), none.alias("content")
    )
    results = conversations.filter("role <> 'assistant' and turn > 0").select(
        "conv_id", "turn", F.lit("result").alias("role"), id_of(turn - 1).alias("call_id"), none.alias("name"),
            none.alias("arguments"),
        F.lit(None).cast("array<string>").alias("depends_on"), F.col("text").alias("content"),
    )
    return calls.union(results)


def op6_query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    schemas = spark.createDataFrame([(n, json.dumps(s)) for n, s in SCHEMAS], "name string, schema string")
    prose = with_envelope(conversations).filter("_m is null").drop("_m")
    return link_tool_calls(read_messages(conversations).union(messages_of(prose)), schemas).withColumn("problems",
        F.array_join("problems", "; "))
