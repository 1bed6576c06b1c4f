"""Tool-call linking: join calls and results by identifier, order them topologically, validate arguments, serialise.

``link`` joins results to calls on (conversation, identifier). A call may wait for others (``parent_id``, or an array ``parents``); its
level is the number of calls on the longest way to it, and (level, seq, call_id) sorts a conversation topologically. Chains of calls
that wait for one other are passed by pointer doubling, log2(n) joins on (conversation, call); calls that wait for several are settled
in rounds, as many as such calls follow on each other. No conversation sits in a task. Calls on a cycle, and those that wait for
one, get no level and status ``cycle``.

Defined cases: a call without a result is ``pending``; a result without a call is kept as ``orphan``; of repeated results of a
call the earliest counts (ties: smallest content), of repeated calls of an identifier too (ties: smallest arguments); every
other one is a row of its own with status ``duplicate`` and no level. A parent that doesn't exist is no parent. Null identifiers
match nothing and wait for nothing: each such call is ``pending``, each such result an ``orphan``. Arguments that aren't a JSON
object are invalid; so are NaN, infinities and numbers that overflow, which JSON lacks, and arguments nested too deeply to be read.
Escaped lone surrogates stay escaped. A schema may use the keywords of JSON Schema that ``keyword`` lists, with references inside
itself; unknown keywords and schemas that can't be read make arguments invalid, they never fail the job. Empty tables give empty results. Further
columns, of whatever name, are ignored. Texts of any length are taken whole.
"""

from __future__ import annotations

import json
import math
import re
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, remove, written

#: Keywords that say nothing about a value, as JSON Schema defines them.
NOTES = {"$schema", "$id", "$anchor", "$comment", "$defs", "definitions", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format", "contentEncoding", "contentMediaType"}


def is_number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


#: JSON type names and the values that have them. A bool is no number; a number without a fraction is an integer, however it is written.
KINDS = {
    "null": lambda v: v is None, "boolean": lambda v: isinstance(v, bool), "string": lambda v: isinstance(v, str), "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict),
    "number": is_number, "integer": lambda v: is_number(v) and v == int(v),
}


def same(a, b) -> bool:
    """Equality of JSON values: numbers by value, never equal to true or false."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def matches(pattern: str, text: str) -> bool:
    try:
        return re.search(pattern, text) is not None
    except re.error:
        return False


def resolved(ref: str, root) -> object:
    """What a reference inside the schema points to, false where there is nothing."""
    if not ref.startswith("#"):
        return False
    for part in ref[1:].split("/")[1:]:
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        root = root.get(part, False) if isinstance(root, dict) else root[int(part)] if isinstance(root, list) and part.isdigit() and int(part) < len(root) else False
    return root


def multiple(value, step) -> bool:
    return Fraction(str(value)) % Fraction(str(step)) == 0


#: Simple checks: the kind of value that each applies to, whether it holds, and what to say where it doesn't.
CHECKS = {
    "minLength": ("string", lambda v, x: len(v) >= x, "too short"), "maxLength": ("string", lambda v, x: len(v) <= x, "too long"), "pattern": ("string", lambda v, x: matches(x, v), "not of the pattern"),
    "minimum": ("number", lambda v, x: v >= x, "out of range"), "maximum": ("number", lambda v, x: v <= x, "out of range"), "exclusiveMinimum": ("number", lambda v, x: v > x, "out of range"), "exclusiveMaximum": ("number", lambda v, x: v < x, "out of range"),
    "multipleOf": ("number", multiple, "not a multiple"), "minItems": ("array", lambda v, x: len(v) >= x, "too few items"), "maxItems": ("array", lambda v, x: len(v) <= x, "too many items"),
    "uniqueItems": ("array", lambda v, x: not x or not any(same(a, b) for k, a in enumerate(v) for b in v[:k]), "repeated items"),
    "minProperties": ("object", lambda v, x: len(v) >= x, "too few members"), "maxProperties": ("object", lambda v, x: len(v) <= x, "too many members"),
}


def faults(value, schema, at: str = "$", root=None) -> list[str]:
    """What is wrong with a value, by the keywords of JSON Schema. A keyword that isn't one is a fault of the schema, never a pass."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    if not isinstance(schema, dict):
        return [f"{at}: not a schema"]
    root = schema if root is None else root
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    if kinds and not any(k in KINDS and KINDS[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(map(str, kinds))}"]
    out = []
    for word, x in schema.items():
        out += keyword(word, x, value, schema, at, root)
    return out


def keyword(word: str, x, value, schema: dict, at: str, root) -> list[str]:
    """The faults of one keyword of a schema."""
    fits = lambda s, v=value: not faults(v, s, at, root)
    inside = lambda pairs: [f for path, v, s in pairs for f in faults(v, s, at + path, root)]
    if word in CHECKS:
        kind, holds, said = CHECKS[word]
        return [f"{at}: {said}"] if KINDS[kind](value) and not holds(value, x) else []
    members = sorted(value.items()) if isinstance(value, dict) else []
    items = value if isinstance(value, list) else []
    known, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
    match word:
        case "type":
            return []
        case "enum":
            return [] if any(same(value, v) for v in x) else [f"{at}: not in enum"]
        case "const":
            return [] if same(value, x) else [f"{at}: not the constant"]
        case "required":
            return [f"{at}.{k}: missing" for k in x if isinstance(value, dict) and k not in value]
        case "properties":
            return inside((f".{k}", v, x[k]) for k, v in members if k in x)
        case "patternProperties":
            return inside((f".{k}", v, s) for k, v in members for p, s in x.items() if matches(p, k))
        case "additionalProperties":
            rest = [(k, v) for k, v in members if k not in known and not any(matches(p, k) for p in patterns)]
            return [f"{at}.{k}: unknown" for k, _ in rest] if x is False else inside((f".{k}", v, x) for k, v in rest)
        case "propertyNames":
            return inside((f".{k}", k, x) for k, _ in members)
        case "dependentRequired":
            return [f"{at}.{n}: missing" for k, names in x.items() if members and k in value for n in names if n not in value]
        case "prefixItems":
            return inside((f"[{k}]", v, s) for k, (v, s) in enumerate(zip(items, x, strict=False)))
        case "items":
            first = len(schema.get("prefixItems", []))
            listed = x if isinstance(x, list) else None
            return inside((f"[{k}]", v, listed[k] if listed else x) for k, v in enumerate(items) if k >= first and (listed is None or k < len(listed)))
        case "contains":
            return [] if not isinstance(value, list) or any(fits(x, v) for v in items) else [f"{at}: lacks an item"]
        case "allOf":
            return [f for s in x for f in faults(value, s, at, root)]
        case "anyOf":
            return [] if any(fits(s) for s in x) else [f"{at}: fits none of the choices"]
        case "oneOf":
            return [] if sum(fits(s) for s in x) == 1 else [f"{at}: doesn't fit one choice"]
        case "not":
            return [f"{at}: not allowed"] if fits(x) else []
        case "if":
            return faults(value, schema.get("then", True) if fits(x) else schema.get("else", True), at, root)
        case "then" | "else":
            return []
        case "$ref":
            return faults(value, resolved(x, root), at, root)
    return [] if word in NOTES else [f"{at}: unknown keyword {word}"]


def checked(value, schema) -> list[str]:
    """``faults``, also of a schema that is itself malformed or refers to itself without end."""
    try:
        return faults(value, schema)
    except RecursionError:
        return ["$: the schema refers to itself without end"]
    except (TypeError, ValueError, AttributeError, KeyError, ZeroDivisionError) as e:
        return [f"$: the schema can't be read: {type(e).__name__}"]


def escaped(text: str) -> str:
    """The text with lone surrogates, which no encoding has, as JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    """Members sorted by name, no spare space, characters as they are."""
    return escaped(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")))


def number(text: str) -> float:
    if not math.isfinite(x := float(text)):
        raise ValueError("JSON has no such number")
    return x


def parsed(text: str | None) -> tuple[object, list[str]]:
    """(value, faults) of a JSON text."""
    try:
        value = json.loads(text or "", parse_float=number, parse_constant=number)
        canonical(value)
    except RecursionError:
        return None, ["$: nested too deeply"]
    except ValueError:
        return None, ["$: not JSON"]
    return value, []


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): calls on the longest way to it; null on and behind a cycle. Rows: conv_id, call_id, and parent_id or parents."""
    parents = F.col("parents") if "parents" in calls.columns else F.array("parent_id")
    ids = calls.select("conv_id", F.col("call_id").alias("up"))
    edges = written(calls.select("conv_id", "call_id", F.explode(F.array_distinct(F.array_compact(parents))).alias("up")).join(ids, ["conv_id", "up"], "left_semi"), "waits")
    counted = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("up").alias("up"))
    now = calls.select("conv_id", "call_id").join(counted, ["conv_id", "call_id"], "left")
    one = F.col("n") == 1
    # a pointer to the call waited for, of calls that wait for one; the others are ends
    now = written(now.select("conv_id", "call_id", F.when(one, F.col("up")).alias("up"), F.coalesce(one, F.lit(False)).cast("long").alias("steps"), F.when(~F.coalesce(one, F.lit(False)), F.col("call_id")).alias("end"), (F.coalesce("n", F.lit(0)) > 1).alias("several")), "levels")
    most, done = now.count(), 1
    while done < 2 * most and not now.filter("up IS NOT NULL").isEmpty():
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("more"), F.col("end").alias("end2"))
        step = now.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("up2").alias("up"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("end", "end2").alias("end"), "several")
        step = written(step, "levels")
        remove(now)
        now, done = step, done * 2
    ends = now.filter("end IS NOT NULL AND up IS NULL").select("conv_id", "call_id", "end", "steps")
    settled = now.filter("NOT several AND end = call_id").select("conv_id", F.col("call_id").alias("end"), F.lit(0).cast("long").alias("base"))
    waiting = now.filter("several").select("conv_id", "call_id")
    while not waiting.isEmpty():
        # the way to each call waited for: its chain's end, and the steps from there
        reached = edges.join(waiting, ["conv_id", "call_id"], "left_semi").join(ends.withColumnRenamed("call_id", "up"), ["conv_id", "up"], "left").join(settled, ["conv_id", "end"], "left")
        ready = reached.groupBy("conv_id", "call_id").agg(F.max(F.col("base") + F.col("steps") + 1).alias("base"), F.count_if(F.col("base").isNull()).alias("missing")).filter("missing = 0")
        ready = written(ready.select("conv_id", F.col("call_id").alias("end"), "base"), "settled")
        if ready.isEmpty():
            break
        settled = written(settled.unionByName(ready), "settled")
        waiting = written(waiting.join(ready.withColumnRenamed("end", "call_id"), ["conv_id", "call_id"], "left_anti"), "waiting")
    return now.select("conv_id", "call_id").join(ends.join(settled, ["conv_id", "end"]).select("conv_id", "call_id", (F.col("base") + F.col("steps")).alias("level")), ["conv_id", "call_id"], "left")


def first_of(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(the first row of each identifier, all others). Rows of an identifier used once pass by; those of others are counted and compared with
    their smallest one, which is found by partial aggregation, so an identifier on very many rows is in no window."""
    key = ["conv_id", "call_id"]
    repeated = written(rows.groupBy(*key).agg(F.count("*").alias("times")).filter("times > 1").select(*key), "repeated-ids")
    once, several = rows.join(repeated, key, "left_anti"), rows.join(repeated, key, "left_semi")
    rest = [c for c in rows.columns if c not in key]
    place = F.struct(*order)
    several = several.groupBy(*key, *rest).agg(F.count("*").alias("times"))
    least = several.groupBy(*key).agg(F.min(place).alias("least"))
    several = several.join(least, key).withColumn("first", place.eqNullSafe(F.col("least")))
    again = several.withColumn("times", F.col("times") - F.col("first").cast("long")).filter("times > 0")
    again = again.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(*rows.columns)
    return once.unionByName(several.filter("first").select(*rows.columns)), again


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row a call, and one an orphan or repeated result: conv_id, call_id, seq, name, level, status, valid, errors, record (canonical JSON).

    ``calls``: conv_id, call_id, seq, name, arguments (JSON), and parent_id or parents (an array); ``results``: conv_id, call_id, seq, content.
    """
    waits = "parents" if "parents" in calls.columns else "parent_id"
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.select("conv_id", "call_id", "seq", "arguments", "name", waits).withColumn("asked", F.lit(True))
    results = results.select("conv_id", "call_id", F.col("seq").alias("result_seq"), "content").withColumn("answered", F.lit(True))
    # rows without an identifier match nothing: they stay out of the groups and the join, where they would meet in one task
    first, more_calls = first_of(calls.filter(known), "seq", "arguments", "name", waits)
    reply, more_replies = first_of(results.filter(known), "result_seq", "content")
    asked = first.join(levels(first), ["conv_id", "call_id"], "left")
    joined = asked.join(reply, ["conv_id", "call_id"], "full").withColumn("again", F.lit(False))
    extra = [t.withColumn("again", F.lit(True)) for t in (more_calls, more_replies)]
    lone = [calls.filter(~known).withColumn("level", F.lit(0).cast("long")), results.filter(~known)]
    for part in (extra[1], *(t.withColumn("again", F.lit(False)) for t in lone), joined):
        extra[0] = extra[0].unionByName(part, allowMissingColumns=True)
    joined = extra[0]
    schema = joined.select("conv_id", "call_id").schema
    for name, kind in (("seq", calls.schema["seq"].dataType), ("name", T.StringType()), ("level", T.LongType()), ("status", T.StringType()), ("valid", T.BooleanType()), ("errors", T.ArrayType(T.StringType())), ("record", T.StringType())):
        schema = schema.add(name, kind)

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                problems, arguments = [], None
                if r["asked"]:
                    arguments, problems = parsed(r["arguments"])
                    if not problems:
                        shape = schemas.get(r["name"])
                        problems = [f"no tool {r['name']}"] if shape is None else [escaped(x) for x in checked(arguments, shape)]
                status = "duplicate" if r["again"] else "orphan" if not r["asked"] else "cycle" if r["level"] is None else "linked" if r["answered"] else "pending"
                record = {"id": r["call_id"], "level": r["level"], "name": r["name"], "arguments": arguments, "result": r["content"], "status": status}
                out.append((r["name"], r["level"], status, bool(r["asked"]) and not problems, problems, canonical(record)))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("call_id"), b.column("seq"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "call_id", "seq", "name", "level", "status", "valid", "errors", "record"])

    return joined.select("conv_id", "call_id", F.coalesce("seq", "result_seq").alias("seq"), "name", "arguments", "level", "asked", "answered", "again", "content").mapInArrow(run, schema)


#: The recorded turns as tools: a user's turn asks, a system turn configures; the assistant turn after it is the result.
TURN_SCHEMAS = {
    "ask": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}},
    "configure": {"type": "object", "required": ["text", "turn"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 0}}},
}


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of recorded conversations. A call's identifier is its turn; it waits for the call two turns before."""
    turn = F.col("turn").cast("long")
    asks = conversations.filter("role IN ('user', 'system')")
    calls = asks.select(
        "conv_id",
        F.concat(F.lit("call_"), turn.cast("string")).alias("call_id"),
        turn.alias("seq"),
        F.when(F.col("role") == "user", "ask").otherwise("configure").alias("name"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), turn.alias("turn"))).alias("arguments"),
        F.concat(F.lit("call_"), (turn - 2).cast("string")).alias("parent_id"),
    )
    results = conversations.filter("role = 'assistant'").select("conv_id", F.concat(F.lit("call_"), (turn - 1).cast("string")).alias("call_id"), turn.alias("seq"), F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


def op5_tool_calls(spark, sf_dir: str) -> DataFrame:
    calls, results = turns_as_calls(read_table(spark, sf_dir, "conversations"))
    out = link(calls, results, TURN_SCHEMAS)
    return out.select("conv_id", "call_id", "name", "level", "status", "valid", F.array_join("errors", ";").alias("errors"), F.sha2("record", 256).alias("record_sha256"))
