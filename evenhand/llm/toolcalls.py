"""Tool-call linking for chat formatting.

Events are calls and results of tools inside conversations::

    conv_id, turn, seq, kind ('call' or 'result'), call_id, name, arguments (JSON text), content, after

``after`` names an earlier call whose result this call needs (or null). The steps:

1. hash join of calls and results by conversation and identifier. Of several calls (results) with one identifier the
   first by position counts, the others are ``duplicate``; minima find it, so a repeated identifier is no large group;
2. topological order: every event has at most one parent (a result its call, a call the result it waits for, else the call).
   Pointer jumping over the parents finds in log(depth) rounds the latest position among an event's ancestors and itself
   and how many steps it is behind that ancestor; ordered by (latest position, steps, position) parents come first, and
   events that are in order already keep their places. Events that never reach a root are in or behind a cycle. Numbers
   within a conversation are distributed prefix sums, so one conversation may hold any share of the rows;
3. arguments are checked against the tool's schema;
4. calls and results are serialised as canonical JSON: sorted keys, no blanks, shortest numbers, UTF-8.

Status: ``linked``, ``unanswered`` (call without result), ``orphan`` (result without call), ``duplicate``, ``no_id``,
``cyclic``. A missing dependency (``after`` that names no call) is ignored and reported as an error.

Defined cases: null conversations are one conversation; null positions come first; ties in position are broken by kind
and content; invalid or null JSON arguments, NaN, infinities, numbers beyond a double or of thousands of digits, halves of
surrogate pairs and more than 200 nested levels are errors, and the text is kept as a string; repeated rows are duplicates of one
call; conversations without events give no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from evenhand.llm.common import cut, running

#: Schemas of the tools by name: the part of JSON Schema that chat tools use.
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "lookup": {"type": "object", "required": ["key"], "additionalProperties": False, "properties": {"key": {"type": "string", "minLength": 1}, "exact": {"type": "boolean"}}},
    "summarise": {"type": "object", "required": ["text", "style"], "additionalProperties": True, "properties": {"text": {"type": "string"}, "style": {"enum": ["short", "long"]}, "tags": {"type": "array", "items": {"type": "string"}}}},
}
DEEPEST = 200  # levels of nested lists and objects
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def errors_of(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a JSON value, in order of its place; empty if it fits."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        if not number or (kind == "integer" and isinstance(value, float) and not value.is_integer()):
            return [f"{at}: not {kind}"]
    elif kind and not isinstance(value, _TYPES[kind]):
        return [f"{at}: not {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not allowed")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            found.append(f"{at}: out of range")
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        found.append(f"{at}: too short")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += errors_of(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                found += errors_of(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    return found


def canonical(value) -> str:
    """Canonical JSON: sorted keys, no blanks, whole numbers without a fraction."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                return None
            return int(x) if x.is_integer() and abs(x) < 1e15 else x
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _refused(constant: str):
    raise ValueError(f"{constant} is no JSON")


def _number(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _refused(text)


def _depth(value) -> int:
    """Levels of lists and objects, without recursion."""
    level, depth = [value], 0
    while level := [x for x in level if isinstance(x, (dict, list))]:
        level, depth = [y for x in level for y in (x.values() if isinstance(x, dict) else x)], depth + 1
    return depth


def parse(text: str | None):
    """``(value, error)`` of JSON text; the text itself where it is no JSON, or JSON that can't be kept: numbers beyond a double
    or of thousands of digits, NaN and infinities, halves of surrogate pairs, more than ``DEEPEST`` levels."""
    if not isinstance(text, str):
        return None, "$: no arguments"
    try:
        value = json.loads(text, parse_constant=_refused, parse_float=_number)
        if _depth(value) > DEEPEST:
            return text, "$: too deep"
        json.dumps(value, ensure_ascii=False).encode()  # halves of surrogate pairs have no UTF-8
    except UnicodeEncodeError:
        return text, "$: no text"
    except (ValueError, RecursionError):
        return text, "$: no JSON"
    return value, None


def serialised(kind: str, call_id: str | None, name: str | None, arguments: str | None, content: str | None, schemas: dict) -> tuple[str, list[str]]:
    """Canonical JSON of an event and the errors of a call's arguments."""
    if kind == "result":
        return canonical({"type": "tool_result", "id": call_id, "content": content}), []
    value, wrong = parse(arguments)
    errors = [wrong] if wrong else [f"unknown tool {name}"] if name not in schemas else errors_of(value, schemas[name])
    return canonical({"type": "tool_call", "id": call_id, "name": name, "arguments": value}), errors


def derived_events(turns: DataFrame) -> DataFrame:
    """Tool events derived from plain conversations (``conv_id, turn, role, text``), for tables that hold no tool calls.

    Each assistant turn is a call of one of three tools, with arguments made of its whole text; some lack a field, have a wrong
    type or are cut-off JSON, by a hash of the text. The next turn's text is its result; some results never come, some come before
    their call, some name an unknown call. Every third call waits for the call of the turn before the last. Turns that give no
    event: those of other roles (system), user turns before turn 1, and a ninth of the other user turns, by a hash (the
    results that never come)."""
    text, nothing = F.coalesce(F.col("text"), F.lit("")), F.lit(None).cast("string")
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))

    def draw(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "conv_id", "turn", "text"), F.lit(n))

    def call_of(turn: Column) -> Column:
        return F.concat_ws("-", F.lit("call"), conv, turn.cast("string"))

    def members(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    value = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)  # a JSON string
    limit = F.when(draw("l", 10) == 0, F.lit('"ten"')).otherwise((draw("n", 60) + 1).cast("string"))
    exact = F.when(draw("e", 2) == 0, F.lit("true")).otherwise(F.lit("false"))
    style = F.when(draw("s", 8) == 0, F.lit("odd")).otherwise(F.lit("short"))
    by_tool = {
        "search": members('{"limit": ', limit, ', "query": ', value, "}"),
        "lookup": F.when(draw("k", 12) == 0, F.lit('{"exact": true}')).otherwise(members('{"key": ', value, ', "exact": ', exact, "}")),
        "summarise": members('{"text": ', value, ', "tags": ["a", "b"], "style": "', style, '"}'),
    }
    tool = F.element_at(F.array(*[F.lit(x) for x in by_tool]), (draw("t", 3) + 1).cast("int"))
    arguments = F.coalesce(*[F.when(tool == x, made) for x, made in by_tool.items()])
    cut_off = F.when(draw("c", 50) == 0, F.substring(arguments, F.lit(1), F.length(arguments) - 1)).otherwise(arguments)
    calls = turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.lit(0).alias("seq"), F.lit("call").alias("kind"), call_of(F.col("turn")).alias("call_id"), tool.alias("name"),
        cut_off.alias("arguments"), nothing.alias("content"), F.when((draw("after", 3) == 0) & (F.col("turn") >= 2), call_of(F.col("turn") - 2)).alias("after"),
    )
    answered = turns.where((F.col("role") == "user") & (F.col("turn") >= 1) & (draw("never", 9) != 0))
    early = F.when(draw("early", 20) == 0, F.col("turn") - 2).otherwise(F.col("turn")).cast(turns.schema["turn"].dataType)
    known = F.when(draw("orphan", 25) == 0, F.lit("call-unknown")).otherwise(call_of(F.col("turn") - 1))
    results = answered.select(
        "conv_id", early.alias("turn"), F.lit(1).alias("seq"), F.lit("result").alias("kind"), known.alias("call_id"), nothing.alias("name"),
        nothing.alias("arguments"), F.col("text").alias("content"), nothing.alias("after"),
    )
    return calls.union(results)


def link(events: DataFrame, schemas: dict | None = None) -> DataFrame:
    """``conv_id, position, turn, kind, call_id, name, status, valid, errors, json`` for each event, ``position`` its place in
    its conversation's topological order (from 0)."""
    schemas = SCHEMAS if schemas is None else schemas

    @F.pandas_udf("json string, errors array<string>")
    def write(kind: pd.Series, call_id: pd.Series, name: pd.Series, arguments: pd.Series, content: pd.Series) -> pd.DataFrame:
        text = lambda x: x if isinstance(x, str) else None
        rows = [serialised(k, text(i), text(n), text(a), text(c), schemas) for k, i, n, a, c in zip(kind, call_id, name, arguments, content)]
        return pd.DataFrame({"json": [r[0] for r in rows], "errors": [r[1] for r in rows]})

    number = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(-(2**62))).alias(c)
    rows = events.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNull().alias("no_conv"), "turn", "kind",
        F.nullif(F.col("call_id"), F.lit("")).alias("call_id"), "name", "after",
        F.struct(number("turn"), number("seq"), "kind", F.xxhash64("name", "arguments", "content", "call_id").alias("tie")).alias("at"),
        write("kind", "call_id", "name", "arguments", "content").alias("out"),
    ).withColumn("row", F.monotonically_increasing_id())
    # Dense places over all events, conversation by conversation: one prefix sum, no window over a conversation.
    placed = running(cut(rows.withColumn("one", F.lit(1))), ["no_conv", "conv", "at", "row"], ["one"]).withColumnRenamed("before_one", "place")
    placed = cut(placed.drop("at", "row", "one"))

    # 1. the first call and result of each identifier, joined by it
    key = ["no_conv", "conv", "call_id"]
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("place"))).alias(kind)
    owners = cut(placed.where(F.col("call_id").isNotNull()).groupBy(key).agg(first("call"), first("result")))
    linked = placed.join(owners, key, "left")
    known = owners.select("no_conv", "conv", F.col("call_id").alias("after"), F.lit(True).alias("after_known"), F.coalesce("result", "call").alias("after_place"))
    waits = known.where(F.col("after_place").isNotNull())
    linked = linked.join(waits, ["no_conv", "conv", "after"], "left")
    own = F.when(F.col("kind") == "call", F.col("call")).otherwise(F.col("result"))
    parent = F.when((F.col("kind") == "result") & F.col("call").isNotNull(), F.col("call")).when(F.col("kind") == "call", F.col("after_place"))
    linked = cut(linked.withColumn("own", own).withColumn("parent", parent))

    # 2. pointer jumping: late is the latest place from here to jump (not included), steps the way to it
    trees = cut(linked.select("place", F.col("parent").alias("jump"), F.col("place").alias("late"), F.lit(0).cast("bigint").alias("steps"), F.lit(1).cast("bigint").alias("span")))
    done = trees.where(F.col("jump").isNull())
    open_ = trees.where(F.col("jump").isNotNull())
    left = open_.count()
    limit = max(1, left).bit_length() + 1
    for _ in range(limit):  # after log2(open) + 1 rounds only cycles are open
        if not left:
            break
        known = done.union(open_)
        above = known.select(F.col("place").alias("jump"), F.col("jump").alias("next"), F.col("late").alias("above"), F.col("steps").alias("above_steps"), F.col("span").alias("above_span"))
        lifted = F.col("above") > F.col("late")
        steps = F.when(lifted, F.col("span") + F.col("above_steps")).otherwise(F.col("steps")).alias("steps")
        late, span = F.greatest("late", "above").alias("late"), (F.col("span") + F.col("above_span")).alias("span")
        moved = cut(open_.join(above, "jump").select("place", F.col("next").alias("jump"), late, steps, span))
        done = cut(done.union(moved.where(F.col("jump").isNull())))
        open_ = moved.where(F.col("jump").isNotNull())
        left = open_.count()
    trees = done.select("place", "late", "steps", F.lit(False).alias("cyclic")).union(open_.select("place", F.col("place").alias("late"), F.lit(0).cast("bigint").alias("steps"), F.lit(True).alias("cyclic")))

    ordered = running(cut(linked.join(trees, "place").withColumn("one", F.lit(1))), ["no_conv", "conv", "cyclic", "late", "steps", "place"], ["one"])
    starts = linked.groupBy("no_conv", "conv").agg(F.min("place").alias("first"))
    other = F.when(F.col("kind") == "call", F.col("result")).otherwise(F.col("call"))
    status = (
        F.when(F.col("cyclic"), "cyclic").when(F.col("call_id").isNull(), "no_id").when(F.col("own") != F.col("place"), "duplicate")
        .when(other.isNotNull(), "linked").when(F.col("kind") == "call", "unanswered").otherwise("orphan")
    )
    lost = F.when(F.col("after").isNotNull() & F.col("after_known").isNull(), F.array(F.concat(F.lit("after: no call "), F.col("after")))).otherwise(F.array().cast("array<string>"))
    out = ordered.join(starts, ["no_conv", "conv"]).withColumn("errors", F.concat("out.errors", lost))
    return out.select("conv_id", (F.col("before_one") - F.col("first")).alias("position"), "turn", "kind", "call_id", "name", status.alias("status"), (F.size("errors") == 0).alias("valid"), "errors", F.col("out.json").alias("json"))
