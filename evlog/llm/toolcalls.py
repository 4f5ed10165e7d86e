"""Tool calls of conversations: linked to their results, ordered, validated and written as canonical JSON.

Events are calls and results. They come from markup in messages, `<tool_call>{"id":…,"name":…,"arguments":{…},"after":[…]}
</tool_call>` and `<tool_result>{"id":…,"content":…}</tool_result>`, and from plain turns, where a user or system turn is a
call (of `reply` or `instruct`, with the text as its argument, after the conversation's first turn) and an assistant turn is
the result of the turn before it. Identifiers hold within a conversation. Calls and results meet in a hash join on the
identifier, one row on each side. A call depends on the calls it names in `after`, and (level, turn, place) orders each
conversation topologically. Conversations of up to `task_edges` dependencies are ordered within a task, many conversations
a task. Those of more, a bounded number for their size, are ordered by rounds: a round takes the dependencies on the calls
that the round before resolved, and resolves the calls that wait for nothing more, so no conversation has to fit a task and
a round handles its own dependencies only.

Defined results: of calls that repeat an identifier the first by (turn, place) is linked and the others are `duplicate`; of
results the first is linked and the others counted in n_results; a result without a call is a row of status `orphan`; a
call without a result is `unanswered`; calls on or behind a cycle have status `cycle` and no level; dependencies on unknown
identifiers are errors and don't hold a call back. Markup that isn't JSON, lacks an id, nests deeper than 200 levels, or holds
what canonical JSON can't (a lone surrogate, a number beyond a double) is a row of status `malformed`.
Arguments of a tool without a schema are errors. Null conversations are one conversation; a null turn sorts first; a null
text has no events. Exactly repeated message rows count once. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, join_hot

_EVENT = pa.schema([("kind", pa.string()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("body", pa.string()), ("after", pa.list_(pa.string()))])
_EVENT_DDL = "kind string, conv_id long, turn long, place int, id string, name string, body string, after array<string>"
_MARKUP = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.DOTALL)

#: The schemas of the tools that plain turns call.
TURN_SCHEMAS = {name: {"type": "object", "required": ["text"], "additionalProperties": False, "properties": {"text": {"type": "string", "minLength": 1}}} for name in ("reply", "instruct")}


def canonical(value) -> str:
    """JSON with sorted keys (by UTF-16 units), no spaces, the shortest escapes and numbers as ECMAScript writes them."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, int) and not isinstance(value, bool) and abs(value) > 2**53:
        return _number(float(value))
    return json.dumps(value, ensure_ascii=False)


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    if x == 0:
        return "0"
    sign, digits, exponent = ("-" if x < 0 else ""), *f"{abs(x)!r}e0".split("e")[:2]
    whole, _, part = digits.partition(".")
    part = "" if part == "0" else part
    point = len(whole) + int(exponent)
    all_digits = (whole + part).lstrip("0")
    point -= len(whole + part) - len(all_digits)
    all_digits = all_digits.rstrip("0")
    n = len(all_digits)
    if n <= point <= 21:
        return sign + all_digits + "0" * (point - n)
    if 0 < point <= 21:
        return sign + all_digits[:point] + "." + all_digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + all_digits
    return sign + all_digits[0] + ("." + all_digits[1:] if n > 1 else "") + "e" + ("+" if point > 0 else "-") + str(abs(point - 1))


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or value == math.floor(value))
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema: type, enum, const, sizes, bounds, pattern, required, properties, items."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{at}: not an allowed value")
    if isinstance(value, str):
        out += [f"{at}: {k}" for k, bad in (("minLength", len(value) < schema.get("minLength", 0)), ("maxLength", len(value) > schema.get("maxLength", math.inf)), ("pattern", not re.search(schema.get("pattern", ""), value))) if bad]
    elif _is(value, "number"):
        out += [f"{at}: {k}" for k, bad in (("minimum", value < schema.get("minimum", -math.inf)), ("maximum", value > schema.get("maximum", math.inf))) if bad]
    elif isinstance(value, list):
        out += [f"{at}: {k}" for k, bad in (("minItems", len(value) < schema.get("minItems", 0)), ("maxItems", len(value) > schema.get("maxItems", math.inf))) if bad]
        for i, x in enumerate(value) if "items" in schema else []:
            out += violations(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    return out


_DEEPEST = 200


def _checked(value, depth: int = 0) -> None:
    """Refuses what can't be written as canonical JSON and read again."""
    if depth > _DEEPEST:
        raise ValueError("nested too deeply")
    if isinstance(value, dict):
        for k, v in value.items():
            _checked(k, depth)
            _checked(v, depth + 1)
    elif isinstance(value, list):
        for v in value:
            _checked(v, depth + 1)
    elif isinstance(value, str):
        value.encode()


def _marked(batches):
    for rows in batches:
        out = []
        for conv, turn, text in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "turn", "text")), strict=True):
            for place, (kind, body) in enumerate(_MARKUP.findall(text or "") if text and "<tool_" in text else []):
                try:
                    own = json.loads(body)
                    _checked(own)
                    name, after = own.get("name"), [str(x) for x in own.get("after") or []]
                    out.append((kind, conv, turn, place, str(own["id"]), None if name is None else str(name), canonical(own.get("arguments" if kind == "call" else "content")), after))
                except (ValueError, KeyError, AttributeError, TypeError, OverflowError, RecursionError):  # UnicodeError is a ValueError
                    out.append(("malformed", conv, turn, place, None, None, body, []))
        yield pa.RecordBatch.from_pylist([dict(zip(_EVENT.names, x, strict=True)) for x in out], schema=_EVENT)


def marked_events(messages: DataFrame) -> DataFrame:
    """The events in the messages' markup."""
    Work(messages.sparkSession, "calls")
    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text").distinct().mapInArrow(_marked, _EVENT_DDL)


def turn_events(messages: DataFrame) -> DataFrame:
    """Plain turns as events."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").where("text is not null and turn is not null").distinct()
    call = F.col("role") != "assistant"
    named = lambda turn: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), turn.cast("string"))
    body = F.when(call, F.concat(F.lit("{"), F.expr("""substring(to_json(struct(text)), 2)"""))).otherwise(F.expr("""regexp_extract(to_json(struct(text)), '^\\\\{"text":([\\\\s\\\\S]*)\\\\}$', 1)"""))
    return rows.where("role in ('user', 'system', 'assistant')").select(
        F.when(call, F.lit("call")).otherwise("result").alias("kind"), "conv_id", "turn", F.lit(-1).alias("place"), named(F.when(call, F.col("turn")).otherwise(F.try_subtract("turn", F.lit(1)))).alias("id"),
        F.when(F.col("role") == "user", "reply").when(F.col("role") == "system", "instruct").alias("name"), body.alias("body"),
        F.when(call & (F.col("turn") > 0), F.array(named(F.lit(0)))).otherwise(F.array().cast("array<string>")).alias("after"),
    )


def _ordered(batches):
    """(k, level) of the calls of whole conversations, which come one after another: (conv, k, dep) sorted by conv."""

    def levels(edges):
        waits, behind, out = {}, {}, {}
        for k, dep in edges:
            waits[k] = waits.get(k, 0) + 1
            behind.setdefault(dep, []).append(k)
        ready = [dep for dep in behind if dep not in waits]
        while ready:
            done = ready.pop()
            for k in behind.get(done, ()):
                out[k] = max(out.get(k, 0), out.get(done, 0) + 1)
                waits[k] -= 1
                if not waits[k]:
                    ready.append(k)
        found = [k for k in out if not waits[k]]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([out[k] for k in found], pa.int32())], ["k", "level"])

    held, last = [], ()
    for rows in batches:
        for conv, k, dep in zip(*(rows.column(c).to_pylist() for c in ("conv", "k", "dep")), strict=True):
            if (conv,) != last and len(held) > 50_000:
                yield levels(held)
                held = []
            last = (conv,)
            held.append((k, dep))
    if held:
        yield levels(held)


def _by_rounds(work: Work, edges: DataFrame) -> DataFrame | None:
    """(k, level) of the calls with dependencies in large conversations, round by round. edges: (k, dep)."""
    total = edges.count()
    if not total:
        return None
    wanted = work.save(edges.groupBy("dep").agg(F.count("*").alias("n")), "wanted")
    # what each call waits for; the first to be resolved are the calls that wait for nothing
    state = work.save(edges.groupBy("k").agg(F.count("*").alias("waits")).withColumn("level", F.lit(0)), "state-0")
    front = work.save(wanted.join(state, wanted["dep"] == state["k"], "left_anti").select("dep", F.lit(0).alias("at"), "n"), "front-0")
    names, number = [], 0
    while not front.isEmpty():
        number += 1
        met = join_hot(edges, front, "dep", "n", total).groupBy("k").agg(F.count("*").alias("met"), (F.max("at") + 1).alias("reached"))
        moved = state.join(met, "k", "left").select("k", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits"), F.greatest("level", F.coalesce("reached", F.lit(0))).alias("level"))
        state = work.save(moved, f"moved-{number}")
        names.append(f"{work.path}/resolved-{number}")
        new = work.save(state.where("waits = 0").select("k", "level"), f"resolved-{number}")
        state = work.save(state.where("waits > 0"), f"state-{number}")
        front = work.save(new.join(wanted, new["k"] == wanted["dep"]).select("dep", F.col("level").alias("at"), "n"), f"front-{number}")
        for old in (f"state-{number - 1}", f"front-{number - 1}", f"moved-{number}"):
            work.drop(old)
    return work.spark.read.schema("k string, level int").parquet(*names) if names else None


def _levels(work: Work, calls: DataFrame, edges: DataFrame, task_edges: int) -> DataFrame:
    """(k, level) of all calls that no cycle holds back. edges: (conv, k, dep), both calls."""
    sizes = edges.groupBy("conv").agg(F.count("*").alias("n"))
    large = F.broadcast(work.save(sizes.where(F.col("n") > task_edges).select(F.col("conv").alias("big")), "large"))  # edges / task_edges rows at most
    within = edges.join(large, F.col("conv").eqNullSafe(F.col("big")), "left_anti")
    found = work.save(within.repartition("conv").sortWithinPartitions("conv").mapInArrow(_ordered, "k string, level int"), "levels")
    rounds = _by_rounds(work, work.save(edges.join(large, F.col("conv").eqNullSafe(F.col("big")), "left_semi").select("k", "dep"), "large-edges"))
    free_calls = calls.join(edges.select("k").distinct(), "k", "left_anti").select("k", F.lit(0).alias("level"))
    out = free_calls.unionByName(found)
    return out if rounds is None else out.unionByName(rounds)


def _rendered(schemas: dict):
    def run(batches):
        for rows in batches:
            valid, errors, texts = [], [], []
            for name, key, body, result, unknown in zip(*(rows.column(c).to_pylist() for c in ("name", "call_id", "body", "result", "unknown")), strict=True):
                arguments = None if body is None else json.loads(body)
                wrong = [f"after {x}: unknown" for x in unknown or []]
                if name in schemas:
                    wrong += violations(arguments, schemas[name])
                else:
                    wrong.append(f"{name}: no schema")
                valid.append(not wrong)
                errors.append(wrong)
                texts.append(canonical({"id": key, "name": name, "arguments": arguments, "result": None if result is None else json.loads(result)}))
            keep = ["conv_id", "turn", "place", "call_id", "name", "level", "status", "result_turn", "n_results"]
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in keep], pa.array(valid, pa.bool_()), pa.array(errors, pa.list_(pa.string())), pa.array(texts, pa.string())], [*keep, "valid", "errors", "json"])

    return run


_LINKED = "conv_id long, turn long, place int, call_id string, name string, level int, status string, result_turn long, n_results long, valid boolean, errors array<string>, json string"


def link(events: DataFrame, schemas: dict, task_edges: int = 5_000) -> DataFrame:
    """A row for each call, and for each orphan result and malformed event (with neither level nor JSON)."""
    work = Work(events.sparkSession, "calls")
    key = F.concat_ws("\0", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "id")
    events = work.save(events.withColumn("k", key), "events")
    at = F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("turn"), "place")
    calls = events.where("kind = 'call'")
    firsts = work.save(calls.groupBy("k").agg(F.min(at).alias("first"), F.count("*").alias("n")), "firsts")
    own = join_hot(calls.withColumn("at", at), firsts, "k", "n", events.count())
    calls = work.save(own.withColumn("duplicate", F.col("at") != F.col("first")).drop("at", "first", "n"), "calls")
    linked = calls.where("not duplicate")
    answers = work.save(events.where("kind = 'result'").groupBy("k").agg(F.min(F.struct(at.alias("at"), "conv_id", "turn", "place", "id", "body")).alias("r"), F.count("*").alias("n_results")), "answers")
    wanted = linked.select("k", F.col("conv_id").alias("conv"), F.explode(F.array_distinct("after")).alias("dep_id")).withColumn("dep", F.concat_ws("\0", F.coalesce(F.col("conv").cast("string"), F.lit("")), "dep_id"))
    sought = work.save(wanted.groupBy("dep").agg(F.count("*").alias("n")).join(linked.select(F.col("k").alias("dep"), F.lit(True).alias("there")), "dep", "left"), "sought")
    edges = work.save(join_hot(wanted, sought, "dep", "n", events.count()).select("conv", "k", "dep", "dep_id", "there"), "all-edges")
    unknown = edges.where("there is null").groupBy("k").agg(F.array_sort(F.collect_list("dep_id")).alias("unknown"))
    levels = _levels(work, linked, edges.where("there").select("conv", "k", "dep"), task_edges)
    joined = linked.join(levels, "k", "left").join(answers, "k", "left").join(unknown, "k", "left")
    status = F.when(F.col("level").isNull(), "cycle").when(F.col("n_results").isNull(), "unanswered").otherwise("answered")
    shown = joined.select("conv_id", "turn", "place", F.col("id").alias("call_id"), "name", "level", status.alias("status"), F.col("r.turn").alias("result_turn"), F.coalesce("n_results", F.lit(0)).alias("n_results"), "body", F.col("r.body").alias("result"), "unknown")
    none = lambda kind: F.lit(None).cast(kind)
    again = calls.where("duplicate").select("conv_id", "turn", "place", F.col("id").alias("call_id"), "name", none("int").alias("level"), F.lit("duplicate").alias("status"), none("long").alias("result_turn"), F.lit(0).cast("long").alias("n_results"), "body", none("string").alias("result"), none("array<string>").alias("unknown"))
    out = shown.unionByName(again).mapInArrow(_rendered(schemas), _LINKED)
    bare = lambda df, status, n: df.select("conv_id", "turn", "place", F.col("id").alias("call_id"), none("string").alias("name"), none("int").alias("level"), F.lit(status).alias("status"), none("long").alias("result_turn"), n.alias("n_results"), none("boolean").alias("valid"), none("array<string>").alias("errors"), none("string").alias("json"))
    orphans = answers.join(linked.select("k"), "k", "left_anti").select("r.conv_id", "r.turn", "r.place", "r.id", "n_results")
    return out.unionByName(bare(orphans, "orphan", F.col("n_results"))).unionByName(bare(events.where("kind = 'malformed'"), "malformed", F.lit(0).cast("long")))
