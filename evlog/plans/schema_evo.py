"""Schemas of events over time: a lock file, what has changed since, and old events read as new ones.

A schema is {aggregate: {event: {field: type}}}; a type that ends in "?" is optional.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import SpecError

Schema = dict[str, dict[str, dict[str, str]]]


@dataclass(frozen=True)
class Change:
    kind: str  # event_added, event_removed, field_added, field_removed, field_type_changed
    aggregate: str
    event: str
    field: str | None = None
    before: str | None = None
    after: str | None = None

    @property
    def breaking(self) -> bool:
        """New events and new optional fields are fine; so is a field that becomes optional. Anything else breaks old events
        or their readers."""
        if self.kind == "event_added":
            return False
        if self.kind == "field_added":
            return not self.after.endswith("?")
        return not (self.kind == "field_type_changed" and self.after == f"{self.before}?")


def diff(locked: Schema, current: Schema) -> list[Change]:
    out = []
    for aggregate in sorted({*locked, *current}):
        old, new = locked.get(aggregate, {}), current.get(aggregate, {})
        for event in sorted({*old, *new}):
            if event not in new:
                out.append(Change("event_removed", aggregate, event))
            elif event not in old:
                out.append(Change("event_added", aggregate, event))
            else:
                a, b = old[event], new[event]
                for name in sorted({*a, *b}):
                    if name not in b:
                        out.append(Change("field_removed", aggregate, event, name, a[name]))
                    elif name not in a:
                        out.append(Change("field_added", aggregate, event, name, None, b[name]))
                    elif a[name] != b[name]:
                        out.append(Change("field_type_changed", aggregate, event, name, a[name], b[name]))
    return out


@dataclass
class Lock:
    """The schema that stored events follow, its version, and for each version the fields that came with it and the values
    that older events get for them."""

    version: int
    schema: Schema
    steps: list[dict] = field(default_factory=list)  # {"version", "aggregate", "event", "field", "default"}

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.schema, sort_keys=True).encode()).hexdigest()

    def dumps(self) -> str:
        return json.dumps(asdict(self) | {"hash": self.hash()}, indent=1, sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> Lock:
        body = json.loads(text)
        lock = cls(body["version"], body["schema"], body["steps"])
        if body.get("hash") != lock.hash():
            raise SpecError("the lock file was changed by hand")
        return lock

    @classmethod
    def load(cls, path: str | Path) -> Lock:
        return cls.loads(Path(path).read_text(encoding="utf-8"))

    def save(self, path: str | Path) -> None:
        """Write the lock file, whole."""
        temporary = Path(f"{path}.tmp")
        temporary.write_text(self.dumps(), encoding="utf-8")
        os.replace(temporary, path)

    def status(self, current: Schema) -> dict[str, list[Change]]:
        changes = diff(self.schema, current)
        return {"breaking": [c for c in changes if c.breaking], "non_breaking": [c for c in changes if not c.breaking]}

    def sync(self, current: Schema, defaults: dict[tuple[str, str, str], object] | None = None, force: bool = False) -> Lock:
        """The lock of the next version. Breaking changes need force, but for required fields that come with a default."""
        defaults = defaults or {}
        changes = diff(self.schema, current)
        given = lambda c: c.kind == "field_added" and (c.aggregate, c.event, c.field) in defaults
        broken = [c for c in changes if c.breaking and not given(c)]
        if broken and not force:
            raise SpecError(f"breaking changes: {broken}")
        if not changes:
            return self
        steps = [{"version": self.version + 1, "aggregate": c.aggregate, "event": c.event, "field": c.field, "default": defaults.get((c.aggregate, c.event, c.field))} for c in changes if c.kind == "field_added"]
        return Lock(self.version + 1, current, [*self.steps, *steps])


def upcast(events: DataFrame, lock: Lock, version: Column | None = None) -> DataFrame:
    """data of older events with the fields that later versions brought, at their defaults; a value that is there stays, an
    explicit null too.

    An event's version is `schema_version` in its metadata, 1 without it. The fields of an object are looked up once, and all
    that lack are added at once, so the plan doesn't grow with the steps: they are a constant. data that is no JSON object
    stays as it is."""
    latest = {(s["event"], s["field"]): s for s in sorted(lock.steps, key=lambda s: s["version"])}
    if not latest:
        return events
    by_event: dict[str, list] = {}
    for (event, name), step in latest.items():
        by_event.setdefault(event, []).append(F.struct(F.lit(name).alias("field"), F.lit(step["version"]).alias("since"), F.lit(f"{json.dumps(name)}:{json.dumps(step['default'])}").alias("entry")))
    steps = F.try_element_at(F.create_map(*[x for event, own in by_event.items() for x in (F.lit(event), F.array(*own))]), F.col("type"))
    stored = F.coalesce(F.get_json_object("metadata", "$.schema_version").try_cast("int"), F.lit(1)) if version is None else version
    there, since, lacking = _unlike(events, "_fields", "_version", "_lacking")
    rows = events.withColumn(there, F.when(F.rlike("data", F.lit(r"\}\s*$")), F.json_object_keys("data"))).withColumn(since, stored)
    rows = rows.withColumn(lacking, F.transform(F.filter(steps, lambda s: (s.since > F.col(since)) & ~F.array_contains(there, s.field)), lambda s: s.entry))
    added = F.concat(F.regexp_replace("data", r"\}\s*$", ""), F.when(F.size(there) > 0, F.lit(",")).otherwise(F.lit("")), F.array_join(lacking, ","), F.lit("}"))
    return rows.withColumn("data", F.when(F.size(lacking) > 0, added).otherwise(F.col("data"))).drop(there, since, lacking)


def _unlike(df: DataFrame, *wanted: str) -> list[str]:
    taken = {c.lower() for c in df.columns}
    return [name + "_" * sum(c.startswith(name) for c in taken) for name in wanted]


#: The types of payload fields, and the columns of read models that hold them.
COLUMN_TYPES = {"string": "string", "number": "double", "boolean": "boolean", "array": "string", "object": "string", "reference": "string"}


def view_ddl(name: str, key: str, fields: dict[str, str], index: list[str] | None = None) -> str:
    """The DDL of a read model's table: its tenant, its key, its columns in snake case, and when rows were made and changed."""
    from ..functions.values import snake_case

    columns = [f"tenant_id STRING NOT NULL, {snake_case(key)} STRING NOT NULL"]
    for field_name, kind in fields.items():
        base = kind.removesuffix("?")
        columns.append(f"{snake_case(field_name)} {COLUMN_TYPES.get(base, 'string').upper()}{'' if kind.endswith('?') else ' NOT NULL'}")
    columns.append("created_at TIMESTAMP, updated_at TIMESTAMP")
    hint = f" COMMENT 'sorted by tenant_id, {', '.join(map(snake_case, index))}'" if index else ""
    return f"CREATE TABLE {snake_case(name)} ({', '.join(columns)}) USING parquet{hint}"


def _not_of(value: Column, kind: str) -> Column:
    """Whether a variant that is there and not null is of another JSON type."""
    stored = F.schema_of_variant(value)
    if kind.startswith("array<") and kind.endswith(">"):
        inner = kind[6:-1].strip()
        items = F.transform(F.expr("cast(null as array<variant>)") if value is None else F.try_variant_get(value, "$", "array<variant>"), lambda x: F.coalesce(_not_of(x, inner.removesuffix("?")) & (F.schema_of_variant(x) != "VOID"), F.lit(True)) | (F.schema_of_variant(x) == "VOID") & F.lit(not inner.endswith("?")))
        return ~stored.startswith("ARRAY") | F.exists(items, lambda wrong: wrong)
    starts = {"string": ("STRING",), "reference": ("STRING",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}
    if kind not in starts:
        raise SpecError(f"no type {kind!r}")
    wrong = ~reduce(lambda a, b: a | b, [stored.startswith(x) for x in starts[kind]])
    return wrong | (F.try_variant_get(value, "$", "string") == "") if kind == "reference" else wrong


def invalid(events: DataFrame, schema: dict[str, dict[str, str]]) -> DataFrame:
    """Events whose payload is not of their type's schema, with what is wrong: {event: {field: type}}. Types are string, number,
    boolean, array, object, reference (a string that isn't empty) and array<type>; with "?" the field may lack or be null.
    JSON has no NaN, so a payload with one is no JSON and lacks all."""
    payload = F.try_parse_json("data")
    problems = []
    for event, fields in schema.items():
        for name, kind in fields.items():
            value = F.try_variant_get(payload, f"$.{name}", "variant")
            none = value.isNull() | (F.schema_of_variant(value) == "VOID")
            wrong = F.when(none, F.lit(not kind.endswith("?"))).otherwise(_not_of(value, kind.removesuffix("?")))
            problems.append(F.when((F.col("type") == event) & wrong, F.lit(f"{name}: not {kind}")))
    known = F.when(~F.col("type").isin(list(schema)), F.lit("unknown type"))
    return events.withColumn("problems", F.array_compact(F.array(known, *problems))).where(F.size("problems") > 0)
