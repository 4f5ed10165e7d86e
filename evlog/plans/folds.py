"""Folds of the event log as relational plans.

A fold is given by what it keeps, not by a loop. Each class knows three plans: partial(events) makes a state table, with a
row for each key; merge(older, newer) puts two state tables together, whichever events each has seen; finish(state) makes the
read model. A batch read model is finish(partial(events)); an incremental one merges the state with the partial state of each
new batch. So both give the same rows, and all the work is partial aggregates, shuffled by key after map-side combining.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import ship
from ..model import SpecError

POSITION = "global_position"


def of_types(types) -> Column:
    """Whether an event is of one of the types; None or "*": any."""
    return F.lit(True) if types in (None, "*") else F.col("type").isin([types] if isinstance(types, str) else list(types))


class Fold:
    key: str | list[str] | None

    @property
    def keys(self) -> list[str]:
        return [] if self.key is None else [self.key] if isinstance(self.key, str) else list(self.key)

    def partial(self, events: DataFrame) -> DataFrame:
        raise NotImplementedError

    def merge(self, older: DataFrame, newer: DataFrame) -> DataFrame:
        raise NotImplementedError

    def finish(self, state: DataFrame) -> DataFrame:
        raise NotImplementedError

    def batch(self, events: DataFrame) -> DataFrame:
        return self.finish(self.partial(events))

    def types(self) -> set[str] | None:
        """The event types that the fold looks at; None: all."""
        return None

    def expressions(self) -> list[str | None]:
        """The SQL that the fold is given in."""
        return []


def _union_types(groups) -> set[str] | None:
    groups = list(groups)
    return None if any(g in (None, "*") for g in groups) else {t for g in groups for t in ([g] if isinstance(g, str) else g)}


@dataclass(frozen=True)
class Measure:
    """count, sum, min, max or avg of an expression over events of some types. digits: sums and averages are of decimals with
    so many places, so that they don't depend on the order of the rows; None: plain doubles."""

    kind: str
    value: str | None = None
    types: tuple[str, ...] | str | None = None
    digits: int | None = 2


@dataclass
class Aggregates(Fold):
    """Commutative measures, for the whole log or by key (a column, or name -> expression for computed keys)."""

    measures: dict[str, Measure]
    key: str | list[str] | None = None
    key_columns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.measures:
            raise SpecError("an aggregate without measures")

    def types(self):
        return _union_types(m.types for m in self.measures.values())

    def expressions(self):
        return [*(m.value for m in self.measures.values()), *self.key_columns.values()]

    def _value(self, m: Measure) -> Column:
        value = F.lit(1) if m.value is None else F.expr(m.value)
        if m.kind in ("sum", "avg") and m.digits is not None:
            value = value.cast(T.DecimalType(28, m.digits))
        return F.when(of_types(m.types), value)

    def _parts(self):
        for name, m in self.measures.items():
            if m.kind == "avg":
                yield f"{name}__sum", "sum", m
                yield f"{name}__n", "count", m
            elif m.kind in ("sum", "count", "min", "max"):
                yield name, m.kind, m
            else:
                raise SpecError(f"no measure {m.kind!r}")

    def partial(self, events):
        for name, expression in self.key_columns.items():
            events = events.withColumn(name, F.expr(expression))
        keys = [*self.keys, *[k for k in self.key_columns if k not in self.keys]]
        return events.groupBy(*keys).agg(*[getattr(F, kind)(self._value(m)).alias(name) for name, kind, m in self._parts()])

    def merge(self, older, newer):
        keys = [*self.keys, *[k for k in self.key_columns if k not in self.keys]]
        again = lambda kind: F.sum if kind in ("sum", "count") else getattr(F, kind)
        both = older.unionByName(newer)
        merged = both.groupBy(*keys).agg(*[again(kind)(name).cast(newer.schema[name].dataType).alias(name) for name, kind, _ in self._parts()])
        return merged

    def finish(self, state):
        out = [F.col(k) for k in state.columns if k in self.keys or k in self.key_columns]
        for name, m in self.measures.items():
            if m.kind == "avg":
                out.append(F.try_divide(F.col(f"{name}__sum").cast("double"), F.col(f"{name}__n")).alias(name))
            else:
                out.append((F.col(name).cast("double") if m.kind == "sum" and m.digits is not None else F.col(name)).alias(name))
        return state.select(*out)


def signed_sum(plus: dict[str, str], minus: dict[str, str] | None = None, name: str = "total", **kinds) -> Aggregates:
    """A sum in which some types add and others subtract: type -> expression."""
    arms = "".join(f" WHEN type = '{t}' THEN {e}" for t, e in plus.items()) + "".join(f" WHEN type = '{t}' THEN -({e})" for t, e in (minus or {}).items())
    return Aggregates({name: Measure("sum", f"CASE{arms} END", (*plus, *(minus or {})))}, **kinds)


@dataclass
class Latest(Fold):
    """A keyed view: events of `upsert` types replace the key's row, those of `delete` types remove it, others don't count.
    where: rows of another shape are left out. Deletions stay in the state, so that merging never revives a row."""

    key: str
    fields: dict[str, str]
    upsert: tuple[str, ...] | str | None = "*"
    delete: tuple[str, ...] = ()
    where: str | None = None
    first: bool = False

    def types(self):
        return _union_types([self.upsert, self.delete])

    def expressions(self):
        return [*self.fields.values(), self.where]

    def partial(self, events):
        seen = of_types(self.upsert) | of_types(self.delete) if self.upsert != "*" else F.lit(True)
        gone = F.col("type").isin(list(self.delete)) if self.delete else F.lit(False)
        shaped = F.expr(self.where) | gone if self.where else F.lit(True)
        row = F.struct(gone.alias("gone"), *[F.expr(e).alias(n) for n, e in self.fields.items()])
        pick, edge = (F.min_by, F.min) if self.first else (F.max_by, F.max)
        return events.where(seen & shaped & F.col(self.key).isNotNull()).groupBy(self.key).agg(pick(row, POSITION).alias("row"), edge(POSITION).alias("at"))

    def merge(self, older, newer):
        pick, edge = (F.min_by, F.min) if self.first else (F.max_by, F.max)
        return older.unionByName(newer).groupBy(self.key).agg(pick("row", "at").alias("row"), edge("at").alias("at"))

    def finish(self, state):
        return state.where("not row.gone").select(self.key, *[F.col(f"row.{n}").alias(n) for n in self.fields])


@dataclass
class Fields(Fold):
    """Field by field the last writer wins: fields[name] = {event type: expression}, and an assigned null is a value too.
    start: what fields hold before any assignment."""

    key: str
    fields: dict[str, dict[str, str]]
    start: dict[str, object] = field(default_factory=dict)

    def types(self):
        return _union_types(tuple(w) for w in self.fields.values())

    def expressions(self):
        return [e for writes in self.fields.values() for e in writes.values()]

    def _assigned(self, name: str) -> Column:
        writes = self.fields[name]
        return F.struct(F.expr("CASE" + "".join(f" WHEN type = '{t}' THEN {e}" for t, e in writes.items()) + " END").alias("v"))

    def partial(self, events):
        out = []
        for name, writes in self.fields.items():
            at = F.when(of_types(tuple(writes)), F.col(POSITION))
            out += [F.max_by(self._assigned(name), at).alias(name), F.max(at).alias(f"{name}__at")]
        return events.groupBy(self.key).agg(*out)

    def merge(self, older, newer):
        parts = []
        for name in self.fields:
            parts += [F.max_by(name, f"{name}__at").alias(name), F.max(f"{name}__at").alias(f"{name}__at")]
        return older.unionByName(newer).groupBy(self.key).agg(*parts)

    def finish(self, state):
        value = lambda n: F.when(F.col(f"{n}__at").isNull(), F.lit(self.start.get(n))).otherwise(F.col(f"{n}.v")).alias(n)
        return state.select(self.key, *map(value, self.fields))


@dataclass
class Resettable(Fold):
    """A sum of contributions since the key's last reset: add[type] = expression."""

    key: str
    add: dict[str, str]
    reset: tuple[str, ...]
    name: str = "value"
    digits: int = 2

    def types(self):
        return _union_types([tuple(self.add), self.reset])

    def expressions(self):
        return list(self.add.values())

    def partial(self, events):
        given = F.expr("CASE" + "".join(f" WHEN type = '{t}' THEN {e}" for t, e in self.add.items()) + " END").cast(T.DecimalType(28, self.digits))
        # a key's events are first put together by stretches of positions, so that a hot key is many groups, then stretch after stretch
        slim = events.where(of_types((*self.add, *self.reset))).select(self.key, F.col(POSITION).alias("at"), F.shiftright(POSITION, 20).alias("stretch"), F.col("type").isin(list(self.reset)).alias("is_reset"), given.alias("given"))
        resets = slim.where("is_reset").groupBy(self.key, "stretch").agg(F.max("at").alias("reset_at"))
        late = F.col("reset_at").isNull() | (F.col("at") > F.col("reset_at"))
        stretches = slim.join(resets, [self.key, "stretch"], "left").groupBy(self.key, "stretch").agg(F.sum(F.when(late, F.col("given"))).cast(T.DecimalType(28, self.digits)).alias("sum"), F.max("reset_at").alias("reset_at"), F.max("at").alias("at"))
        return self._in_order(stretches)

    def merge(self, older, newer):
        return self._in_order(older.unionByName(newer))

    def _in_order(self, parts: DataFrame) -> DataFrame:
        """Of a key's states, in order of their events, those before the last one with a reset count no more."""
        states = F.array_sort(F.collect_list(F.struct("at", "reset_at", "sum")))
        zero = F.struct(F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("reset_at"), F.lit(None).cast(T.DecimalType(28, self.digits)).alias("sum"))
        both = lambda a, b: F.when(a.isNull(), b).otherwise(F.coalesce(a + b, a)).cast(T.DecimalType(28, self.digits))
        step = lambda a, b: F.struct(b.at.alias("at"), F.coalesce(b.reset_at, a.reset_at).alias("reset_at"), F.when(b.reset_at.isNotNull(), b["sum"]).otherwise(both(a["sum"], b["sum"])).alias("sum"))
        merged = parts.groupBy(self.key).agg(F.aggregate(states, zero, step).alias("s"))
        return merged.select(self.key, F.col("s.sum").alias("sum"), F.col("s.reset_at").alias("reset_at"), F.col("s.at").alias("at"))

    def finish(self, state):
        return state.select(self.key, F.coalesce(F.col("sum").cast("double"), F.lit(0.0)).alias(self.name))


@dataclass
class Machine(Fold):
    """The general fold, for states that no aggregate can hold: step(state, event) -> state over a key's events in order of
    position. state and event are dicts, state is kept as JSON. A key's events are folded in one task, read in sorted batches,
    so its memory is the state and one batch. only: the types that step looks at."""

    key: str
    step: Callable[[dict, dict], dict]
    zero: dict
    only: tuple[str, ...] | None = None

    def types(self):
        return None if self.only is None else set(self.only)

    def _run(self, events: DataFrame, state: DataFrame | None) -> DataFrame:
        ship(events.sparkSession)
        step, zero, key = self.step, json.dumps(self.zero), self.key
        rows = events.where(of_types(self.only)).select(F.col(key).cast("string").alias("k"), F.col(POSITION).alias("at"), "type", "data", "timestamp_ms", F.lit(None).cast("string").alias("state"))
        if state is not None:
            none = lambda kind: F.lit(None).cast(kind)
            rows = rows.unionByName(state.select("k", F.lit(-1).cast("long").alias("at"), none("string").alias("type"), none("string").alias("data"), none("long").alias("timestamp_ms"), F.to_json(F.struct("state", "at")).alias("state")))

        def rows_of(out):
            columns = list(zip(*out, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], ["k", "state", "at"])

        def fold(batches):
            current, held, upto, out = None, None, -1, []
            for rows in batches:
                for k, at, kind, data, ts, stored in zip(*(rows.column(c).to_pylist() for c in ("k", "at", "type", "data", "timestamp_ms", "state")), strict=True):
                    if k != current:
                        if current is not None:
                            out.append((current, json.dumps(held, sort_keys=True), upto))
                        current, held, upto = k, json.loads(zero), -1
                    if stored is not None:
                        was = json.loads(stored)
                        held, upto = json.loads(was["state"]), was["at"]
                    elif at > upto:
                        held, upto = step(held, {"type": kind, "data": None if data is None else json.loads(data), "timestamp_ms": ts, "position": at}), at
                yield rows_of(out)
                out = []
            if current is not None:
                yield rows_of([(current, json.dumps(held, sort_keys=True), upto)])

        return rows.where("k is not null").repartition("k").sortWithinPartitions("k", "at").mapInArrow(fold, "k string, state string, at long")

    def partial(self, events):
        return self._run(events, None)

    def advance(self, state: DataFrame | None, events: DataFrame) -> DataFrame:
        """The states after more events of the keys that have any: this fold goes on from a key's state."""
        if state is not None:
            state = state.join(events.where(of_types(self.only)).select(F.col(self.key).cast("string").alias("k")), "k", "left_semi")
        return self._run(events, state)

    def merge(self, older, newer):
        """Of a key's states the one that has seen most: each goes on from those before."""
        return older.unionByName(newer).groupBy("k").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))

    def finish(self, state):
        return state.select(F.col("k").alias(self.key), "state")


def replay(events: DataFrame, key: str, zero: Column, step: Callable[[Column, Column], Column], name: str = "state", columns: list[str] | None = None) -> DataFrame:
    """A state machine as an expression: step over each key's events in order, all in the JVM. A key's events form one array,
    so this is for keys of bounded size; Machine has no such bound."""
    columns = columns or ["type", "data"]
    own = F.array_sort(F.collect_list(F.struct(POSITION, *columns)))
    return events.groupBy(key).agg(F.aggregate(own, zero, step).alias(name))


def time_series(value: str, time: str, unit: str = "day", types=None, tenant: bool = False) -> Aggregates:
    """Sums by time bucket; buckets are plain keys that stay open."""
    from ..functions.values import _TIME_KEYS

    columns = {"time_key": f"date_format({time}, \"{_TIME_KEYS[unit]}\")"}
    return Aggregates({"value": Measure("sum", value, types)}, key="tenant_id" if tenant else None, key_columns=columns)


def fuse(folds: dict[str, Aggregates], events: DataFrame) -> dict[str, DataFrame]:
    """Several folds with the same keys in one scan and one aggregation: their measures side by side."""
    first = next(iter(folds.values()))
    if any(f.keys != first.keys or f.key_columns != first.key_columns for f in folds.values()):
        raise SpecError("folds with different keys can't share an aggregation")
    together = Aggregates({f"{n}__{m}": x for n, f in folds.items() for m, x in f.measures.items()}, first.key, first.key_columns)
    wanted = together.types()
    rows = together.batch(events if wanted is None else events.where(of_types(tuple(sorted(wanted)))))
    keys = [*first.keys, *first.key_columns]
    return {n: rows.select(*dict.fromkeys(keys), *[F.col(f"{n}__{m}").alias(m) for m in f.measures]) for n, f in folds.items()}


def union_of_types(folds: list[Fold]) -> set[str] | None:
    """The types that any of the folds looks at: what a shared scan has to read."""
    return reduce(lambda a, b: None if a is None or b is None else a | b, [f.types() for f in folds], set())
