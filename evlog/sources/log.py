"""The event log: Parquet files that commit files make visible.

    <path>/data/<id>/part-*.parquet     events
    <path>/_log/<number>.json           {"base", "count", "folder", "token", "replaces", "heads" | "heads_folder"}
    <path>/_snapshots/<number>.json     what all commits up to a number come to
    <path>/heads/, <path>/tokens/       sorted runs: streams with their revisions, tokens with their commits

A commit file is created exclusively under the next number, after its data are complete; that one step publishes the commit,
so a batch is there as a whole or not at all, and a job that fails or loses executors leaves only files that nothing names
(vacuum() removes them).

A writer works on one state of the log: number, next position, heads and tokens, all as of the same commit. What it appends
is placed, and every condition and token checked, on that state, and published as the state's number and one. If another
writer was there first, the state is read on and all of it is done again: conditions, positions, revisions.

The state is kept in memory and read on commit by commit; a new process starts from the newest snapshot. Commits carry the
heads they make; at a snapshot these go to a sorted run, and runs are merged as they grow, so that neither an append nor
opening the log reads events. Small commits are merged level by level into larger ones, sorted by (stream, revision).
"""

from __future__ import annotations

import io
import json
import threading
import time
import uuid
from collections import deque
from dataclasses import asdict, dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import DEFAULT_TENANT, EVENT_COLUMNS, EVENT_DDL, NO_STREAM, ConcurrencyError, EvlogError, NotOpenError, StoreFatalError, integrity
from ..operators import reads
from .files import Files, Journal

_EVENTS = pa.schema([(c.split()[0], pa.int64() if c.endswith(" long") else pa.string()) for c in EVENT_DDL.split(", ")])
_HEADS = pa.schema([("stream_id", pa.string()), ("revision", pa.int64())])
_TOKENS = pa.schema([("token", pa.string()), ("number", pa.int64())])
_TRIES = 50
#: Tables of so many rows are read and written by the driver; longer ones by Spark.
_FEW = 100_000


@dataclass(frozen=True)
class Appended:
    stream_revision: int
    global_position: int
    event_count: int


@dataclass(frozen=True)
class BatchAppended:
    streams: dict[str, Appended]
    global_position: int
    total_events: int


@dataclass
class Append:
    """One stream's part of a batch. expected_revision: None, any; -1, the stream must not exist; else exactly that one."""

    stream_id: str
    events: list[dict]
    expected_revision: int | None = None
    tenant_id: str = DEFAULT_TENANT


@dataclass(frozen=True)
class Commit:
    number: int
    base: int
    count: int
    folder: str
    token: str | None = None
    replaces: list[int] = field(default_factory=list)


class _Runs:
    """Sorted tables of (key, number) of which a key's greatest counts; a new one is merged with those of about its size."""

    def __init__(self, log: EventLog, folder: str, schema: pa.Schema, tables: list | None = None):
        self.log, self.folder, self.schema, self.tables = log, folder, schema, [list(t) for t in tables or []]
        self.key, self.value = schema.names

    def frame(self) -> DataFrame:
        paths = [f"{self.log.path}/{self.folder}/{name}" for name, _ in self.tables]
        ddl = f"{self.key} string, {self.value} long"
        return self.log.spark.read.schema(ddl).parquet(*paths) if paths else self.log.spark.createDataFrame([], ddl)

    def rows(self) -> int:
        return sum(n for _, n in self.tables)

    def all(self) -> dict[str, int]:
        """Everything, for runs of a size that is known to fit."""
        out: dict[str, int] = {}
        for name, _ in self.tables:
            for key, value in self.log._read_table(f"{self.folder}/{name}", self.schema):
                out[key] = max(value, out.get(key, value))
        return out

    def find(self, keys: list[str]) -> dict[str, int]:
        if not self.tables or not keys:
            return {}
        rows = self.frame()
        if len(keys) <= 1000:
            rows = rows.where(F.col(self.key).isin(keys))
        else:
            rows = rows.join(self.log.spark.createDataFrame([(k,) for k in keys], f"{self.key} string"), self.key, "left_semi")
        return dict(tuple(r) for r in rows.groupBy(self.key).agg(F.max(self.value)).collect())

    def add(self, numbers: dict[str, int]) -> None:
        if numbers:
            name = uuid.uuid4().hex
            self.log._write_table(f"{self.folder}/{name}", self.schema, sorted(numbers.items()))
            self.tables.append([name, len(numbers)])
            self.merge()

    def merge(self) -> None:
        at = len(self.tables)
        while at > 1 and self.tables[at - 2][1] < 4 * sum(n for _, n in self.tables[at - 1 :]):
            at -= 1
        if len(self.tables) - at < 1:
            return
        newer, name = _Runs(self.log, self.folder, self.schema, self.tables[at - 1 :]), uuid.uuid4().hex
        if newer.rows() <= _FEW:
            numbers = newer.all()
            self.log._write_table(f"{self.folder}/{name}", self.schema, sorted(numbers.items()))
        else:
            merged = newer.frame().groupBy(self.key).agg(F.max(self.value).alias(self.value))
            merged.repartitionByRange(self.key).sortWithinPartitions(self.key).write.parquet(f"{self.log.path}/{self.folder}/{name}")
        self.tables[at - 1 :] = [[name, newer.rows()]]


class _State:
    """The log as of commit `number`."""

    def __init__(self, log: EventLog, body: dict | None = None):
        body = body or {"number": -1, "position": 0, "live": [], "heads": [], "tokens": []}
        self.number, self.position = body["number"], body["position"]
        self.live = {c["number"]: Commit(**c) for c in body["live"]}
        self.head_runs, self.token_runs = _Runs(log, "heads", _HEADS, body["heads"]), _Runs(log, "tokens", _TOKENS, body["tokens"])
        self.most = log.heads_in_memory
        self.recent: dict[str, int] = {}  # heads of commits since the runs
        self.known: dict[str, int] = {}  # heads that the runs hold, as far as they were read
        self.whole = not self.head_runs.tables  # whether `known` has all of them
        self.tokens: dict[str, int] = {}

    def apply(self, number: int, body: dict) -> None:
        commit = Commit(number, body["base"], body["count"], body["folder"], body["token"], body.get("replaces") or [])
        for gone in commit.replaces:
            self.live.pop(gone, None)
        self.live[number] = commit
        if not commit.replaces:
            self.position = commit.base + commit.count
            self.recent.update(body.get("heads") or {})
            if body.get("heads_folder"):
                self.head_runs.tables.append(body["heads_folder"])
                self.known.clear()
                self.whole = False
        if commit.token is not None:
            self.tokens[commit.token] = number
        self.number = number

    def heads(self, stream_ids: list[str]) -> dict[str, int]:
        """Runs of up to `most` streams are read once; of longer ones only what is asked for."""
        if not self.whole and self.head_runs.rows() <= self.most:
            self.known, self.whole = self.head_runs.all(), True
        if not self.whole and (missing := [s for s in stream_ids if s not in self.known]):
            if len(self.known) > self.most:
                self.known.clear()
                missing = stream_ids
            self.known.update(dict.fromkeys(missing, NO_STREAM) | self.head_runs.find(missing))
        return {s: max(self.recent.get(s, NO_STREAM), self.known.get(s, NO_STREAM)) for s in stream_ids}

    def heads_frame(self, log: EventLog) -> DataFrame:
        """(stream_id, revision) of every stream there is."""
        recent = log.spark.createDataFrame(sorted(self.recent.items()), "stream_id string, revision long")
        return self.head_runs.frame().unionByName(recent).groupBy("stream_id").agg(F.max("revision").alias("revision"))

    def commit_of(self, token: str) -> int | None:
        found = self.tokens.get(token)
        return self.token_runs.find([token]).get(token) if found is None else found

    def commits(self) -> list[Commit]:
        return sorted(self.live.values(), key=lambda c: (c.base, c.number))


class EventLog:
    def __init__(self, spark: SparkSession, path: str, auto_flush: int = 1, clock=lambda: int(time.time() * 1000), snapshot_every: int = 128, fanout: int = 64, tail_events: int = 100_000, heads_in_memory: int = 1_000_000):
        """auto_flush: how many events are held back before they are committed; 1: each call commits; 0: only flush() does.
        snapshot_every: commits between snapshots. fanout: how many commits of a level are merged into one of the next; 0: none.
        tail_events: how many of its own last events the writer keeps in memory for read_cached(). heads_in_memory: up to so
        many streams' heads are kept in memory; of more, those that were asked for."""
        self.spark, self.path, self.auto_flush, self.clock = spark, path.rstrip("/"), auto_flush, clock
        self.snapshot_every, self.fanout, self.heads_in_memory = snapshot_every, fanout, heads_in_memory
        self.files = Files(spark, self.path)
        self.journal, self.snapshots = Journal(self.files, "_log"), Journal(self.files, "_snapshots")
        self._lock, self._pending, self._open, self._failed = threading.RLock(), [], True, None
        self._known: _State | None = None
        self.tail: deque[tuple] = deque(maxlen=tail_events)
        self.before_append = None  # a hook: called with the number of events, may raise to hold writers back

    @classmethod
    def open(cls, spark: SparkSession, path: str, **options) -> EventLog:
        return cls(spark, path, **options)

    # -- state

    def close(self) -> None:
        """Commit what is held back, and take no more calls; closing twice is fine."""
        with self._lock:
            if self._open and self._failed is None:
                self.flush()
            self._open = False

    def is_open(self) -> bool:
        return self._open

    def is_failed(self) -> bool:
        return self._failed is not None

    def failed_error(self) -> Exception | None:
        return self._failed

    def data_dir(self) -> str:
        return self.path

    def _check(self) -> None:
        if not self._open:
            raise NotOpenError("the log is closed")
        if self._failed is not None:
            raise StoreFatalError("an earlier write failed; open the log again") from self._failed

    def _state(self) -> _State:
        """The log as it is now: the state in memory, read on."""
        with self._lock:
            if self._known is None or len(self._known.recent) > self.heads_in_memory:
                newest = max(self.snapshots.numbers(), default=None)
                self._known = _State(self, None if newest is None else json.loads(self.files.read(self.snapshots.name(newest))))
            for number, body in self.journal.after(self._known.number):
                self._known.apply(number, body)
            return self._known

    def commits(self) -> list[Commit]:
        """The commits that count, in order: those that a compaction has replaced are left out."""
        return self._state().commits()

    # -- reads

    def committed(self, first: int = 0, last: int | None = None) -> DataFrame:
        """The committed events of commits that reach into the positions; others' files are not even listed."""
        folders = [f"{self.path}/data/{c.folder}" for c in self.commits() if c.count and c.base + c.count > first and (last is None or c.base <= last)]
        return self.spark.read.schema(EVENT_DDL).parquet(*folders) if folders else self.spark.createDataFrame([], EVENT_DDL)

    def events(self, first: int = 0) -> DataFrame:
        """Committed events and those held back by this writer, placed behind them."""
        self._check()
        with self._lock:
            rows = self.committed(first)
            return rows.unionByName(self.spark.createDataFrame(self._place(self._pending, self._state(), False)[0], EVENT_DDL)) if self._pending else rows

    def read_global(self, start: int = 0, limit: int | None = None) -> DataFrame:
        return reads.global_scan(self.events(start), start, limit)

    def read_global_durable(self, start: int = 0, limit: int | None = None) -> DataFrame:
        self._check()
        return reads.global_scan(self.committed(start), start, limit)

    def stream_global(self, start: int = 0):
        """The events one by one, in order, without holding them all."""
        return self.read_global(start).toLocalIterator()

    def stream_global_durable(self, start: int = 0):
        return self.read_global_durable(start).toLocalIterator()

    def read_cached(self, start: int, limit: int) -> list[dict] | None:
        """Committed events from a position on, from memory alone; None if any of them isn't there."""
        self._check()
        with self._lock:
            rows = list(self.tail)
            end = self._state().position
            wanted = min(end, start + limit) - start
            if start >= end or not rows or rows[0][0] > start or rows[-1][0] < start + wanted - 1:
                return None
            found = [dict(zip(EVENT_COLUMNS, r, strict=True)) for r in rows if start <= r[0] < start + wanted]
            return found if len(found) == wanted else None

    def read_stream(self, stream_id: str, **options) -> DataFrame:
        return reads.stream_scan(self.events(), stream_id, **options)

    def heads(self, stream_ids: list[str]) -> dict[str, int]:
        """The streams' revisions, events held back included; -1 for streams that don't exist."""
        with self._lock:
            found = self._state().heads(stream_ids)
            for operations, _ in self._pending:
                for o in operations:
                    if o.stream_id in found:
                        found[o.stream_id] += len(o.events)
            return found

    def stream_revision(self, stream_id: str) -> int:
        self._check()
        return self.heads([stream_id])[stream_id]

    def has_stream(self, stream_id: str) -> bool:
        return self.stream_revision(stream_id) != NO_STREAM

    def stream_ids(self) -> DataFrame:
        """From the heads alone: no event is read."""
        self._check()
        with self._lock:
            names = self._state().heads_frame(self).select("stream_id")
            held = {(o.stream_id,) for operations, _ in self._pending for o in operations}
            return reads.stream_ids(names.unionByName(self.spark.createDataFrame(sorted(held), "stream_id string")) if held else names)

    def durable_position(self) -> int:
        """How many events are committed: the next position to be."""
        return self._state().position

    def global_position(self) -> int:
        self._check()
        return self.durable_position() + self._held()

    def validate(self) -> DataFrame:
        return integrity(self.committed())

    # -- writes

    def append(self, stream_id: str, events: list[dict], expected_revision: int | None = None, tenant_id: str = DEFAULT_TENANT, token: str | None = None) -> Appended:
        """Append to one stream. token: a call that is repeated with the same token after it was committed changes nothing."""
        if not events:
            raise EvlogError("nothing to append")
        return self.append_batch([Append(stream_id, events, expected_revision, tenant_id)], token).streams[stream_id]

    def append_batch(self, operations: list[Append], token: str | None = None) -> BatchAppended:
        """Append to several streams at once, all or none. Every condition is checked against the log as it was before; parts
        for one stream follow each other, and the condition of the first holds.

        Of events that are held back the result is provisional: flush() checks their conditions on the log as it is then,
        and returns what they have become."""
        with self._lock:
            self._check()
            total = sum(len(o.events) for o in operations)
            if not total:
                return BatchAppended({}, self.global_position(), 0)
            if any(not o.stream_id for o in operations):
                raise EvlogError("a stream needs an id")
            if self.before_append is not None:
                self.before_append(total)
            batch = ([o for o in operations if o.events or o.expected_revision is not None], self.clock())
            if self.auto_flush == 1 or token is not None:
                self.flush()
                return self._commit([batch], token)[-1]
            result = self._place([*self._pending, batch], self._state())[1][-1]
            self._pending.append(batch)
            return self.flush()[-1] if self.auto_flush and self._held() >= self.auto_flush else result

    def _held(self) -> int:
        return sum(len(o.events) for operations, _ in self._pending for o in operations)

    def _place(self, batches: list[tuple[list[Append], int]], state: _State, check: bool = True) -> tuple[list[tuple], list[BatchAppended]]:
        """The events of batches as rows behind a state, and the batches' results. Each batch's conditions hold for the log and
        the batches before it."""
        heads = state.heads(list(dict.fromkeys(o.stream_id for operations, _ in batches for o in operations)))
        position, rows, results = state.position, [], []
        for operations, now in batches:
            seen, done, base = set(), {}, position
            for o in operations:
                if check and o.stream_id not in seen and o.expected_revision is not None and heads[o.stream_id] != o.expected_revision:
                    raise ConcurrencyError(o.stream_id, o.expected_revision, heads[o.stream_id])
                seen.add(o.stream_id)
            for o in operations:
                first = position
                for e in o.events:
                    heads[o.stream_id] += 1
                    rows.append((position, o.stream_id, heads[o.stream_id], e["type"], json.dumps(e.get("data")), None if e.get("metadata") is None else json.dumps(e["metadata"]), now, o.tenant_id))
                    position += 1
                if o.events:
                    before = done.get(o.stream_id)
                    done[o.stream_id] = Appended(heads[o.stream_id], before.global_position if before else first, len(o.events) + (before.event_count if before else 0))
            results.append(BatchAppended(done, base, position - base))
        return rows, results

    def _as_before(self, commit: int) -> BatchAppended:
        """The result of a commit, from its events, wherever a compaction has put them."""
        body = json.loads(self.files.read(self.journal.name(commit)))
        first, last = body["base"], body["base"] + body["count"] - 1
        rows = self.committed(first, last).where(F.col("global_position").between(first, last))
        streams = rows.groupBy("stream_id").agg(F.max("revision"), F.min("global_position"), F.count("*")).collect()
        return BatchAppended({r[0]: Appended(*r[1:]) for r in streams}, first, body["count"])

    def flush(self) -> list[BatchAppended]:
        """Commit what is held back, as one commit, and return each call's final result. If a condition doesn't hold any more
        nothing is committed, the error is raised, and all stays held back, for discard() or for another try."""
        with self._lock:
            self._check()
            if not self._pending:
                return []
            results = self._commit(self._pending, None)
            self._pending = []
            return results

    def discard(self) -> int:
        """Give up what is held back; how many events that were."""
        with self._lock:
            n, self._pending = self._held(), []
            return n

    def _commit(self, batches: list[tuple[list[Append], int]], token: str | None) -> list[BatchAppended]:
        for _ in range(_TRIES):
            state = self._state()
            if token is not None and (done := state.commit_of(token)) is not None:
                return [self._as_before(done)]
            rows, results = self._place(batches, state)
            folder = uuid.uuid4().hex
            heads = {r[1]: r[2] for r in rows}  # the last of each stream
            try:
                self._write_table(f"data/{folder}", _EVENTS, rows)
                made = self.journal.publish(state.number + 1, {"base": state.position, "count": len(rows), "folder": folder, "token": token, "heads": heads})
            except Exception as e:
                self._failed = e
                raise StoreFatalError("a commit could not be written") from e
            if made:
                self.tail.extend(rows)
                self._keep_up()
                return results
            self.files.delete(f"data/{folder}")
        raise EvlogError("other writers were first, again and again")

    def _write_table(self, folder: str, schema: pa.Schema, rows: list[tuple]) -> None:
        """Rows as a table: a Parquet file from here if they are few, else by Spark."""
        if len(rows) > _FEW:
            self.spark.createDataFrame(rows, ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)).write.parquet(f"{self.path}/{folder}")
            return
        out = io.BytesIO()
        pq.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema), out, compression="zstd")
        self.files.write(f"{folder}/part-00000.parquet", out.getvalue())

    def _read_table(self, folder: str, schema: pa.Schema) -> list[tuple]:
        """The rows of a small table, without a job where its files are on this machine."""
        if self.files.local is not None:
            names = [n for n in self.files.names(folder) if n.endswith(".parquet")]
            tables = [pq.read_table(f"{self.files.local}/{folder}/{n}", schema=schema) for n in names]
            return [row for t in tables for row in zip(*(c.to_pylist() for c in t.columns), strict=True)]
        ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in schema)
        return [tuple(r) for r in self.spark.read.schema(ddl).parquet(f"{self.path}/{folder}").collect()]

    def append_frame(self, frame: DataFrame, order: list[str], token: str | None = None) -> tuple[int, int]:
        """Append a DataFrame (stream_id, type, data, and metadata, timestamp_ms, tenant_id if they are there) in the order of the
        given columns; returns its first position and its number of events.

        Positions are dense without a single task: the frame is range-sorted and stored once, partitions are counted, and each
        row's position is its partition's offset and its place there. Revisions are taken the same way, within (partition,
        stream) and by offsets for each pair, so that a stream with a third of all events is spread over partitions too."""
        with self._lock:
            self._check()
            self.flush()
            if token is not None and (done := self._state().commit_of(token)) is not None:
                return self._span(done)
            staging = f"data/{uuid.uuid4().hex}"
            given = {"metadata": F.lit(None).cast("string"), "timestamp_ms": F.lit(self.clock()), "tenant_id": F.lit(DEFAULT_TENANT)}
            rows = frame.select("*", *[v.alias(k) for k, v in given.items() if k not in frame.columns])
            place = F.monotonically_increasing_id()  # the partition's number, then the row's in it
            rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", place).write.parquet(f"{self.path}/{staging}")
            try:
                return self._append_staged(staging, token)
            finally:
                self.files.delete(staging)

    def _span(self, commit: int) -> tuple[int, int]:
        body = json.loads(self.files.read(self.journal.name(commit)))
        return body["base"], body["count"]

    def _append_staged(self, staging: str, token: str | None) -> tuple[int, int]:
        staged = self.spark.read.parquet(f"{self.path}/{staging}").withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND((1 << 33) - 1))
        sizes = sorted((r["_part"], r["count"]) for r in staged.groupBy("_part").count().collect())  # a row a partition
        total, starts, at = sum(n for _, n in sizes), [], 0
        for part, n in sizes:
            starts.append((part, at))
            at += n
        if not total:
            return self.durable_position(), 0
        offsets = self.spark.createDataFrame(starts, "_part long, _start long")
        pairs = staged.groupBy("stream_id", "_part").agg(F.count("*").alias("n"))
        upto = Window.partitionBy("stream_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        own = F.row_number().over(Window.partitionBy("_part", "stream_id").orderBy("_nth")).cast("long") - 1
        for _ in range(_TRIES):
            state = self._state()
            if token is not None and (done := state.commit_of(token)) is not None:
                return self._span(done)
            folder, heads_folder = uuid.uuid4().hex, uuid.uuid4().hex
            heads = state.heads_frame(self).select("stream_id", (F.col("revision") + 1).alias("_head"))
            before = pairs.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(heads, "stream_id", "left").select("stream_id", "_part", (F.col("_before") + F.coalesce("_head", F.lit(0))).alias("_before"))
            placed = staged.withColumn("_own", own).join(F.broadcast(offsets), "_part").join(before, ["stream_id", "_part"])
            done = placed.withColumn("global_position", F.col("_start") + F.col("_nth") + state.position).withColumn("revision", F.col("_before") + F.col("_own"))
            made_heads = pairs.groupBy("stream_id").agg(F.sum("n").alias("n")).join(heads, "stream_id", "left").select("stream_id", (F.coalesce("_head", F.lit(0)) + F.col("n") - 1).alias("revision"))
            try:
                # as they lie, by (stream, partition): a range would need another pass; merging levels puts them in order
                done.select(*EVENT_COLUMNS).sortWithinPartitions("stream_id", "revision").write.parquet(f"{self.path}/data/{folder}")
                made_heads.repartitionByRange("stream_id").sortWithinPartitions("stream_id").write.parquet(f"{self.path}/heads/{heads_folder}")
                n_heads = self.spark.read.parquet(f"{self.path}/heads/{heads_folder}").count()
                body = {"base": state.position, "count": total, "folder": folder, "token": token, "heads_folder": [heads_folder, n_heads]}
                made = self.journal.publish(state.number + 1, body)
            except Exception as e:
                self._failed = e
                raise StoreFatalError("a commit could not be written") from e
            if made:
                self._keep_up()
                return body["base"], total
            self.files.delete(f"data/{folder}")
            self.files.delete(f"heads/{heads_folder}")
        raise EvlogError("other writers were first, again and again")

    # -- upkeep

    def _keep_up(self) -> None:
        """After a commit of this writer: merge a full level of commits, and make a snapshot when it is due. Neither changes
        what the log says, so a failure here is no failure of the append; the next writer comes by."""
        state = self._state()
        commits = state.commits()
        levels = [self._level(c) for c in commits]
        for level in range(max(levels) + 1 if self.fanout else 0):
            at = len(commits)
            while at and levels[at - 1] <= level:
                at -= 1
            if levels[at:].count(level) >= self.fanout:  # smaller ones among them go along
                self._merge(commits[at:])
                break
        if state.number and state.number % self.snapshot_every == 0:
            self.snapshot()

    def _level(self, commit: Commit, rows: int = 1000) -> int:
        level = 0
        while commit.count > rows * self.fanout**level:
            level += 1
        return level

    def snapshot(self) -> None:
        """Write down what all commits come to: a new process starts from here."""
        with self._lock:
            state = self._state()
            state.head_runs.add(state.recent)
            state.head_runs.merge()  # with those that came with large commits
            state.token_runs.add(state.tokens)
            if state.whole and len(state.known) + len(state.recent) <= state.most:
                for name, revision in state.recent.items():
                    state.known[name] = max(revision, state.known.get(name, revision))
            else:
                state.known, state.whole = {}, False
            state.recent, state.tokens = {}, {}
            body = {"number": state.number, "position": state.position, "live": [asdict(c) for c in state.commits()], "heads": state.head_runs.tables, "tokens": state.token_runs.tables}
            self.snapshots.publish(state.number, body)
            for old in sorted(self.snapshots.numbers())[:-2]:
                self.files.delete(self.snapshots.name(old))

    def _merge(self, old: list[Commit], file_rows: int = 5_000_000) -> Commit | None:
        """Neighbouring commits as one; None if another writer has merged some of them."""
        folder, first = uuid.uuid4().hex, old[0].base
        body = {"base": first, "count": sum(c.count for c in old), "folder": folder, "token": None, "replaces": [c.number for c in old]}
        if body["count"] <= _FEW and self.files.local is not None:
            few = [row for c in old if c.count for row in self._read_table(f"data/{c.folder}", _EVENTS)]
            self._write_table(f"data/{folder}", _EVENTS, sorted(few, key=lambda r: (r[1], r[2])))
        else:
            rows = self.spark.read.schema(EVENT_DDL).parquet(*[f"{self.path}/data/{c.folder}" for c in old if c.count])
            rows.repartitionByRange("stream_id", "revision").sortWithinPartitions("stream_id", "revision").write.option("maxRecordsPerFile", file_rows).parquet(f"{self.path}/data/{folder}")
        for _ in range(_TRIES):
            state = self._state()
            if not all(c.number in state.live for c in old):
                break
            if self.journal.publish(state.number + 1, body):
                self._state()
                return Commit(state.number, **body)
        self.files.delete(f"data/{folder}")
        return None

    def compact(self, file_rows: int = 5_000_000) -> Commit | None:
        """All commits as one, sorted by (stream, revision) so that stream reads prune row groups."""
        with self._lock:
            self.flush()
            old = self.commits()
            return self._merge(old, file_rows) if len(old) > 1 else None

    def vacuum(self) -> list[str]:
        """Remove data that no commit names: what failed or replaced commits have left. For when no one reads older snapshots
        and no other writer is at work."""
        with self._lock:
            state = self._state()
            live = {c.folder for c in state.commits()}
            dead = [d for d in self.files.names("data") if d not in live]
            for folder in dead:
                self.files.delete(f"data/{folder}")
            newest = [json.loads(self.files.read(self.snapshots.name(n))) for n in self.snapshots.numbers()]
            for runs in (state.head_runs, state.token_runs):
                named = {name for name, _ in [*runs.tables, *(t for b in newest for t in b[runs.folder])]}
                for name in self.files.names(runs.folder):
                    if name not in named:
                        self.files.delete(f"{runs.folder}/{name}")
            return dead
