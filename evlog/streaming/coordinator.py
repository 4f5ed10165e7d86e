"""Keeping projections up to date with the log.

The stream's source is the folder of commit files: a commit becomes visible there as a whole, so a micro-batch is a list of
commits, and their Parquet files are read with the union of the projections' event types pushed down, once for all projections
that share the reader. Each projection's state moves from position to position, whatever micro-batches come or come again.
A projection that fails stops its query; no event is passed over.
"""

from __future__ import annotations

import random
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import EVENT_DDL, BackpressureTimeoutError, CatchUpTimeoutError, CoordinatorError, NotStartedError, ProjectionBuildError
from ..operators.telemetry import health
from ..plans.folds import of_types, union_of_types
from ..plans.projections import Options, Projection, Published, Registry, StateStore, advance, model, view
from ..sources.log import EventLog


def schedule(options: list[Options]) -> tuple[int, int]:
    """Commits a micro-batch and milliseconds between micro-batches for projections that share a reader: the shortest of what
    any of them asks for. The jitter keeps readers that were started together from storing together."""
    each = []
    for o in options:
        pause = o.poll_ms if not o.checkpoint_ms else max(o.poll_ms, o.checkpoint_ms + random.randint(-o.jitter_ms, o.jitter_ms))
        each.append((pause, max(1, o.batch_commits * pause // max(1, o.poll_ms))))
    return min(n for _, n in each), min(p for p, _ in each)


class Coordinator:
    """Runs the projections of a registry over a log. Two coordinators over one path don't harm each other: the second to store
    a step is refused (StateStore), its query stops, and the states go on from the first's."""

    def __init__(self, log: EventLog, registry: Registry, path: str | None = None):
        self.log, self.registry, self.spark = log, registry, log.spark
        self.path = (path or f"{log.path}/projections").rstrip("/")
        self.queries: dict[str, StreamingQuery] = {}

    def store(self, name: str) -> StateStore:
        return StateStore(self.spark, f"{self.path}/states", name)

    # -- life

    def running(self) -> bool:
        return any(q.isActive for q in self.queries.values())

    def start(self) -> None:
        """Start the queries: one for all projections that share a reader, one each for the others. Starting twice is fine."""
        if self.running():
            return
        enabled = self.registry.enabled()
        if not enabled:
            return
        self.log.files.fs.mkdirs(self.log.files._path("_log"))
        shared = [p for p in enabled if p.options.shared_reader]
        groups = ([("shared", shared)] if shared else []) + [(p.name, [p]) for p in enabled if not p.options.shared_reader]
        for name, group in groups:
            self.queries[name] = self._start(name, group)

    def _start(self, name: str, group: list[Projection], once: bool = False) -> StreamingQuery:
        batch_commits, pause = schedule([p.options for p in group])
        commits = self.spark.readStream.format("text").option("maxFilesPerTrigger", batch_commits).option("pathGlobFilter", "*.json").load(f"{self.log.path}/_log")

        def take(batch: DataFrame, _: int) -> None:
            part = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind)
            found = batch.where(F.coalesce(part("replaces[0]", "string"), F.lit("")) == "").agg(F.max(part("base", "long") + part("count", "long"))).first()[0]
            if found:
                self.take(group, found - 1)

        writer = commits.writeStream.queryName(f"evlog-{name}-{id(self)}").foreachBatch(take).option("checkpointLocation", f"{self.path}/reader-{name}")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{pause} milliseconds")).start()

    def take(self, group: list[Projection], upto: int) -> None:
        """Bring the group's states up to a position. Positions, not micro-batches, say what is new; after a compaction the
        events are where the log says now."""
        seen = min(self.store(p.name).position() for p in group)
        if upto <= seen:
            return
        wanted = union_of_types([p.fold for p in group])
        events = self.log.committed(seen + 1, upto).where(F.col("global_position").between(seen + 1, upto))
        if wanted is not None:
            events = events.where(of_types(tuple(sorted(wanted))))
        if len(group) > 1:
            events = events.persist()
        try:
            for p in group:
                try:
                    advance(p, self.store(p.name), events, upto)
                except Exception as e:
                    raise ProjectionBuildError(f"{p.name} failed between positions {seen + 1} and {upto}") from e
        finally:
            if len(group) > 1:
                events.unpersist()

    def run_once(self) -> None:
        """Catch up with all commits there are, and stop."""
        if self.running():
            raise CoordinatorError("the projections are running")
        self.start_once()
        for q in self.queries.values():
            q.awaitTermination()
        self.queries = {}

    def start_once(self) -> None:
        self.log.files.fs.mkdirs(self.log.files._path("_log"))
        enabled = self.registry.enabled()
        shared = [p for p in enabled if p.options.shared_reader]
        for name, group in ([("shared", shared)] if shared else []) + [(p.name, [p]) for p in enabled if not p.options.shared_reader]:
            self.queries[name] = self._start(name, group, once=True)

    def stop(self) -> None:
        for q in self.queries.values():
            q.stop()
        self.queries = {}

    def rebuild(self, name: str) -> None:
        """Forget a projection's state and fold the whole log again."""
        projection, store = self.registry.require(name), self.store(name)
        store.reset()
        upto = self.log.durable_position() - 1
        if upto >= 0:
            advance(projection, store, self.log.committed(), upto)

    # -- waiting

    def wait(self, timeout: float = 30.0, position: int | None = None) -> None:
        """Until every projection has seen all events before a position; by default all that are committed now."""
        if not self.queries:
            raise NotStartedError("projections are not running")
        target = (self.log.durable_position() if position is None else position) - 1
        end = time.monotonic() + timeout
        while (behind := [p.name for p in self.registry.enabled() if self.store(p.name).position() < target]):
            for q in self.queries.values():
                if q.exception() is not None:
                    raise ProjectionBuildError(str(q.exception()))
            if time.monotonic() > end:
                raise CatchUpTimeoutError(f"not at position {target} in {timeout} s: {', '.join(behind)}")
            time.sleep(0.05)

    def force_checkpoint(self) -> None:
        """States are stored as they advance; this waits for what is committed."""
        self.wait()

    def hold_back(self, most: int = 200_000, wait: float = 5.0, poll: float = 0.025) -> None:
        """Make writers wait while the slowest projection lags by more than `most` events, and fail after `wait` seconds."""

        def before_append(_: int) -> None:
            end = time.monotonic() + wait
            while self.queries and self.lag() > most:
                if time.monotonic() > end:
                    raise BackpressureTimeoutError(f"projections lag by {self.lag()} events")
                time.sleep(poll)

        self.log.before_append = before_append

    # -- answers

    def lag(self) -> int:
        head = self.log.durable_position() - 1
        positions = [self.store(p.name).position() for p in self.registry.enabled()]
        return max(0, head - max(-1, min(positions))) if positions else 0

    def status(self) -> DataFrame:
        """name, enabled, position, lag, health: a row a projection."""
        head = self.log.durable_position() - 1
        rows = [(p.name, p.options.enabled, (at := self.store(p.name).position()), max(0, head - at)) for p in self.registry]
        return self.spark.createDataFrame(rows, "name string, enabled boolean, position long, lag long").withColumn("health", health(F.col("lag")))

    def model(self, name: str) -> DataFrame:
        projection = self.registry.require(name)
        return model(projection, self.store(name), self.spark.createDataFrame([], EVENT_DDL))

    def view(self, name: str):
        return view(self.registry.require(name), self.model(name))

    def published(self, name: str) -> Published:
        return Published(self.spark, f"{self.path}/models", self.registry.require(name))

    def publish(self, name: str) -> Published:
        """Write a model out as it is now, laid out by its key and its index."""
        out = self.published(name)
        out.publish(self.model(name), self.store(name).position())
        return out


def tail(log: EventLog, after: int, limit: int = 100) -> tuple[DataFrame, int]:
    """The next events past a position, and the position to go on from."""
    rows = log.read_global_durable(after + 1, limit)
    last = rows.agg(F.max("global_position")).first()[0]
    return rows, after if last is None else last
