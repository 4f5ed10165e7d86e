"""Projections: named read models over the log, and where their states are kept."""

from __future__ import annotations

import json
import re
import time
import uuid
import zlib
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import AlreadyRegisteredError, CheckpointCorruptionError, CheckpointError, CheckpointLoadError, CheckpointVersionError, CheckpointWriteError, ProjectionDisabledError, ProjectionNotFoundError, SpecError
from ..operators.views import View
from ..sources.files import Files, Journal
from .folds import Fold, Machine, of_types

FORMAT = 2


@dataclass(frozen=True)
class Options:
    """How a projection is kept up to date: how often, in batches of how many commits, with or apart from the others.

    checkpoint_ms: 0, every micro-batch stores its state; else micro-batches, and states, come so often, give or take
    jitter_ms, and take as many polls' worth of commits at once."""

    poll_ms: int = 100
    batch_commits: int = 100
    checkpoint_ms: int = 0
    jitter_ms: int = 1000
    shared_reader: bool = True
    enabled: bool = True


@dataclass(frozen=True)
class Projection:
    """A fold with a name. subscribed: event types, or "*"; condition: a predicate on events besides; index: fields that
    queries name, by which a stored view is laid out."""

    name: str
    fold: Fold
    subscribed: tuple[str, ...] | str = "*"
    condition: str | None = None
    index: tuple[str, ...] = ()
    options: Options = Options()

    def __post_init__(self):
        if not self.name:
            raise SpecError("a projection needs a name")
        wanted = self.fold.types()
        if self.subscribed != "*" and wanted is not None and not wanted <= set(self.subscribed):
            raise SpecError(f"{self.name} folds types it doesn't subscribe to: {sorted(wanted - set(self.subscribed))}")
        check_pure(self.condition, *self.fold.expressions())

    def sees(self) -> Column:
        own = of_types(self.subscribed)
        return own & F.coalesce(F.expr(self.condition), F.lit(False)) if self.condition else own

    def batch(self, events: DataFrame) -> DataFrame:
        """The read model computed from all events."""
        return self.fold.batch(events.where(self.sees()))


#: Functions whose value depends on more than the row: a fold that uses one would not give the same rows again.
IMPURE = ("rand", "randn", "random", "uniform", "randstr", "uuid", "shuffle", "current_timestamp", "now", "current_date", "current_time", "curdate", "localtimestamp", "unix_timestamp", "current_user", "monotonically_increasing_id", "spark_partition_id", "input_file_name")
#: Of these the ones that SQL takes without parentheses too.
_BARE = ("current_timestamp", "current_date", "current_time", "localtimestamp", "current_user")


def check_pure(*expressions: str | None) -> None:
    """Names in quotes or with more letters around them are none of these functions."""
    for expression in filter(None, expressions):
        bare = re.sub(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`", "''", expression.lower())
        found = sorted({name for name in IMPURE if re.search(rf"(?<![\w.]){name}\s*\(", bare) or name in _BARE and re.search(rf"(?<![\w.]){name}(?!\w)", bare)})
        if found:
            raise SpecError(f"not the same at every run: {', '.join(found)}")


class Registry:
    """Projections by name; options given at registration go before the projection's own."""

    def __init__(self):
        self._all: dict[str, Projection] = {}

    def register(self, projection: Projection, **options) -> Projection:
        if projection.name in self._all:
            raise AlreadyRegisteredError(f"{projection.name} is registered already")
        self._all[projection.name] = replace(projection, options=replace(projection.options, **options))
        return self._all[projection.name]

    def get(self, name: str) -> Projection | None:
        return self._all.get(name)

    def require(self, name: str) -> Projection:
        found = self._all.get(name)
        if found is None:
            raise ProjectionNotFoundError(f"no projection {name!r}")
        if not found.options.enabled:
            raise ProjectionDisabledError(f"{name} is disabled")
        return found

    def enabled(self) -> list[Projection]:
        return [p for p in self._all.values() if p.options.enabled]

    def __iter__(self):
        return iter(self._all.values())


class StateStore:
    """A projection's state as runs: tables that together are the state. Taking a batch in writes the batch's own run; when
    `fanout` runs of about a size have come together they are merged into one, so a step costs what the batch costs.

    Each step is an entry of a journal: the runs, the position reached, and a checksum. Of two coordinators that go on from
    the same entry one is refused, so none overwrites the other's state. The runs of the last `keep` entries stay, for those
    who read them; a crash leaves the entry before."""

    def __init__(self, spark: SparkSession, path: str, name: str, fanout: int = 8, keep: int = 10):
        self.spark, self.path, self.fanout, self.keep = spark, f"{path.rstrip('/')}/{name}", fanout, keep
        self.files = Files(spark, self.path)
        self.journal = Journal(self.files, "steps")

    @staticmethod
    def _sum(body: dict) -> int:
        return zlib.crc32(json.dumps({k: v for k, v in body.items() if k != "crc"}, sort_keys=True).encode())

    def _newest(self) -> tuple[int, dict | None]:
        number = max(self.journal.numbers(), default=-1)
        if number < 0:
            return number, None
        try:
            body = json.loads(self.files.read(self.journal.name(number)))
        except ValueError as e:
            raise CheckpointCorruptionError(f"{self.path}: not a checkpoint") from e
        if body.get("format") != FORMAT:
            raise CheckpointVersionError(f"{self.path}: format {body.get('format')}")
        if body.get("crc") != self._sum(body):
            raise CheckpointCorruptionError(f"{self.path}: checksum")
        return number, body

    def current(self) -> dict | None:
        return self._newest()[1]

    def position(self) -> int:
        """The last position that the state has seen; -1: none."""
        body = self.current()
        return -1 if body is None else body["position"]

    def list(self) -> list[tuple[int, int, int]]:
        """(number, position, when it was stored) of the states that are kept."""
        bodies = [(n, json.loads(self.files.read(self.journal.name(n)))) for n in self.journal.numbers()]
        return [(n, b["position"], b["saved_ms"]) for n, b in bodies]

    def runs(self, body: dict) -> list[DataFrame]:
        for folder, _ in body["runs"]:
            if not self.files.exists(folder):
                raise CheckpointLoadError(f"{self.path}: the state {folder} is gone")
        return [self.spark.read.parquet(f"{self.path}/{folder}") for folder, _ in body["runs"]]

    def load(self, fold: Fold) -> DataFrame | None:
        """The state as one table; None before there is any."""
        body = self.current()
        return None if body is None else merged(fold, self.runs(body))

    def save(self, run: DataFrame, position: int, fold: Fold, whole: bool = False) -> None:
        """Store a step: a run more (whole: instead of all before), and the position reached with it."""
        number, before = self._newest()
        runs = [] if whole or before is None else before["runs"]
        folder = f"runs/{uuid.uuid4().hex}"
        run.write.parquet(f"{self.path}/{folder}")
        runs, made = [*runs, [folder, 0]], [folder]
        while len(same := [r for r in runs if r[1] == runs[-1][1]]) >= self.fanout:
            folder = f"runs/{uuid.uuid4().hex}"
            merged(fold, self.runs({"runs": same})).write.parquet(f"{self.path}/{folder}")
            runs, made = [*[r for r in runs if r not in same], [folder, same[0][1] + 1]], [*made, folder]
        body = {"format": FORMAT, "runs": runs, "position": position, "saved_ms": int(time.time() * 1000)}
        if not self.journal.publish(number + 1, body | {"crc": self._sum(body)}):
            raise CheckpointWriteError(f"{self.path}: another coordinator has stored a state past {number}")
        for passing in made[:-1]:  # merged within this step: no entry names them
            self.files.delete(passing)
        self._forget(number + 1)

    def _forget(self, newest: int) -> None:
        """Remove entries beyond the last `keep`, and the runs that only they name."""
        old = [n for n in self.journal.numbers() if n <= newest - self.keep]
        if not old:
            return
        named = {folder for n in self.journal.numbers() if n not in old for folder, _ in json.loads(self.files.read(self.journal.name(n)))["runs"]}
        for n in old:
            for folder, _ in json.loads(self.files.read(self.journal.name(n)))["runs"]:
                if folder not in named:
                    self.files.delete(folder)
            self.files.delete(self.journal.name(n))

    def delete(self, number: int) -> None:
        """Remove a state that is kept, and the runs that only it names. The newest one can't be: reset() removes all."""
        if number == max(self.journal.numbers(), default=-1):
            raise CheckpointError(f"{self.path}: {number} is the state in force")
        gone = json.loads(self.files.read(self.journal.name(number)))["runs"]
        self.files.delete(self.journal.name(number))
        named = {folder for n in self.journal.numbers() for folder, _ in json.loads(self.files.read(self.journal.name(n)))["runs"]}
        for folder, _ in gone:
            if folder not in named:
                self.files.delete(folder)

    def reset(self) -> None:
        for name in self.files.names(""):
            self.files.delete(name)


def merged(fold: Fold, runs: list[DataFrame]) -> DataFrame:
    """Runs of a state as one: any number of them in one aggregation by key."""
    return runs[0] if len(runs) == 1 else fold.merge(reduce(DataFrame.unionByName, runs[:-1]), runs[-1])


def advance(projection: Projection, store: StateStore, events: DataFrame, upto: int) -> int:
    """Take events up to a position into the stored state: those it has seen already are left out, so a batch that comes again
    changes nothing. Returns the position reached."""
    seen = store.position()
    if upto <= seen:
        return seen
    new = events.where((F.col("global_position") > seen) & (F.col("global_position") <= upto)).where(projection.sees())
    fold = projection.fold
    store.save(fold.advance(store.load(fold), new) if isinstance(fold, Machine) else fold.partial(new), upto, fold)
    return upto


def model(projection: Projection, store: StateStore, empty: DataFrame) -> DataFrame:
    """The read model of the stored state; of no events, before there is one."""
    state = store.load(projection.fold)
    return projection.fold.finish(projection.fold.partial(empty) if state is None else state)


def view(projection: Projection, rows: DataFrame) -> View:
    key = projection.fold.keys[0] if projection.fold.keys else rows.columns[0]
    return View(rows, key)


class Published:
    """Read models written out for queries: one copy laid out by key, and one by each field of the projection's index, so that a
    query by key, by range or by an indexed field reads the row groups that can hold its rows."""

    def __init__(self, spark: SparkSession, path: str, projection: Projection):
        self.spark, self.projection, self.path = spark, projection, f"{path.rstrip('/')}/{projection.name}"
        self.files = Files(spark, self.path)
        self.journal = Journal(self.files, "published")

    def publish(self, rows: DataFrame, position: int) -> None:
        """Write the model as of a position. The one before stays for its readers; older ones go."""
        own, folders = view(self.projection, rows), {}
        for field in dict.fromkeys([own.key, *self.projection.index]):
            folders[field] = f"tables/{uuid.uuid4().hex}"
            own.layout(field).write.parquet(f"{self.path}/{folders[field]}")
        number = max(self.journal.numbers(), default=-1) + 1
        if not self.journal.publish(number, {"position": position, "folders": folders}):
            raise CheckpointWriteError(f"{self.path}: published by another at once")
        for old in [n for n in self.journal.numbers() if n < number - 1]:
            for folder in json.loads(self.files.read(self.journal.name(old)))["folders"].values():
                self.files.delete(folder)
            self.files.delete(self.journal.name(old))

    def position(self) -> int:
        newest = max(self.journal.numbers(), default=-1)
        return -1 if newest < 0 else json.loads(self.files.read(self.journal.name(newest)))["position"]

    def view(self, field: str | None = None) -> View:
        """The newest model, in the copy that is laid out by a field; by default, or of a field without index, by key."""
        newest = max(self.journal.numbers(), default=-1)
        if newest < 0:
            raise CheckpointLoadError(f"{self.path}: nothing is published")
        folders = json.loads(self.files.read(self.journal.name(newest)))["folders"]
        key = next(iter(folders))
        return View(self.spark.read.parquet(f"{self.path}/{folders.get(field, folders[key])}"), key)
