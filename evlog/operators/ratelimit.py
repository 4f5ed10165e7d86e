"""Rate limits over attempts: a window that opens with the first attempt, a lockout that doubles, and success that clears."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship


@dataclass(frozen=True)
class Limit:
    attempts: int = 5
    window_ms: int = 15 * 60_000
    lockout_ms: int = 15 * 60_000
    backoff: bool = True


@dataclass
class Standing:
    """Where a key stands. No failures and no lockouts is a key that was never seen."""

    failures: int = 0
    since: int = 0
    locked_until: int = 0
    lockouts: int = 0
    known: bool = False

    def after(self, limit: Limit, now: int, success: bool) -> Standing:
        if success:
            return Standing()
        fresh = not self.known or now - self.since > limit.window_ms
        failures, since = (1, now) if fresh else (self.failures + 1, self.since)
        if failures < limit.attempts:
            return Standing(failures, since, self.locked_until, self.lockouts, True)
        return Standing(failures, since, now + limit.lockout_ms * (2**self.lockouts if limit.backoff else 1), self.lockouts + 1, True)

    def allowed(self, now: int) -> bool:
        return self.locked_until <= now


def standings(attempts: DataFrame, limit: Limit = Limit()) -> DataFrame:
    """key, failures, since, locked_until, lockouts, refused (attempts made while locked out) after all attempts of each key,
    in the order of (ts_ms, seq). Where a window opens depends on where the one before closed, attempt by attempt, so this is
    no aggregate and no window function can say it: a key's attempts are folded in one task, in sorted Arrow batches, by a loop
    that holds the state and not the attempts."""
    ship(attempts.sparkSession)
    names, types = ["key", "failures", "since", "locked_until", "lockouts", "refused"], [pa.string(), *[pa.int64()] * 5]

    def rows_of(out):
        columns = list(zip(*out, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def fold(batches):
        key, standing, refused, out = None, Standing(), 0, []
        row = lambda: (key, standing.failures, standing.since, standing.locked_until, standing.lockouts, refused)
        for rows in batches:
            for k, ts, success in zip(*(rows.column(c).to_pylist() for c in ("key", "ts_ms", "success")), strict=True):
                if k != key:
                    if key is not None:
                        out.append(row())
                    key, standing, refused = k, Standing(), 0
                refused += not standing.allowed(ts)
                standing = standing.after(limit, ts, bool(success))
            yield rows_of(out)
            out = []
        if key is not None:
            yield rows_of([row()])

    ordered = attempts.where("key is not null").select(F.col("key").cast("string").alias("key"), F.col("ts_ms").cast("long").alias("ts_ms"), "seq", "success").repartition("key").sortWithinPartitions("key", "ts_ms", "seq")
    return ordered.mapInArrow(fold, "key string, failures long, since long, locked_until long, lockouts long, refused long")
