"""The event row, its invariants, identifiers and the errors of the engine."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .deploy import ship

#: data and metadata are JSON texts: typed columns are taken from them where a fold or a query needs them.
EVENT_DDL = "global_position long, stream_id string, revision long, type string, data string, metadata string, timestamp_ms long, tenant_id string"
EVENT_COLUMNS = [c.split()[0] for c in EVENT_DDL.split(", ")]
DEFAULT_TENANT = "default"
#: What append takes for "the stream must not exist" and what an empty stream's revision is.
NO_STREAM = -1


class EvlogError(Exception):
    """Any error of this engine."""


class NotOpenError(EvlogError):
    """The log is closed."""


class NotStartedError(EvlogError):
    """Projections are not running."""


class BackpressureError(EvlogError):
    """A projection lags too far behind for more events."""


class BackpressureTimeoutError(BackpressureError):
    """The lag didn't fall in time."""


class ConcurrencyError(EvlogError):
    """A stream isn't at the revision that the writer expects."""

    def __init__(self, stream_id: str, expected: int, actual: int):
        super().__init__(f"stream {stream_id!r}: expected revision {expected}, found {actual}")
        self.stream_id, self.expected, self.actual = stream_id, expected, actual


class StoreFatalError(EvlogError):
    """A write failed in a way that leaves the store unusable until it is opened again."""


class InvalidStreamIdError(EvlogError):
    """Not a stream id."""


class InvalidPositionError(EvlogError):
    """Not a position or revision."""


class ProjectionError(EvlogError):
    """Any error of a projection."""


class ProjectionBuildError(ProjectionError):
    """A fold failed on an event."""


class ProjectionNotFoundError(ProjectionError):
    """No projection of that name."""


class AlreadyRegisteredError(ProjectionError):
    """A projection of that name is there already."""


class ProjectionDisabledError(ProjectionError):
    """The projection is registered but disabled."""


class CoordinatorError(ProjectionError):
    """The projections can't be started or stopped."""


class CatchUpTimeoutError(ProjectionError):
    """Projections didn't reach the position in time."""


class CheckpointError(EvlogError):
    """Any error of a stored state."""


class CheckpointWriteError(CheckpointError):
    """A state couldn't be stored."""


class CheckpointLoadError(CheckpointError):
    """A state couldn't be read."""


class CheckpointCorruptionError(CheckpointLoadError):
    """A state is not what its checkpoint says."""


class CheckpointVersionError(CheckpointLoadError):
    """A state is of another format version."""


class SpecError(EvlogError):
    """A fold, view or domain specification that can't be right."""


def check_stream_id(stream_id: str) -> str:
    """Strict identifiers, for those who want them: the log itself takes any text that isn't empty."""
    if not re.fullmatch(r"[A-Za-z0-9_:.\-]{1,256}", stream_id or ""):
        raise InvalidStreamIdError(f"not a stream id: {stream_id!r}")
    return stream_id


def check_tenant_id(tenant_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_:.\-]{1,128}", tenant_id or ""):
        raise EvlogError(f"not a tenant id: {tenant_id!r}")
    return tenant_id


def check_position(position: int, name: str = "position") -> int:
    if not isinstance(position, int) or isinstance(position, bool) or position < 0:
        raise InvalidPositionError(f"not a {name}: {position!r}")
    return position


def _neighbours(batches):
    """Of rows sorted by (stream_id, revision, global_position): what each stream's part within this partition comes to."""
    names = ["stream_id", "n", "low", "high", "broken", "first_position", "last_position", "out_of_order"]
    held = None  # the stream at the end, which may go on

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate([pa.string(), *[pa.int64()] * 3, pa.bool_(), *[pa.int64()] * 3])], names)

    for rows in batches:
        if not rows.num_rows:
            continue
        streams, revision, position = rows.column("stream_id"), np.asarray(rows.column("revision"), np.int64), np.asarray(rows.column("global_position"), np.int64)
        heads = np.concatenate(([0], 1 + np.flatnonzero(np.asarray(pc.not_equal(streams[1:], streams[:-1]).to_numpy(zero_copy_only=False)))))
        ends = np.append(heads[1:], len(revision))
        step, back = np.diff(revision) != 1, np.diff(position) <= 0
        parts = []
        for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
            part = [streams[a].as_py(), b - a, int(revision[a]), int(revision[b - 1]), bool(step[a : b - 1].any()), int(position[a]), int(position[b - 1]), int(back[a : b - 1].sum())]
            if held is not None and held[0] == part[0]:
                part = [part[0], held[1] + part[1], held[2], part[3], held[4] or part[4] or part[2] != held[3] + 1, held[5], part[6], held[7] + part[7] + (part[5] <= held[6])]
            elif held is not None:
                parts.append(held)
            held = part
        if parts:
            yield out(parts)
    if held is not None:
        yield out([held])


def integrity(events: DataFrame) -> DataFrame:
    """One row of counts; a sound log has 0 in all but n_events: repeated positions, gaps in positions, streams whose
    revisions are not 0..n-1 each once, and events whose position order within a stream is not their revision order.

    Positions are counted in bitmaps, which combine before the shuffle. Streams are compared neighbour by neighbour within
    range-sorted partitions, where one of any length is spread over many; the parts of a stream, a row for each partition that
    holds some of it, meet by stream."""
    bits = events.groupBy(F.bitmap_bucket_number("global_position").alias("bucket")).agg(F.count("*").alias("n"), F.min("global_position").alias("low"), F.max("global_position").alias("high"), F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("global_position"))).alias("d"))
    total = bits.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_events"), F.coalesce(F.sum("n") - F.sum("d"), F.lit(0)).alias("duplicate_positions"), F.coalesce(F.max("high") - F.min("low") + 1 - F.sum("d"), F.lit(0)).alias("position_gaps"))
    ship(events.sparkSession)
    order = ["stream_id", "revision", "global_position"]
    parts = events.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, "stream_id string, n long, low long, high long, broken boolean, first_position long, last_position long, out_of_order long")
    before = lambda c: F.lag(c).over(Window.partitionBy("stream_id").orderBy("low", "high", "first_position"))
    joined = parts.withColumn("high_before", before("high")).withColumn("last_before", before("last_position"))
    broken = F.col("broken") | F.when(F.col("high_before").isNull(), F.col("low") != 0).otherwise(F.col("low") != F.col("high_before") + 1)
    by_stream = joined.groupBy("stream_id").agg(F.max(broken).alias("broken"), F.sum(F.col("out_of_order") + F.coalesce((F.col("first_position") <= F.col("last_before")).cast("long"), F.lit(0))).alias("out"))
    streams = by_stream.agg(F.count_if("broken").alias("streams_with_gaps"), F.coalesce(F.sum("out"), F.lit(0)).alias("out_of_order"))
    return total.crossJoin(streams)  # single rows
