"""Reads of an event DataFrame: the whole log, one stream, heads, ids. All are plain filters, sorts and limits, so that
filters and columns reach the Parquet scan and a limited read is a top-n, not a full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import check_position


def global_scan(events: DataFrame, start: int = 0, limit: int | None = None) -> DataFrame:
    """Events from position `start` on, in order; limit 0 is none at all."""
    rows = events.where(F.col("global_position") >= check_position(start)).orderBy("global_position")
    return rows if limit is None else rows.limit(limit)


def stream_scan(events: DataFrame, stream_id: str, first: int = 0, last: int | None = None, limit: int | None = None, backward: bool = False) -> DataFrame:
    """A stream's events with first <= revision <= last. Backward with a limit gives the last ones of that range."""
    wanted = (F.col("stream_id") == stream_id) & (F.col("revision") >= check_position(first, "revision"))
    if last is not None:
        wanted &= F.col("revision") <= check_position(last, "revision")
    rows = events.where(wanted).orderBy(F.desc("revision") if backward else F.asc("revision"))
    return rows if limit is None else rows.limit(limit)


def stream_heads(events: DataFrame) -> DataFrame:
    """stream_id, head_revision, n_events, last_position."""
    return events.groupBy("stream_id").agg(F.max("revision").alias("head_revision"), F.count("*").alias("n_events"), F.max("global_position").alias("last_position"))


def stream_ids(events: DataFrame) -> DataFrame:
    """The streams, in the order of their UTF-8 bytes."""
    return events.select("stream_id").distinct().orderBy("stream_id")


def log_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count_distinct("stream_id").alias("stream_count"), F.count("*").alias("total_entries"), F.max("global_position").alias("last_position"))


def subscribed(events: DataFrame, types: list[str] | str = "*", condition: Column | None = None, after: int | None = None) -> DataFrame:
    """What a projection sees: its event types ("*": all), then its own condition, past the position it has reached."""
    if after is not None:
        events = events.where(F.col("global_position") > after)
    if types != "*" and "*" not in types:
        events = events.where(F.col("type").isin(list(types)))
    return events if condition is None else events.where(condition)


def of_tenant(rows: DataFrame, tenant_id: str) -> DataFrame:
    return rows.where(F.col("tenant_id") == tenant_id)


def at_or_after(events: DataFrame, position: int) -> DataFrame:
    """The first event at a position or past it."""
    return global_scan(events, position, 1)


def page(rows: DataFrame, order: list[Column], size: int) -> tuple[DataFrame, DataFrame]:
    """The first `size` rows, and a one-row DataFrame has_more: one row more is looked at, as pages do."""
    ahead = rows.orderBy(*order).limit(size + 1)
    return ahead.limit(size), ahead.agg((F.count("*") > size).alias("has_more"))


def recent(events: DataFrame, size: int) -> DataFrame:
    """The newest events, newest first."""
    return events.orderBy(F.desc("global_position")).limit(size)
