"""Tables of other shapes as canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EVENT_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with canonical names and its payload still typed (value, k, ts): no revision, so no shuffle."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("event_id").alias("global_position"), F.concat(F.lit("user-"), F.col("user_id")).alias("stream_id"), F.col("event_type").alias("type"),
        "user_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.concat(F.lit("tenant-"), F.col("user_id") % 4).alias("tenant_id"),
    )


def with_revisions(rows: DataFrame, stretch_bits: int = 20) -> DataFrame:
    """Rows with each stream's revisions, 0, 1, 2 … by position.

    Numbers are given within stretches of positions, and a stretch begins after what the stream has in those before it, so a
    stream of any length is spread over many tasks; of a stretch one number is summed up along the stream."""
    stretched = rows.withColumn("_stretch", F.shiftright("global_position", stretch_bits))
    counts = stretched.groupBy("stream_id", "_stretch").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("stream_id").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("stream_id", "_stretch", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("stream_id", "_stretch").orderBy("global_position")) - 1
    return stretched.withColumn("_own", own).join(before, ["stream_id", "_stretch"]).withColumn("revision", F.col("_before") + F.col("_own")).select(*rows.columns, "revision")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as canonical events."""
    rows = with_revisions(activity_rows(spark, sf_dir))
    data = F.to_json(F.struct("value", "k"))
    return rows.withColumn("data", data).withColumn("metadata", F.lit(None).cast("string")).select(*EVENT_COLUMNS)


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as streams: a turn is an event, its number the revision. Positions follow (conversation, turn); they are
    not dense, since a dense number would need a global count: the high part is the conversation, the low part the turn."""
    rows = table(spark, sf_dir, "conversations")
    position = F.shiftleft("conv_id", 20) + F.col("turn")
    return rows.select(position.alias("global_position"), F.concat(F.lit("conv-"), F.col("conv_id")).alias("stream_id"), F.col("turn").alias("revision"), F.col("role").alias("type"), F.to_json(F.struct("text")).alias("data"), F.lit(None).cast("string").alias("metadata"), F.lit(0).cast("long").alias("timestamp_ms"), F.lit("default").alias("tenant_id"))
