"""Queries on telemetry (spans, metrics, logs in one wide table) and on the state of projections, and where telemetry goes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Severity codes and their names.
SEVERITIES = {1: "trace", 5: "debug", 9: "info", 13: "warn", 17: "error", 21: "fatal"}
#: Lags beyond which a projection counts as late, and as failing.
WARNING_LAG, ERROR_LAG = 1_000, 10_000

RECORD_DDL = "kind string, ts_ms long, tenant_id string, trace_id string, span_id string, name string, severity int, body string, value double, service string, attrs string"


def query(records: DataFrame, kind: str | None = None, start_ms: int | None = None, end_ms: int | None = None, name: str | None = None, severity: int | None = None, trace_id: str | None = None, service: str | None = None, limit: int | None = None, newest_first: bool = True) -> DataFrame:
    """Records by equality on what is given and by time, both ends inclusive."""
    for column, value in (("kind", kind), ("name", name), ("severity", severity), ("trace_id", trace_id), ("service", service)):
        if value is not None:
            records = records.where(F.col(column) == value)
    if start_ms is not None:
        records = records.where(F.col("ts_ms") >= start_ms)
    if end_ms is not None:
        records = records.where(F.col("ts_ms") <= end_ms)
    records = records.orderBy(F.desc("ts_ms") if newest_first else F.asc("ts_ms"))
    return records if limit is None else records.limit(limit)


def severity_name(code: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in SEVERITIES.items() for x in pair])
    return F.coalesce(F.element_at(named, code), F.lit("unknown"))


def rates(metrics: DataFrame, end_ms: int, by: str = "method", seconds: int = 5) -> DataFrame:
    """Events a second by an attribute over the last seconds, rounded half up."""
    recent = metrics.where((F.col("ts_ms") > end_ms - 1000 * seconds) & (F.col("ts_ms") <= end_ms))
    return recent.groupBy(F.get_json_object("attrs", f"$.{by}").alias(by)).agg(F.floor(F.sum("value") / seconds + 0.5).alias("per_second"))


def latency_summary(rows: DataFrame, value: str) -> DataFrame:
    """min, mean, nearest-rank percentiles and max over all rows, in one pass of partial aggregates."""
    ranks = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return rows.agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("avg"), *ranks, F.max(value).alias("max"))


def health(lag: Column) -> Column:
    return F.when(lag > ERROR_LAG, "error").when(lag > WARNING_LAG, "warning").otherwise("healthy")


def lags(projections: DataFrame, head: int) -> DataFrame:
    """name, position, lag, health. head: the position of the last event; position -1: nothing seen."""
    lag = F.greatest(F.lit(0).cast("long"), F.lit(head).cast("long") - F.greatest(F.lit(0).cast("long"), F.col("position")))
    return projections.select("name", "position", lag.alias("lag"), health(lag).alias("health"))


def slowest_lag(projections: DataFrame, head: int) -> DataFrame:
    least = F.greatest(F.lit(0).cast("long"), F.min("position"))
    return projections.agg(F.greatest(F.lit(0).cast("long"), F.lit(head).cast("long") - least).alias("lag"))


def health_counts(projections: DataFrame, head: int) -> DataFrame:
    return lags(projections, head).groupBy("health").agg(F.count("*").alias("n"))


def tail(records: DataFrame, after_ms: int, seen: list[str], limit: int = 100) -> tuple[DataFrame, int, list[str]]:
    """The next records in time order, past a cursor: a time, and the spans already seen at that time; and the cursor to go on
    from. What reaches the driver are the ids of one page."""
    known = F.coalesce(F.col("span_id").isin(seen), F.lit(False)) if seen else F.lit(False)
    new = records.where((F.col("ts_ms") > after_ms) | ((F.col("ts_ms") == after_ms) & ~known))
    page = new.orderBy("ts_ms", "span_id").limit(limit)
    rows = page.select("ts_ms", "span_id").collect()
    if not rows:
        return page, after_ms, seen
    last = max(r.ts_ms for r in rows)
    at_last = [r.span_id for r in rows if r.ts_ms == last and r.span_id is not None]
    return page, last, at_last + (seen if last == after_ms else [])


def log_rows(records: DataFrame) -> DataFrame:
    """Logs as a page shows them, newest first: id (the time and the place among the logs of that time), the severity's name,
    the body, and the attributes as a map."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("ts_ms").orderBy("span_id")) - 1
    shown = records.where("kind = 'log'").select(F.concat_ws("-", "ts_ms", nth).alias("id"), "ts_ms", severity_name(F.col("severity")).alias("severity"), "body", F.from_json("attrs", "map<string,string>").alias("attributes"))
    return shown.orderBy(F.desc("ts_ms"), F.desc("id"))


class Telemetry:
    """Telemetry records below a path, by day. Writing never fails its caller: what can't be stored is counted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.stored, self.lost, self.last_error = spark, path.rstrip("/"), 0, 0, None

    def write(self, records: DataFrame | list[dict]) -> bool:
        """Append a batch, whole or not at all; False, and no error, if it can't be."""
        n = len(records) if isinstance(records, list) else 0
        try:
            if isinstance(records, list):
                names = [c.split()[0] for c in RECORD_DDL.split(", ")]
                records = self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in records], RECORD_DDL)
            day = F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd")
            records.withColumn("slice", day).write.mode("append").partitionBy("slice").parquet(self.path)
        except Exception as e:  # noqa: BLE001 - a request must not fail because its trace can't be stored
            self.lost, self.last_error = self.lost + n, e
            return False
        self.stored += n
        return True

    def records(self) -> DataFrame:
        return self.spark.read.schema(RECORD_DDL + ", slice string").parquet(self.path)

    def push(self, channels: dict[str, Callable[[DataFrame], DataFrame]], send: Callable[[str, DataFrame], None], checkpoint: str, every_ms: int = 1000, once: bool = False) -> StreamingQuery:
        """Push channels: at every interval each channel's rows of what is new go to send(channel, rows). A channel that fails
        doesn't hold the others up; records that were pushed are not pushed again, after a restart neither."""
        new = self.spark.readStream.schema(RECORD_DDL + ", slice string").parquet(self.path)

        def take(batch: DataFrame, _: int) -> None:
            batch = batch.persist()
            try:
                for name, rows in channels.items():
                    try:
                        send(name, rows(batch))
                    except Exception as e:  # noqa: BLE001 - a listener that is gone
                        self.last_error = e
            finally:
                batch.unpersist()

        writer = new.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every_ms} milliseconds")).start()
