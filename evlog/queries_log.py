"""Queries of the log's writes and upkeep, of projections, domain objects, schemas and expressions, each beside its SQL.

Tables of few rows (nation, region) are appended event by event; larger ones as frames."""

from __future__ import annotations

import hashlib
import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema
from .functions import values as V
from .model import ConcurrencyError, SpecError, integrity
from .operators import ratelimit, reads, telemetry
from .operators.endpoints import Method, call
from .operators.views import View
from .plans import access, domain, schema_evo
from .plans.folds import Aggregates, Fields, Latest, Machine, Measure, signed_sum
from .plans.projections import Options, Projection, Published, Registry, StateStore, advance, check_pure, model
from .queries import _EVENTS, _scratch_folder, query
from .sources.adapters import activity, activity_rows, conversation_events, table
from .sources.files import Files
from .sources.kv import KeyValueTable
from .sources.log import Append, EventLog
from .streaming.coordinator import Coordinator, tail

#: Nations in order of their keys, as events of their regions' streams.
_NATIONS = """
WITH n AS (
  SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS position, 'region-' || n_regionkey AS stream_id,
    row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS revision, n_name AS name, n_nationkey AS id, n_regionkey AS region FROM nation
)
"""


def _nations(spark, sf_dir) -> list:
    return table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows at any size


def _joined(row, **more) -> dict:
    return {"type": "NationJoined", "data": {"id": row.n_nationkey, "name": row.n_name, **more}}


def _log(spark, **options) -> EventLog:
    return EventLog(spark, _scratch_folder(spark, "log"), **options)


def _nation_log(spark, sf_dir, **options) -> EventLog:
    log = _log(spark, **options)
    for row in _nations(spark, sf_dir):
        log.append(f"region-{row.n_regionkey}", [_joined(row)])
    return log


def _frame(spark, sf_dir):
    return activity_rows(spark, sf_dir).select("global_position", "stream_id", "type", F.to_json(F.struct("value", "k")).alias("data"), "timestamp_ms", "tenant_id")


def _activity_log(spark, sf_dir, parts: int = 3, **options) -> EventLog:
    """The events table as a log of some commits."""
    log, rows = _log(spark, **options), _frame(spark, sf_dir)
    n = rows.agg(F.max("global_position")).first()[0] + 1
    for i in range(parts):
        log.append_frame(rows.where((F.col("global_position") >= i * n // parts) & (F.col("global_position") < (i + 1) * n // parts)), ["global_position"])
    return log


def _rows(spark, rows: list, ddl: str):
    return spark.createDataFrame(rows, ddl)


# -- reads of the log


@query(_EVENTS + "SELECT global_position, stream_id, revision, type, tenant_id FROM e WHERE global_position >= 3000 ORDER BY global_position LIMIT 400")
def durable_read_page(spark, sf_dir):
    """A page across commits: only those that hold its positions are read."""
    return _activity_log(spark, sf_dir).read_global_durable(3000, 400).select("global_position", "stream_id", "revision", "type", "tenant_id")


@query(_EVENTS + "SELECT global_position, type FROM e WHERE global_position >= (SELECT max(global_position) FROM e) - 20")
def durable_iteration(spark, sf_dir):
    """The last events one by one, as a reader that goes on from a position takes them."""
    log = _activity_log(spark, sf_dir)
    found = [(r.global_position, r.type) for r in log.stream_global_durable(log.durable_position() - 21)]
    return _rows(spark, found, "global_position long, type string")


@query(_EVENTS + "SELECT global_position, stream_id, revision, type FROM e WHERE stream_id = 'user-11' AND revision BETWEEN 3 AND 40")
def durable_stream_read(spark, sf_dir):
    """A stream's range after compaction: sorted files, so that row groups of other streams are passed over."""
    log = _activity_log(spark, sf_dir)
    log.compact()
    return log.read_stream("user-11", first=3, last=40).select("global_position", "stream_id", "revision", "type")


@query(_NATIONS + "SELECT position AS global_position, stream_id, revision, TRUE AS cached FROM n WHERE position BETWEEN 5 AND 14")
def cached_tail(spark, sf_dir):
    """Events from the writer's memory; nothing where some are missing or beyond the end."""
    log = _nation_log(spark, sf_dir)
    held = log.read_cached(5, 10)
    beyond, other = log.read_cached(25, 5), EventLog(spark, log.path).read_cached(5, 10)
    return _rows(spark, [(e["global_position"], e["stream_id"], e["revision"], beyond is None and other is None) for e in held], "global_position long, stream_id string, revision long, cached boolean")


@query(_EVENTS + "SELECT global_position, stream_id, CASE WHEN global_position >= (SELECT count(*) FROM e) - 100 THEN 'later' ELSE 'first' END AS page FROM e WHERE global_position >= (SELECT count(*) FROM e) - 200")
def live_tail(spark, sf_dir):
    """A listener that starts 200 events before the end and takes 100 a tick."""
    log = _activity_log(spark, sf_dir, 2)
    first, at = tail(log, log.durable_position() - 201, 100)
    later, _ = tail(log, at, 100)
    return first.withColumn("page", F.lit("first")).unionByName(later.withColumn("page", F.lit("later"))).select("global_position", "stream_id", "page")


@query(_NATIONS + "SELECT position AS global_position, stream_id, revision, position < 20 AS durable FROM n")
def durable_and_pending(spark, sf_dir):
    """What is committed and what is held back, in one read; readers of committed events see the first only."""
    log, rows = _log(spark, auto_flush=20), _nations(spark, sf_dir)
    for row in rows:
        log.append(f"region-{row.n_regionkey}", [_joined(row)])
    durable = log.read_global_durable().select("global_position", F.lit(True).alias("durable"))
    return log.read_global().join(durable, "global_position", "left").select("global_position", "stream_id", "revision", F.coalesce("durable", F.lit(False)).alias("durable"))


@query("SELECT DISTINCT 'region-' || n_regionkey AS stream_id FROM nation UNION SELECT 'region-new'")
def stream_ids_with_pending(spark, sf_dir):
    log = _nation_log(spark, sf_dir)
    log.auto_flush = 0
    log.append("region-new", [{"type": "T"}])
    return log.stream_ids()


@query(_NATIONS + "SELECT stream_id, max(revision) AS head, -1 AS none FROM n GROUP BY stream_id")
def heads_by_lookup(spark, sf_dir):
    """Heads from memory, from a snapshot's runs, and of a stream that isn't there."""
    log = _nation_log(spark, sf_dir, snapshot_every=7)
    again = EventLog(spark, log.path)
    names = [f"region-{r.r_regionkey}" for r in table(spark, sf_dir, "region").collect()]
    heads, own = again.heads([*names, "none"]), log.heads(names)
    return _rows(spark, [(s, h, heads["none"]) for s, h in own.items() if heads[s] == h], "stream_id string, head long, none int")


@query(_EVENTS + """, damaged AS (SELECT * FROM e WHERE global_position % 97 <> 5), again AS (SELECT * FROM damaged UNION ALL SELECT * FROM damaged WHERE global_position % 101 = 7),
swapped AS (SELECT global_position, stream_id, CASE WHEN user_id = 3 AND revision = 4 THEN 9 WHEN user_id = 3 AND revision = 9 THEN 4 ELSE revision END AS revision FROM (SELECT *, CAST(substr(stream_id, 6) AS BIGINT) AS user_id FROM again)),
streams AS (SELECT stream_id, count(*) AS n, min(revision) AS low, max(revision) AS high, count(DISTINCT revision) AS d FROM swapped GROUP BY stream_id),
ordered AS (SELECT global_position AS p, lag(global_position) OVER (PARTITION BY stream_id ORDER BY revision, global_position) AS b FROM swapped)
SELECT count(*) AS n_events, count(*) - count(DISTINCT global_position) AS duplicate_positions, max(global_position) - min(global_position) + 1 - count(DISTINCT global_position) AS position_gaps,
  (SELECT count(*) FROM streams WHERE low <> 0 OR high <> n - 1 OR d <> n) AS streams_with_gaps, (SELECT count(*) FROM ordered WHERE b >= p) AS out_of_order FROM swapped""")
def damaged_log_integrity(spark, sf_dir):
    """A log with lost, doubled and swapped events: every count tells."""
    whole = activity(spark, sf_dir).where("global_position % 97 <> 5")
    rows = whole.unionByName(whole.where("global_position % 101 = 7"))
    swap = F.when((F.col("stream_id") == "user-3") & (F.col("revision") == 4), 9).when((F.col("stream_id") == "user-3") & (F.col("revision") == 9), 4).otherwise(F.col("revision"))
    return integrity(rows.withColumn("revision", swap))


# -- writes and upkeep


@query(_NATIONS + "SELECT stream_id, revision AS stream_revision, position AS global_position, CAST(1 AS BIGINT) AS event_count FROM n")
def append_results(spark, sf_dir):
    """What each append returns."""
    log = _log(spark)
    done = [(f"region-{r.n_regionkey}", log.append(f"region-{r.n_regionkey}", [_joined(r)])) for r in _nations(spark, sf_dir)]
    return _rows(spark, [(s, a.stream_revision, a.global_position, a.event_count) for s, a in done], "stream_id string, stream_revision long, global_position long, event_count long")


@query("""SELECT 'region-' || n_regionkey AS stream_id, count(*) * 2 - 1 AS stream_revision, CAST(sum(count(*)) OVER (ORDER BY n_regionkey) - count(*) + (SELECT count(*) FROM nation) AS BIGINT) AS global_position, count(*) AS event_count, (SELECT count(*) FROM nation) AS refused_at
FROM nation GROUP BY n_regionkey""")
def append_batch_results(spark, sf_dir):
    """All regions' nations in one batch, after a first one; a batch with one condition that fails appends nothing."""
    log, by_region = _log(spark), {}
    for r in _nations(spark, sf_dir):
        by_region.setdefault(r.n_regionkey, []).append(_joined(r))
    log.append_batch([Append(f"region-{k}", v, -1) for k, v in sorted(by_region.items())])
    try:
        log.append_batch([Append("fresh", [{"type": "T"}], -1), Append("region-0", [{"type": "T"}], 99)])
    except ConcurrencyError:
        refused = log.global_position()
    done = log.append_batch([Append(f"region-{k}", v, len(v) - 1) for k, v in sorted(by_region.items())])
    return _rows(spark, [(s, a.stream_revision, a.global_position, a.event_count, refused) for s, a in done.streams.items()], "stream_id string, stream_revision long, global_position long, event_count long, refused_at long")


@query(_NATIONS + "SELECT stream_id, revision, name, id % 2 AS writer, (SELECT count(*) FROM nation) AS refused FROM n")
def append_two_writers(spark, sf_dir):
    """Two writers at one log by turns, each behind the other; who expects a revision that the other has used is refused."""
    one = _log(spark)
    two, refused = EventLog(spark, one.path), 0
    for row in _nations(spark, sf_dir):
        writer, other = (one, two) if row.n_nationkey % 2 == 0 else (two, one)
        stream = f"region-{row.n_regionkey}"
        seen = other.stream_revision(stream)
        writer.append(stream, [_joined(row, writer=row.n_nationkey % 2)], expected_revision=seen)
        try:
            other.append(stream, [{"type": "Late"}], expected_revision=seen)
        except ConcurrencyError:
            refused += 1
    data = lambda name, kind="string": V.field(name, kind)
    return one.read_global_durable().select("stream_id", "revision", data("name").alias("name"), data("writer", "int").alias("writer"), F.lit(refused).cast("long").alias("refused"))


@query("""WITH c AS (SELECT (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 AS number FROM nation)
SELECT number, min(number) * 10 AS base, count(*) AS count FROM c GROUP BY number""")
def group_commits(spark, sf_dir):
    """Events held back go in commits of ten, and the rest when the log is closed."""
    log = _log(spark, auto_flush=10)
    for row in _nations(spark, sf_dir):
        log.append(f"region-{row.n_regionkey}", [_joined(row)])
    log.close()
    return _rows(spark, [(c.number, c.base, c.count) for c in EventLog(spark, log.path).commits()], "number long, base long, count long")


@query(_NATIONS + "SELECT position AS global_position, revision, TRUE AS same FROM n")
def idempotent_retry(spark, sf_dir):
    """Every append comes twice with its token, the second time from another process: it gets the first one's result."""
    log, done = _log(spark, snapshot_every=9), []
    for row in _nations(spark, sf_dir):
        event = [_joined(row)]
        first = log.append(f"region-{row.n_regionkey}", event, token=f"nation-{row.n_nationkey}")
        done.append((row, first))
    again = EventLog(spark, log.path)
    rows = [(a.global_position, a.stream_revision, again.append(f"region-{r.n_regionkey}", [_joined(r)], token=f"nation-{r.n_nationkey}") == a) for r, a in done]
    return _rows(spark, rows, "global_position long, revision long, same boolean").where(F.lit(again.global_position() == len(done)))


@query(_NATIONS + "SELECT position AS global_position, stream_id, revision, name, (SELECT count(*) FROM n) // 5 AS merged FROM n")
def levelled_commits(spark, sf_dir):
    """Five commits of a level become one: fewer files, the same events."""
    log = _nation_log(spark, sf_dir, fanout=5)
    merged = sum(c.count for c in log.commits() if c.replaces) // 5
    return log.read_global().select("global_position", "stream_id", "revision", V.field("name").alias("name"), F.lit(merged).cast("long").alias("merged"))


@query(_NATIONS + "SELECT position AS global_position, stream_id, 'torn' AS removed FROM n")
def recovery(spark, sf_dir):
    """What a crash leaves, data that no commit names, is not read and can be removed; the log goes on."""
    log = _nation_log(spark, sf_dir)
    log.files.write("data/torn/part-00000.parquet", b"half a file")
    log.files.write("_log/00000000000000000099.json.tmp", b"{")
    again = EventLog(spark, log.path)
    removed = again.vacuum()
    return again.read_global().select("global_position", "stream_id", F.lit(",".join(removed)).alias("removed"))


@query(f"SELECT md5('{'0123456789abcdef' * 4}') AS digest, count(*) * 4 * 16 AS size, 2 AS published FROM range(1)")
def whole_files(spark, sf_dir):
    """A file is there as a whole or not at all, through the kernel and through Hadoop's file systems."""
    folder, text, done = _scratch_folder(spark, "files"), "0123456789abcdef" * 4, []
    for hadoop in (False, True):
        files = Files(spark, folder, through_hadoop=hadoop)
        done.append(files.create(f"{hadoop}.txt", text) and not files.create(f"{hadoop}.txt", "other"))
    read = Files(spark, folder).read("True.txt")
    return _rows(spark, [(hashlib.md5(read.encode()).hexdigest(), len(read), sum(done))], "digest string, size long, published int")


@query("SELECT n_name AS key, CAST(n_regionkey * 10 AS VARCHAR) AS value FROM nation WHERE n_nationkey % 3 <> 0")
def kv_set_and_delete(spark, sf_dir):
    """Two processes set, change and delete keys; the latest of each counts, and compaction changes no answer."""
    one = KeyValueTable(spark, _scratch_folder(spark, "kv"))
    two, nations = KeyValueTable(spark, one.path), table(spark, sf_dir, "nation")
    one.set_all(nations.select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value")))
    two.set_all(nations.select(F.col("n_name").alias("key"), (F.col("n_regionkey") * 10).cast("string").alias("value")))
    one.write(nations.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(True).alias("deleted")))
    two.compact()
    return one.live()


@query("SELECT n_name AS key, (SELECT count(*) FROM nation) AS size, 0.5 AS garbage FROM nation")
def kv_scan(spark, sf_dir):
    kv, nations = KeyValueTable(spark, _scratch_folder(spark, "kv")), table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.lit("1").alias("value"))
    kv.set_all(nations)
    kv.set_all(nations)
    return kv.keys().select("key", F.lit(kv.size()).cast("long").alias("size"), F.lit(kv.garbage_ratio()).alias("garbage"))


@query(_NATIONS + "SELECT row_number() OVER (ORDER BY position) - 1 AS number, position, (position + 1) * 1.0 AS events FROM n WHERE position % 5 = 4")
def checkpoints(spark, sf_dir):
    """A state stored every five events: what is kept, and what a state says; one that is deleted is gone."""
    log, store = _nation_log(spark, sf_dir), StateStore(spark, _scratch_folder(spark, "states"), "n", fanout=2)
    counted = Projection("n", Aggregates({"n": Measure("count")}))
    rows = []
    for upto in range(4, log.durable_position(), 5):
        advance(counted, store, log.committed(), upto)
        rows.append((store.list()[-1][0], store.position(), float(model(counted, store, log.committed().limit(0)).first().n)))
    store.delete(0)
    kept = {n for n, _, _ in store.list()}
    return _rows(spark, [r for r in rows if r[0] in kept or r[0] == 0], "number long, position long, events double")


@query("""SELECT * FROM (VALUES ('tenant_id', 'string'), ('user_id', 'string'), ('first_name', 'string'), ('age', 'double'), ('is_active', 'boolean'), ('tags', 'string'), ('created_at', 'timestamp'), ('updated_at', 'timestamp')) t(name, type)""")
def read_model_ddl(spark, sf_dir):
    """The DDL of a read model, run: its columns as Spark has them."""
    fields = {"firstName": "string", "age": "number", "isActive": "boolean", "tags": "array?"}
    name = "profile_" + hashlib.md5(_scratch_folder(spark, "ddl").encode()).hexdigest()[:12]
    spark.sql(schema_evo.view_ddl(name, "userId", fields, ["age"]))
    columns = [(f.name, f.dataType.simpleString()) for f in spark.table(name).schema]
    spark.sql(f"DROP TABLE {name}")
    return _rows(spark, columns, "name string, type string")


# -- telemetry


def _records(spark, sf_dir):
    """The events as telemetry: errors are logs, purchases metrics, all else spans."""
    kind = F.when(F.col("type") == "error", "log").when(F.col("type") == "purchase", "metric").otherwise("span")
    return activity_rows(spark, sf_dir).select(
        kind.alias("kind"), F.col("global_position").alias("ts_ms"), "tenant_id", F.col("stream_id").alias("trace_id"), F.format_string("%010d", "global_position").alias("span_id"), F.col("type").alias("name"),
        F.when(F.col("type") == "error", F.when(F.col("k") < 50, 17).otherwise(13)).alias("severity"), F.concat_ws(" ", "type", "k").alias("body"), "value", F.concat(F.lit("service-"), F.col("k") % 3).alias("service"), F.to_json(F.struct(F.col("k").cast("string").alias("k"))).alias("attrs"),
    )


_RECORDS = _EVENTS + """, r AS (SELECT CASE type WHEN 'error' THEN 'log' WHEN 'purchase' THEN 'metric' ELSE 'span' END AS kind, global_position AS ts_ms, stream_id AS trace_id, lpad(CAST(global_position AS VARCHAR), 10, '0') AS span_id,
  CASE WHEN type = 'error' THEN CASE WHEN k < 50 THEN 17 ELSE 13 END END AS severity, 'service-' || (k % 3) AS service, k, value, type FROM e)
"""


@query(_RECORDS + "SELECT ts_ms, trace_id, service FROM r WHERE kind = 'log' AND severity = 17 AND service = 'service-1' AND ts_ms BETWEEN 1000 AND 6000 ORDER BY ts_ms DESC LIMIT 50")
def telemetry_scan(spark, sf_dir):
    """Logs by severity, time and service, newest first."""
    return telemetry.query(_records(spark, sf_dir), kind="log", start_ms=1000, end_ms=6000, severity=17, service="service-1", limit=50).select("ts_ms", "trace_id", "service")


@query(_RECORDS + "SELECT ts_ms, span_id, kind FROM r WHERE ts_ms BETWEEN 500 AND 799")
def telemetry_tail(spark, sf_dir):
    """Three pages of 100 records, each from the cursor of the one before; the first cursor has seen one record of its time."""
    records, at, seen, pages = _records(spark, sf_dir), 499, ["0000000499"], []
    for _ in range(3):
        page, at, seen = telemetry.tail(records, at, seen, 100)
        pages.append(page.select("ts_ms", "span_id", "kind"))
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query(_RECORDS + "SELECT ts_ms || '-0' AS id, CASE severity WHEN 17 THEN 'error' ELSE 'warn' END AS severity, CAST(k AS VARCHAR) AS k FROM r WHERE kind = 'log'")
def log_rows(spark, sf_dir):
    """Logs as a page shows them: severities by name, attributes parsed."""
    return telemetry.log_rows(_records(spark, sf_dir)).select("id", "severity", F.col("attributes")["k"].alias("k"))


@query(_RECORDS + "SELECT ts_ms, service, TRUE AS has_more FROM r WHERE kind = 'log' ORDER BY ts_ms DESC LIMIT 20")
def page_with_more(spark, sf_dir):
    rows, more = reads.page(_records(spark, sf_dir).where("kind = 'log'"), [F.desc("ts_ms")], 20)
    return rows.select("ts_ms", "service").crossJoin(more)  # one row


@query(_RECORDS + "SELECT ts_ms, trace_id FROM r WHERE kind = 'log' ORDER BY ts_ms DESC LIMIT 1000")
def newest_logs(spark, sf_dir):
    """The thousand newest logs, which is all that is kept to show."""
    return telemetry.query(_records(spark, sf_dir), kind="log", limit=1000).select("ts_ms", "trace_id")


@query("WITH p AS (SELECT event_type AS name, min(event_id) * 37 AS position FROM events GROUP BY event_type) SELECT greatest(0, (SELECT max(event_id) FROM events) - greatest(0, min(position))) AS lag FROM p")
def slowest_lag(spark, sf_dir):
    rows = activity_rows(spark, sf_dir)
    positions = rows.groupBy(F.col("type").alias("name")).agg((F.min("global_position") * 37).alias("position"))
    return telemetry.slowest_lag(positions, rows.agg(F.max("global_position")).first()[0])


@query(_RECORDS + "SELECT ts_ms, span_id, kind, value, FALSE AS lost FROM r")
def telemetry_write(spark, sf_dir):
    """Records stored and read back; a batch that can't be stored doesn't fail its caller."""
    sink = telemetry.Telemetry(spark, _scratch_folder(spark, "telemetry"))
    stored = sink.write(_records(spark, sf_dir))
    refused = sink.write([{"kind": "log", "ts_ms": "not a time"}])
    return sink.records().select("ts_ms", "span_id", "kind", "value", F.lit(refused or not stored or sink.lost != 1).alias("lost"))


@query(_RECORDS + "SELECT CASE kind WHEN 'log' THEN 'logs' ELSE 'metrics' END AS channel, count(*) AS n, min(ts_ms) AS first, max(ts_ms) AS last FROM r WHERE kind <> 'span' GROUP BY 1")
def push_channels(spark, sf_dir):
    """New records go to the channels that want them, once; a channel that fails doesn't hold the others up."""
    sink, got = telemetry.Telemetry(spark, _scratch_folder(spark, "telemetry")), []
    sink.write(_records(spark, sf_dir))

    def send(name, rows):
        if name == "broken":
            raise OSError("gone")
        got.append((name, *rows.agg(F.count("*"), F.min("ts_ms"), F.max("ts_ms")).first()))

    channels = {"logs": lambda df: df.where("kind = 'log'"), "broken": lambda df: df, "metrics": lambda df: df.where("kind = 'metric'")}
    at = _scratch_folder(spark, "push")
    for _ in range(2):  # the second time there is nothing new
        sink.push(channels, send, at, once=True).awaitTermination()
    return _rows(spark, got, "channel string, n long, first long, last long")


# -- domain objects


def _identity_events(spark, sf_dir):
    """The events as an identity's life."""
    data = F.when(F.col("type") == "signup", F.to_json(F.struct(F.col("stream_id").alias("userId"), F.concat(F.col("stream_id"), F.lit("@x")).alias("email")))).when(F.col("type") == "click", F.to_json(F.struct(F.concat(F.lit("r"), F.col("k") % 5).alias("role"), F.concat(F.lit("t"), F.col("k") % 3).alias("tenantId")))).otherwise(F.to_json(F.struct(F.col("k").cast("string").alias("sessionId"))))
    name = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "UserRegistered", "click", "RoleAssigned", "purchase", "SessionCreated", "error", "SessionRevokedByReuse", "view", "LoginFailed")]), F.col("type"))
    return activity(spark, sf_dir).withColumn("k", V.field("k", "long")).withColumn("data", data).withColumn("type", name)


@query(_EVENTS + """, sessions AS (SELECT stream_id, k, arg_max(type, global_position) AS last, max(CASE WHEN type = 'error' THEN 1 ELSE 0 END) AS revoked FROM e WHERE type IN ('purchase', 'error') GROUP BY stream_id, k)
SELECT e.stream_id, max(CASE WHEN type = 'signup' THEN e.stream_id || '@x' END) AS email, max(CASE WHEN type = 'signup' THEN 1 ELSE 0 END) = 1 AS registered, count(*) FILTER (type = 'view') AS failed_logins,
  count(DISTINCT CASE WHEN type = 'click' THEN (k % 3) * 10 + k % 5 END) AS n_roles, (SELECT count(*) FROM sessions s WHERE s.stream_id = e.stream_id AND last = 'purchase') AS n_sessions, (SELECT count(*) FROM sessions s WHERE s.stream_id = e.stream_id AND revoked = 1) AS n_revoked
FROM e GROUP BY e.stream_id""")
def identity_fold(spark, sf_dir):
    """Maps and sets as state: roles by organisation, open sessions, revoked ones, failed logins."""
    state = T.StructType.fromDDL("email string, exists boolean, failed_logins long, roles map<string,array<string>>, sessions map<string,string>, revoked array<string>")
    rows = domain.IDENTITY.batch(_identity_events(spark, sf_dir)).withColumn("s", F.from_json("state", state))
    n_roles = F.aggregate(F.map_values("s.roles"), F.lit(0).cast("long"), lambda n, own: n + F.size(own))
    return rows.select("stream_id", "s.email", F.col("s.exists").alias("registered"), F.col("s.failed_logins").alias("failed_logins"), n_roles.alias("n_roles"), F.size("s.sessions").cast("long").alias("n_sessions"), F.size("s.revoked").cast("long").alias("n_revoked"))


@query(_EVENTS + """, m AS (SELECT stream_id, k, arg_max(type, global_position) AS last FROM e WHERE type IN ('purchase', 'error') GROUP BY stream_id, k),
i AS (SELECT stream_id, k, arg_max(type, global_position) AS last FROM e WHERE type IN ('click', 'purchase') GROUP BY stream_id, k)
SELECT stream_id, arg_max('plan-' || k, global_position) FILTER (type = 'view') AS plan, (SELECT count(*) FROM m WHERE m.stream_id = e.stream_id AND last = 'purchase') AS n_members, (SELECT count(*) FROM i WHERE i.stream_id = e.stream_id AND last = 'click') AS n_invites FROM e GROUP BY stream_id""")
def tenant_fold(spark, sf_dir):
    """A tenant: settings merged key by key, members that come and go, invitations that end when they are taken."""
    k = F.col("k").cast("string")
    data = F.when(F.col("type") == "view", F.to_json(F.struct(F.struct(F.concat(F.lit("plan-"), k).alias("plan")).alias("settings")))).when(F.col("type") == "click", F.to_json(F.struct(k.alias("email"), F.lit("member").alias("role")))).when(F.col("type") == "purchase", F.to_json(F.struct(k.alias("email"), k.alias("userId"), F.lit("member").alias("role")))).otherwise(F.to_json(F.struct(k.alias("userId"))))
    name = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "TenantCreated", "click", "MemberInvited", "purchase", "MemberJoined", "error", "MemberRemoved", "view", "TenantSettingsChanged")]), F.col("type"))
    rows = activity(spark, sf_dir).withColumn("k", V.field("k", "long")).withColumn("data", data).withColumn("type", name)
    state = T.StructType.fromDDL("settings map<string,string>, members map<string,string>, invites map<string,string>")
    found = domain.TENANT.batch(rows).withColumn("s", F.from_json("state", state))
    return found.select("stream_id", F.try_element_at("s.settings", F.lit("plan")).alias("plan"), F.size("s.members").cast("long").alias("n_members"), F.size("s.invites").cast("long").alias("n_invites"))


@query(_EVENTS + "SELECT stream_id, arg_max(value, global_position) FILTER (type IN ('purchase', 'view')) AS value, CAST(arg_max(k, global_position) FILTER (type = 'click') AS DOUBLE) AS k FROM e GROUP BY stream_id")
def copied_fields_fold(spark, sf_dir):
    """Every event sets the fields that its schema names."""
    return domain.copied_fields("stream_id", {"purchase": {"value": "number"}, "view": {"value": "number?"}, "click": {"k": "number"}}).batch(activity(spark, sf_dir))


_TASKS = """, t AS (SELECT *, CASE type WHEN 'signup' THEN 'TaskCreated' WHEN 'purchase' THEN 'TaskCompleted' WHEN 'error' THEN 'TaskReopened' WHEN 'click' THEN 'TaskAssigned' ELSE 'TaskUnassigned' END AS kind FROM e)
"""


@query(_EVENTS + _TASKS + """SELECT stream_id, arg_max('title ' || k, global_position) FILTER (kind = 'TaskCreated') AS title, coalesce(arg_max(kind, global_position) FILTER (kind IN ('TaskCompleted', 'TaskReopened')) = 'TaskCompleted', FALSE) AS completed,
  CASE WHEN arg_max(kind, global_position) FILTER (kind IN ('TaskAssigned', 'TaskUnassigned')) = 'TaskAssigned' THEN arg_max(CAST(k AS VARCHAR), global_position) FILTER (kind IN ('TaskAssigned', 'TaskUnassigned')) END AS assignee_id FROM t GROUP BY stream_id""")
def task_states(spark, sf_dir):
    """A task's fields, of which one is set back to nothing."""
    name = F.element_at(F.create_map(*[F.lit(x) for x in ("signup", "TaskCreated", "purchase", "TaskCompleted", "error", "TaskReopened", "click", "TaskAssigned", "view", "TaskUnassigned")]), F.col("type"))
    k = V.field("k")
    rows = activity(spark, sf_dir).withColumn("data", F.to_json(F.struct(F.concat(F.lit("title "), k).alias("title"), k.alias("assigneeId")))).withColumn("type", name)
    return domain.TASK.batch(rows).select("stream_id", "title", "completed", "assignee_id")


def _account(state, command):
    """Opens an account once, and pays into it while it stands below its limit."""
    if state is None or not state["n"]:
        return [{"type": "Opened", "data": {"limit": command["limit"]}}, {"type": "Paid", "data": {"amount": command["amount"]}}]
    if state["total"] + command["amount"] > state["limit"]:
        raise ValueError("over the limit")
    return [{"type": "Paid", "data": {"amount": command["amount"]}}] if command["amount"] else []


_ACCOUNT = domain.Aggregate("account", Aggregates({"n": Measure("count", types=("Opened",)), "limit": Measure("max", "CAST(get_json_object(data, '$.limit') AS DOUBLE)", ("Opened",)), "total": Measure("sum", "CAST(get_json_object(data, '$.amount') AS DOUBLE)", ("Paid",))}, key="stream_id"), _account)


@query("""SELECT 'region-' || n_regionkey AS stream_id, CAST(least(count(*), 3) AS DOUBLE) * 10 AS total, least(count(*), 3) + 1 AS n_events, greatest(count(*) - 3, 0) AS refused FROM nation GROUP BY n_regionkey""")
def commands(spark, sf_dir):
    """Each nation pays 10 into its region's account, whose limit is 30: what is beyond is refused."""
    log, refused = _log(spark), {}
    for row in _nations(spark, sf_dir):
        stream = f"region-{row.n_regionkey}"
        refused.setdefault(stream, 0)
        try:
            domain.handle(log, _ACCOUNT, stream, {"amount": 10, "limit": 30})
        except ValueError:
            refused[stream] += 1
    states = _ACCOUNT.fold.batch(log.committed()).join(reads.stream_heads(log.committed()), "stream_id")
    return states.join(_rows(spark, sorted(refused.items()), "stream_id string, refused long"), "stream_id").select("stream_id", "total", "n_events", "refused")


@query("""WITH r AS (SELECT r_regionkey AS k, row_number() OVER (ORDER BY r_regionkey) - 1 AS place FROM region)
SELECT 'region-' || k AS stream_id, CAST(1 AS BIGINT) AS stream_revision, place * 2 AS global_position, CAST((SELECT count(*) FROM r) * 2 AS BIGINT) AS total_events FROM r""")
def orchestrated(spark, sf_dir):
    """One step for every region, all or none: an attempt with one step that is refused leaves nothing."""
    log, regions = _log(spark), [f"region-{r.r_regionkey}" for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    ok = {"amount": 10, "limit": 30}

    def refuse(state, command):
        raise ValueError("no")

    try:
        domain.orchestrate(log, [*((_ACCOUNT, s, ok) for s in regions), (domain.Aggregate("x", _ACCOUNT.fold, refuse), "x", {})])
    except ValueError:
        pass
    done = domain.orchestrate(log, [(_ACCOUNT, s, ok) for s in regions])
    return _rows(spark, [(s, a.stream_revision, a.global_position, done.total_events) for s, a in done.streams.items()], "stream_id string, stream_revision long, global_position long, total_events long")


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS id, TRUE AS others FROM nation")
def lookup_streams(spark, sf_dir):
    """A secondary index as streams of one event: the first claim of a name holds."""
    log, rows = _log(spark), _nations(spark, sf_dir)
    log.append_batch([Append(f"lookup-nation-{r.n_name}", [{"type": "Claimed", "data": {"id": str(r.n_nationkey)}}, {"type": "Claimed", "data": {"id": "late"}}]) for r in rows])
    none = domain.lookup(log, "nation", "nowhere", "id") is None
    return _rows(spark, [(r.n_name, domain.lookup(log, "nation", r.n_name, "id"), none) for r in rows], "name string, id string, others boolean")


@query("""SELECT 'customer-' || c_custkey AS stream_id, 'nation-' || c_nationkey AS nation, n_name AS name, CAST(c_acctbal AS DOUBLE) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def states_of_two_kinds(spark, sf_dir):
    """Customers' states beside those of the nations that they name."""
    none = F.lit(None).cast("string")
    event = lambda df, stream, kind, data, at: df.select(at.alias("global_position"), stream.alias("stream_id"), F.lit(0).cast("long").alias("revision"), F.lit(kind).alias("type"), F.to_json(data).alias("data"), none.alias("metadata"), F.lit(0).cast("long").alias("timestamp_ms"), F.lit("default").alias("tenant_id"))
    nations, customers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    events = event(nations, F.concat(F.lit("nation-"), "n_nationkey"), "NationJoined", F.struct(F.col("n_name").alias("name")), F.col("n_nationkey").cast("long")).unionByName(event(customers, F.concat(F.lit("customer-"), "c_custkey"), "CustomerJoined", F.struct(F.concat(F.lit("nation-"), "c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")), F.col("c_custkey") + 1000))
    first = Latest("stream_id", {"nation": "get_json_object(data, '$.nation')", "balance": "CAST(get_json_object(data, '$.balance') AS DOUBLE)"}, ("CustomerJoined",))
    second = Latest("stream_id", {"name": "get_json_object(data, '$.name')"}, ("NationJoined",))
    return domain.states_of_two(events, first, second, "nation").select("stream_id", "nation", "name", "balance")


@query(_EVENTS + "SELECT p.global_position, p.stream_id, p.value, arg_max(s.global_position, s.global_position) AS signup_position FROM e p JOIN e s ON p.stream_id = s.stream_id AND s.type = 'signup' AND s.global_position < p.global_position WHERE p.type = 'purchase' GROUP BY ALL")
def correlated_events(spark, sf_dir):
    """Each purchase with the signup before it: events of two kinds that speak of one user."""
    rows = activity_rows(spark, sf_dir).where("type IN ('purchase', 'signup')")
    from pyspark.sql import Window

    last = F.last(F.when(F.col("type") == "signup", F.col("global_position")), ignorenulls=True).over(Window.partitionBy("stream_id").orderBy("global_position"))
    return rows.withColumn("signup_position", last).where("type = 'purchase' AND signup_position IS NOT NULL").select("global_position", "stream_id", "value", "signup_position")


@query(_EVENTS + "SELECT i.stream_id, i.n, e.type AS last_type FROM (SELECT stream_id, count(*) AS n, max(global_position) AS at FROM e GROUP BY stream_id) i JOIN e ON e.global_position = i.at")
def index_to_log(spark, sf_dir):
    """From an index of positions to the events themselves."""
    rows = activity_rows(spark, sf_dir)
    index = reads.stream_heads(rows.withColumn("revision", F.lit(0).cast("long"))).select(F.col("stream_id").alias("of"), F.col("n_events").alias("n"), F.col("last_position").alias("at"))
    return index.join(rows, (F.col("global_position") == F.col("at")) & (F.col("stream_id") == F.col("of"))).select("stream_id", "n", F.col("type").alias("last_type"))


@query("SELECT * FROM (VALUES ('OPEN_ORDERS', 'Aggregates'), ('SHOP', 'Aggregate'), ('TOTAL', 'Projection')) t(name, kind)")
def discovered_specs(spark, sf_dir):
    """The specifications that a folder's files define."""
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "shop.py").write_text("from evlog.plans.domain import Aggregate\nfrom evlog.plans.folds import Aggregates, Measure\nOPEN_ORDERS = Aggregates({'n': Measure('count')}, key='stream_id')\nSHOP = Aggregate('shop', OPEN_ORDERS, lambda s, c: [])\n")
        Path(folder, "views").mkdir()
        Path(folder, "views", "total.py").write_text("from evlog.plans.folds import signed_sum\nfrom evlog.plans.projections import Projection\nTOTAL = Projection('total', signed_sum({'Placed': '1'}))\n")
        for hidden in ("__init__.py", "_private.py", ".cache/x.py"):
            Path(folder, hidden).parent.mkdir(exist_ok=True)
            Path(folder, hidden).write_text("raise SystemExit('not to be run')")
        found = domain.discover(folder)
    return _rows(spark, [(n, type(v).__name__) for n, v in found.items()], "name string, kind string")


# -- projections


_AMOUNT = "CAST(get_json_object(data, '$.value') AS DOUBLE)"
_K = "CAST(get_json_object(data, '$.k') AS BIGINT)"


def _projections(**options) -> Registry:
    registry = Registry()
    registry.register(Projection("revenue", signed_sum({"purchase": _AMOUNT}, {"error": _AMOUNT}), ("purchase", "error")), **options)
    registry.register(Projection("clicks", Aggregates({"n": Measure("count"), "high": Measure("max", _K)}, key="type"), ("click", "view"), index=("n",)), **options)
    registry.register(Projection("off", Aggregates({"n": Measure("count")})), enabled=False)
    return registry


_BOTH = _EVENTS + """SELECT 'revenue' AS name, NULL AS type, CAST(sum(CASE type WHEN 'purchase' THEN CAST(value AS DECIMAL(18,2)) WHEN 'error' THEN -CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS value FROM e
UNION ALL SELECT 'clicks', type, CAST(count(*) AS DOUBLE) FROM e WHERE type IN ('click', 'view') GROUP BY type"""


def _both(coordinator: Coordinator):
    revenue = coordinator.model("revenue").select(F.lit("revenue").alias("name"), F.lit(None).cast("string").alias("type"), F.col("total").alias("value"))
    return revenue.unionByName(coordinator.model("clicks").select(F.lit("clicks").alias("name"), "type", F.col("n").cast("double").alias("value")))


@query(_BOTH)
def shared_reader(spark, sf_dir):
    """Two projections on one reader, resumed half-way by another process."""
    log, rows = _log(spark), _frame(spark, sf_dir)
    middle = rows.agg(F.max("global_position")).first()[0] // 2
    log.append_frame(rows.where(F.col("global_position") <= middle), ["global_position"])
    Coordinator(log, _projections()).run_once()
    log.append_frame(rows.where(F.col("global_position") > middle), ["global_position"])
    again = Coordinator(EventLog(spark, log.path), _projections())
    again.run_once()
    return _both(again)


@query(_BOTH)
def independent_readers(spark, sf_dir):
    """A reader for each projection, running while the log grows, and waited for."""
    log = _log(spark)
    coordinator = Coordinator(log, _projections(shared_reader=False))
    coordinator.start()
    try:
        log.append_frame(_frame(spark, sf_dir), ["global_position"])
        coordinator.force_checkpoint()
        return _both(coordinator)
    finally:
        coordinator.stop()


@query(_BOTH)
def rebuilt_projections(spark, sf_dir):
    """States forgotten and folded again from the whole log."""
    log = _activity_log(spark, sf_dir, 2)
    coordinator = Coordinator(log, _projections())
    for name in ("revenue", "clicks"):
        coordinator.rebuild(name)
    return _both(coordinator)


@query("SELECT name, enabled, position, lag, CASE WHEN lag > 10000 THEN 'error' WHEN lag > 1000 THEN 'warning' ELSE 'healthy' END AS health FROM (SELECT *, CASE WHEN name = 'off' THEN h + 1 ELSE 0 END AS lag, CASE WHEN name = 'off' THEN -1 ELSE h END AS position FROM (VALUES ('revenue', TRUE), ('clicks', TRUE), ('off', FALSE)) t(name, enabled), (SELECT max(event_id) AS h FROM events))")
def projection_status(spark, sf_dir):
    """Where every projection stands; one that is disabled stands at the beginning."""
    coordinator = Coordinator(_activity_log(spark, sf_dir, 1), _projections())
    coordinator.run_once()
    return coordinator.status()


@query(_NATIONS + "SELECT count(*) - 1 AS appended, 'BackpressureTimeoutError' AS error FROM n WHERE position <= 11")
def backpressure(spark, sf_dir):
    """Writers are held back while projections lag by more than ten events, and fail after a while."""
    log = _log(spark)
    coordinator, error = Coordinator(log, _projections()), None
    coordinator.run_once()
    coordinator.queries = {"none": None}  # as while they run
    coordinator.hold_back(most=10, wait=0.05)
    for row in _nations(spark, sf_dir):
        try:
            log.append(f"region-{row.n_regionkey}", [_joined(row)])
        except Exception as e:  # noqa: BLE001
            error = type(e).__name__
            break
    return _rows(spark, [(log.durable_position(), error)], "appended long, error string")


@query(_EVENTS + "SELECT (SELECT count(*) FROM e) // 2 - 1 AS position, 'stopped' AS reader, CAST(sum(k) AS BIGINT) AS total FROM e WHERE global_position < (SELECT count(*) FROM e) // 2")
def failing_fold(spark, sf_dir):
    """A fold that fails on a later event stops its reader; the state stays where it was, and passes over nothing."""
    log, rows = _log(spark), _frame(spark, sf_dir)
    n = rows.agg(F.max("global_position")).first()[0] + 1
    log.append_frame(rows.where(F.col("global_position") < n // 2), ["global_position"])
    registry = Registry()
    registry.register(Projection("total", Aggregates({"total": Measure("sum", _K, digits=None)})))
    coordinator, reader = Coordinator(log, registry), "ran on"
    coordinator.run_once()
    log.append("user-0", [{"type": "click", "data": {"k": "no number"}}])
    try:
        coordinator.run_once()
    except Exception:  # noqa: BLE001
        reader = "stopped"
    coordinator.stop()
    return coordinator.model("total").select(F.lit(coordinator.store("total").position()).alias("position"), F.lit(reader).alias("reader"), "total")


@query("SELECT * FROM (VALUES ('again', 'AlreadyRegisteredError'), ('unknown', 'ProjectionNotFoundError'), ('disabled', 'ProjectionDisabledError'), ('poll', '7'), ('of its own', '100')) t(what, answer)")
def registry_answers(spark, sf_dir):
    """Unique names; options given at registration go before the projection's own."""
    registry, out = _projections(), []
    for what, f in (("again", lambda: registry.register(Projection("revenue", signed_sum({"a": "1"})))), ("unknown", lambda: registry.require("nothing")), ("disabled", lambda: registry.require("off"))):
        try:
            f()
        except Exception as e:  # noqa: BLE001
            out.append((what, type(e).__name__))
    registry.register(Projection("x", signed_sum({"a": "1"}), options=Options(poll_ms=50)), poll_ms=7)
    return _rows(spark, [*out, ("poll", str(registry.require("x").options.poll_ms)), ("of its own", str(registry.require("clicks").options.poll_ms))], "what string, answer string")


@query("SELECT 'owner' AS writer, max(event_id) AS position, 1 AS refused FROM events")
def exclusive_states(spark, sf_dir):
    """Of two coordinators that go on from the same state one is refused."""
    log, rows = _log(spark), _frame(spark, sf_dir)
    log.append_frame(rows, ["global_position"])
    counted = Projection("n", Aggregates({"n": Measure("count")}))
    folder = _scratch_folder(spark, "states")
    owner, late, refused = StateStore(spark, folder, "n"), StateStore(spark, folder, "n"), 0
    late._newest = lambda seen=late._newest(): seen
    advance(counted, owner, log.committed(), log.durable_position() - 1)
    try:
        advance(counted, late, log.committed(), 5)
    except Exception:  # noqa: BLE001
        refused = 1
    return _rows(spark, [("owner", owner.position(), refused)], "writer string, position long, refused int")


@query("SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus AS status, o_totalprice AS amount FROM orders) WHERE amount BETWEEN 50000 AND 60000")
def published_view(spark, sf_dir):
    """A read model written out by its key and its index: a range of an indexed field is read from the copy in its order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    projection = Projection("orders", Latest("o_orderkey", {"status": "status", "amount": "amount"}), index=("amount",))
    out = Published(spark, _scratch_folder(spark, "models"), projection)
    out.publish(orders, 7)
    return out.view("amount").query_field_range("amount", 50000.0, 60000.0)


@query(_EVENTS + "SELECT stream_id, count(*) AS n, count(*) FILTER (type = 'error') AS errors, max(global_position) AS last FROM e GROUP BY stream_id")
def stepwise_machine(spark, sf_dir):
    """The general fold taken on in three steps: each goes on from the states of the keys it meets."""
    def step(state, event):
        return {"n": state["n"] + 1, "errors": state["errors"] + (event["type"] == "error"), "last": event["position"]}

    machine, events = Machine("stream_id", step, {"n": 0, "errors": 0, "last": None}), activity(spark, sf_dir)
    projection, store = Projection("m", machine), StateStore(spark, _scratch_folder(spark, "states"), "m")
    end = events.agg(F.max("global_position")).first()[0]
    for upto in (end // 3, end // 2, end):
        advance(projection, store, events, upto)
    state = F.from_json("state", "n long, errors long, last long")
    return model(projection, store, events.limit(0)).select("stream_id", state.alias("s")).select("stream_id", "s.n", "s.errors", "s.last")


@query("SELECT * FROM (VALUES ('rand()', FALSE), ('sum of uuid()', FALSE), ('key by now()', FALSE), ('brand(x)', TRUE), ('a quoted rand()', TRUE), ('unsubscribed type', FALSE), ('no measures', FALSE)) t(what, accepted)")
def checked_specs(spark, sf_dir):
    """Folds must give the same rows at every run, look only at what they subscribe to, and hold something."""
    tries = {
        "rand()": lambda: check_pure("v > rand()"), "sum of uuid()": lambda: Projection("x", Aggregates({"n": Measure("max", "uuid()")})), "key by now()": lambda: Projection("x", Aggregates({"n": Measure("count")}, key_columns={"d": "date_format(now(), 'yyyy')"})),
        "brand(x)": lambda: check_pure("brand(x)"), "a quoted rand()": lambda: check_pure("v = 'rand()'"), "unsubscribed type": lambda: Projection("x", signed_sum({"a": "1"}), ("b",)), "no measures": lambda: Aggregates({}),
    }
    out = []
    for what, f in tries.items():
        try:
            f()
            out.append((what, True))
        except SpecError:
            out.append((what, False))
    return _rows(spark, out, "what string, accepted boolean")


# -- views by name, access


@query("SELECT o_orderkey, o_custkey, o_totalprice AS amount, CASE WHEN o_custkey = 7 THEN 'by customer' ELSE 'by price' END AS method FROM orders WHERE o_custkey = 7 OR (o_totalprice BETWEEN 50000 AND 51000 AND o_custkey <> 7)")
def routed_methods(spark, sf_dir):
    """Query methods called with texts, as a router has them."""
    orders = View(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("amount")), "o_orderkey")
    one = call(orders, Method("byCustomer", ("o_custkey",)), {"o_custkey": "7"})
    two = call(orders, Method("byPrice", between="amount"), {"start": "50000", "end": "51000"}).where("o_custkey <> 7")
    return one.withColumn("method", F.lit("by customer")).unionByName(two.withColumn("method", F.lit("by price")))


@query("SELECT * FROM (VALUES ('list', 'public', TRUE, TRUE, TRUE), ('rename', 'internal', FALSE, TRUE, TRUE), ('remove', 'private', FALSE, FALSE, TRUE)) t(method, level, stranger, member, admin)")
def access_rules(spark, sf_dir):
    """A method's rule goes before its entity's; private methods are for roles."""
    entity = access.Entity("nation", access.Rule("internal"), {"list": access.Rule("public"), "rename": None, "remove": access.Rule("private", ("admin",))})
    rows = access.rules(spark, [entity])
    who = {"stranger": (False, []), "member": (True, ["reader"]), "admin": (True, ["reader", "admin"])}
    return rows.select("method", "level", *[access.may(F.col("level"), F.col("roles"), F.lit(known), F.array(*map(F.lit, has)).cast("array<string>")).alias(name) for name, (known, has) in who.items()])


@query("SELECT status, count(*) AS n FROM (SELECT o_orderstatus AS status FROM orders) GROUP BY status")
def cached_view(spark, sf_dir):
    """A view whose rows are kept in memory between queries."""
    view = View(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "o_orderkey").cached()
    counts = _rows(spark, [tuple(r) for r in view.value_counts("status").collect()], "status string, n long")  # a row a status
    view.release()
    return counts


# -- schemas


@query("SELECT * FROM (VALUES ('event_added', 'order', 'Shipped', NULL, FALSE), ('event_removed', 'order', 'Gone', NULL, TRUE), ('field_added', 'order', 'Placed', 'note', FALSE), ('field_added', 'order', 'Placed', 'currency', TRUE), ('field_removed', 'order', 'Placed', 'old', TRUE), ('field_type_changed', 'order', 'Placed', 'amount', TRUE), ('field_type_changed', 'order', 'Placed', 'tag', FALSE), ('event_removed', 'user', 'Joined', NULL, TRUE)) t(kind, aggregate, event, field, breaking)")
def schema_changes(spark, sf_dir):
    """What has changed since the lock, and what of it breaks old events or their readers."""
    locked = {"order": {"Placed": {"amount": "number", "old": "string", "tag": "string"}, "Gone": {}}, "user": {"Joined": {}}}
    current = {"order": {"Placed": {"amount": "string", "tag": "string?", "note": "string?", "currency": "string"}, "Shipped": {}}}
    return _rows(spark, [(c.kind, c.aggregate, c.event, c.field, c.breaking) for c in schema_evo.diff(locked, current)], "kind string, aggregate string, event string, field string, breaking boolean")


@query("SELECT * FROM (VALUES (1, 'sync', 0, 1), (2, 'status', 1, 1), (3, 'sync', 1, 1), (4, 'sync with a default', 0, 2), (5, 'diff', 0, 2), (6, 'sync --force', 0, 3)) t(step, command, code, version)")
def schema_commands(spark, sf_dir):
    """The commands on a lock file: what they end with, and the lock's version after them."""
    with tempfile.TemporaryDirectory() as folder:
        lock, given, out = f"{folder}/schema.lock", Path(folder, "schema.json"), []
        old, new, less = {"order": {"Placed": {"amount": "number"}}}, {"order": {"Placed": {"amount": "number", "currency": "string"}}}, {"order": {"Placed": {"amount": "number"}}}
        for step, (name, now, command) in enumerate([("sync", old, ["sync"]), ("status", new, ["status"]), ("sync", new, ["sync"]), ("sync with a default", new, ["sync", "--default", 'order.Placed.currency="EUR"']), ("diff", new, ["diff"]), ("sync --force", less, ["sync", "--force"])], 1):
            given.write_text(json.dumps(now))
            code = schema.main([*command, "--lock", lock, "--schema", str(given)], say=lambda _: None)
            out.append((step, name, code, schema_evo.Lock.load(lock).version))
    return _rows(spark, out, "step int, command string, code int, version int")


@query(_EVENTS + "SELECT global_position, CASE WHEN type = 'purchase' THEN CASE WHEN global_position % 3 = 0 THEN 'null' ELSE 'f1=1,f10=10' END ELSE '' END AS added, k FROM e")
def upcast_ten_steps(spark, sf_dir):
    """Ten versions, each with a field more; a null that is there stays."""
    schema_ = {"user": {"purchase": {"value": "number"}}}
    lock = schema_evo.Lock(1, schema_)
    for i in range(1, 11):
        schema_ = {"user": {"purchase": {**schema_["user"]["purchase"], f"f{i}": "number"}}}
        lock = lock.sync(schema_, {("user", "purchase", f"f{i}"): i})
    old = activity(spark, sf_dir)
    data = F.when((F.col("type") == "purchase") & (F.col("global_position") % 3 == 0), F.regexp_replace("data", r"\}$", ',"f1":null}')).otherwise(F.col("data"))
    rows = schema_evo.upcast(old.withColumn("data", data), lock)
    v = F.try_parse_json("data")
    f1 = F.try_variant_get(v, "$.f1", "variant")
    shown = F.when(f1.isNull(), F.lit("")).when(F.is_variant_null(f1), F.lit("null")).otherwise(F.concat(F.lit("f1="), V.field("f1"), F.lit(",f10="), V.field("f10")))
    return rows.select("global_position", shown.alias("added"), V.field("k", "long").alias("k"))


@query(_EVENTS + """SELECT global_position, CASE type WHEN 'signup' THEN 'unknown type' WHEN 'purchase' THEN 'note: not string?' WHEN 'error' THEN 'tags: not array<string>' WHEN 'click' THEN 'who: not reference' END AS problem
FROM e WHERE type = 'signup' OR type = 'purchase' AND k < 20 OR type = 'error' AND k >= 50 OR type = 'click' AND k % 2 = 0""")
def invalid_payloads(spark, sf_dir):
    """Payloads that are not of their type's schema, and what is wrong."""
    k = V.field("k", "long")
    value = V.field("value", "double")
    data = (
        F.when(F.col("type") == "purchase", F.when(k < 20, F.to_json(F.struct(value.alias("value"), k.alias("note")))).otherwise(F.to_json(F.struct(value.alias("value"), F.lit("x").alias("note")))))
        .when(F.col("type") == "error", F.when(k >= 50, F.lit('{"tags":["a",1]}')).otherwise(F.lit('{"tags":["a","b"]}')))
        .when(F.col("type") == "click", F.when(k % 2 == 0, F.lit('{"who":"","at":{"x":1}}')).otherwise(F.lit('{"who":"u","at":{}}')))
        .otherwise(F.col("data"))
    )
    wanted = {"purchase": {"value": "number", "note": "string?"}, "error": {"tags": "array<string>"}, "click": {"who": "reference", "at": "object"}, "view": {"k": "number", "gone": "boolean?"}}
    rows = activity(spark, sf_dir).withColumn("data", data)
    return schema_evo.invalid(rows, wanted).select("global_position", F.array_join("problems", ",").alias("problem"))


# -- values and expressions


@query(_EVENTS + """SELECT global_position, k + 1 AS more, k * 2 - 1 AS twice, CASE WHEN k = 0 THEN NULL ELSE value / k END AS ratio, k >= 50 AND type <> 'view' AS busy, NOT (type = 'click' OR k < 10) AS other, -k AS less,
  CAST(floor(-value + 0.5) AS BIGINT) AS rounded, greatest(k, 50) AS top, least(k, 50) AS bottom, CAST(floor(value) AS BIGINT) AS whole, CAST(k * k AS DOUBLE) AS square FROM e""")
def expression_numbers(spark, sf_dir):
    """Arithmetic, comparison, logic and numbers in the expression language."""
    c, op, num = (lambda x: {"col": x}), (lambda *x: {"op": list(x)}), (lambda *x: {"call": list(x)})
    trees = {
        "more": op("+", c("k"), 1), "twice": op("-", op("*", c("k"), 2), 1), "ratio": op("/", c("value"), c("k")), "busy": op("&&", op(">=", c("k"), 50), op("!==", c("type"), "view")), "other": {"not": op("||", op("===", c("type"), "click"), op("<", c("k"), 10))},
        "less": {"neg": c("k")}, "rounded": num("round", {"neg": c("value")}), "top": num("max", c("k"), 50), "bottom": num("min", c("k"), 50), "whole": num("floor", c("value")), "square": num("pow", c("k"), 2),
    }
    rows = activity_rows(spark, sf_dir).select("global_position", *[V.compile_expression(t).alias(n) for n, t in trees.items()])
    longs = [F.col(n).cast("long").alias(n) for n in ("more", "twice", "less", "rounded", "top", "bottom", "whole")]
    ratio = F.when(F.abs("ratio") == float("inf"), None).when(F.isnan("ratio"), None).otherwise(F.col("ratio"))
    return rows.select("global_position", *longs, ratio.alias("ratio"), "busy", "other", "square")


@query("""SELECT c_custkey AS id, trim('  ' || c_mktsegment || ' ') AS trimmed, contains(c_mktsegment, 'UILD') AS has, ends_with(c_mktsegment, 'Y') AS ends, starts_with(c_mktsegment, 'A') AS starts, replace(c_mktsegment, 'E', '3') AS swapped,
  substr(c_mktsegment, 2, 3) AS part, printf('%.1f', CASE WHEN c_acctbal * 4 = floor(c_acctbal * 4) THEN c_acctbal + sign(c_acctbal) / 64 ELSE c_acctbal END) AS fixed, length(c_mktsegment) AS size, CASE WHEN c_acctbal < 0 THEN 'owes' ELSE c_mktsegment END AS shown FROM customer""")
def expression_texts(spark, sf_dir):
    """Texts, conditions and names in the expression language."""
    s, num = {"col": "c_mktsegment"}, (lambda *x: {"call": list(x)})
    trees = {
        "trimmed": num("trim", {"col": "padded"}), "has": num("includes", s, "UILD"), "ends": num("endsWith", s, "Y"), "starts": num("startsWith", s, "A"), "swapped": num("replace", s, "E", "3"), "part": num("slice", s, 1, 4), "fixed": num("toFixed", {"col": "c_acctbal"}, 1),
        "size": num("length", s), "shown": {"let": ["owes", {"op": ["<", {"col": "c_acctbal"}, 0]}, {"if": [{"var": "owes"}, "owes", s]}]},
    }
    rows = table(spark, sf_dir, "customer").withColumn("padded", F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")))
    return rows.select(F.col("c_custkey").alias("id"), *[V.compile_expression(t).alias(n) for n, t in trees.items()]).withColumn("size", F.col("size").cast("long"))


@query(_EVENTS + """SELECT stream_id, count(DISTINCT type) AS n_types, len(list_filter(list(k), lambda x: x > 90)) AS high, CAST(list_sum(list_transform(list(k), lambda x: x * 2)) AS BIGINT) AS twice, count(*) + 1 AS pushed, list_contains(list(k), 7) AS has_seven, count(DISTINCT type) + 1 AS after_set, count(DISTINCT type) - max(CASE WHEN type = 'view' THEN 1 ELSE 0 END) AS after_delete FROM e GROUP BY stream_id""")
def expression_collections(spark, sf_dir):
    """Arrays and maps in the expression language: values, filter, map, push, has, set, delete."""
    rows = activity_rows(spark, sf_dir).groupBy("stream_id").agg(F.collect_list("k").alias("ks"), F.collect_set("type").alias("types")).withColumn("m", F.map_from_arrays("types", F.transform("types", lambda t: F.length(t))))
    num = lambda *x: {"call": list(x)}
    trees = {"types_": num("values", {"col": "m"}), "high_": {"filter": [{"col": "ks"}, "x", {"op": [">", {"var": "x"}, 90]}]}, "twice_": {"map": [{"col": "ks"}, "x", {"op": ["*", {"var": "x"}, 2]}]}, "pushed_": num("push", {"col": "ks"}, 1), "has_seven": num("has", {"col": "ks"}, 7), "set_": num("set", {"col": "m"}, "new", 1), "delete_": num("delete", {"col": "m"}, "view")}
    done = rows.select("stream_id", *[V.compile_expression(t).alias(n) for n, t in trees.items()])
    size = lambda c: F.size(c).cast("long")
    return done.select("stream_id", size("types_").alias("n_types"), size("high_").alias("high"), F.aggregate("twice_", F.lit(0).cast("long"), lambda a, x: a + x).alias("twice"), size("pushed_").alias("pushed"), "has_seven", size("set_").alias("after_set"), size("delete_").alias("after_delete"))


@query(_EVENTS + """SELECT global_position, CASE WHEN type = 'view' THEN 0 WHEN k > 80 THEN 2 ELSE 1 END AS n, CASE WHEN type = 'view' THEN '' WHEN k > 80 THEN 'Seen,Praised' ELSE 'Seen' END AS types,
  CASE WHEN type <> 'view' THEN '{"k":' || k || ',"double":' || (k * 2) || '}' END AS first FROM e""")
def emitted_events(spark, sf_dir):
    """A command's body as an expression: names, conditions, an early return, events."""
    body = [
        {"if": [{"op": ["===", {"col": "type"}, "view"]}, [{"return": None}]]}, {"let": ["twice", {"op": ["*", {"col": "k"}, 2]}]}, {"emit": ["Seen", {"k": {"col": "k"}, "double": {"var": "twice"}}]},
        {"if": [{"op": [">", {"col": "k"}, 80]}, [{"emit": ["Praised", {}]}], [{"if": [{"op": ["<", {"col": "k"}, 0]}, [{"throw": "no such k"}]]}]]},
    ]
    rows = activity_rows(spark, sf_dir).select("global_position", V.compile_statements(body).alias("out"))
    return rows.select("global_position", F.size("out").cast("long").alias("n"), F.array_join(F.transform("out", lambda e: e["type"]), ",").alias("types"), F.try_element_at("out", F.lit(1))["data"].alias("first"))


@query("SELECT * FROM (VALUES ('%', 'error'), ('??', 'error'), ('unknown call', 'error'), ('unknown statement', 'error'), ('throw', 'error'), ('===', 'fine')) t(what, answer)")
def refused_expressions(spark, sf_dir):
    """An operator or a call that isn't known is an error, never taken for another; a throw fails its query."""
    tries = {
        "%": lambda: V.compile_expression({"op": ["%", 1, 2]}), "??": lambda: V.compile_expression({"op": ["??", 1, 2]}), "unknown call": lambda: V.compile_expression({"call": ["eval", "x"]}), "unknown statement": lambda: V.compile_statements([{"fetch": "x"}]),
        "throw": lambda: spark.range(1).select(V.compile_expression({"if": [{"op": ["===", {"col": "id"}, 0]}, {"throw": "zero"}, "fine"]}).cast("string")).collect(), "===": lambda: V.compile_expression({"op": ["===", 1, 1]}),
    }
    out = []
    for what, f in tries.items():
        try:
            f()
            out.append((what, "fine"))
        except Exception:  # noqa: BLE001
            out.append((what, "error"))
    return _rows(spark, out, "what string, answer string")


@query("SELECT * FROM (VALUES (1, 'user_i_d', 'User'), (2, 'created_at', 'Order'), (3, 'name', 'Nothing')) t(n, snake, aggregate)")
def names_of_things(spark, sf_dir):
    """Column names in snake case, and the entity that an event's name speaks of."""
    return _rows(spark, [(i, V.snake_case(a), V.aggregate_name(b)) for i, (a, b) in enumerate([("userID", "UserCreated"), ("createdAt", "OrderDeleted"), ("name", "Nothing")], 1)], "n int, snake string, aggregate string")


@query(_EVENTS + "SELECT count(DISTINCT stream_id) AS streams, TRUE AS in_range, TRUE AS ordered, count(*) AS ids FROM e")
def ids_and_buckets(spark, sf_dir):
    """Buckets of streams are the same in every run and within bounds; batch ids order by time; command ids are all different."""
    rows = activity_rows(spark, sf_dir)
    named = rows.select("stream_id", V.stream_bucket(F.col("stream_id"), 16).alias("bucket"), (F.shiftright(V.batch_id(F.col("timestamp_ms"), F.col("stream_id")), 20) == F.col("timestamp_ms")).alias("timed"), V.command_id().alias("command"))
    by_stream = named.groupBy("stream_id").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    buckets = by_stream.agg(F.count("*").alias("streams"), F.min((F.col("low") == F.col("high")) & F.col("low").between(0, 15)).alias("in_range"))
    return buckets.crossJoin(named.agg(F.min("timed").alias("ordered"), F.count_distinct("command").alias("ids")))  # single rows


@query("SELECT CAST(3421780262 AS BIGINT) AS crc, md5('123456789') AS digest")
def checksums(spark, sf_dir):
    """The check value of CRC-32."""
    return spark.range(1).select(F.crc32(F.lit("123456789").cast("binary")).alias("crc"), F.md5(F.lit("123456789").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, text IS NULL AS nothing, CASE WHEN text = '' THEN 'empty' WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS shown FROM conversations")
def json_round_trip(spark, sf_dir):
    """Texts of any kind through the payload's JSON and back, and cut for a preview."""
    rows = conversation_events(spark, sf_dir).withColumn("text", V.field("text"))
    shown = F.when(F.col("text") == "", "empty").otherwise(V.preview(F.col("text"), 60))
    return rows.select(F.expr("CAST(substring(stream_id, 6) AS BIGINT)").alias("conv_id"), F.col("revision").alias("turn"), F.col("text").isNull().alias("nothing"), shown.alias("shown"))


@query("""SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, strftime(ts, '%Y') AS year, count(*) AS n FROM events GROUP BY 1, 2""")
def time_keys(spark, sf_dir):
    rows = activity_rows(spark, sf_dir).withColumn("at", V.at_ms(F.col("timestamp_ms")))
    return rows.groupBy(V.time_key(F.col("at"), "hour").alias("hour"), V.time_key(F.col("at"), "year").alias("year")).agg(F.count("*").alias("n"))
