"""The engine's queries over the tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.values import time_key
from .model import integrity
from .operators import ratelimit, reads, telemetry
from .operators.views import View
from .plans import schema_evo
from .plans.folds import Aggregates, Fields, Latest, Machine, Measure, Resettable, fuse, replay, signed_sum, time_series
from .plans.projections import Projection, Registry
from .sources import scratch
from .sources.adapters import activity, activity_rows, conversation_events, table, with_revisions

def _scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder for one run of a query."""
    return scratch.new(spark, name)


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return take


#: The events table with the names of the canonical schema, in SQL.
_EVENTS = """
WITH e AS (
  SELECT event_id AS global_position, 'user-' || user_id AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS revision,
    event_type AS type, user_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, ts, 'tenant-' || (user_id % 4) AS tenant_id
  FROM events
)
"""
_EVENT_VALUES = ["global_position", "stream_id", "revision", "type", "value", "k"]


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_revisions(activity_rows(spark, sf_dir))


@query(_EVENTS + "SELECT global_position, stream_id, type, value, k FROM e WHERE global_position >= 500 ORDER BY global_position LIMIT 100")
def global_read_page(spark, sf_dir):
    return reads.global_scan(activity_rows(spark, sf_dir), 500, 100).select("global_position", "stream_id", "type", "value", "k")


@query(_EVENTS + "SELECT global_position, stream_id, revision, type, value, k FROM e WHERE stream_id = 'user-7' AND revision BETWEEN 5 AND 20")
def stream_read_range(spark, sf_dir):
    own = with_revisions(activity_rows(spark, sf_dir).where("user_id = 7"))
    return reads.stream_scan(own, "user-7", 5, 20).select(*_EVENT_VALUES)


@query(_EVENTS + "SELECT global_position, stream_id, revision, type, value, k FROM e WHERE stream_id = 'user-7' ORDER BY revision DESC LIMIT 10")
def stream_last_n(spark, sf_dir):
    own = with_revisions(activity_rows(spark, sf_dir).where("user_id = 7"))
    return reads.stream_scan(own, "user-7", limit=10, backward=True).select(*_EVENT_VALUES)


@query(_EVENTS + "SELECT stream_id, max(revision) AS head_revision, count(*) AS n_events, max(global_position) AS last_position FROM e GROUP BY stream_id")
def stream_heads(spark, sf_dir):
    # the table has no revisions; they are dense, so a head is a count less one: no window
    counted = reads.stream_heads(activity_rows(spark, sf_dir).withColumn("revision", F.lit(0).cast("long")))
    return counted.withColumn("head_revision", F.col("n_events") - 1)


@query(_EVENTS + "SELECT DISTINCT stream_id FROM e")
def stream_ids(spark, sf_dir):
    return reads.stream_ids(activity_rows(spark, sf_dir))


@query(_EVENTS + "SELECT count(DISTINCT stream_id) AS stream_count, count(*) AS total_entries, max(global_position) AS last_position FROM e")
def log_stats(spark, sf_dir):
    return reads.log_stats(activity_rows(spark, sf_dir))


@query(_EVENTS + """, streams AS (SELECT stream_id, count(*) AS n, min(revision) AS low, max(revision) AS high, count(DISTINCT revision) AS d FROM e GROUP BY stream_id),
ordered AS (SELECT global_position AS p, lag(global_position) OVER (PARTITION BY stream_id ORDER BY revision, global_position) AS b FROM e)
SELECT count(*) AS n_events, count(*) - count(DISTINCT global_position) AS duplicate_positions, max(global_position) - min(global_position) + 1 - count(DISTINCT global_position) AS position_gaps,
  (SELECT count(*) FROM streams WHERE low <> 0 OR high <> n - 1 OR d <> n) AS streams_with_gaps, (SELECT count(*) FROM ordered WHERE b >= p) AS out_of_order FROM e""")
def log_integrity(spark, sf_dir):
    return integrity(_typed(spark, sf_dir))


@query(_EVENTS + "SELECT global_position, stream_id, type FROM e WHERE global_position >= 777 ORDER BY global_position LIMIT 1")
def position_lookup(spark, sf_dir):
    return reads.at_or_after(activity_rows(spark, sf_dir), 777).select("global_position", "stream_id", "type")


@query(_EVENTS + """SELECT global_position, stream_id, type, CASE WHEN length(p) > 30 THEN substr(p, 1, 27) || '...' ELSE p END AS data_preview
  FROM (SELECT *, stream_id || ' ' || type || ' at position ' || global_position AS p FROM e) ORDER BY global_position DESC LIMIT 50""")
def recent_events(spark, sf_dir):
    from .functions.values import preview

    text = F.concat_ws(" ", "stream_id", "type", F.lit("at position"), "global_position")
    return reads.recent(activity_rows(spark, sf_dir), 50).select("global_position", "stream_id", "type", preview(text, 30).alias("data_preview"))


@query("""SELECT CAST(sum(CASE event_type WHEN 'purchase' THEN CAST(value AS DECIMAL(18,2)) WHEN 'error' THEN -CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM events""")
def agg_signed_total(spark, sf_dir):
    return signed_sum({"purchase": "value"}, {"error": "value"}).batch(activity_rows(spark, sf_dir))


@query("SELECT event_type AS type, count(*) AS n FROM events GROUP BY event_type")
def agg_count_by_type(spark, sf_dir):
    return Aggregates({"n": Measure("count")}, key="type").batch(activity_rows(spark, sf_dir))


@query("""SELECT event_type AS type, count(value) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean, min(value) AS low, max(value) AS high FROM events GROUP BY event_type""")
def agg_count_sum_avg(spark, sf_dir):
    measures = {"n": Measure("count", "value"), "total": Measure("sum", "value"), "mean": Measure("avg", "value"), "low": Measure("min", "value"), "high": Measure("max", "value")}
    return Aggregates(measures, key="type").batch(activity_rows(spark, sf_dir))


#: `error` stands for a deletion here: the last event of a user decides.
_LATEST = Latest("stream_id", {"last_type": "type", "value": "value", "k": "k", "last_position": "global_position"}, delete=("error",))
_LATEST_SQL = _EVENTS + ", latest AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY global_position DESC) AS nth FROM e), view AS (SELECT stream_id, type AS last_type, value, k, global_position AS last_position FROM latest WHERE nth = 1 AND type <> 'error')\n"


@query(_LATEST_SQL + "SELECT * FROM view")
def view_latest_by_user(spark, sf_dir):
    return _LATEST.batch(activity_rows(spark, sf_dir))


@query(_EVENTS + """SELECT stream_id, arg_max(value, global_position) FILTER (type = 'purchase') AS last_purchase, arg_max(k, global_position) FILTER (type IN ('click', 'view')) AS last_k,
  max(CASE WHEN type = 'signup' THEN 1 ELSE 0 END) = 1 AS signed_up FROM e GROUP BY stream_id""")
def view_fieldwise_user(spark, sf_dir):
    fold = Fields("stream_id", {"last_purchase": {"purchase": "value"}, "last_k": {"click": "k", "view": "k"}, "signed_up": {"signup": "true"}}, {"signed_up": False})
    return fold.batch(activity_rows(spark, sf_dir))


_COUNTER = Resettable("stream_id", {"purchase": "value", "error": "-value"}, ("signup",))
_COUNTER_SQL = _EVENTS + """, resets AS (SELECT stream_id, max(global_position) AS at FROM e WHERE type = 'signup' GROUP BY stream_id)
SELECT e.stream_id, coalesce(CAST(sum(CASE type WHEN 'purchase' THEN CAST(value AS DECIMAL(18,2)) WHEN 'error' THEN -CAST(value AS DECIMAL(18,2)) END) FILTER (r.at IS NULL OR e.global_position > r.at) AS DOUBLE), 0) AS value
FROM e LEFT JOIN resets r ON e.stream_id = r.stream_id WHERE type IN ('purchase', 'error', 'signup') GROUP BY e.stream_id"""


@query(_COUNTER_SQL)
def counter_with_reset(spark, sf_dir):
    return _COUNTER.batch(activity_rows(spark, sf_dir))


@query(_EVENTS + "SELECT stream_id, arg_min(type, global_position) AS first_type, min(global_position) AS first_position FROM e GROUP BY stream_id")
def first_event_by_user(spark, sf_dir):
    return Latest("stream_id", {"first_type": "type", "first_position": "global_position"}, first=True).batch(activity_rows(spark, sf_dir))


_CENTS_SQL = _EVENTS + """, resets AS (SELECT stream_id, max(global_position) AS at FROM e WHERE type = 'error' GROUP BY stream_id)
SELECT e.stream_id, CAST(coalesce(sum(k) FILTER (r.at IS NULL OR e.global_position > r.at), 0) AS BIGINT) AS total
FROM e LEFT JOIN resets r ON e.stream_id = r.stream_id GROUP BY e.stream_id"""


@query(_CENTS_SQL)
def state_machine_fold(spark, sf_dir):
    """A running total that an error sets back, as an expression over each user's events."""
    zero = F.lit(0).cast("long")
    step = lambda state, e: F.when(e["type"] == "error", F.lit(0).cast("long")).otherwise(state + e["k"])
    return replay(activity_rows(spark, sf_dir), "stream_id", zero, step, "total", ["type", "k"])


def _total_step(state: dict, event: dict) -> dict:
    return {"total": 0 if event["type"] == "error" else state["total"] + event["data"]["k"]}


@query(_CENTS_SQL)
def general_machine_fold(spark, sf_dir):
    """The same by the general fold, which takes any Python step."""
    machine = Machine("stream_id", _total_step, {"total": 0})
    return machine.batch(activity(spark, sf_dir)).select("stream_id", F.get_json_object("state", "$.total").cast("long").alias("total"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS time_key, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1")
def timeseries_daily(spark, sf_dir):
    return time_series("value", "ts").batch(activity_rows(spark, sf_dir))


_DAYS = "(SELECT strftime(ts, '%Y-%m-%d') AS time_key, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1)"


@query(f"SELECT CAST(sum(v) AS DOUBLE) AS total, count(*) AS n_rows FROM {_DAYS} WHERE time_key BETWEEN (SELECT strftime(min(ts) + INTERVAL 5 DAY, '%Y-%m-%d') FROM events) AND (SELECT strftime(min(ts) + INTERVAL 12 DAY, '%Y-%m-%d') FROM events)")
def timeseries_range_total(spark, sf_dir):
    rows = activity_rows(spark, sf_dir)
    low = rows.agg(F.min("ts")).first()[0]
    days = rows.withColumn("time_key", time_key(F.col("ts"))).groupBy("time_key").agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
    from datetime import timedelta

    total = View(days, "time_key").range_total(f"{low + timedelta(days=5):%Y-%m-%d}", f"{low + timedelta(days=12):%Y-%m-%d}")
    return total.select(F.col("total").cast("double").alias("total"), "n_rows")


@query("SELECT 'tenant-' || (user_id % 4) AS tenant_id, strftime(ts, '%Y-%m') AS time_key, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2")
def timeseries_by_tenant(spark, sf_dir):
    return time_series("value", "ts", "month", ("purchase",), tenant=True).batch(activity_rows(spark, sf_dir))


def _orders(spark, sf_dir) -> View:
    orders = table(spark, sf_dir, "orders")
    return View(orders.select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_totalprice").alias("amount")), "o_orderkey")


_ORDERS = "(SELECT o_orderkey, o_custkey, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day, o_totalprice AS amount FROM orders)"


@query(f"SELECT * FROM {_ORDERS} WHERE status = 'F'")
def view_query_eq(spark, sf_dir):
    return _orders(spark, sf_dir).query(status="F")


@query(f"SELECT * FROM {_ORDERS} WHERE status = 'O' AND o_custkey = 7")
def view_query_eq_multi(spark, sf_dir):
    return _orders(spark, sf_dir).query(status="O", o_custkey=7)


@query(f"SELECT * FROM {_ORDERS} WHERE o_orderkey = 33")
def view_point_lookup(spark, sf_dir):
    return _orders(spark, sf_dir).get(33)


@query(f"SELECT * FROM {_ORDERS} WHERE status = 'P' ORDER BY o_orderkey LIMIT 1")
def view_find_one(spark, sf_dir):
    return _orders(spark, sf_dir).find_one(status="P")


@query(f"SELECT * FROM {_ORDERS} WHERE o_orderkey BETWEEN 100 AND 199")
def view_key_range(spark, sf_dir):
    return _orders(spark, sf_dir).query_range(100, 199)


@query(f"SELECT * FROM {_ORDERS} WHERE day BETWEEN '1995-01-01' AND '1995-03-31'")
def view_field_range(spark, sf_dir):
    return _orders(spark, sf_dir).query_field_range("day", "1995-01-01", "1995-03-31")


@query(f"SELECT status, count(*) AS n FROM {_ORDERS} GROUP BY status")
def index_value_counts(spark, sf_dir):
    return _orders(spark, sf_dir).value_counts("status")


@query(_EVENTS + "SELECT global_position, stream_id, type FROM e WHERE type IN ('click', 'purchase')")
def subscription_filter(spark, sf_dir):
    return reads.subscribed(activity_rows(spark, sf_dir), ["click", "purchase"]).select("global_position", "stream_id", "type")


@query(_EVENTS + "SELECT type, count(*) AS n, max(global_position) AS last_position FROM e GROUP BY type")
def wildcard_subscription(spark, sf_dir):
    return reads.subscribed(activity_rows(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"), F.max("global_position").alias("last_position"))


@query(_EVENTS + "SELECT global_position, stream_id, value FROM e WHERE type = 'purchase' AND value > 90 AND global_position > 1000")
def custom_event_filter(spark, sf_dir):
    return reads.subscribed(activity_rows(spark, sf_dir), ["purchase"], F.col("value") > 90, after=1000).select("global_position", "stream_id", "value")


@query(_EVENTS + "SELECT stream_id, count(*) AS n FROM e WHERE tenant_id = 'tenant-2' GROUP BY stream_id")
def tenant_scope(spark, sf_dir):
    return reads.of_tenant(activity_rows(spark, sf_dir), "tenant-2").groupBy("stream_id").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM events) + row_number() OVER (ORDER BY event_id) - 1 AS global_position, 'user-' || user_id AS stream_id, (SELECT count(*) FROM events h WHERE h.user_id = e.user_id) + row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS revision FROM events e WHERE event_type = 'purchase'")
def append_assign_positions(spark, sf_dir):
    """The log written once, and all purchases appended to it again: what positions and revisions they get."""
    from .sources.log import EventLog

    log = EventLog(spark, _scratch_folder(spark, "log"))
    rows = activity_rows(spark, sf_dir).select("global_position", "stream_id", "type", F.to_json(F.struct("value", "k")).alias("data"))
    log.append_frame(rows, ["global_position"])
    base, _ = log.append_frame(rows.where("type = 'purchase'"), ["global_position"])
    return log.committed(base).where(F.col("global_position") >= base).select("global_position", "stream_id", "revision")


@query("""WITH heads AS (SELECT user_id, count(*) - 1 AS head FROM events GROUP BY user_id), wanted AS (SELECT c_custkey AS id, c_custkey % 80 AS expected FROM customer)
SELECT 'user-' || w.id AS stream_id, CAST(w.expected AS BIGINT) AS expected, coalesce(h.head, -1) AS actual, coalesce(h.head, -1) <> w.expected AS conflict FROM wanted w LEFT JOIN heads h ON w.id = h.user_id""")
def append_batch_conflicts(spark, sf_dir):
    """The check of a large batch's conditions: each stream's expected revision against its head."""
    wanted = table(spark, sf_dir, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey")).alias("stream_id"), (F.col("c_custkey") % 80).cast("long").alias("expected"))
    heads = stream_heads(spark, sf_dir).select("stream_id", "head_revision")
    actual = F.coalesce("head_revision", F.lit(-1).cast("long"))
    return wanted.join(heads, "stream_id", "left").select("stream_id", "expected", actual.alias("actual"), (actual != F.col("expected")).alias("conflict"))


@query("""WITH p AS (SELECT event_type AS name, min(event_id) * 37 AS position FROM events GROUP BY event_type), head AS (SELECT max(event_id) AS h FROM events)
SELECT name, position, greatest(0, h - greatest(0, position)) AS lag, CASE WHEN greatest(0, h - greatest(0, position)) > 10000 THEN 'error' WHEN greatest(0, h - greatest(0, position)) > 1000 THEN 'warning' ELSE 'healthy' END AS health FROM p, head""")
def projection_lag_health(spark, sf_dir):
    rows = activity_rows(spark, sf_dir)
    positions = rows.groupBy(F.col("type").alias("name")).agg((F.min("global_position") * 37).alias("position"))
    return telemetry.lags(positions, rows.agg(F.max("global_position")).first()[0])


@query("""WITH p AS (SELECT event_type AS name, min(event_id) * 37 AS position FROM events GROUP BY event_type), l AS (SELECT greatest(0, (SELECT max(event_id) FROM events) - greatest(0, position)) AS lag FROM p)
SELECT CASE WHEN lag > 10000 THEN 'error' WHEN lag > 1000 THEN 'warning' ELSE 'healthy' END AS health, count(*) AS n FROM l GROUP BY 1""")
def health_rollup(spark, sf_dir):
    rows = activity_rows(spark, sf_dir)
    positions = rows.groupBy(F.col("type").alias("name")).agg((F.min("global_position") * 37).alias("position"))
    return telemetry.health_counts(positions, rows.agg(F.max("global_position")).first()[0])


@query("SELECT event_id AS global_position, 'user-' || user_id AS stream_id, value FROM events WHERE event_type = 'purchase' AND value >= 50 AND CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def type_guard(spark, sf_dir):
    """Payloads of the wanted shape only: a number where a number is wanted."""
    from .functions.values import field

    value, k = field("value", "double"), field("k", "long")
    data = F.to_json(F.struct("value", "k"))
    rows = activity_rows(spark, sf_dir).where("type = 'purchase'").withColumn("data", data)
    return rows.where(value.isNotNull() & (value >= 50) & k.isNotNull() & (k >= 50)).select("global_position", "stream_id", value.alias("value"))


@query(_LATEST_SQL + "SELECT stream_id AS key, last_type AS value FROM view")
def kv_latest(spark, sf_dir):
    """A key-value table fed in two versions and compacted: the last type by user, errors as deletions."""
    from .sources.kv import KeyValueTable

    kv = KeyValueTable(spark, _scratch_folder(spark, "kv"))
    rows = activity_rows(spark, sf_dir)
    middle = rows.agg(F.max("global_position")).first()[0] // 2
    for part in (rows.where(F.col("global_position") <= middle), rows.where(F.col("global_position") > middle)):
        last = part.groupBy("stream_id").agg(F.max_by("type", "global_position").alias("value"))
        kv.write(last.select(F.col("stream_id").alias("key"), "value", (F.col("value") == "error").alias("deleted")))
    kv.compact()
    return kv.live()


def _metrics(spark, sf_dir) -> DataFrame:
    """The events as metrics: a row a call, its method by type."""
    method = F.when(F.col("type").isin("view", "click"), "GET").otherwise("POST")
    return activity_rows(spark, sf_dir).select("timestamp_ms", F.col("timestamp_ms").alias("ts_ms"), "value", F.to_json(F.struct(method.alias("method"))).alias("attrs"), "type", "stream_id", "global_position")


@query("""WITH m AS (SELECT epoch_ms(ts) AS ms, CASE WHEN event_type IN ('view', 'click') THEN 'GET' ELSE 'POST' END AS method, value FROM events)
SELECT method, CAST(floor(sum(value) / 36000 + 0.5) AS BIGINT) AS per_second FROM m WHERE ms > (SELECT max(ms) FROM m) - 36000000 GROUP BY method""")
def rate_per_second(spark, sf_dir):
    metrics = _metrics(spark, sf_dir)
    return telemetry.rates(metrics, metrics.agg(F.max("ts_ms")).first()[0], seconds=36000)


@query("SELECT count(value) AS n, min(value) AS min, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events")
def latency_summary(spark, sf_dir):
    rows = activity_rows(spark, sf_dir)
    exact = rows.agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias("avg"))
    return telemetry.latency_summary(rows, "value").drop("avg").crossJoin(exact)  # single rows


@query(_EVENTS + """SELECT global_position AS id, CASE type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'info' ELSE 'debug' END AS severity, k FROM e WHERE type <> 'view' AND global_position < 5000 ORDER BY global_position DESC LIMIT 101""")
def log_page_desc(spark, sf_dir):
    code = F.when(F.col("type") == "error", 17).when(F.col("type") == "purchase", 9).otherwise(5)
    records = activity_rows(spark, sf_dir).select(F.when(F.col("type") != "view", "log").otherwise("span").alias("kind"), F.col("global_position").alias("ts_ms"), code.alias("severity"), "k")
    return telemetry.query(records, kind="log", end_ms=4999, limit=101).select(F.col("ts_ms").alias("id"), telemetry.severity_name(F.col("severity")).alias("severity"), "k")


@query(_EVENTS + "SELECT global_position, CASE WHEN type = 'purchase' THEN 'EUR' END AS currency, k FROM e")
def upcast_defaults(spark, sf_dir):
    """Purchases got a currency in version 2; older ones read as EUR."""
    lock = schema_evo.Lock(1, {"user": {"purchase": {"value": "number"}}}).sync({"user": {"purchase": {"value": "number", "currency": "string"}}}, {("user", "purchase", "currency"): "EUR"})
    old = activity(spark, sf_dir)
    return schema_evo.upcast(old, lock).select("global_position", F.get_json_object("data", "$.currency").alias("currency"), F.get_json_object("data", "$.k").cast("long").alias("k"))


@query("SELECT 'conv-' || conv_id AS stream_id, count(*) AS n_turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def conversation_replay(spark, sf_dir):
    turns = conversation_events(spark, sf_dir).withColumn("text", F.get_json_object("data", "$.text"))
    zero = F.lit(None).cast("string")
    step = lambda state, e: F.concat_ws("\n", state, F.concat(e["type"], F.lit(": "), e["text"]))
    replayed = replay(turns, "stream_id", zero, step, "transcript", ["type", "text"])
    return replayed.join(turns.groupBy("stream_id").agg(F.count("*").alias("n_turns")), "stream_id")


@query("""SELECT count(*) FILTER (event_type = 'purchase') AS purchases, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase') AS DOUBLE) AS revenue, count(*) FILTER (event_type = 'error') AS errors FROM events""")
def fused_projections(spark, sf_dir):
    """Two projections in one scan and one aggregation."""
    folds = {"sales": Aggregates({"purchases": Measure("count", types=("purchase",)), "revenue": Measure("sum", "value", ("purchase",))}), "faults": Aggregates({"errors": Measure("count", types=("error",))})}
    out = fuse(folds, activity_rows(spark, sf_dir))
    return out["sales"].crossJoin(out["faults"])  # single rows


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM lineitem GROUP BY l_returnflag")
def volume_fold(spark, sf_dir):
    return Aggregates({"n": Measure("count"), "quantity": Measure("sum", "l_quantity"), "price": Measure("sum", "l_extendedprice")}, key="l_returnflag").batch(table(spark, sf_dir, "lineitem"))


@query("""WITH RECURSIVE a AS (SELECT 'user-' || user_id AS key, epoch_us(ts) // 1000 AS ts, event_type = 'signup' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type IN ('error', 'signup')),
w AS (
  SELECT key, CAST(0 AS BIGINT) AS nth, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS since, CAST(0 AS BIGINT) AS locked_until, CAST(0 AS BIGINT) AS lockouts, FALSE AS known, CAST(0 AS BIGINT) AS refused FROM (SELECT DISTINCT key FROM a)
  UNION ALL
  SELECT key, nth, CASE WHEN ok THEN 0 ELSE f END, CASE WHEN ok THEN 0 ELSE s END, CASE WHEN ok THEN 0 WHEN f < 3 THEN locked_until ELSE ts + 86400000 * CAST(pow(2, lockouts) AS BIGINT) END, CASE WHEN ok THEN 0 WHEN f < 3 THEN lockouts ELSE lockouts + 1 END, NOT ok, refused
  FROM (SELECT w.key, a.nth, a.ts, a.ok, w.locked_until, w.lockouts, CASE WHEN NOT w.known OR a.ts - w.since > 604800000 THEN 1 ELSE w.failures + 1 END AS f, CASE WHEN NOT w.known OR a.ts - w.since > 604800000 THEN a.ts ELSE w.since END AS s,
    w.refused + CASE WHEN w.locked_until > a.ts THEN 1 ELSE 0 END AS refused FROM w JOIN a ON w.key = a.key AND a.nth = w.nth + 1)
)
SELECT key, failures, since, locked_until, lockouts, refused FROM w WHERE nth = (SELECT max(nth) FROM a WHERE a.key = w.key)""")
def rate_limiter(spark, sf_dir):
    """Errors as failed attempts and signups as successful ones, by user."""
    rows = activity_rows(spark, sf_dir).where("type IN ('error', 'signup')")
    attempts = rows.select(F.col("stream_id").alias("key"), F.col("timestamp_ms").alias("ts_ms"), F.col("global_position").alias("seq"), (F.col("type") == "signup").alias("success"))
    return ratelimit.standings(attempts, ratelimit.Limit(3, 7 * 86_400_000, 86_400_000))


@query(_LATEST_SQL + "SELECT stream_id, last_type, value, last_position FROM view")
def stream_maintained_view(spark, sf_dir):
    """The latest event by user, kept by a streaming query over a log that was written in three commits."""
    from .sources.log import EventLog
    from .streaming.coordinator import Coordinator

    log = EventLog(spark, _scratch_folder(spark, "log"))
    rows = activity_rows(spark, sf_dir).select("global_position", "stream_id", "type", F.to_json(F.struct("value", "k")).alias("data"))
    n = rows.agg(F.max("global_position")).first()[0] + 1
    registry = Registry()
    fold = Latest("stream_id", {"last_type": "type", "value": "CAST(get_json_object(data, '$.value') AS DOUBLE)", "last_position": "global_position"}, delete=("error",))
    registry.register(Projection("latest", fold), batch_commits=1)
    coordinator = Coordinator(log, registry)
    for a, b in ((0, n // 3), (n // 3, n // 2), (n // 2, n)):
        log.append_frame(rows.where((F.col("global_position") >= a) & (F.col("global_position") < b)), ["global_position"])
    coordinator.run_once()
    return coordinator.model("latest")


from . import queries_log  # noqa: E402, F401 - registers its queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest event with the head of its stream."""
    return view_latest_by_user(spark, sf_dir).join(stream_heads(spark, sf_dir), "stream_id")
