"""Folds against plain loops, in batch and in steps; views, domain objects, rate limits and schemas."""

import json
import random

import pytest
from pyspark.sql import functions as F

from evlog import model
from evlog.functions import values
from evlog.model import EVENT_DDL
from evlog.operators import ratelimit, reads, telemetry
from evlog.operators.views import View
from evlog.plans import domain, schema_evo
from evlog.plans.folds import Aggregates, Fields, Latest, Machine, Measure, Resettable, fuse, signed_sum, time_series
from evlog.plans.projections import Projection, Registry, StateStore, advance, check_pure
from evlog.plans.projections import model as read_model

VALUE = "CAST(get_json_object(data, '$.v') AS DOUBLE)"


@pytest.fixture(scope="module")
def history():
    rng = random.Random(11)
    return [(i, rng.choice("abc"), rng.choice(["Up", "Down", "Reset", "Gone", "Other"]), rng.randint(-500, 500) / 100 if rng.random() < 0.9 else None) for i in range(300)]


@pytest.fixture(scope="module")
def events(spark, history):
    rows = [(p, s, 0, t, json.dumps({"v": v}), None, 1_600_000_000_000 + p * 3_600_000, "default") for p, s, t, v in history]
    return spark.createDataFrame(rows, EVENT_DDL).repartition(5)


FOLDS = {
    "aggregates": Aggregates({"n": Measure("count"), "total": Measure("sum", VALUE, ("Up",)), "low": Measure("min", VALUE), "mean": Measure("avg", VALUE)}, key="stream_id"),
    "whole": signed_sum({"Up": VALUE}, {"Down": VALUE}),
    "latest": Latest("stream_id", {"kind": "type", "v": VALUE}, upsert=("Up", "Down"), delete=("Gone",)),
    "first": Latest("stream_id", {"kind": "type", "at": "global_position"}, first=True),
    "fields": Fields("stream_id", {"up": {"Up": VALUE, "Reset": "CAST(NULL AS DOUBLE)"}, "never": {"Nothing": VALUE}}, {"never": 1.5}),
    "resettable": Resettable("stream_id", {"Up": VALUE, "Down": f"-{VALUE}"}, ("Reset",)),
    "series": time_series(VALUE, "timestamp_millis(timestamp_ms)", types=("Up",)),
}


def by_hand(name, history):
    up = lambda x: 0 if x is None else x
    out = {}
    for p, s, t, v in history:
        if name == "latest":
            if t in ("Up", "Down"):
                out[s] = (t, v)
            elif t == "Gone":
                out.pop(s, None)
        elif name == "first":
            out.setdefault(s, (t, p))
        elif name == "fields":
            out.setdefault(s, (None, 1.5))
            if t in ("Up", "Reset"):
                out[s] = (v if t == "Up" else None, 1.5)
        elif name == "resettable" and t in ("Up", "Down", "Reset"):
            out[s] = (0.0,) if t == "Reset" else (round(out.get(s, (0.0,))[0] + (up(v) if t == "Up" else -up(v)), 2),)
    return out


@pytest.mark.parametrize("name", ["latest", "first", "fields", "resettable"])
def test_batch_folds_equal_a_loop(events, history, name):
    assert {r[0]: tuple(r)[1:] for r in FOLDS[name].batch(events).collect()} == by_hand(name, history)


@pytest.mark.parametrize("name", FOLDS)
def test_folding_in_steps_equals_a_batch(spark, events, tmp_path, name):
    projection, store = Projection(name, FOLDS[name]), StateStore(spark, f"file://{tmp_path}", name)
    for upto in (99, 99, 150, 299):  # a step that comes again changes nothing
        advance(projection, store, events, upto)
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(read_model(projection, store, events.limit(0))) == order(FOLDS[name].batch(events)) and store.position() == 299


def test_the_general_fold_in_steps(spark, events, history, tmp_path):
    def counting(state, event):
        return {"n": state["n"] + 1, "last": event["position"], "sum": round(state["sum"] + (event["data"]["v"] or 0), 2)}

    fold = Machine("stream_id", counting, {"n": 0, "last": -1, "sum": 0})
    projection, store = Projection("m", fold), StateStore(spark, f"file://{tmp_path}", "m")
    for upto in (120, 299):
        advance(projection, store, events, upto)
    want = {}
    for p, s, _, v in history:
        want[s] = counting(want.get(s, {"n": 0, "last": -1, "sum": 0}), {"position": p, "data": {"v": v}})
    assert {r[0]: json.loads(r[1]) for r in read_model(projection, store, events.limit(0)).collect()} == want
    assert {r[0]: json.loads(r[1]) for r in fold.batch(events).collect()} == want


def test_stored_states_are_checked(spark, events, tmp_path):
    projection, store = Projection("p", FOLDS["latest"]), StateStore(spark, f"file://{tmp_path}", "p")
    assert store.load(projection.fold) is None and store.position() == -1
    advance(projection, store, events, 50)
    file = tmp_path / "p" / store.journal.name(0)
    good = json.loads(file.read_text())
    for change, error in (({"position": 9}, model.CheckpointCorruptionError), ({"format": 99}, model.CheckpointVersionError)):
        file.write_text(json.dumps(good | change))
        with pytest.raises(error):
            store.load(projection.fold)
    store.reset()
    assert store.position() == -1


def test_fused_folds_share_a_scan(events):
    folds = {"a": Aggregates({"n": Measure("count", types=("Up",))}, key="stream_id"), "b": Aggregates({"n": Measure("count", types=("Down",))}, key="stream_id")}
    for name, rows in fuse(folds, events).items():
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, folds[name].batch(events).collect()))
    with pytest.raises(model.SpecError):
        fuse(folds | {"c": Aggregates({"n": Measure("count")})}, events)


def test_subscriptions(events, history):
    assert reads.subscribed(events, ["Up"], F.col("stream_id") == "a", after=100).count() == sum(p > 100 and s == "a" and t == "Up" for p, s, t, _ in history)
    assert reads.subscribed(events).count() == 300


def test_projection_specs_and_the_registry():
    registry = Registry()
    registry.register(Projection("a", FOLDS["latest"]), poll_ms=7)
    assert registry.require("a").options.poll_ms == 7 and registry.get("b") is None
    with pytest.raises(model.AlreadyRegisteredError):
        registry.register(Projection("a", FOLDS["latest"]))
    with pytest.raises(model.ProjectionNotFoundError):
        registry.require("b")
    registry.register(Projection("off", FOLDS["latest"]), enabled=False)
    with pytest.raises(model.ProjectionDisabledError):
        registry.require("off")
    with pytest.raises(model.SpecError):
        Projection("x", FOLDS["latest"], subscribed=("Up",))
    with pytest.raises(model.SpecError):
        check_pure("v > rand()")
    for impure in (Aggregates({"n": Measure("sum", "v * random ( )")}), Aggregates({"n": Measure("count")}, key_columns={"d": "date_format(current_timestamp, 'yyyy')"}), Latest("stream_id", {"v": "uuid()"}), Latest("stream_id", {"v": "v"}, where="now() > ts"), Fields("stream_id", {"v": {"Up": "rand()"}}), Resettable("stream_id", {"Up": "randn()"}, ("Down",))):
        with pytest.raises(model.SpecError, match="same at every run"):
            Projection("x", impure)
    check_pure("brand(v) + data.now", "'rand()'", "now_at = `uuid()`", None)


# -- views


@pytest.fixture(scope="module")
def people(spark):
    rows = [("1", "Alice", "active", 100.0, 1000), ("2", "Bob", "active", 200.0, 2000), ("3", "Alice", "inactive", float("nan"), 3000), ("4", "Eve", None, None, 4000)]
    return View(spark.createDataFrame(rows, "id string, name string, status string, amount double, created int"), "id")


def test_view_queries(people):
    n = lambda **k: people.query(**k).count()
    assert n() == 4 and n(status="active") == 2 and n(name="Alice", status="active") == 1 and n(status="deleted") == 0 and n(created=2000) == 1
    assert n(status=None) == 1 and n(amount=float("nan")) == 0 and n(amount=100.0) == 1
    assert people.get("2").first().name == "Bob" and people.find_one(name="Alice").first().id == "1"
    assert {r.name: r.n for r in people.value_counts("name").collect()} == {"Alice": 2, "Bob": 1, "Eve": 1}
    assert people.query_field_range("created", 1500, 3000).count() == 2


def test_key_ranges(spark):
    days = View(spark.createDataFrame([("2024-01-01", 1), ("2024-01-15", 2), ("2024-02-01", None)], "day string, value int"), "day")
    n = lambda *a: days.query_range(*a).count()
    assert (n("2024-01-01", "2024-01-31"), n(None, "2024-01-20"), n("2024-01-15"), n()) == (2, 2, 2, 3)
    assert tuple(days.range_total("2024-01-10", "2024-02-01").first()) == (2, 2)
    assert [r.day for r in days.layout().collect()] == ["2024-01-01", "2024-01-15", "2024-02-01"]


# -- values


def test_value_semantics(spark):
    row = spark.createDataFrame([(1.0, 0.0, -2.5, "x" * 600)], "a double, z double, h double, t string")
    got = row.select(values.divide(F.col("a"), F.col("z")), values.divide(-F.col("a"), F.col("z")), values.divide(F.col("z"), F.col("z")), values.divide(F.col("a"), F.lit(4)), values.round_half_up(F.col("h")), F.length(values.preview(F.col("t")))).first()
    assert got[0] == float("inf") and got[1] == float("-inf") and got[2] != got[2] and got[3:] == (0.25, -2, 500)
    assert values.snake_case("userID") == "user_i_d" and values.snake_case("createdAt") == "created_at" and values.aggregate_name("OrderCreated") == "Order"
    tree = {"if": [{"op": ["&&", {"op": [">", {"field": "n", "kind": "double"}, 1]}, {"not": {"op": ["===", {"field": "s"}, "no"]}}]}, {"call": ["trim", {"field": "s"}]}, "none"]}
    rows = spark.createDataFrame([('{"n": 2, "s": " yes "}',), ('{"n": "x", "s": "yes"}',)], "data string")
    assert [r[0] for r in rows.select(values.compile_expression(tree)).collect()] == ["yes", "none"]
    with pytest.raises(model.SpecError):
        values.compile_expression({"op": ["%", 1, 2]})


# -- domain objects


def make(spark, stream, *events):
    return spark.createDataFrame([(i, stream, i, t, json.dumps(d), None, i, "default") for i, (t, d) in enumerate(events)], EVENT_DDL)


def test_counter_task_and_user(spark):
    counter = make(spark, "c", ("Incremented", {"amount": 5}), ("Reset", {}), ("Incremented", {"amount": 3}), ("Decremented", {"amount": 1}))
    assert domain.COUNTER.batch(counter).first()["count"] == 2
    task = make(spark, "t", ("TaskCreated", {"title": "A", "description": "d"}), ("TaskAssigned", {"assigneeId": "u"}), ("TaskCompleted", {}), ("TaskTitleChanged", {"title": "B"}), ("TaskUnassigned", {}))
    assert domain.TASK.batch(task).first().asDict() == {"stream_id": "t", "title": "B", "description": "d", "completed": True, "assignee_id": None}
    user = make(spark, "u", ("UserCreated", {"name": "N", "email": "e"}), ("UserDeactivated", {}), ("UserEmailChanged", {"email": "f"}))
    assert domain.USER.batch(user).first().asDict() == {"stream_id": "u", "name": "N", "email": "f", "active": False}


def test_states_of_maps_and_sets(spark):
    identity = make(spark, "i", ("UserRegistered", {"userId": "u", "email": "e"}), ("RoleAssigned", {"tenantId": "t", "role": "b"}), ("RoleAssigned", {"tenantId": "t", "role": "a"}), ("RoleAssigned", {"tenantId": "t", "role": "a"}), ("SessionCreated", {"sessionId": "1"}), ("SessionCreated", {"sessionId": "2"}), ("SessionRevokedByReuse", {"sessionId": "1"}), ("SessionCreated", {"sessionId": "3"}), ("AllSessionsRevoked", {}), ("LoginFailed", {}), ("LoginFailed", {}))
    state = json.loads(domain.IDENTITY.batch(identity).first().state)
    assert state["roles"] == {"t": ["a", "b"]} and state["sessions"] == {} and state["revoked"] == ["1", "2", "3"] and state["failed_logins"] == 2 and state["exists"]
    tenant = make(spark, "t", ("TenantCreated", {"name": "T"}), ("TenantSettingsChanged", {"settings": {"a": 1, "b": 2}}), ("TenantSettingsChanged", {"settings": {"b": 3}}), ("MemberInvited", {"email": "m", "role": "r"}), ("MemberInvited", {"email": "n", "role": "r"}), ("MemberJoined", {"email": "m", "userId": "u", "role": "r"}))
    state = json.loads(domain.TENANT.batch(tenant).first().state)
    assert state["settings"] == {"a": 1, "b": 3} and state["invites"] == {"n": "r"} and state["members"] == {"u": "r"}


def test_commands(spark, tmp_path):
    from evlog.sources.log import EventLog

    log = EventLog(spark, f"file://{tmp_path}/log")

    def decide(state, command):
        if state is not None and state["count"] + command["by"] > 10:
            raise ValueError("too much")
        return [{"type": "Incremented", "data": {"amount": command["by"]}}]

    counter = domain.Aggregate("counter", domain.COUNTER, decide)
    domain.handle(log, counter, "c-1", {"by": 4})
    domain.handle(log, counter, "c-1", {"by": 6})
    with pytest.raises(ValueError):
        domain.orchestrate(log, [(counter, "c-2", {"by": 1}), (counter, "c-1", {"by": 1})])
    assert not log.has_stream("c-2") and domain.state_of(log, counter, "c-1") == ({"stream_id": "c-1", "count": 10.0}, 1)
    assert domain.orchestrate(log, [(counter, "c-2", {"by": 1}), (counter, "c-3", {"by": 2})]).total_events == 2
    log.append("lookup-email-x", [{"type": "Taken", "data": {"userId": "u9"}}])
    assert domain.lookup(log, "email", "x") == "u9" and domain.lookup(log, "email", "y") is None


# -- rate limits


def test_rate_limits(spark):
    limit = ratelimit.Limit(attempts=3, window_ms=100, lockout_ms=1000)
    tries = {"a": [(0, False), (10, False), (20, False), (30, False)], "b": [(0, False), (10, False), (200, False)], "c": [(0, False), (5, False), (6, True), (7, False)], "d": [(0, False), (1, False), (2, False), (1100, False), (1101, False), (1102, False)]}
    rows = [(k, ts, i, ok) for k, own in tries.items() for i, (ts, ok) in enumerate(own)]
    got = {r.key: tuple(r)[1:] for r in ratelimit.standings(spark.createDataFrame(rows, "key string, ts_ms long, seq long, success boolean"), limit).collect()}
    assert got["a"] == (4, 0, 30 + 2000, 2, 1)  # the fourth, while locked out, doubles the lockout
    assert got["b"] == (1, 200, 0, 0, 0)  # the window was over
    assert got["c"] == (1, 7, 0, 0, 0)  # success cleared it
    assert got["d"] == (3, 1100, 1102 + 2000, 2, 0)


# -- schemas

OLD = {"Counter": {"Incremented": {"amount": "number"}}}


@pytest.mark.parametrize(
    "new, kind, breaking",
    [
        ({"Counter": {"Incremented": {"amount": "number"}, "Decremented": {}}}, "event_added", False), ({"Counter": {}}, "event_removed", True), ({}, "event_removed", True),
        ({"Counter": {"Incremented": {"amount": "number", "reason": "string?"}}}, "field_added", False), ({"Counter": {"Incremented": {"amount": "number", "userId": "string"}}}, "field_added", True),
        ({"Counter": {"Incremented": {}}}, "field_removed", True), ({"Counter": {"Incremented": {"amount": "string"}}}, "field_type_changed", True), ({"Counter": {"Incremented": {"amount": "number?"}}}, "field_type_changed", False),
        (OLD | {"User": {"Created": {}}}, "event_added", False),
    ],
)
def test_schema_diff(new, kind, breaking):
    assert schema_evo.diff(OLD, OLD) == []
    (change,) = schema_evo.diff(OLD, new)
    assert change.kind == kind and change.breaking == breaking


def test_locks_and_upcasts(spark):
    lock = schema_evo.Lock(1, OLD)
    assert schema_evo.Lock.loads(lock.dumps()) == lock
    with pytest.raises(model.SpecError):
        schema_evo.Lock.loads(lock.dumps().replace("number", "string"))
    with pytest.raises(model.SpecError):
        lock.sync({"Counter": {"Incremented": {"amount": "number", "unit": "string"}}})
    two = lock.sync({"Counter": {"Incremented": {"amount": "number", "unit": "string"}}}, {("Counter", "Incremented", "unit"): "pcs"})
    three = two.sync({"Counter": {"Incremented": {"amount": "number", "unit": "string", "note": "string?"}}})
    assert (two.version, three.version, len(three.steps)) == (2, 3, 2) and three.sync(three.schema) is three
    rows = [('{"amount":1}', None, "Incremented"), ('{"amount":1,"unit":"kg"}', None, "Incremented"), ("{}", None, "Incremented"), ('{"amount":1}', '{"schema_version":2}', "Incremented"), ('{"amount":1}', None, "Other")]
    got = [json.loads(r.data) for r in schema_evo.upcast(spark.createDataFrame(rows, "data string, metadata string, type string"), two).collect()]
    assert got == [{"amount": 1, "unit": "pcs"}, {"amount": 1, "unit": "kg"}, {"unit": "pcs"}, {"amount": 1}, {"amount": 1}]


def test_payload_validation_and_ddl(spark):
    rows = [("Incremented", '{"amount": 1}'), ("Incremented", '{"amount": "x"}'), ("Incremented", "{}"), ("Odd", "{}")]
    bad = schema_evo.invalid(spark.createDataFrame(rows, "type string, data string"), OLD["Counter"])
    assert [r.problems for r in bad.collect()] == [["amount: not number"], ["amount: not number"], ["unknown type"]]
    assert "user_id STRING NOT NULL, full_name STRING NOT NULL, age DOUBLE," in schema_evo.view_ddl("UserView", "userId", {"fullName": "string", "age": "number?"})


# -- telemetry


def test_telemetry(spark):
    rows = [("log", i, "t", f"tr{i % 2}", None, "n", 17 if i % 3 == 0 else 9, "b", None, "svc", None) for i in range(20)]
    records = spark.createDataFrame(rows, telemetry.RECORD_DDL)
    assert [r.ts_ms for r in telemetry.query(records, severity=17, start_ms=3, end_ms=12, limit=2).collect()] == [12, 9]
    assert telemetry.query(records, trace_id="tr1", service="svc").count() == 10 and telemetry.query(records, kind="metric").count() == 0
    assert [r[0] for r in records.select(telemetry.severity_name(F.col("severity"))).distinct().orderBy(F.lit(1)).collect()] == ["error", "info"]
    page, more = reads.page(records, [F.desc("ts_ms")], 5)
    assert page.count() == 5 and more.first().has_more
    lags = telemetry.lags(spark.createDataFrame([("a", 100), ("b", -1), ("c", 20_000)], "name string, position long"), 12_000)
    assert {r.name: (r.lag, r.health) for r in lags.collect()} == {"a": (11_900, "error"), "b": (12_000, "error"), "c": (0, "healthy")}
    assert telemetry.slowest_lag(spark.createDataFrame([(50,), (90,)], "position long"), 100).first().lag == 50
    page, at, seen = telemetry.tail(records.withColumn("span_id", F.concat(F.lit("s"), (F.col("ts_ms") % 2).cast("string"))).withColumn("ts_ms", F.floor(F.col("ts_ms") / 2)), 3, ["s0"], 3)
    assert [(r.ts_ms, r.span_id) for r in page.collect()] == [(3, "s1"), (4, "s0"), (4, "s1")] and (at, seen) == (4, ["s0", "s1"])
    assert {r.health: r.n for r in telemetry.health_counts(spark.createDataFrame([("a", 100), ("c", 20_000)], "name string, position long"), 12_000).collect()} == {"error": 1, "healthy": 1}
