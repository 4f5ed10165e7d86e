"""Projections kept by streaming queries: equal to batches, resumed, rebuilt, waited for."""

import pytest

from evlog import model
from evlog.plans.folds import Aggregates, Latest, Machine, Measure, signed_sum
from evlog.plans.projections import Options, Projection, Registry
from evlog.sources.log import EventLog
from evlog.streaming.coordinator import Coordinator, schedule, tail

AMOUNT = "CAST(get_json_object(data, '$.amount') AS DOUBLE)"
REVENUE = Projection("revenue", signed_sum({"Placed": AMOUNT}, {"Refunded": AMOUNT}), ("Placed", "Refunded"))
DIRECTORY = Projection("directory", Latest("stream_id", {"name": "get_json_object(data, '$.name')"}, ("Created", "Updated"), ("Deleted",), where="get_json_object(data, '$.name') IS NOT NULL"))
COUNTS = Projection("counts", Aggregates({"n": Measure("count")}, key="type"), condition="stream_id <> 'u-0'")


@pytest.fixture
def log(spark, tmp_path):
    return EventLog(spark, f"file://{tmp_path}/log")


def ev(kind, **data):
    return {"type": kind, "data": data}


def fill(log, n):
    for i in range(n):
        log.append(f"u-{i % 3}", [ev("Created", name=f"n{i}"), ev("Placed", amount=10.5 + i), ev("Updated"), ev("Refunded", amount=1.25)])
    log.append("u-1", [ev("Deleted")])


def check(log, coordinator):
    for p in coordinator.registry.enabled():
        assert sorted(map(repr, coordinator.model(p.name).collect())) == sorted(map(repr, p.batch(log.committed()).collect())), p.name


def coordinator(log, **options):
    registry = Registry()
    for p in (REVENUE, DIRECTORY, COUNTS):
        registry.register(p, **options)
    return Coordinator(log, registry)


@pytest.mark.parametrize("shared", [True, False])
def test_streams_equal_batches_and_resume(log, shared):
    own = coordinator(log, shared_reader=shared, batch_commits=2)
    assert own.model("directory").count() == 0
    fill(log, 3)
    own.run_once()
    check(log, own)
    fill(log, 2)
    log.compact()
    log.append("u-9", [ev("Created", name="x")])
    again = coordinator(log, shared_reader=shared)  # as after a restart
    again.run_once()
    check(log, again)
    assert again.lag() == 0 and again.view("directory").query(name="x").count() == 1
    again.rebuild("revenue")
    check(log, again)


def test_a_running_coordinator(log):
    own = coordinator(log)
    with pytest.raises(model.NotStartedError):
        own.wait()
    own.start()
    own.start()
    try:
        assert own.running()
        fill(log, 2)
        own.wait(60)
        check(log, own)
        assert {r.name: (r.lag, r.health) for r in own.status().collect()} == dict.fromkeys(("revenue", "directory", "counts"), (0, "healthy"))
        with pytest.raises(model.CatchUpTimeoutError):
            own.wait(0.3, position=10_000)
        with pytest.raises(model.CoordinatorError):
            own.run_once()
    finally:
        own.stop()
    assert not own.running()
    own.stop()


def test_a_failing_fold_stops_and_passes_over_nothing(log):
    registry = Registry()
    registry.register(Projection("bad", Aggregates({"n": Measure("sum", "CAST(get_json_object(data, '$.amount') AS INT)")})))
    own = Coordinator(log, registry)
    log.append("a", [ev("T", amount=1)])
    own.run_once()
    log.append("a", [ev("T", amount="no number")])
    own.start_once()
    with pytest.raises(Exception, match="bad failed"):
        for q in own.queries.values():
            q.awaitTermination()
    assert own.store("bad").position() == 0


def test_backpressure(log):
    own = coordinator(log)
    own.hold_back(most=3, wait=0.2)
    fill(log, 1)  # projections don't run: nobody waits
    own.queries = {"x": None}
    with pytest.raises(model.BackpressureTimeoutError):
        log.append("a", [ev("T")])
    own.queries = {}
    log.append("a", [ev("T")])


def test_tail(log):
    fill(log, 1)
    rows, at = tail(log, -1, 3)
    assert [r.global_position for r in rows.collect()] == [0, 1, 2] and at == 2
    rows, at = tail(log, at)
    assert rows.count() == 2 and tail(log, at)[1] == at == 4


def test_states_are_runs_that_merge_and_readers_keep_theirs(log):
    own = coordinator(log)
    fill(log, 1)
    own.run_once()
    before = own.model("directory")
    rows = sorted(map(repr, before.collect()))
    for _ in range(7):
        log.append("u-2", [ev("Created", name="again"), ev("Placed", amount=1.0)])
        own.run_once()
    assert sorted(map(repr, before.collect())) == rows  # a DataFrame of an earlier state still reads
    check(log, own)
    store = own.store("revenue")
    assert len(store.current()["runs"]) == 1 and len(store.list()) == 8 and [p for _, p, _ in store.list()] == sorted(p for _, p, _ in store.list())
    for _ in range(6):
        log.append("u-2", [ev("Placed", amount=1.0)])
        own.run_once()
    assert len(store.list()) == store.keep and len(store.files.names("runs")) == 14
    check(log, own)


def test_a_general_fold_goes_on_from_the_states_of_its_keys(log):
    registry = Registry()
    machine = Machine("stream_id", lambda state, event: {"n": state["n"] + 1, "last": event["position"]}, {"n": 0, "last": None})
    registry.register(Projection("machine", machine))
    own = Coordinator(log, registry)
    for i in range(10):
        fill(log, 1) if i % 4 == 0 else log.append("u-7", [ev("Placed")])
        own.run_once()
    check(log, own)


def test_two_coordinators_do_not_overwrite_each_other(log):
    one, two = coordinator(log), coordinator(log)
    fill(log, 1)
    one.run_once()
    store, late = one.store("revenue"), two.store("revenue")
    late._newest = lambda seen=late._newest(): seen  # has read the state before the other went on
    log.append("a", [ev("Placed", amount=2.0)])
    one.run_once()
    with pytest.raises(model.CheckpointWriteError):
        late.save(REVENUE.fold.partial(log.committed()), 0, REVENUE.fold)
    assert store.position() == log.durable_position() - 1
    check(log, one)


def test_damaged_states_are_found(log):
    own = coordinator(log)
    fill(log, 1)
    own.run_once()
    store = own.store("revenue")
    name = store.journal.name(0)
    good = store.files.read(name)
    for text, error in (("{", model.CheckpointCorruptionError), (good.replace('"position": ', '"position": 1'), model.CheckpointCorruptionError), (good.replace('"format": 2', '"format": 9'), model.CheckpointVersionError)):
        store.files.replace(name, text)
        with pytest.raises(error):
            store.position()
    store.files.replace(name, good)
    store.files.delete(store.current()["runs"][0][0])
    with pytest.raises(model.CheckpointLoadError):
        own.model("revenue")


def test_schedules():
    assert schedule([Options(), Options(poll_ms=50, batch_commits=7)]) == (7, 50)
    commits, pause = schedule([Options(checkpoint_ms=5000, jitter_ms=1000)])
    assert 4000 <= pause <= 6000 and commits == pause
    assert schedule([Options(checkpoint_ms=10, jitter_ms=1000)])[1] >= 100
