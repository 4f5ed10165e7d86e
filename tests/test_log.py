"""The event log: appends, conditions, reads, recovery. The expectations are those of an event store's contract."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from evlog import model
from evlog.sources.kv import KeyValueTable
from evlog.sources.log import Append, EventLog


@pytest.fixture
def log(spark, tmp_path):
    return EventLog.open(spark, f"file://{tmp_path}/log", clock=lambda: 1_700_000_000_000)


def ev(kind="Made", **data):
    return {"type": kind, "data": data}


def test_append_gives_positions_and_revisions(log):
    first = log.append("a", [ev(), ev()])
    assert (first.stream_revision, first.global_position, first.event_count) == (1, 0, 2)
    second = log.append("b", [ev(n=1)], tenant_id="t")
    assert (second.stream_revision, second.global_position) == (0, 2)
    assert log.append("a", [ev()]).stream_revision == 2
    assert log.global_position() == 4 and log.stream_revision("a") == 2 and log.stream_revision("zz") == -1 and log.has_stream("b")
    assert [r.stream_id for r in log.stream_ids().collect()] == ["a", "b"]
    row = log.read_stream("b").first()
    assert json.loads(row.data) == {"n": 1} and row.metadata is None and row.tenant_id == "t" and row.timestamp_ms == 1_700_000_000_000
    assert log.validate().first().asDict() == {"n_events": 4, "duplicate_positions": 0, "position_gaps": 0, "streams_with_gaps": 0, "out_of_order": 0}


def test_conditions(log):
    log.append("a", [ev()], expected_revision=-1)
    log.append("a", [ev()], expected_revision=0)
    with pytest.raises(model.ConcurrencyError) as e:
        log.append("a", [ev()], expected_revision=0)
    assert (e.value.expected, e.value.actual) == (0, 1)
    with pytest.raises(model.ConcurrencyError):
        log.append("a", [ev()], expected_revision=-1)
    with pytest.raises(model.ConcurrencyError):  # -2 is an exact revision like any other, so nothing is at it
        log.append("a", [ev()], expected_revision=-2)
    with pytest.raises(model.EvlogError):
        log.append("a", [])
    assert log.global_position() == 2


def test_a_batch_is_all_or_nothing(log):
    log.append("a", [ev()])
    with pytest.raises(model.ConcurrencyError):
        log.append_batch([Append("b", [ev()]), Append("a", [ev()], expected_revision=7)])
    assert log.global_position() == 1
    done = log.append_batch([Append("a", [ev(), ev()], 0), Append("b", [ev()], -1), Append("a", [ev()], 0)])
    assert done.total_events == 4 and done.global_position == 1
    assert done.streams["a"].stream_revision == 3 and done.streams["a"].event_count == 3  # both parts count
    assert log.append_batch([]).total_events == 0


def test_reads(log):
    log.append("s", [ev(i=i) for i in range(10)])
    log.append("o", [ev()])
    revisions = lambda **k: [r.revision for r in log.read_stream("s", **k).collect()]
    assert revisions() == list(range(10))
    assert revisions(first=3, last=5) == [3, 4, 5]
    assert revisions(limit=2) == [0, 1] and revisions(limit=0) == []
    assert revisions(backward=True, limit=3) == [9, 8, 7]
    assert revisions(first=2, last=6, backward=True, limit=2) == [6, 5]
    assert log.read_stream("none").count() == 0
    assert [r.global_position for r in log.read_global(8, 2).collect()] == [8, 9]
    assert log.read_global(0, 0).count() == 0 and log.read_global(11).count() == 0
    assert [r.global_position for r in log.stream_global(9)] == [9, 10]
    with pytest.raises(model.InvalidPositionError):
        log.read_global(-1)


@pytest.mark.parametrize("stream", ["😀-1", "流-二", "مرحبا", "a b/c", "x" * 300])
def test_any_text_is_a_stream_id(log, stream):
    log.append(stream, [ev(text="é" * 1000)])
    assert log.read_stream(stream).count() == 1
    with pytest.raises(model.InvalidStreamIdError):
        model.check_stream_id(stream)
    assert model.check_stream_id("Order-1:a.b_c") and model.check_tenant_id("t-1")


def test_payloads_of_every_shape(log):
    for data in (None, {}, [], 0, "x", {"a": {"b": [1, None]}}):
        log.append("s", [{"type": "T", "data": data, "metadata": {"correlationId": "c"}}])
    got = [json.loads(r.data) for r in log.read_stream("s").collect()]
    assert got == [None, {}, [], 0, "x", {"a": {"b": [1, None]}}]


def test_events_that_are_held_back(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    log = EventLog(spark, path, auto_flush=3)
    log.append("a", [ev(), ev()])
    assert log.read_global().count() == 2 and log.read_global_durable().count() == 0 and log.stream_revision("a") == 1
    assert (log.global_position(), log.durable_position()) == (2, 0)
    assert EventLog(spark, path).global_position() == 0  # another reader sees committed events only
    log.append("a", [ev()])
    assert log.durable_position() == 3
    log.append("b", [ev()])
    log.close()
    log.close()
    assert EventLog(spark, path).global_position() == 4
    with pytest.raises(model.NotOpenError):
        log.append("a", [ev()])


def test_a_token_commits_once(log):
    first = log.append("a", [ev(), ev()], token="t1")
    assert log.append("a", [ev(), ev()], token="t1") == first and log.global_position() == 2


def test_two_writers(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    logs, failed = [EventLog(spark, path) for _ in range(3)], []

    def write(own, name):
        try:
            for _ in range(3):
                own.append(name, [ev(), ev()])
                own.append("shared", [ev()])
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(x, f"w{i}")) for i, x in enumerate(logs)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    sound = logs[0].validate().first()
    assert sound.n_events == 27 and sum(sound) == 27
    with pytest.raises(model.ConcurrencyError):
        logs[1].append("shared", [ev()], expected_revision=3)


def test_what_no_commit_names_is_not_there(log, tmp_path):
    log.append("a", [ev()])
    (tmp_path / "log" / "data" / "dead").mkdir()
    (tmp_path / "log" / "data" / "dead" / "part-0.parquet").write_bytes(b"torn")
    assert log.read_global().count() == 1
    assert log.vacuum() == ["dead"] and log.read_global().count() == 1


def test_a_failed_commit_poisons_the_writer(log, spark, tmp_path, monkeypatch):
    log.append("a", [ev()])
    monkeypatch.setattr(log.files, "create", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(model.StoreFatalError):
        log.append("a", [ev()])
    assert log.is_failed() and isinstance(log.failed_error(), OSError)
    with pytest.raises(model.StoreFatalError):
        log.read_global()
    assert EventLog(spark, f"file://{tmp_path}/log").global_position() == 1


def test_frames_get_dense_positions(log, spark):
    log.append("s-1", [ev(), ev()])
    frame = spark.range(1000).select(F.concat(F.lit("s-"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("stream_id"), F.lit("T").alias("type"), F.to_json(F.struct("id")).alias("data"), "id").repartition(6)
    assert log.append_frame(frame, ["id"], token="x") == (2, 1000) == log.append_frame(frame, ["id"], token="x")
    rows = log.read_global(2).collect()
    assert [json.loads(r.data)["id"] for r in rows] == list(range(1000)) and [r.global_position for r in rows] == list(range(2, 1002))
    sound = log.validate().first()
    assert sound.n_events == sum(sound) == 1002
    assert log.append_frame(frame.limit(0), ["id"]) == (1002, 0)


def test_compaction_changes_no_answer(log):
    for i in range(4):
        log.append(f"s{i % 2}", [ev(i=i)])
    before = [tuple(r) for r in log.read_global().collect()]
    assert log.compact().replaces == [0, 1, 2, 3] and log.compact() is None
    assert [tuple(r) for r in log.read_global().collect()] == before and len(log.vacuum()) == 4
    log.append("s0", [ev()])
    assert log.global_position() == 5 and log.validate().first().position_gaps == 0


def test_reads_skip_commits_and_push_filters(log):
    for _ in range(3):
        log.append("a", [ev(), ev()])
    assert len(log.committed(4).inputFiles()) == 1
    plan = log.read_stream("a", first=1)._jdf.queryExecution().toString()
    assert "EqualTo(stream_id,a)" in plan and "GreaterThanOrEqual(revision,1)" in plan


def test_key_value_table(spark, tmp_path):
    kv = KeyValueTable(spark, f"file://{tmp_path}/kv")
    for k, v in (("a", 1), ("b", [2]), ("a", {"x": 3})):
        kv.set(k, v)
    kv.delete("b")
    assert kv.get("a") == {"x": 3} and kv.get("b") is None and kv.get("c") is None and kv.size() == 1 and kv.has("a") and not kv.has("b")
    assert kv.garbage_ratio() == pytest.approx(0.75)
    kv.compact()
    assert kv.garbage_ratio() == 0 and [r.key for r in kv.keys().collect()] == ["a"]
    kv.set("b", 5)
    assert kv.get("b") == 5
