"""Several writers at one log: whoever is second sees what the first has done, at every step."""

import threading

import pytest
from pyspark.sql import functions as F

from evlog import model
from evlog.sources.files import Files
from evlog.sources.kv import KeyValueTable
from evlog.sources.log import Append, EventLog


def ev(kind="T", **data):
    return {"type": kind, "data": data}


@pytest.fixture
def path(tmp_path):
    return f"file://{tmp_path}/log"


def sound(log):
    row = log.validate().first()
    assert row.n_events == sum(row) == log.durable_position()
    return row.n_events


#: Where a commit of another writer comes in between: before a step of this writer.
STEPS = ["_state", "_place", "_write_table", "publish"]


def interrupted(log, step, act):
    """Lets act() happen once, before the log's next `step`."""
    owner = log.journal if step == "publish" else log
    real, done = getattr(owner, step), []

    def between(*args, **options):
        if not done:
            done.append(1)
            act()
        return real(*args, **options)

    setattr(owner, step, between)


@pytest.mark.parametrize("step", STEPS)
def test_a_condition_has_one_winner(spark, path, step):
    one, two = EventLog(spark, path), EventLog(spark, path)
    one.append("y", [ev()])
    interrupted(one, step, lambda: two.append("x", [ev(by="two")], expected_revision=-1))
    with pytest.raises(model.ConcurrencyError):
        one.append("x", [ev(by="one")], expected_revision=-1)
    assert sound(one) == 2 and '"two"' in one.read_stream("x").first().data and not one.is_failed()
    assert one.append("x", [ev()], expected_revision=0).stream_revision == 1


@pytest.mark.parametrize("step", STEPS)
def test_a_token_has_one_winner(spark, path, step):
    one, two = EventLog(spark, path), EventLog(spark, path)
    one.append("y", [ev()])
    interrupted(one, step, lambda: two.append_batch([Append("x", [ev(), ev()]), Append("z", [ev()])], token="t"))
    done = one.append_batch([Append("x", [ev(), ev()]), Append("z", [ev()])], token="t")
    assert done == two.append_batch([Append("x", [ev()])], token="t") and done.global_position == 1 and done.total_events == 3
    assert sound(one) == 4


@pytest.mark.parametrize("step", STEPS)
def test_without_a_condition_both_stay(spark, path, step):
    one, two = EventLog(spark, path), EventLog(spark, path)
    interrupted(one, step, lambda: two.append("x", [ev(), ev()]))
    done = one.append("x", [ev()])
    assert (done.stream_revision, done.global_position) == (2, 2) and sound(one) == 3


@pytest.mark.parametrize("step", ["_state", "publish", "_append_staged"])
@pytest.mark.parametrize("token", [None, "t"])
def test_frames_move_behind_another_writer(spark, path, step, token):
    one, two = EventLog(spark, path), EventLog(spark, path)
    one.append("s-0", [ev()])
    frame = spark.range(100).select(F.concat(F.lit("s-"), F.col("id") % 3).alias("stream_id"), F.lit("T").alias("type"), F.lit("{}").alias("data"), "id")
    interrupted(one, step, lambda: two.append("s-1", [ev(), ev()], token=token))
    if token is None:
        assert one.append_frame(frame, ["id"]) == (3, 100) and sound(one) == 103
        assert one.heads(["s-0", "s-1", "s-2"]) == {"s-0": 34, "s-1": 34, "s-2": 32} == EventLog(spark, path).heads(["s-0", "s-1", "s-2"])
    else:
        assert one.append_frame(frame, ["id"], token=token) == (1, 2) and sound(one) == 3


def test_events_held_back_keep_their_conditions(spark, path):
    one, two = EventLog(spark, path, auto_flush=0), EventLog(spark, path)
    first = one.append("x", [ev()], expected_revision=-1)
    assert (first.stream_revision, first.global_position) == (0, 0)
    assert one.append("x", [ev()], expected_revision=0).stream_revision == 1  # behind its own
    two.append("x", [ev()])
    with pytest.raises(model.ConcurrencyError):
        one.flush()
    assert sound(two) == 1 and one.global_position() == 3
    assert one.discard() == 2 and one.flush() == []
    one.append("x", [ev()])
    two.append("y", [ev()])
    assert [r.streams["x"].global_position for r in one.flush()] == [2] and sound(one) == 3


def test_many_writers_with_conditions(spark, path):
    """Each of 12 revisions is won once, however many try."""
    logs, won, failed = [EventLog(spark, path) for _ in range(4)], [], []

    def write(log):
        try:
            while (at := log.stream_revision("x")) < 11:
                try:
                    won.append(log.append("x", [ev()], expected_revision=at).stream_revision)
                except model.ConcurrencyError:
                    pass
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(x,)) for x in logs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and len(won) == len(set(won)) == sound(logs[0]) and max(won) >= 11


def test_snapshots_and_levels_change_no_answer(spark, path):
    log = EventLog(spark, path, snapshot_every=7, fanout=5)
    frame = spark.range(40).select(F.concat(F.lit("s-"), F.col("id") % 9).alias("stream_id"), F.lit("T").alias("type"), F.lit("{}").alias("data"), "id")
    heads = {}
    for i in range(40):
        if i in (11, 26):
            log.append_frame(frame, ["id"], token=f"frame-{i}")
            for k in range(40):
                heads[f"s-{k % 9}"] = heads.get(f"s-{k % 9}", -1) + 1
        name = f"s-{i % 13}"
        heads[name] = heads.get(name, -1) + 1
        assert log.append(name, [ev(i=i)], expected_revision=heads[name] - 1, token=f"t-{i}").stream_revision == heads[name]
    assert len(log.commits()) < 20 and 1 <= len(log.snapshots.numbers()) <= 2
    for other in (log, EventLog(spark, path, snapshot_every=7, fanout=5)):
        assert sound(other) == 120 and other.heads([*heads, "none"]) == heads | {"none": -1}
        assert {r.stream_id for r in other.stream_ids().collect()} == set(heads)
        assert other.append("s-3", [ev()], token="t-3").global_position == 3  # known by its token, wherever it is now
        assert other.append_frame(frame, ["id"], token="frame-11") == (11, 40)
    log.compact()
    log.vacuum()
    again = EventLog(spark, path)
    assert sound(again) == 120 and again.heads(list(heads)) == heads and again._state().commit_of("t-2") is not None


def test_an_append_costs_the_same_in_a_long_log(spark, path, monkeypatch):
    """After the first lookup an append reads no event and runs no job but for upkeep."""
    log = EventLog(spark, path, snapshot_every=50, fanout=20)
    log.append_frame(spark.range(50).select(F.lit("a").alias("stream_id"), F.lit("T").alias("type"), F.lit("{}").alias("data"), "id"), ["id"])
    log.append("b", [ev()])
    log.append("a", [ev()])
    monkeypatch.setattr(type(spark.read), "parquet", lambda *a, **b: pytest.fail("read a table"))
    reads = []
    real = log.files.read
    monkeypatch.setattr(log.files, "read", lambda name: reads.append(name) or real(name))
    for i in range(200):
        assert log.append(["a", "b", f"new-{i}"][i % 3], [ev(i=i)]).global_position == 52 + i
    assert len([r for r in reads if r.startswith("_log")]) < 230  # its own commits, each once, and those that merge them
    monkeypatch.undo()
    assert sound(log) == 252 and len(log.commits()) < 60 and EventLog(spark, path).heads(["a", "new-2", "none"]) == log.heads(["a", "new-2", "none"])


def test_heads_beyond_memory_are_looked_up(spark, path):
    log = EventLog(spark, path, snapshot_every=5, heads_in_memory=3)
    for i in range(23):
        assert log.append(f"s-{i % 8}", [ev()], expected_revision=i // 8 - 1).stream_revision == i // 8
    again = EventLog(spark, path, heads_in_memory=3)
    assert again.heads([f"s-{i}" for i in range(9)]) == {**{f"s-{i}": 2 if i < 7 else 1 for i in range(8)}, "s-8": -1} and not again._state().whole
    assert sound(again) == 23


@pytest.mark.parametrize("through_hadoop", [False, True])
def test_files_are_published_whole(spark, tmp_path, through_hadoop):
    files = Files(spark, f"file://{tmp_path}/f", through_hadoop)
    assert files.create("a/x.json", "one") and not files.create("a/x.json", "two") and files.read("a/x.json") == "one"
    files.replace("a/x.json", "three")
    files.replace("a/y.json", "é")
    assert files.read("a/x.json") == "three" and files.read("a/y.json") == "é" and files.names("a") == ["x.json", "y.json"]
    files.delete("a")
    assert not files.exists("a/x.json") and files.names("a") == []


def test_object_stores_are_refused(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}/f")
    files.scheme = "s3a"
    with pytest.raises(model.EvlogError, match="rename"):
        files.create("x", "y")


def test_no_update_of_a_key_is_lost(spark, tmp_path):
    tables, failed = [KeyValueTable(spark, f"file://{tmp_path}/kv", fanout=4) for _ in range(3)], []

    def write(kv, n):
        try:
            for i in range(3):
                kv.set(f"{n}-{i}", i)
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(kv, n)) for n, kv in enumerate(tables)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and tables[0].size() == 9 and len(tables[0].folders) < 9
    tables[0].set("0-0", "new")
    tables[1].delete("1-1")
    tables[2].compact()
    fresh = KeyValueTable(spark, f"file://{tmp_path}/kv")
    assert fresh.get("0-0") == "new" and fresh.get("1-1") is None and fresh.size() == 8
    assert fresh.vacuum() and fresh.size() == 8
