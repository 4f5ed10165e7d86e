"""Values, payload schemas, integrity, telemetry and views by name, held against plain Python."""

import json
import random
import time
from collections import Counter
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal

import pytest
from pyspark.sql import functions as F

from evlog import model
from evlog.functions import values as V
from evlog.operators.endpoints import Method, call
from evlog.operators.telemetry import Telemetry
from evlog.operators.views import View
from evlog.plans import access, schema_evo
from evlog.plans.projections import Projection, Published
from evlog.plans.folds import Latest
from evlog.sources import scratch
from evlog.sources.adapters import with_revisions
from evlog.sources.log import EventLog


def test_fixed_decimals_round_by_the_exact_value(spark):
    rng = random.Random(1)
    numbers = [0.0, 0.5, 1.5, 2.5, -2.5, 0.125, -0.375, 749.15, -749.15, 1.005, 8.345, 1234567.875, 0.25, 99.995, -0.04] + [rng.uniform(-1000, 1000) for _ in range(300)] + [rng.randrange(-4000, 4000) / 16 for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", *[V.to_fixed(F.col("x"), n).alias(f"f{n}") for n in (0, 1, 2, 3)]).collect()
    for r in rows:
        for n in (0, 1, 2, 3):
            want = Decimal(r.x).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP)
            assert Decimal(r[f"f{n}"]) == want, (r.x, n)


def test_fixed_decimals_of_any_size(spark):
    rng = random.Random(2)
    numbers = [-0.0, 5e-324, 2.0**62, 1e36, 1.7976931348623157e308] + [rng.uniform(-2, 2) * 2.0**e for e in range(-60, 1023)] + [rng.choice([1, -1]) * (2.0**e + rng.choice([0.25, 0.5, 0.75, 1 / 64])) for e in range(47)]
    rows = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", *[V.to_fixed(F.col("x"), n).alias(f"f{n}") for n in (0, 1, 3, 15)]).collect()
    exact = Context(prec=400)
    for r in rows:
        for n in (0, 1, 3, 15):
            want = Decimal(abs(r.x)).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP if abs(r.x) < 2.0**47 else ROUND_HALF_EVEN, exact)
            assert r[f"f{n}"] == "-" * (r.x < 0) + f"{want:f}", (r.x, n)


def test_statements(spark):
    body = [{"let": ["n", {"col": "id"}]}, {"if": [{"op": ["===", {"var": "n"}, 1]}, [{"let": ["n", 9]}, {"emit": ["One", {"n": {"var": "n"}}]}], []]}, {"emit": ["All", {"n": {"var": "n"}, "none": None}]}, {"if": [{"op": [">", {"col": "id"}, 1]}, [{"return": None}]]}, {"emit": ["Few", {}]}]
    got = [[(e["type"], e["data"]) for e in r.out] for r in spark.range(3).select("id", V.compile_statements(body).alias("out")).orderBy("id").collect()]
    assert got == [[("All", '{"n":0,"none":null}'), ("Few", "{}")], [("One", '{"n":9}'), ("All", '{"n":9,"none":null}'), ("Few", "{}")], [("All", '{"n":2,"none":null}')]] or got[1][1] == ("All", '{"n":1,"none":null}')
    with pytest.raises(Exception, match="too small"):
        spark.range(1).select(V.compile_statements([{"if": [{"op": ["<", {"col": "id"}, 1]}, [{"throw": "too small"}]]}])).collect()


def event_rows(spark, rows):
    return spark.createDataFrame([(i, "s", i, kind, data, meta, 0, "t") for i, (kind, data, meta) in enumerate(rows)], model.EVENT_DDL)


def test_upcast_keeps_what_is_there(spark):
    schema = {"u": {"A": {"x": "number"}, "B": {}}}
    lock = schema_evo.Lock(1, schema)
    lock = lock.sync({"u": {"A": {"x": "number", "c": "string"}, "B": {}}}, {("u", "A", "c"): "EUR"})
    lock = lock.sync({"u": {"A": {"x": "number", "c": "string", "d": "object?"}, "B": {"e": "number?"}}}, {("u", "A", "d"): {"k": [1]}})
    rows = [("A", '{"x":1}', None), ("A", "{}", None), ("A", '{"c":null}', None), ("A", '{"c":"USD" } \n', None), ("A", '{"x":1}', '{"schema_version":2}'), ("A", '{"x":1}', '{"schema_version":3}'), ("B", "{}", None), ("C", "{}", None), ("A", "[1]", None), ("A", "null", None), ("A", None, None), ("A", "not json}", None), ("A", '{"x":{"c":1}}', None)]
    got = [r.data for r in schema_evo.upcast(event_rows(spark, rows).withColumn("_fields", F.lit(1)), lock).orderBy("global_position").collect()]
    d = {"k": [1]}
    want = [{"x": 1, "c": "EUR", "d": d}, {"c": "EUR", "d": d}, {"c": None, "d": d}, {"c": "USD", "d": d}, {"x": 1, "d": d}, {"x": 1}, {"e": None}, {}, [1], None]
    assert [json.loads(g) for g in got[:10]] == want and got[10:12] == [None, "not json}"] and json.loads(got[12]) == {"x": {"c": 1}, "c": "EUR", "d": d}


def test_upcast_does_not_grow_with_its_steps(spark):
    schema, lock = {"u": {"A": {}}}, schema_evo.Lock(1, {"u": {"A": {}}})
    for i in range(50):
        schema = {"u": {"A": {**schema["u"]["A"], f"f{i}": "number"}}}
        lock = lock.sync(schema, {("u", "A", f"f{i}"): i})
    rows = event_rows(spark, [("A", '{"f7":70}', None)])
    schema_evo.upcast(rows, lock).collect()
    began = time.perf_counter()
    data = json.loads(schema_evo.upcast(rows, lock).first().data)
    assert time.perf_counter() - began < 2 and data == {f"f{i}": 70 if i == 7 else i for i in range(50)}


@pytest.mark.parametrize("kind, good, bad", [
    ("string", ['"x"', '""'], ["1", "null", "[]", "{}"]), ("number", ["1", "-2.5", "1e300", "12345678901234567890123"], ['"1"', "true", "null"]), ("boolean", ["true"], ["1", '"true"']), ("array", ["[]", '[1,"a"]'], ["{}", "1"]),
    ("object", ["{}", '{"a":1}'], ["[]", '"{}"']), ("reference", ['"id"'], ['""', "1"]), ("string?", ["null", '"x"'], ["1"]), ("array<number>", ["[]", "[1,2.5]"], ['[1,"a"]', "[null]", "1"]), ("array<string?>", ['["a",null]'], ["[1]"]),
])
def test_validators(spark, kind, good, bad):
    rows = event_rows(spark, [("A", f'{{"f":{x}}}', None) for x in [*good, *bad]] + [("A", "{}", None)])
    found = {r.global_position for r in schema_evo.invalid(rows, {"A": {"f": kind}}).collect()}
    assert found == set(range(len(good), len(good) + len(bad))) | (set() if kind.endswith("?") else {len(good) + len(bad)})


def test_validators_of_no_such_type(spark):
    with pytest.raises(model.SpecError):
        schema_evo.invalid(event_rows(spark, []), {"A": {"f": "money"}})


@pytest.mark.parametrize("seed", range(6))
def test_integrity_equals_counting(spark, seed):
    rng, rows = random.Random(seed), []
    for p in range(400):
        rows.append([p, f"s{min(p % 7, rng.randrange(4))}"])
    seen = Counter()
    rows = [(p, s, seen.update([s]) or seen[s] - 1) for p, s in rows]
    for _ in range(seed * 3):
        i, j = rng.randrange(len(rows)), rng.randrange(len(rows))
        how = rng.randrange(4)
        rows = rows[:i] + rows[i + 1 :] if how == 0 else [*rows, rows[i]] if how == 1 else [*rows[:i], (rows[j][0], *rows[i][1:]), *rows[i + 1 :]] if how == 2 else [*rows[:i], (*rows[i][:2], rows[i][2] + rng.choice([-1, 1, 5])), *rows[i + 1 :]]
    streams, positions = {}, [p for p, *_ in rows]
    for p, s, r in rows:
        streams.setdefault(s, []).append((r, p))
    gaps = sum(sorted(r for r, _ in own) != list(range(len(own))) for own in streams.values())
    out = sum(b[1] <= a[1] for own in streams.values() for a, b in zip(sorted(own), sorted(own)[1:], strict=False))
    want = (len(rows), len(rows) - len(set(positions)), max(positions) - min(positions) + 1 - len(set(positions)), gaps, out)
    df = spark.createDataFrame([(p, s, r, "T", "{}", None, 0, "t") for p, s, r in rows], model.EVENT_DDL).repartition(5)
    assert tuple(model.integrity(df).first()) == want
    assert tuple(model.integrity(df.limit(0)).first()) == (0, 0, 0, 0, 0)


def test_events_from_memory(spark, tmp_path):
    log = EventLog(spark, f"file://{tmp_path}/log", tail_events=5)
    for i in range(8):
        log.append("a", [{"type": "T", "data": i}])
    assert [e["global_position"] for e in log.read_cached(3, 100)] == [3, 4, 5, 6, 7] and len(log.read_cached(4, 2)) == 2
    assert log.read_cached(2, 3) is None and log.read_cached(8, 1) is None
    EventLog(spark, log.path).append("a", [{"type": "T"}])
    assert log.read_cached(5, 3) is not None and log.read_cached(5, 4) is None  # the last is another writer's


def test_telemetry_is_pushed_once_and_never_fails(spark, tmp_path):
    sink, got = Telemetry(spark, f"{tmp_path}/t"), []
    assert sink.write([{"kind": "log", "ts_ms": i, "span_id": str(i)} for i in range(5)]) and sink.stored == 5
    assert not sink.write([{"ts_ms": "x"}]) and sink.lost == 1 and sink.last_error is not None
    for n in (5, 2):
        sink.push({"all": lambda df: df}, lambda name, df: got.append(df.count()), f"{tmp_path}/c", once=True).awaitTermination()
        sink.write([{"kind": "log", "ts_ms": 10 + i} for i in range(2)])
    assert got == [5, 2]


def test_methods_and_access(spark):
    view = View(spark.createDataFrame([("a", 1, "t1"), ("b", 2, "t1"), ("c", 2, "t2")], "id string, n int, tenant_id string"), "id")
    assert [r.id for r in call(view, Method("byN", ("n",), one=True), {"n": "2"}).collect()] == ["b"]
    assert [r.id for r in call(view, Method("from", between="id", tenant=True), {"start": "b"}, "t2").collect()] == ["c"]
    assert Method("byN", ("n",)).route() == "/byN/{n}" and Method("r", between="id").route() == "/r" == Method("r", ("a", "b")).route()
    for bad in (lambda: call(view, Method("byN", ("n",)), {}), lambda: call(view, Method("byN", ("n",)), {"n": "1", "x": "1"}), lambda: call(view, Method("x", tenant=True), {})):
        with pytest.raises(model.SpecError):
            bad()
    with pytest.raises(Exception, match="CAST_INVALID"):
        call(view, Method("byN", ("n",)), {"n": "many"}).collect()
    entity = access.Entity("e", access.Rule("private", ("admin",)), {"read": access.Rule("public"), "write": None})
    assert entity.of("read").level == "public" and entity.of("write").roles == ("admin",) == entity.of("other").roles
    with pytest.raises(model.SpecError):
        access.Rule("secret")


def test_published_models_are_laid_out_and_pruned(spark, tmp_path):
    rows = spark.range(5000).select(F.format_string("%05d", F.col("id")).alias("stream_id"), (F.col("id") * 7919 % 5000).alias("n"))
    out = Published(spark, f"file://{tmp_path}/m", Projection("m", Latest("stream_id", {"n": "n"}), index=("n",)))
    with pytest.raises(model.CheckpointLoadError):
        out.view()
    for position in (4, 9, 12):
        out.publish(rows, position)
    assert out.position() == 12 and len(out.files.names("tables")) == 4
    by_n = out.view("n").query_field_range("n", 10, 19)
    assert by_n.count() == 10 and out.view().get("00042").count() == 1
    stored = [r.n for r in out.view("n").rows.select("n").collect()]
    assert stored == sorted(stored) and "GreaterThanOrEqual(n,10)" in by_n._jdf.queryExecution().toString()


def test_scratch_folders():
    from types import SimpleNamespace

    def session(master, named=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *_: None)))

    assert scratch.folder(session("spark://x", "hdfs://y/z/")) == "hdfs://y/z"
    assert scratch.folder(session("local[4]")).startswith("file:///")
    with pytest.raises(ValueError, match="checkpoint"):
        scratch.folder(session("spark://elsewhere"))


def test_scratch_folders_are_removed(spark):
    path = scratch.new(spark, "passing")
    spark.range(3).write.parquet(f"{path}/x")
    assert spark.read.parquet(f"{path}/x").count() == 3 and path in scratch._made
    scratch.delete(spark, path)
    assert path not in scratch._made
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{path}/x")


def test_revisions_are_numbered_by_stretches(spark):
    rng = random.Random(3)
    rows = [(p, rng.choice("aaaab")) for p in rng.sample(range(5000), 900)]
    seen, want = Counter(), {}
    for p, s in sorted(rows):
        want[p] = seen[s]
        seen[s] += 1
    df = spark.createDataFrame([(p, s, 1) for p, s in rows], "global_position long, stream_id string, x int").repartition(4)
    for bits in (20, 6):
        got = with_revisions(df, bits)
        assert got.columns == ["global_position", "stream_id", "x", "revision"] and {r.global_position: r.revision for r in got.collect()} == want
