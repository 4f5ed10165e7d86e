"""WARC, tool calls, top-k search and the registry."""

import base64
import gzip
import hashlib
import json
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from evlog.llm import toolcalls, topk, warc
from evlog.llm.queries import oracle_sql, queries


def tree(path):
    return {p.name: p.read_bytes() for p in Path(path).iterdir() if p.is_file() and not p.name.startswith(".")}


# -- WARC

PAGES = "page_id long, url string, html string, kind int, shard long"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(1)
    rows = [(i * 7, f"http://x/{i}", f"<p>{rng.random()}</p>" * rng.randrange(1, 60), 1, 2) for i in range(200)]
    rows += [(5000 + i, "http://y/\r\nInjected: 1", "same", 1, 2) for i in range(70)] + [(9000, None, None, None, None), (9001, "u", "", 1, 1), (9002, "u", "é" * 5000, 1, 1)]
    return [*rows, rows[3], (None, "u", "same", 1, 1), (None, "u", "alone", 1, 1), (rows[4][0], "u", "another text under an id", 1, 1)]


def expected(pages, min_bytes=0):
    payload = lambda r: (r[2] or "").encode()
    keeper = {}
    for r in pages:
        if r[0] is not None:
            keeper[payload(r)] = max(r[0], keeper.get(payload(r), r[0]))
    out, done = Counter(), set()
    for r in pages:
        body = payload(r)
        again = (r[0], body) in done and r[0] is not None
        done.add((r[0], body))
        k = keeper.get(body)
        revisit = len(body) >= min_bytes and k is not None and (r[0] != k or again)
        out[r[0], len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", k if revisit else None] += 1
    return out


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_warc_round_trip(spark, pages, tmp_path, min_bytes):
    warc.write(spark.createDataFrame(pages, PAGES).repartition(5), str(tmp_path), shard_bytes=20_000, file_bytes=2_000, min_bytes=min_bytes)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected(pages, min_bytes)
    whole = {(r[0], (r[2] or "").encode()) for r in pages}
    assert all((r.key, bytes(r.payload)) in whole for r in rows if r.record_type == "response") and all(r.payload is None for r in rows if r.record_type == "revisit")
    assert {r.url for r in rows if r.key == 5001} == {"http://y/%0D%0AInjected: 1"}


def test_warc_files_do_not_depend_on_partitions(spark, pages, tmp_path):
    for name, parts in (("a", 1), ("b", 7)):
        warc.write(spark.createDataFrame(pages, PAGES).orderBy(F.xxhash64("page_id", F.lit(parts))).repartition(parts), str(tmp_path / name), shard_bytes=20_000, file_bytes=2_000)
    a, b = tree(tmp_path / "a"), tree(tmp_path / "b")
    assert a == b and len(a) > 5 and not (tmp_path / "a" / "_temporary").exists()
    listed = [json.loads(x) for x in a["manifest.json"].decode().splitlines()]
    assert {x["name"] for x in listed} == a.keys() - {"manifest.json"} and all(hashlib.sha256(a[x["name"]]).hexdigest() == x["sha256"] for x in listed)
    assert all(x["bytes"] < 2_000 + 12_000 for x in listed)
    assert gzip.decompress(a[listed[0]["name"]]).startswith(b"WARC/1.1\r\n")


def test_warc_reader_finds_damage(spark, pages, tmp_path):
    warc.write(spark.createDataFrame(pages[:20], PAGES), str(tmp_path))
    file = next(p for p in tmp_path.iterdir() if p.name.endswith(".gz"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"<p>", b"<q>", 1)))
    with pytest.raises(Exception, match="digest|payload|manifest"):
        warc.read(spark, str(tmp_path)).count()


def test_warc_of_nothing(spark, tmp_path):
    warc.write(spark.createDataFrame([], PAGES), str(tmp_path))
    assert warc.read(spark, str(tmp_path)).count() == 0


def test_shard_bounds_with_crowded_keys(spark):
    slim = spark.createDataFrame([(k, f"{k:040x}", 1000) for k in [*range(1000), 10**15, -(10**15)]], "key long, digest string, bytes long")
    bounds = warc._bounds(slim, 50_000)
    counts = np.bincount(bounds.shard(np.arange(1000), np.zeros(1000, np.int64)))
    assert counts.max() * 1512 <= 50_000


def test_a_key_with_more_than_a_shard_is_cut_by_digest(spark, tmp_path):
    """A third of the records have no key, a third share one."""
    sha = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(None, sha(i), 1000) for i in range(400)] + [(7, sha(-i), 1000) for i in range(400)] + [(i, sha(i), 1000) for i in range(8, 408)]
    bounds = warc._bounds(spark.createDataFrame(rows, "key long, digest string, bytes long"), 50_000)
    shards = bounds.shard(np.array([warc._FIRST if k is None else k for k, *_ in rows]), np.array([int(d[:15], 16) for _, d, _ in rows]))
    order = np.lexsort(([d for _, d, _ in rows], [warc._FIRST if k is None else k for k, *_ in rows]))
    assert (np.diff(shards[order]) >= 0).all() and np.bincount(shards).max() * 1512 <= 50_000 and len(bounds) < 60
    pages = [(k, "u", f"{d} {i % 3}", 1, 1) for i, (k, d, _) in enumerate(rows)] + [(7, "u", "the same", 1, 1)] * 9
    warc.write(spark.createDataFrame(pages, PAGES), str(tmp_path), shard_bytes=20_000)
    found = warc.read(spark, str(tmp_path)).collect()
    assert Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected(pages)


@pytest.mark.parametrize("min_bytes", [0, 10_000])
def test_records_that_repeat_for_more_than_a_shard_are_cut_by_number(spark, tmp_path, min_bytes):
    """A third of the records are one page, under few URLs; as many have no key and one payload, which another page has too."""
    rows = [(7, f"u{i % 3}", "one page " * 9, 1, 1) for i in range(300)] + [(None, "u", "a payload of its own", 1, 1)] * 200 + [(None, f"v{i}", "shared", 1, 1) for i in range(150)] + [(50, "w", "shared", 1, 1)]
    rows += [(i, "x", f"{i}", 1, 1) for i in range(100, 160)] + [(7, "x", f"another {i}", 1, 1) for i in range(90)] + [(9, None, None, 1, 1)] * 120
    for name, parts in (("a", 1), ("b", 6)):
        warc.write(spark.createDataFrame(rows, PAGES).orderBy(F.xxhash64("url", F.lit(parts))).repartition(parts), str(tmp_path / name), shard_bytes=20_000, file_bytes=4_000, min_bytes=min_bytes)
    a, b = tree(tmp_path / "a"), tree(tmp_path / "b")
    assert a == b
    found = warc.read(spark, str(tmp_path / "a")).collect()
    assert Counter((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected(rows, min_bytes)
    listed = [json.loads(x) for x in a["manifest.json"].decode().splitlines()]
    by_shard = Counter()
    for x in listed:
        by_shard[x["name"][:12]] += x["records"]
    assert max(by_shard.values()) * 512 <= 20_000 + 1024 and len(by_shard) > 25
    ids = re.findall(rb"WARC-Record-ID: (\S+)", b"".join(gzip.decompress(v) for k, v in a.items() if k.endswith(".gz")))
    assert len(ids) == len(set(ids)) == len(rows)


# -- tool calls

CALL = '<tool_call>{"id": "%s", "name": "add", "arguments": %s, "after": %s}</tool_call>'
RESULT = '<tool_result>{"id": "%s", "content": %s}</tool_result>'
SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": ["string", "null"], "maxLength": 3, "pattern": "^x"}, "c": {"type": "array", "items": {"enum": [1, 2]}, "maxItems": 2}}}}


def test_tool_calls(spark):
    rows = [
        (1, 0, "assistant", "x" + CALL % ("p", '{"b": "xy", "a": 1.0}', "[]") + CALL % ("q", '{"a": -1, "z": 1}', '["p", "nope"]')),
        (1, 1, "tool", RESULT % ("q", '"né"') + RESULT % ("p", "[1e21, 0.000001, 1E-7, 5e-324, 12.50]") + RESULT % ("p", "2") + RESULT % ("lost", "1")),
        (1, 2, "assistant", CALL % ("r", '{"a": 2, "c": [1, 3, 2]}', '["q"]') + CALL % ("p", '{"a": 9}', "[]") + "<tool_call>{oops</tool_call>"),
        (2, 0, "assistant", CALL % ("p", '{"a": 3}', '["s"]') + CALL % ("s", '{"a": 4}', '["p"]') + CALL % ("t", '{"a": 4, "b": null}', '["s"]')),
        (None, None, "assistant", CALL % ("p", '{"a": 5}', "[]")), (3, 0, "user", None), (4, 0, "user", ""),
    ]
    messages = spark.createDataFrame([(*r, "extra") for r in [*rows, rows[0]]], "conv_id long, turn long, role string, text string, level string")
    found = {(r.conv_id, r.turn, r.place): r for r in toolcalls.link(toolcalls.marked_events(messages), SCHEMAS).collect()}
    status = {k: (r.call_id, r.status, r.level, r.n_results) for k, r in found.items()}
    assert status == {
        (1, 0, 0): ("p", "answered", 0, 2), (1, 0, 1): ("q", "answered", 1, 1), (1, 1, 3): ("lost", "orphan", None, 1), (1, 2, 0): ("r", "unanswered", 2, 0), (1, 2, 1): ("p", "duplicate", None, 0), (1, 2, 2): (None, "malformed", None, 0),
        (2, 0, 0): ("p", "cycle", None, 0), (2, 0, 1): ("s", "cycle", None, 0), (2, 0, 2): ("t", "cycle", None, 0), (None, None, 0): ("p", "unanswered", 0, 0),
    }
    assert found[1, 0, 0].json == '{"arguments":{"a":1,"b":"xy"},"id":"p","name":"add","result":[1e+21,0.000001,1e-7,5e-324,12.5]}' and found[1, 0, 0].valid
    assert found[1, 0, 1].errors == ["after nope: unknown", "$.a: minimum", "$.z: unknown"] and found[1, 2, 0].errors == ["$.c: maxItems", "$.c[1]: not an allowed value"]
    assert found[2, 0, 2].valid


@pytest.mark.parametrize("odd", ['"\\ud800"', '{"\\udfff": 1}', "[" * 200_000 + "]" * 200_000, "[" * 201 + "]" * 201, "1" + "0" * 400, "1" * 5000, "1e999", "NaN", "-Infinity", '{"a":', "\u0000"])
def test_odd_markup_is_malformed(spark, odd):
    rows = [(1, 0, CALL % ("p", odd, "[]")), (1, 1, CALL % ("q", '{"a": 1}', "[]") + RESULT % ("q", odd))]
    found = {(r.turn, r.place): (r.call_id, r.status) for r in toolcalls.link(toolcalls.marked_events(spark.createDataFrame(rows, "conv_id long, turn long, text string")), SCHEMAS).collect()}
    assert found == {(0, 0): (None, "malformed"), (1, 0): ("q", "unanswered"), (1, 1): (None, "malformed")}


def test_odd_ids_are_malformed(spark):
    rows = [(1, 0, '<tool_call>{"id": "\\ud800", "name": "add"}</tool_call><tool_call>{"id": "a", "name": "\\ud800"}</tool_call><tool_call>{"id": "b", "name": "add", "after": ["\\ud800"]}</tool_call><tool_call>[1]</tool_call>'), (-(2**63), -(2**63), "")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumn("role", F.lit("assistant"))
    found = toolcalls.link(toolcalls.marked_events(messages).unionByName(toolcalls.turn_events(messages)), SCHEMAS).groupBy("status").count().collect()
    assert {tuple(r) for r in found} == {("malformed", 4), ("orphan", 2)}


def levels_by_hand(calls):
    """calls: {id: ids it waits for}, ids that are not there don't count."""
    out = {}
    while True:
        new = {k: max([out[d] + 1 for d in deps if d in calls], default=0) for k, deps in calls.items() if k not in out and all(d in out for d in deps if d in calls)}
        if not new:
            return out
        out |= new


@pytest.mark.parametrize("task_edges", [5_000, 3])
def test_levels_within_tasks_and_by_rounds(spark, task_edges):
    rng, rows, want = random.Random(2), [], {}
    for conv in [*range(12), None]:
        names = [f"c{i}" for i in range(rng.randint(1, 9))]
        calls = {n: rng.sample([*names, "gone"], rng.randint(0, min(2, len(names)))) if conv != 4 else names[i - 1 : i] for i, n in enumerate(names)}
        rows += [(conv, i, CALL % (n, '{"a": 1}', json.dumps(deps))) for i, (n, deps) in enumerate(calls.items())]
        want |= {(conv, n): levels_by_hand(calls).get(n) for n in names}
    found = toolcalls.link(toolcalls.marked_events(spark.createDataFrame(rows, "conv_id long, turn long, text string")), SCHEMAS, task_edges)
    assert {(r.conv_id, r.call_id): r.level for r in found.collect()} == want and None in want.values()


def test_tool_calls_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert toolcalls.link(toolcalls.marked_events(none).unionByName(toolcalls.turn_events(none)), {}).count() == 0


def test_plain_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", 'q "1"\n'), (1, 2, "assistant", "a\u2028\\"), (1, 3, "user", ""), (2, 1, "user", "x"), (2, 2, "robot", "y")]
    found = toolcalls.link(toolcalls.turn_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), toolcalls.TURN_SCHEMAS)
    got = {(r.conv_id, r.turn): (r.level, r.status, r.valid, r.json) for r in found.collect()}
    assert got[1, 1] == (1, "answered", True, '{"arguments":{"text":"q \\"1\\"\\n"},"id":"1:1","name":"reply","result":"a\u2028\\\\"}')
    assert got[1, 0][:3] == (0, "unanswered", True) and got[1, 3][:3] == (1, "unanswered", False) and got[2, 1][:3] == (0, "unanswered", False)


@pytest.mark.parametrize("value, text", [(1.5, "1.5"), (100.0, "100"), (1e20, "100000000000000000000"), (1.2e21, "1.2e+21"), (-0.0, "0"), (123456.789, "123456.789"), (2**60, "1152921504606847000"), (-1e-10, "-1e-10"), ({"b": 1, "a": [None, True]}, '{"a":[null,true],"b":1}'), ("\u0001é\x7f", '"\\u0001é\x7f"')])
def test_canonical_json(value, text):
    assert toolcalls.canonical(value) == text


# -- top-k


def top_by_hand(rows, k=5):
    vectors = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in vectors:
        if i % 50 == 0:
            scores = {}
            for j, c in vectors:
                if j != i:
                    s = sum(a * b for a, b in zip(q, c, strict=False))
                    scores[j] = max(s, scores.get(j, s))
            out[i] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return {(i, n + 1, j, s) for i, own in out.items() for n, (j, s) in enumerate(own)}


@pytest.mark.parametrize("shard_rows, leaf", [(1 << 14, 128), (60, 4)])
def test_top_k(spark, shard_rows, leaf):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(400)] + [(i, [1.0] * 8) for i in range(1000, 1300)]
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, []), (2200, [5.0, 5.0]), (None, [9.0] * 8), (2250, [float("inf")] * 8), rows[7], (7, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, score int, rank int").repartition(3)
    found = topk.top_k(df, shard_rows=shard_rows, block_rows=4, leaf=leaf)
    assert {tuple(r) for r in found.collect()} == top_by_hand(rows)


@pytest.mark.parametrize("box_bytes", [1 << 20, 40])
def test_queries_go_where_boxes_reach(spark, monkeypatch, box_bytes):
    """In few dimensions most shards are ruled out by their boxes; with few boxes for many shards, fewer are."""
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for i in range(2000)] + [(i, [0.5, 0.5]) for i in range(5000, 5900)] + [(7000, [0.25, -0.5])] * 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    found = topk.top_k(df, shard_rows=50, block_rows=8, leaf=8, box_bytes=box_bytes)
    assert {tuple(r) for r in found.collect()} == top_by_hand(rows)
    boxes = topk.Boxes(40, 2, box_bytes)
    splits = topk.Splits(np.array([v for _, v in rows[:2000]]), 40)
    place = splits.place(np.array([v for _, v in rows[:2000]]))
    assert splits.leaves == 40 and np.bincount(place).max() < 2 * 50
    for (_, v), leaf in zip(rows[:2000], place.tolist(), strict=True):
        boxes.add(leaf, np.array(v), np.array(v))
    query, scores = np.array([[1.0, 0.2]]), {leaf: max(v[0] + 0.2 * v[1] for (_, v), p in zip(rows, place, strict=False) if p == leaf) for leaf in range(40)}
    bounds = boxes.bounds(query)[0]
    assert all(bounds[leaf // boxes.span] >= s for leaf, s in scores.items())
    if boxes.span == 1:
        assert (bounds >= sorted((v[0] + 0.2 * v[1] for _, v in rows[:2000]), reverse=True)[4]).sum() < 20


def test_top_k_of_huge_numbers_and_nothing(spark):
    rows = [(0, [1e12, 3.0]), (1, [1e12, 1.0]), (2, [1e12, 2.0]), (3, [-1e12, 2.0])]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2)
    assert [(r.query_id, r.vec_id) for r in found.orderBy("rank").collect()] == [(0, 1), (0, 2)]  # both at the limit of 64 bits
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_the_registry():
    names = list(queries())
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert oracle_sql().keys() <= queries().keys()


def test_hot_keys_follow_the_number_of_partitions(spark):
    from evlog.llm import common

    assert common.hot_rows(spark, 100) == 1000 and common.hot_rows(spark, 10**9) == 500_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10000")
    try:
        assert common.hot_rows(spark, 10**9) == 25_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_work_folders_are_removed(spark):
    from evlog.llm import common

    work = common.Work(spark, "passing")
    work.save(spark.range(3), "x")
    path = Path(work.path.removeprefix("file:"))
    assert path.exists()
    work.close()
    assert not path.exists()
