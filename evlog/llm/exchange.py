"""Keyed exchange between blocks of documents, without a row for each key.

Documents are put together into blocks, rows of a bucketed table, so that what comes back to a block is joined without
shuffling texts. A block gives out its different 64-bit keys, sorted, cut by the keys' leading bits into buckets; a bucket
gathers the keys that all blocks hold in its range and answers each block with an array, a number for each key, in the
block's order. A key travels once for each block that holds it, however often it stands there, and as a packed difference
of some six bytes, not as a row; keys are hashes, so buckets are even. Buckets go to partitions by their number, as many
partitions as the bytes ask for.

A block sends `fan` rows at most. Where there are more buckets, keys go by two levels: blocks send to `fan` ranges; in each
range the keys of some hundreds of blocks are put together, and such a node sends to the buckets and answers its blocks. So
rows stay some hundreds of keys long, however many blocks and buckets there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, batch

_BLOCK = pa.schema([("doc_ids", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary()))])
_SENT = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
SENT_DDL = "slot int, kind int, bucket int, block long, keys binary, values binary"
_ANSWER = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("answer", pa.binary()), ("facts", pa.list_(pa.int64()))])
ANSWER_DDL = "block long, kind int, bucket int, answer binary, facts array<long>"
_NODE = pa.schema([("kind", pa.int32()), ("range", pa.int32()), ("keys", pa.binary()), ("values", pa.binary()), ("members", pa.list_(pa.int64())), ("places", pa.list_(pa.binary()))])
_NODE_DDL = "kind int, range int, keys binary, values binary, members array<long>, places array<binary>"
#: About what a key takes in a shuffle, and what a partition should.
_KEY_BYTES, _PART_BYTES = 10, 32 << 20


def add(merged: Merged, values: list[np.ndarray]) -> np.ndarray:
    return merged.reduce(np.add, [v.astype(np.int64) for v in values])


def same(merged: Merged, values: list[np.ndarray]) -> np.ndarray:
    """The one value of a key's entries; 0 if they differ or one is 0."""
    low, high = merged.reduce(np.minimum, values), merged.reduce(np.maximum, values)
    return np.where(low == high, low, np.uint64(0))


@dataclass(frozen=True)
class Rule:
    """What becomes of a kind of keys: how each number beside a key is put together over all blocks, the answer made of these
    numbers, and counts over a bucket's keys."""

    how: tuple[Callable, ...]
    reply: Callable
    facts: Callable = lambda *_: []


def pack_planes(numbers: np.ndarray) -> bytes:
    """Whole numbers by byte planes, the planes that are all zero left out: what compression does well on."""
    numbers = np.ascontiguousarray(numbers, "<u8")
    planes = numbers.view(np.uint8).reshape(-1, 8).T
    used = [i for i in range(8) if planes[i].any()]
    return bytes([sum(1 << i for i in used)]) + len(numbers).to_bytes(8, "little") + b"".join(planes[i].tobytes() for i in used)


def unpack_planes(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[1:9], "little")
    out, at = np.zeros((n, 8), np.uint8), 9
    for i in range(8):
        if data[0] >> i & 1:
            out[:, i] = np.frombuffer(data, np.uint8, n, at)
            at += n
    return out.view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack_planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack_planes(data), dtype=np.uint64)


def _blocked(block_bytes: int):
    def run(batches):
        ids, texts, held = [], [], 0
        for rows in batches:
            for key, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist(), strict=True):
                size = len(text or b"") + 16
                if held and held + size > block_bytes:
                    yield batch(_BLOCK, [ids], [texts])
                    ids, texts, held = [], [], 0
                ids.append(key)
                texts.append(text or b"")
                held += size
        if ids:
            yield batch(_BLOCK, [ids], [texts])

    return run


@dataclass(frozen=True)
class Answers:
    """rows: (block, kind, bucket, answer). counts: (kind, facts), a row a bucket."""

    rows: DataFrame
    counts: DataFrame

    def facts(self, kind: int) -> list[int]:
        """The kind's counts over all buckets."""
        added = self.counts.where(F.col("kind") == kind).select(F.posexplode("facts")).groupBy("pos").agg(F.sum("col").alias("n")).collect()  # a row a count
        return [r.n for r in sorted(added)]


class Exchange:
    """The blocks of a table of documents (doc_id, text; a null text is empty), and what is sent between them."""

    def __init__(self, docs: DataFrame, name: str, block_bytes: int = 4 << 20, bucket_keys: int = 1 << 20, fan: int = 4096, node_blocks: int = 512):
        spark = docs.sparkSession
        self.work, self.bucket_keys, self.fan, self.node_blocks, self.tables = Work(spark, name), bucket_keys, fan, node_blocks, []
        slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        blocks = slim.mapInArrow(_blocked(block_bytes), "doc_ids array<long>, texts array<binary>").withColumn("block", F.monotonically_increasing_id())
        self.parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), slim.rdd.getNumPartitions())
        self.blocks = self._table(blocks, name)

    def _table(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows bucketed by block. A task writes a file for each of its blocks at most; with fewer buckets than shuffle partitions
        Spark would shuffle both sides of a join to have more tasks."""
        table = f"{name}_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.parts, "block").option("compression", "zstd").option("path", f"{self.work.path}/{table}").saveAsTable(table)
        self.tables.append(table)
        return self.work.spark.table(table)

    def send(self, send: Callable, rules: dict[int, Rule], keys: int, name: str, source: DataFrame | None = None) -> Answers:
        """What all blocks answer each other.

        send(doc_ids, texts, answers) yields (kind, sorted different uint64 keys, tuple of arrays of whole numbers beside them)
        of a block. keys: about how many there will be, for the number of buckets. source: the blocks, or what meet() has
        made of them."""
        bits = max(1, min(40, -(-max(keys, 1) // self.bucket_keys) - 1).bit_length())
        coarse = max(1, self.fan.bit_length() - 1)
        rows = self.blocks if source is None else source
        if bits <= coarse:
            answers = self._round(rows.mapInArrow(_sent(send, sorted(rules), bits), SENT_DDL), rules, bits, keys, name)
            return Answers(answers, answers.where("facts is not null").select("kind", "facts"))
        groups = -(-self.blocks.count() // self.node_blocks)
        by_range = rows.mapInArrow(_sent(send, sorted(rules), coarse), SENT_DDL).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
        at = ["kind", "bucket", "group"]
        n = max(int(self.work.spark.conf.get("spark.sql.shuffle.partitions")), keys * _KEY_BYTES // _PART_BYTES)
        nodes = self._table(by_range.repartition(n, *at).sortWithinPartitions(*at).mapInArrow(_gathered(rules), _NODE_DDL).withColumn("block", F.monotonically_increasing_id()), f"{name}_nodes")
        fine = self._round(nodes.mapInArrow(_sent_on(sorted(rules), bits), SENT_DDL), rules, bits, keys, f"{name}-fine")
        back = self.work.save(self._joined(nodes, fine).mapInArrow(_returned, ANSWER_DDL), name)
        return Answers(back, fine.where("facts is not null").select("kind", "facts"))

    def _round(self, sent: DataFrame, rules: dict[int, Rule], bits: int, keys: int, name: str) -> DataFrame:
        """Keys to buckets, which are whole in a partition, and answers."""
        slots = len(rules) << min(bits, 24)
        n = min(slots, max(int(self.work.spark.conf.get("spark.sql.shuffle.partitions")), keys * _KEY_BYTES // _PART_BYTES))
        dealt = sent.repartitionById(n, F.expr(f"cast(cast(slot as long) * {n} div {slots} as int)")).sortWithinPartitions("slot", "kind", "bucket")
        return self.work.save(dealt.mapInArrow(_answered(rules), ANSWER_DDL), name)

    @staticmethod
    def _joined(rows: DataFrame, answers: DataFrame) -> DataFrame:
        own = answers.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("kind", "bucket", "answer"))).alias("answers"))
        return rows.join(own.hint("shuffle_hash"), "block", "left")

    def meet(self, *answers: Answers) -> DataFrame:
        """The blocks with all their answers: block, doc_ids, texts, answers (array of kind, bucket, answer)."""
        rows = answers[0].rows
        for more in answers[1:]:
            rows = rows.unionByName(more.rows)
        return self._joined(self.blocks, rows.select("block", "kind", "bucket", "answer"))

    def close(self) -> None:
        """Remove the tables from the catalog and from disk, once no plan reads them."""
        for table in self.tables:
            self.work.spark.sql(f"DROP TABLE IF EXISTS {table}")
            self.work.drop(table)
        self.tables = []

    def __enter__(self) -> Exchange:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def each_block(rows: pa.RecordBatch):
    """(block, doc_ids, texts, answers) of the batch's rows, one at a time."""
    answers = rows.column("answers") if "answers" in rows.schema.names else None
    for i in range(rows.num_rows):
        yield rows.column("block")[i].as_py(), rows.column("doc_ids")[i].as_py(), rows.column("texts")[i].as_py(), None if answers is None else answers[i].as_py()


def _cut(kinds: list[int], kind: int, block: int, keys: np.ndarray, values: tuple, bits: int):
    """A row for each bucket that has some of the sorted keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(keys) else np.empty(0, np.int64)
    base = kinds.index(kind) << min(bits, 24)
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(keys)]):
        at = int(bucket[a])
        slot = base + (at if bits <= 24 else at >> (bits - 24))
        planes = [pack_planes(v[a:b]) for v in values]
        yield batch(_SENT, [slot], [kind], [at], [block], [pack_sorted(keys[a:b])], [b"".join(len(x).to_bytes(8, "little") + x for x in planes)])


def _sent(send: Callable, kinds: list[int], bits: int):
    def run(batches):
        for rows in batches:
            for block, doc_ids, texts, answers in each_block(rows):
                for kind, keys, values in send(doc_ids, texts, answers):
                    yield from _cut(kinds, kind, block, keys, values, bits)

    return run


def _groups(batches, names: list[str]):
    """(the names' values, rows as dicts of lists) of each run of rows that agree in them, whatever batches they come in."""
    at, held = None, []
    for rows in batches:
        columns = [rows.column(c).to_pylist() for c in names]
        for i, own in enumerate(zip(*columns, strict=True)):
            if own != at:
                if held:
                    yield at, held
                at, held = own, []
            held.append({c: rows.column(c)[i].as_py() for c in ("block", "keys", "values")})
    if held:
        yield at, held


def _gathered(rules: dict[int, Rule]):
    """A node for each (kind, range, group): the blocks' keys together, and where each block's are among them."""

    def run(batches):
        for (kind, range_, _), held in _groups(batches, ["kind", "bucket", "group"]):
            keys = [unpack_sorted(h["keys"]) for h in held]
            merged, values = Merged(keys), list(zip(*(_values(h["values"]) for h in held), strict=True))
            own = [how(merged, list(v)) for how, v in zip(rules[kind].how, values, strict=True)]
            planes = [pack_planes(v) for v in own]
            places = [pack_sorted(p.astype(np.uint64)) for p in merged.back(np.arange(len(merged.heads)))]
            yield batch(_NODE, [kind], [range_], [pack_sorted(merged.keys)], [b"".join(len(x).to_bytes(8, "little") + x for x in planes)], [[h["block"] for h in held]], [places])

    return run


def _sent_on(kinds: list[int], bits: int):
    """What nodes send to the buckets."""

    def run(batches):
        for rows in batches:
            for i in range(rows.num_rows):
                kind, block, keys, values = (rows.column(c)[i].as_py() for c in ("kind", "block", "keys", "values"))
                yield from _cut(kinds, kind, block, unpack_sorted(keys), _values(values), bits)

    return run


def _returned(batches):
    """The answers of each node's blocks."""
    for rows in batches:
        for i in range(rows.num_rows):
            kind, range_, members, places, answers = (rows.column(c)[i].as_py() for c in ("kind", "range", "members", "places", "answers"))
            whole = answers_of(answers, kind)
            for block, own in zip(members, places, strict=True):
                yield batch(_ANSWER, [block], [kind], [range_], [pack_planes(whole[unpack_sorted(own).astype(np.int64)])], [None])


def _values(data: bytes) -> tuple[np.ndarray, ...]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(unpack_planes(data[at + 8 : at + 8 + n]))
        at += 8 + n
    return tuple(out)


def _answered(rules: dict[int, Rule]):
    def run(batches):
        for (_, kind, bucket), held in _groups(batches, ["slot", "kind", "bucket"]):
            rule, merged = rules[kind], Merged([unpack_sorted(h["keys"]) for h in held])
            values = zip(*(_values(h["values"]) for h in held), strict=True)
            numbers = [how(merged, list(v)) for how, v in zip(rule.how, values, strict=True)]
            arrays, n = merged.back(rule.reply(*numbers)), len(held)
            yield batch(_ANSWER, [h["block"] for h in held], [kind] * n, [bucket] * n, [pack_planes(a) for a in arrays], [rule.facts(*numbers), *[None] * (n - 1)])

    return run


def answers_of(row_answers: list[dict] | None, kind: int) -> np.ndarray:
    """The numbers that answer a block's keys of a kind, in the order of its sorted keys."""
    own = [unpack_planes(a["answer"]) for a in row_answers or [] if a["kind"] == kind]
    return np.concatenate(own) if own else np.empty(0, np.uint64)


class Merged:
    """The keys of several lists together: for work on all entries of a key at once."""

    def __init__(self, keys: list[np.ndarray]):
        flat = np.concatenate(keys)
        self.order = np.argsort(flat, kind="stable")
        sorted_keys = flat[self.order]
        self.heads = np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))
        self.keys = sorted_keys[self.heads]
        self.sizes = np.diff(np.append(self.heads, len(flat)))
        self.ends = np.cumsum([len(k) for k in keys])[:-1]

    def reduce(self, how: np.ufunc, values: list[np.ndarray]) -> np.ndarray:
        """A number for each different key."""
        return how.reduceat(np.concatenate(values)[self.order], self.heads)

    def back(self, numbers: np.ndarray) -> list[np.ndarray]:
        """The different keys' numbers in the order of each list."""
        out = np.empty(len(self.order), numbers.dtype)
        out[self.order] = np.repeat(numbers, self.sizes)
        return np.split(out, self.ends)
