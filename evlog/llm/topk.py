"""Exact top-k search by inner product: a KD-tree for each shard, best-first traversal, and the k-th score carried on.

Vectors are dealt to shards of a bounded number of rows by median splits, learned on a bounded sample of the vectors; a part
that holds more than its share, as of equal vectors, is dealt on by turns. Each shard becomes a KD-tree: median splits along
the widest side, with the tightest box around every node. For a query q, no point of a box [lo, hi] scores more than
max(q,0)·hi + min(q,0)·lo, so nodes are taken from a heap by that bound until it falls below the k-th score. Queries travel in
blocks of neighbours. A block first searches the shard whose box promises most; then its queries go, with their k-th scores,
to those shards whose boxes reach these scores, and to no others, and prune there from the start. The boxes are broadcast;
where they would take more than `box_bytes` neighbouring shards share one.

Defined results: vectors that are null or hold null, NaN or infinity take no part, nor do rows without an id; shorter
vectors count as padded with zeros (an empty one scores 0). Rows that repeat an id are candidates of that id, of which the
best score counts, and are never candidates of a query with that id. Ties go to the smaller id. Scores beyond 64 bits are
held at the limit. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, batch

_VECTORS = pa.schema([("id", pa.int64()), ("v", pa.binary())])
_TREE = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("ids", pa.binary()), ("points", pa.binary()), ("dim", pa.int32()), ("thresholds", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_DDL = "shard int, kind int, ids binary, points binary, dim int, thresholds binary"


def quantised(scale: float):
    """Rows (id, v): v holds floor(scale * x) of each component x as float64, in bytes."""

    def run(batches):
        for rows in batches:
            ids, vectors, keep, out = rows.column(0).to_pylist(), rows.column(1), [], []
            for i, key in enumerate(ids):
                if key is None or not vectors[i].is_valid or vectors[i].values.null_count:
                    continue
                x = np.floor(np.asarray(vectors[i].values.to_numpy(zero_copy_only=False), np.float64) * scale)
                if np.isfinite(x).all():
                    keep.append(key)
                    out.append(x.tobytes())
            yield batch(_VECTORS, keep, out)

    return run


class Tree:
    """A KD-tree over points: nodes in arrays, leaves as ranges of the reordered points."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int):
        order, lo, hi, self.children, self.ranges = np.arange(len(ids)), [], [], [], []
        todo = [(0, len(ids), None)]
        while todo:
            a, b, parent = todo.pop()
            own = points[order[a:b]]
            lo.append(own.min(0))
            hi.append(own.max(0))
            node = len(self.ranges)
            self.ranges.append((a, b))
            self.children.append([])
            if parent is not None:
                self.children[parent].append(node)
            if b - a > leaf and points.shape[1]:
                axis = int(np.argmax(hi[-1] - lo[-1]))
                if hi[-1][axis] > lo[-1][axis]:
                    middle = (b - a) // 2
                    order[a:b] = order[a:b][np.argpartition(own[:, axis], middle)]
                    todo += [(a, a + middle, node), (a + middle, b, node)]
        self.ids, self.points, self.lo, self.hi = ids[order], points[order], np.array(lo), np.array(hi)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray):
        """For each query its k best (score, id) among the points that score `least` or more."""
        bounds = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        for q, (own, vector) in enumerate(zip(query_ids, queries, strict=True)):
            bound, heap, best, scores, ids = bounds[q], [(-bounds[q][0], 0)], least[q], np.empty(0), np.empty(0, np.int64)
            while heap and -heap[0][0] >= best:
                _, node = heapq.heappop(heap)
                if self.children[node]:
                    for child in self.children[node]:
                        if bound[child] >= best:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                a, b = self.ranges[node]
                found = self.points[a:b] @ vector
                good = (found >= best) & (self.ids[a:b] != own)
                if good.any():
                    scores, ids = best_of(np.concatenate((scores, found[good])), np.concatenate((ids, self.ids[a:b][good])), k)
                    if len(ids) == k:
                        best = max(best, scores[-1])
            yield scores, ids


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of different ids, by score and then the smaller id."""
    order = np.lexsort((ids, -scores))
    scores, ids = scores[order], ids[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return scores[first], ids[first]


def _exact(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray):
    """For components so large that float64 would round: whole numbers of any size, without a tree."""
    whole = [[int(x) for x in p] for p in points]
    for q, own in enumerate(query_ids):
        vector = [int(x) for x in queries[q]]
        found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(p, vector, strict=True)))), int(i)) for p, i in zip(whole, ids, strict=True) if i != own]
        unlike = dict(sorted(((i, s) for s, i in found), key=lambda x: -x[1]))
        top = sorted((s, i) for i, s in unlike.items())[:k]
        top = [x for x in top if -x[0] >= least[q]]
        yield [-s for s, _ in top], [i for _, i in top]


def _padded(vectors: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        row = np.frombuffer(v, np.float64)
        out[i, : len(row)] = row
    return out


class Splits:
    """Median splits of a sample into `parts`, as a tree in arrays: a node's axis (-1: a leaf), value and children."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.axis, self.value, self.child, self.leaf, self.leaves = [], [], [], [], 0
        todo = [(np.arange(len(sample)), parts, None)]
        while todo:  # depth first, so that neighbouring leaves have neighbouring numbers
            rows, parts, parent = todo.pop()
            node = len(self.axis)
            if parent is not None:
                self.child[parent[0]][parent[1]] = node
            own = sample[rows]
            axis = int(np.argmax(own.max(0) - own.min(0))) if parts > 1 and len(rows) > 1 and sample.shape[1] else -1
            value = np.sort(own[:, axis])[max(1, len(rows) * (parts // 2) // parts)] if axis >= 0 else 0.0
            above = own[:, axis] >= value if axis >= 0 else np.zeros(0, bool)
            if axis >= 0 and (above.all() or not above.any()):
                axis = -1
            self.axis.append(axis)
            self.value.append(value)
            self.child.append([-1, -1])
            self.leaf.append(-1 if axis >= 0 else self.leaves)
            if axis < 0:
                self.leaves += 1
            else:
                todo += [(rows[above], parts - parts // 2, (node, 1)), (rows[~above], parts // 2, (node, 0))]
        self.axis, self.value, self.child, self.leaf = np.array(self.axis), np.array(self.value), np.array(self.child), np.array(self.leaf)

    def place(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        while len(inner := np.flatnonzero(self.axis[node] >= 0)):
            at = node[inner]
            node[inner] = self.child[at, (points[inner, self.axis[at]] >= self.value[at]).astype(np.int64)]
        return self.leaf[node]


def _placed(splits, dim: int):
    def run(batches):
        for rows in batches:
            leaf = splits.value.place(_padded(rows.column("v").to_pylist(), dim))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(leaf, pa.int32())], [*rows.schema.names, "leaf"])

    return run


def _gathered(dim: int):
    """The vectors of a shard as one row."""

    def run(key, table):
        points, ids = _padded(table.column("v").to_pylist(), dim), np.asarray(table.column("id"), np.int64)
        none = np.empty(0).tobytes()
        return pa.Table.from_batches([batch(_TREE, [key[0].as_py()], [0], [ids.tobytes()], [points.tobytes()], [dim], [none])])

    return run


def _blocked(dim: int, block_rows: int):
    """Queries, which come sorted, in blocks."""

    def run(batches):
        ids, vectors = [], []

        def block():
            return batch(_TREE, [0], [1], [np.array(ids, np.int64).tobytes()], [_padded(vectors, dim).tobytes()], [dim], [np.full(len(ids), -np.inf).tobytes()])

        for rows in batches:
            for key, v in zip(rows.column("id").to_pylist(), rows.column("v").to_pylist(), strict=True):
                ids.append(key)
                vectors.append(v)
                if len(ids) == block_rows:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()

    return run


class Boxes:
    """The box around every shard, or around each `span` neighbouring ones."""

    def __init__(self, shards: int, dim: int, box_bytes: int):
        self.shards, self.span = shards, max(1, -(-shards * dim * 16 // box_bytes))
        n = -(-shards // self.span)
        self.lo, self.hi = np.full((n, dim), np.inf), np.full((n, dim), -np.inf)

    def add(self, shard: int, lo: np.ndarray, hi: np.ndarray) -> None:
        at = shard // self.span
        self.lo[at], self.hi[at] = np.minimum(self.lo[at], lo), np.maximum(self.hi[at], hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and box what no vector in it exceeds; infinite where float64 would round."""
        there = np.isfinite(self.lo).all(1)
        lo, hi = np.where(there[:, None], self.lo, 0), np.where(there[:, None], self.hi, 0)
        out = np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T
        most = np.abs(queries).max(initial=0) * max(np.abs(lo).max(initial=0), np.abs(hi).max(initial=0)) * max(1, queries.shape[1])
        return np.where(there, out if most < 2**53 else np.inf, -np.inf)


def _edges(batches):
    """(shard, lo, hi) of each shard."""
    for rows in batches:
        out = []
        for row in rows.to_pylist():
            points = np.frombuffer(row["points"], np.float64).reshape(-1, row["dim"])
            out.append((row["shard"], points.min(0).tobytes(), points.max(0).tobytes()))
        yield batch(pa.schema([("shard", pa.int32()), ("lo", pa.binary()), ("hi", pa.binary())]), *zip(*out, strict=True)) if out else pa.RecordBatch.from_pylist([], pa.schema([("shard", pa.int32()), ("lo", pa.binary()), ("hi", pa.binary())]))


def _queries_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], np.int64)
    return ids, np.frombuffer(row["points"], np.float64).reshape(len(ids), row["dim"]), np.frombuffer(row["thresholds"], np.float64)


def _pilot(boxes):
    """Each block with the shard that promises most to its queries together."""

    def run(batches):
        for rows in batches:
            for row in rows.to_pylist():
                own = boxes.value
                promise = np.where(np.isfinite(bounds := own.bounds(_queries_of(row)[1])), bounds, np.sign(bounds)).sum(0)
                yield pa.RecordBatch.from_pylist([row | {"shard": int(np.argmax(promise)) * own.span}], schema=_TREE)

    return run


def _routed(boxes):
    """The queries of each block that a shard's box can still help, for each shard but the pilot."""

    def run(batches):
        for rows in batches:
            for row in rows.to_pylist():
                own, (ids, points, least) = boxes.value, _queries_of(row)
                wanted = own.bounds(points) >= least[:, None]
                for box in np.flatnonzero(wanted.any(0)).tolist():
                    some = np.flatnonzero(wanted[:, box])
                    sent = row | {"ids": ids[some].tobytes(), "points": points[some].tobytes(), "thresholds": least[some].tobytes()}
                    for shard in range(box * own.span, min((box + 1) * own.span, own.shards)):
                        if shard != row["shard"]:
                            yield pa.RecordBatch.from_pylist([{c: sent[c] for c in _TREE.names} | {"shard": shard}], schema=_TREE)

    return run


def _searched(k: int, leaf: int, carry: bool):
    """In each shard's tree, every block that follows it. carry: return the blocks with their k-th scores besides."""

    def run(batches):
        shard = tree = None
        for rows in batches:
            for row in rows.to_pylist():
                ids, dim = np.frombuffer(row["ids"], np.int64), row["dim"]
                points = np.frombuffer(row["points"], np.float64).reshape(len(ids), dim)
                if row["kind"] == 0:
                    shard, tree = row["shard"], Tree(ids, points, leaf) if len(ids) else None
                    continue
                if row["shard"] != shard or tree is None:
                    continue
                d, least = max(dim, tree.points.shape[1]), np.frombuffer(row["thresholds"], np.float64)
                wide = lambda x: np.pad(x, ((0, 0), (0, d - x.shape[1])))  # noqa: E731, B023
                if tree.points.shape[1] < d:
                    tree.points, tree.lo, tree.hi = wide(tree.points), wide(tree.lo), wide(tree.hi)
                queries = wide(points)
                most = np.abs(queries).max(initial=0) * np.abs(tree.points).max(initial=0) * max(d, 1)
                found = tree.search(ids, queries, k, least) if most < 2**53 else _exact(tree.ids, tree.points, ids, queries, k, least)
                out, kth = [], np.array(least)
                for i, (scores, near) in enumerate(found):
                    out += [(int(ids[i]), int(n), int(s)) for s, n in zip(scores, near, strict=True)]
                    if len(near) == k and most < 2**53:
                        kth[i] = max(kth[i], float(scores[-1]))
                if carry:
                    row["thresholds"] = kth.tobytes()
                yield out, row

    def found_only(batches):
        for out, _ in run(batches):
            yield batch(_FOUND, *zip(*out, strict=True)) if out else batch(_FOUND, [], [], [])

    def carried(batches):
        schema = pa.schema([*_TREE, ("found", pa.list_(pa.struct(_FOUND)))])
        for out, row in run(batches):
            yield pa.RecordBatch.from_pylist([row | {"found": [dict(zip(_FOUND.names, x, strict=True)) for x in out]}], schema=schema)

    return carried if carry else found_only


def top_k(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", query_every: int = 50, k: int = 5, scale: float = 256.0, shard_rows: int = 16384, block_rows: int = 1024, leaf: int = 128, sample_bytes: int = 32 << 20, box_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best. Queries are the rows whose id is divisible by query_every.
    sample_bytes: how much of the vectors the splits between shards are learned on, by a hash of their ids."""
    spark = vectors.sparkSession
    work = Work(spark, "topk")
    slim = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    points = work.save(slim.mapInArrow(quantised(scale), "id long, v binary"), "points")
    n, dim = points.agg(F.count("*"), F.coalesce(F.max(F.octet_length("v")), F.lit(0)) / 8).first()
    dim, wanted = int(dim), max(1, -(-n // shard_rows))
    share = sample_bytes / max(1, n * (8 * dim + 16))
    drawn = points.where((F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) if share < 1 else F.lit(True)) if wanted > 1 else points.limit(0)
    sample = _padded([bytes(r.v) for r in drawn.select("v").limit(int(2 * share * n) + 1000).toLocalIterator()], dim)
    splits = spark.sparkContext.broadcast(Splits(sample, wanted))
    # a part of over two shards is dealt to several by turns; `turn` differs for rows that are equal in all
    placed = work.save(points.mapInArrow(_placed(splits, dim), "id long, v binary, leaf int").withColumn("turn", F.monotonically_increasing_id()), "placed")
    work.drop("points")
    sizes = dict(tuple(r) for r in placed.groupBy("leaf").count().collect())  # a row a part: n / shard_rows of them
    first, shards = [], 0
    for part in range(splits.value.leaves):
        ways = max(1, -(-sizes.get(part, 0) // (2 * shard_rows)))
        first.append((part, shards, ways))
        shards += ways
    dealt = placed.join(F.broadcast(spark.createDataFrame(first, "leaf int, base int, ways int")), "leaf").withColumn("shard", (F.col("base") + F.pmod("turn", "ways")).cast("int"))
    trees = work.save(dealt.groupBy("shard").applyInArrow(_gathered(dim), _DDL), "shards")
    boxes = Boxes(shards, dim, box_bytes)
    for row in trees.mapInArrow(_edges, "shard int, lo binary, hi binary").toLocalIterator():
        boxes.add(row.shard, np.frombuffer(row.lo), np.frombuffer(row.hi))
    sent = spark.sparkContext.broadcast(boxes)
    is_query = F.col("id") % query_every == 0
    queries = placed.where(is_query).repartitionByRange("leaf", "id").sortWithinPartitions("leaf", "id").mapInArrow(_blocked(dim, block_rows), _DDL)
    meet = lambda q: trees.unionByName(q).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow
    first = work.save(meet(queries.mapInArrow(_pilot(sent), _DDL))(_searched(k, leaf, True), _DDL + ", found array<struct<query_id long, vec_id long, score long>>"), "pilot")
    found = first.select(F.inline("found"))
    if shards > 1:
        found = found.unionByName(meet(first.drop("found").mapInArrow(_routed(sent), _DDL))(_searched(k, leaf, False), "query_id long, vec_id long, score long"))
    best = work.save(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "found")  # k rows a shard at most for each query
    for name in ("placed", "shards", "pilot"):
        work.drop(name)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
