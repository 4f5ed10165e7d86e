"""SimHash near-dedup with a Gray-order hierarchical index.

A document's fingerprint: A-Z lower-cased, words cut at ASCII white space, shingles of three words (fewer words: all of
them; none: fingerprint zero), XXH64 with seed 42 of each, and each bit by majority.

Fingerprints that differ in `distance` bits or fewer agree on one of distance+1 blocks of bits. So every different
fingerprint goes, once for each block, to the group that has its value there; a group of over group_rows is split again by
blocks of the remaining bits. A group's fingerprints are sorted by the Gray rank of the bits, leading block first, and
become a tree: a node holds the bits that all below it share, less those that its parent holds already. A fingerprint goes
down the tree summing the differences from these patterns, and a node where the sum is beyond the distance is left with all
below it, as is a node that is wholly in the fingerprint's own component already. A group returns a star for each component
(fewer links than rows, never all pairs), and the stars meet in distributed components.

Defined results: a null text has no words; rows without an id get the component's smallest id, or null if it has none; rows
that repeat an id are documents of their own with that id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Work, free, join_hot, slices, utf8
from .components import components

_BITS = 64


def fingerprint(text: bytes, words: int = 3) -> int:
    own = text.translate(LOWER).split()
    if not own:
        return 0
    joined, n = b" ".join(own), max(1, len(own) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], ">u8")
    set_in = np.zeros(_BITS, np.int64)
    for i in range(0, n, 1 << 16):
        set_in += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_in * 2 > n).tobytes(), "big")


def _fingerprints(words: int):
    def run(batches):
        for rows in batches:
            for part in slices(rows, "text", 16 << 20):
                codes = np.array([fingerprint(t, words) for t in utf8(part.column("text"))], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(codes.view(np.int64))], ["doc_id", "mark", "code"])

    return run


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


class GrayIndex:
    """The trees of several groups at once: group (numbers) and codes, of equal length, in any order."""

    def __init__(self, group: np.ndarray, lead: np.ndarray, codes: np.ndarray, fan: int = 8):
        turned = (codes << lead) | (codes >> ((np.uint64(_BITS) - lead) % np.uint64(_BITS)))
        self.order = np.lexsort((gray_rank(np.where(lead == 0, codes, turned)), group))
        group, self.codes = group[self.order], codes[self.order]
        every = np.arange(len(codes))
        self.levels = [{"all": self.codes, "any": self.codes, "first": every, "last": every}]
        while True:
            heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            if len(heads) == len(group):
                break
            within = np.arange(len(group)) - np.repeat(heads, np.diff(np.append(heads, len(group))))
            starts = np.flatnonzero(within % fan == 0)
            below = self.levels[-1]
            self.levels.append({"all": np.bitwise_and.reduceat(below["all"], starts), "any": np.bitwise_or.reduceat(below["any"], starts), "child": starts, "end": np.append(starts[1:], len(group)), "first": below["first"][starts], "last": below["last"][np.append(starts[1:], len(group)) - 1]})
            group = group[starts]
        for level in self.levels:
            level["mask"] = ~(level["all"] ^ level["any"])
        self.labels = np.arange(len(codes))

    def _down(self, depth: int, query: np.ndarray, node: np.ndarray, sums: np.ndarray, distance: int, most: int = 1 << 21):
        """The links (i, j), i < j, of the queries below the nodes."""
        if len(query) > most:
            half = len(query) // 2
            yield from self._down(depth, query[:half], node[:half], sums[:half], distance)
            yield from self._down(depth, query[half:], node[half:], sums[half:], distance)
        elif depth == 0:
            yield query, node
        elif len(query):
            level, below = self.levels[depth], self.levels[depth - 1]
            counts = level["end"][node] - level["child"][node]
            child = np.repeat(level["child"][node] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            of = np.repeat(np.arange(len(query)), counts)
            query, sums, above = query[of], sums[of], level["mask"][node[of]]
            live = np.flatnonzero((below["last"][child] > query) & (self.uniform[depth - 1][child] != self.labels[query]))
            query, sums, child, above = query[live], sums[live], child[live], above[live]
            sums = sums + np.bitwise_count((self.codes[query] ^ below["all"][child]) & below["mask"][child] & ~above)
            live = sums <= distance
            yield from self._down(depth - 1, query[live], child[live], sums[live], distance)

    def _label(self) -> None:
        self.uniform = [self.labels]
        for level in self.levels[1:]:
            below = self.uniform[-1]
            low, high = np.minimum.reduceat(below, level["child"]), np.maximum.reduceat(below, level["child"])
            self.uniform.append(np.where((low == high) & (low >= 0), low, -1))

    def _join(self, i: np.ndarray, j: np.ndarray) -> None:
        labels = self.labels
        while True:
            a, b = labels[i], labels[j]
            if (a == b).all():
                break
            np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
            while (labels != (jumped := labels[labels])).any():
                labels[:] = jumped

    def stars(self, distance: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the smallest code of each one's component, for those that are not it themselves."""
        if len(self.levels) > 1:
            top = len(self.levels) - 1
            root = np.searchsorted(self.levels[top]["last"], np.arange(len(self.codes)))
            self._label()
            for a in range(0, len(self.codes), step):
                query = np.arange(a, min(a + step, len(self.codes)))
                found = list(self._down(top, query, root[query], np.zeros(len(query), np.int64), distance))
                i, j = (np.concatenate([x[k] for x in found] or [np.empty(0, np.int64)]) for k in (0, 1))
                if len(i):
                    self._join(i, j)
                    self._label()
        least = self.codes.view(np.int64).copy()
        np.minimum.at(least, self.labels, self.codes.view(np.int64))
        roots = least[self.labels]
        other = roots != self.codes.view(np.int64)
        return self.codes.view(np.int64)[other], roots[other]


def _linked(distance: int, most: int = 1 << 18):
    """Stars of the groups of a partition, which come sorted by group; whole groups are put together up to `most` rows."""

    def stars(parts):
        group, lead, code = (np.concatenate([p[k] for p in parts]) for k in range(3))
        a, b = GrayIndex(group, lead.astype(np.uint64), code.view(np.uint64)).stars(distance)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches):
        held, size, enough = [], 0, most
        for rows in batches:
            held.append([np.asarray(rows.column(c), np.int64) for c in ("group", "lead", "code")])
            size += rows.num_rows
            if size >= enough:
                flat = [np.concatenate([h[k] for h in held]) for k in range(3)]
                edge = int(np.flatnonzero(flat[0] == flat[0][-1])[0])
                if edge:
                    yield stars([[x[:edge] for x in flat]])
                held = [[x[edge:] for x in flat]]
                size = len(held[0][0])
                enough = max(most, 2 * size)
        if size:
            yield stars(held)

    return run


def _grouped(codes: DataFrame, distance: int, group_rows: int) -> DataFrame:
    """(group, lead, code): each code once for each block, and again by blocks of the other bits in groups that are too large."""
    width = _BITS // (distance + 1)
    block = lambda at, size: F.shiftrightunsigned("code", _BITS - size - at).bitwiseAND((1 << size) - 1)
    places = F.explode(F.array(*[F.struct(F.lit(i * width).alias("lead"), block(i * width, width).alias("value")) for i in range(distance + 1)]))
    placed = codes.select("code", places.alias("p")).select("code", F.col("p.lead").cast("long").alias("lead"), F.col("p.value").alias("value"))
    counts = placed.groupBy("lead", "value").count().where(F.col("count") > group_rows).select("lead", "value", F.lit(True).alias("large"))
    # (distance+1) * 2**width groups at most can be there, whatever the input
    placed = placed.join(F.broadcast(counts), ["lead", "value"], "left")
    inner = (_BITS - width) // (distance + 1)
    # the code turned so that its block leads; then blocks of what follows
    turned = lambda lead: F.when(F.col("lead") == 0, F.col("code")).otherwise(F.shiftleft("code", lead).bitwiseOR(F.shiftrightunsigned("code", _BITS - lead)))
    second = None
    for i in range(distance + 1):
        lead = i * width
        own = F.array(*[F.shiftrightunsigned(turned(lead), _BITS - width - (u + 1) * inner).bitwiseAND((1 << inner) - 1).bitwiseOR(F.lit((u + 1) << inner).cast("long")) for u in range(distance + 1)])
        second = F.when(F.col("lead") == lead, own) if second is None else second.when(F.col("lead") == lead, own)
    split = placed.withColumn("part", F.explode(F.when(F.col("large"), second).otherwise(F.array(F.lit(0).cast("long")))))
    group = F.col("lead") * (1 << 40) + F.col("value") * (1 << 20) + F.col("part")
    return split.select(group.alias("group"), "lead", "code")


def _found(docs: DataFrame, words: int, distance: int, group_rows: int) -> DataFrame:
    """doc_id, mark (a hash of the text), code, component_id, root (the component's smallest code)."""
    work = Work(docs.sparkSession, "simhash")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    prints = work.save(slim.mapInArrow(_fingerprints(words), "doc_id long, mark long, code long"), "prints")
    codes = work.save(prints.groupBy("code").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "codes")
    grouped = _grouped(codes.select("code"), distance, group_rows).repartition("group").sortWithinPartitions("group")
    stars = work.save(grouped.mapInArrow(_linked(distance), "a long, b long"), "links")
    root = components(work, stars).select(F.col("a").alias("code"), F.col("b").alias("root"))
    rooted = work.save(codes.join(root, "code", "left").withColumn("root", F.coalesce("root", "code")), "rooted")
    least = work.save(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")).where("members > 1"), "least")
    linked = join_hot(rooted, least, "root", "members", codes.count(), "left")
    named = work.save(linked.select("code", "n", F.when(F.col("members").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), "root"), "named")
    return join_hot(prints, named, "code", "n", prints.count()).select("doc_id", "mark", "code", "component_id", "root")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, group_rows: int = 1 << 21) -> DataFrame:
    """doc_id, code (the fingerprint as a long), component_id: the smallest doc_id reachable by links."""
    return _found(docs, words, distance, group_rows).drop("mark", "root")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 3, group_rows: int = 1 << 21) -> DataFrame:
    """docs with one document of each group, one with the smallest id; rows without an id stay. Rows that share an id but not
    their group are each judged by their own; of rows that repeat an id and its text one stays."""
    id_, mark, rows = free(docs, "_kept", "_mark", "_rows")
    found = _found(docs, words, distance, group_rows).where("doc_id = component_id")
    of_group = found.groupBy("root").agg(F.first("doc_id").alias(id_), F.min("mark").alias(mark), F.count("*").alias(rows))
    kept = Work(docs.sparkSession, "kept").save(of_group.drop("root"), "kept")
    own = docs.join(kept.select(id_, mark), (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(mark)), "left_semi")
    if not kept.where(F.col(rows) > 1).isEmpty():  # rows that repeat an id and its text
        own = own.dropDuplicates(["doc_id", "text"])
    return docs.where("doc_id is null").unionByName(own)
