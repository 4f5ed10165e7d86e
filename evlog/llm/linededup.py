"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches by falling id. A batch's eligible lines are counted by hash and merge-anti-joined with the runs:
hashes that no run holds enter the batch's own run with the batch's largest document as their keeper, hashes that some run
holds enter with their count only, since an earlier batch has their keeper. Every run is a table bucketed and sorted by hash,
all with the same number of buckets, so runs are joined and merged bucket by bucket, as they lie: only a batch's own lines
are shuffled, once. When a level holds `fanout` runs they are merged into one of the next level. Lines found in `min_docs`
documents or more stay in their keeper, the largest id, alone.

There are `batch_docs` documents a batch, or more where that would make over `most_batches`; batches are cut at quantiles of
the ids, so an id far from the others doesn't matter.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; keys of fewer than min_chars code
points are never dropped. Keys are compared by their 128-bit XXH3 hash.

Defined results: a null or empty text is one empty line, and a null stays null; rows without an id keep all lines and
count for none; rows that repeat an id count as documents of their own, and all rows with a key's largest id keep it. An
empty table stays empty. All other columns pass through.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Work, free, join_hot, slices

_SPACE = " \t\n\v\f\r"


def line_hash(line: str, min_chars: int) -> bytes | None:
    """The hash of a line's key; None if the key is too short."""
    if len(line) < min_chars:
        return None
    key = line.strip(_SPACE)
    return xxhash.xxh3_128_digest(key.encode().translate(LOWER)) if len(key) >= min_chars else None


def _hashed(cuts: list[int], min_chars: int):
    """For each document its batch and the different hashes of its lines. cuts: rising; the largest ids are batch 0."""

    def run(rows_in):
        for rows in rows_in:
            for part in slices(rows, "text", 16 << 20):
                ids, numbers, hashes = [], [], []
                for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found = {h for line in (text or "").split("\n") if (h := line_hash(line, min_chars)) is not None}
                    if found:
                        ids.append(key)
                        numbers.append(len(cuts) - bisect_left(cuts, key))
                        hashes.append(sorted(found))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.list_(pa.binary())), pa.array(numbers, pa.int32())], ["doc_id", "hashes", "batch"])

    return run


_ORDERING = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class Runs:
    """Levelled sorted runs (hash, n, keeper): n documents hold the line, keeper is the largest of them, in one run only.

    A run is written by tasks that hold a bucket each, as a file a bucket; within this block Spark reads these files as the
    sorted partitions that they are."""

    def __init__(self, work: Work, fanout: int = 4):
        self.work, self.fanout, self.levels, self.made, self.conf = work, fanout, [[]], 0, work.spark.conf
        self.buckets, self.prefix = int(self.conf.get("spark.sql.shuffle.partitions")), f"line_runs_{uuid.uuid4().hex}"

    def __enter__(self) -> Runs:
        self.before = self.conf.get(_ORDERING, None)
        self.conf.set(_ORDERING, "true")
        return self

    def __exit__(self, *_) -> None:
        """Removes the runs: what is wanted of them has been stored by then."""
        self.conf.set(_ORDERING, self.before) if self.before is not None else self.conf.unset(_ORDERING)
        for level in self.levels:
            for name, _ in level:
                self._drop(name)

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"{self.prefix}_{self.made}"
        self.made += 1
        rows.write.bucketBy(self.buckets, "hash").sortBy("hash").option("compression", "zstd").option("path", f"{self.work.path}/{name}").saveAsTable(name)
        self.levels[level].append((name, self.work.spark.table(name)))

    def _drop(self, name: str) -> None:
        self.work.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.work.drop(name)

    def all(self) -> list[DataFrame]:
        return [table for level in self.levels for _, table in level]

    def merged(self, tables: list[DataFrame] | None = None) -> DataFrame | None:
        tables = self.all() if tables is None else tables
        if not tables:
            return None
        # the filter holds for every row; with it the union takes rows, not column batches, which it would put one after another
        # instead of bucket to bucket (Spark 4.1)
        return reduce(DataFrame.unionByName, [t.where("n > 0") for t in tables]).groupBy("hash").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def new(self, lines: DataFrame) -> DataFrame:
        """The run of a batch: (hash, doc_id), each hash once for a document, all ids smaller than those of earlier batches."""
        own = lines.groupBy("hash").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        held = F.lit(False)
        for number, table in enumerate(self.all()):
            own = own.join(table.select("hash", F.lit(True).alias(f"in_{number}")), "hash", "left")
            held = held | F.col(f"in_{number}").isNotNull()
        return own.select("hash", "n", F.when(~held, F.col("keeper")).alias("keeper"))

    def add(self, lines: DataFrame) -> None:
        self._write(self.new(lines), 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(self.merged([table for _, table in full]), level + 1)
            for name, _ in full:
                self._drop(name)
            level += 1


def _kept(columns: list[str], gone: str, names: list[str], min_chars: int):
    """Drops from each text the lines whose hashes stand in its row, and counts."""

    def run(rows_in):
        for rows in rows_in:
            for part in slices(rows, "text", 16 << 20):
                texts, lines, dropped = [], [], []
                for text, hashes in zip(part.column("text").to_pylist(), part.column(gone).to_pylist(), strict=True):
                    own = (text or "").split("\n")
                    kept = own
                    if hashes:
                        hashes = set(hashes)
                        kept = [x for x in own if line_hash(x, min_chars) not in hashes]
                    texts.append(text if len(kept) == len(own) else "\n".join(kept))
                    lines.append(len(own))
                    dropped.append(len(own) - len(kept))
                out = [pa.array(texts, pa.string()) if name == "text" else part.column(name) for name in columns]
                yield pa.RecordBatch.from_arrays([*out, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*columns, *names])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batch_docs: int = 1 << 20, least_batches: int = 4, most_batches: int = 16, fanout: int = 4, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """docs, which needs doc_id and text, with their repeated lines dropped, and the numbers of lines and of dropped lines
    besides, in columns of the given names: by default _n_lines and _n_dropped, with underscores more where docs has these."""
    work = Work(docs.sparkSession, "lines")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    batches = min(max(least_batches, -(-slim.count() // batch_docs)), max(least_batches, most_batches))
    cuts = slim.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    hashed = work.save(slim.mapInArrow(_hashed(cuts, min_chars), "doc_id long, hashes array<binary>, batch int"), "hashed", by="batch")
    with Runs(work, fanout) as runs:
        for number in range(len(cuts) + 1):
            runs.add(hashed.where(F.col("batch") == number).select(F.explode("hashes").alias("hash"), "doc_id"))
        drops = work.save(runs.merged().where(F.col("n") >= min_docs), "drops")
    lines = hashed.select(F.explode("hashes").alias("hash"), "doc_id")
    total = hashed.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    own = free(docs, n_lines or "_n_lines", n_dropped or "_n_dropped", "_doc", "_gone")
    n_lines, n_dropped, doc, gone = n_lines or own[0], n_dropped or own[1], own[2], own[3]
    hashes = join_hot(lines, drops, "hash", "n", total).where("doc_id <> keeper").groupBy(F.col("doc_id").alias(doc)).agg(F.collect_list("hash").alias(gone))
    schema = docs.schema
    out = T.StructType([*schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    joined = docs.join(hashes, F.col("doc_id") == F.col(doc), "left").drop(doc)
    return joined.mapInArrow(_kept(schema.names, gone, [n_lines, n_dropped], min_chars), out)
