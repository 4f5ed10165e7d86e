"""What the operators share: work tables, joins that stand a hot key, words and hashes."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..deploy import ship
from ..sources import scratch

#: A-Z to a-z on bytes; other bytes stay.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> None:
    """Ship the package, and keep Arrow batches at 4 MB, unless the session has a size of its own: a batch of texts stands in
    the executor and in its Python worker at once, several times over."""
    ship(spark)
    if spark.conf.get(_BATCH_BYTES, "64MB") in ("64MB", "67108864b", "67108864"):
        spark.conf.set(_BATCH_BYTES, str(4 << 20))


class Work:
    """Tables written in a folder of their own below the shared one. Every task that is run again writes the same rows,
    and Spark's committer publishes a table as a whole, so a lost executor costs time only."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.path = scratch.new(spark, name)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df as a table and return the table: its lineage ends here."""
        to = f"{self.path}/{name}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, name: str) -> None:
        """Remove a table that nothing reads any more."""
        scratch.delete(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Remove the folder, once nothing reads any of its tables."""
        scratch.delete(self.spark, self.path)

    def release(self) -> None:
        """Let Spark's cleaner remove the shuffle files of plans that are done with."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def free(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted column names, with underscores more where df has them already: names differ in more than case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hot_rows(spark: SparkSession, total: int) -> int:
    """A key that holds so many of `total` rows counts as hot: a quarter of what a partition would hold, so that a partition is
    never much larger than the others by a key. At most four keys a partition, or two thousand, can be hot."""
    keys = max(2000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1000, -(-total // keys))


def join_hot(left: DataFrame, right: DataFrame, on: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and, in `count`, the key's rows in left (`total` in all).

    Hot keys, whose number is bounded by their definition, go by broadcast and so stay where left has them; all other keys are
    shuffled, and none of those can fill a task. left must be a table, as both parts read it. how: inner or left.
    """
    least = hot_rows(left.sparkSession, total)
    hot = F.broadcast(right.where(F.col(count) >= least).withColumn("_hot", F.lit(True)))
    marked = left.join(hot, on, "left")
    at_once = marked.where("_hot").drop("_hot")
    rest = left.join(F.broadcast(right.where(F.col(count) >= least).select(on)), on, "left_anti")
    return at_once.unionByName(rest.join(right.where(F.col(count) < least), on, how))


def utf8(values: pa.Array) -> list[bytes]:
    """The UTF-8 of each text; a null is an empty text."""
    return [b"" if v is None else v for v in values.cast(pa.binary()).to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def slices(rows: pa.RecordBatch, column: str, most: int):
    """The batch in slices whose texts take about `most` bytes at most: long rows must not make a task's memory grow."""
    start, held = 0, 0
    for i, n in enumerate(pc.binary_length(rows.column(column)).to_pylist()):
        n = (n or 0) + 16
        if held and held + n > most:
            yield rows.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < rows.num_rows:
        yield rows.slice(start)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words of a buffer, cut at ASCII white space, eight bytes at a time over all words."""
    b = np.frombuffer(buf, np.uint8)
    word = ~SPACE[b]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(b) and word[0]:
        edge = np.concatenate((np.zeros(1, np.int64), edge))
    if len(b) and word[-1]:
        edge = np.append(edge, len(b))
    start, end = edge[0::2], edge[1::2]
    del word
    length = end - start
    padded = np.concatenate((b, np.zeros(16, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded, shape=(len(b) + 8, 8), strides=(1, 1))
    h = mix(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(start)), 0
    while len(live):
        lane = eights[start[live] + at].view(np.uint64).ravel()
        left = length[live] - at
        lane = lane << (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        h[live] = mix(h[live] * np.uint64(0x9FB21C651E98DF25) ^ lane)
        live, at = live[left > 8], at + 8
    return start, end, h
