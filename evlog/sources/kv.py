"""A key-value table of versions: sets and deletions are appended, the latest of a key counts, compaction drops the rest.

Every write is an entry of a journal that names its folder; its number is the version. Two writers get two numbers, so no
update is lost."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EvlogError
from .files import Files, Journal

_DDL = "key string, value string, deleted boolean"


class KeyValueTable:
    def __init__(self, spark: SparkSession, path: str, fanout: int = 32):
        """fanout: so many writes are compacted into one; 0: only compact() does."""
        self.spark, self.path, self.files, self.fanout = spark, path.rstrip("/"), Files(spark, path), fanout
        self.journal, self.number, self.folders = Journal(self.files, "_log"), -1, {}

    def _read_on(self) -> int:
        """Takes the entries of other writers in, and returns the last one's number."""
        for number, body in self.journal.after(self.number):
            gone = [self.folders.pop(old)[0] for old in body["replaces"]]
            self.folders[number] = (max(gone, default=number), body["folder"])  # a compaction is as old as the newest in it
            self.number = number
        return self.number

    def versions(self) -> DataFrame:
        """key, value, version, deleted: all that is stored."""
        self._read_on()
        tables = [self.spark.read.schema(_DDL).parquet(f"{self.path}/{folder}").select("key", "value", F.lit(version).cast("long").alias("version"), "deleted") for version, folder in self.folders.values()]
        return reduce(DataFrame.unionByName, tables) if tables else self.spark.createDataFrame([], "key string, value string, version long, deleted boolean")

    def write(self, rows: DataFrame) -> int:
        """Add (key, value, deleted) as one version and return it; of rows for one key the greatest value counts."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.select("key", "value", "deleted").write.parquet(f"{self.path}/{folder}")
        number = self._publish({"folder": folder, "replaces": []})
        if self.fanout and len(self.folders) >= self.fanout:
            self.compact()
        return number

    def _publish(self, body: dict) -> int:
        for _ in range(100):
            number = self._read_on() + 1
            if any(old not in self.folders for old in body["replaces"]):
                return -1
            if self.journal.publish(number, body):
                self._read_on()
                return number
        raise EvlogError("other writers were first, again and again")

    def set_all(self, rows: DataFrame) -> int:
        return self.write(rows.select("key", "value").withColumn("deleted", F.lit(False)))

    def set(self, key: str, value) -> int:
        return self.set_all(self.spark.createDataFrame([(key, json.dumps(value))], "key string, value string"))

    def delete(self, key: str) -> int:
        return self.write(self.spark.createDataFrame([(key, None, True)], "key string, value string, deleted boolean"))

    def live(self) -> DataFrame:
        """key, value: the latest of each key that is not deleted."""
        latest = self.versions().groupBy("key").agg(F.max(F.struct("version", F.struct("deleted", "value").alias("row"))).alias("m"))
        return latest.where("not m.row.deleted").select("key", F.col("m.row.value").alias("value"))

    def get(self, key: str):
        row = self.versions().where(F.col("key") == key).agg(F.max(F.struct("version", F.struct("deleted", "value").alias("row")))).first()[0]
        return None if row is None or row.row.deleted else json.loads(row.row.value)

    def has(self, key: str) -> bool:
        return not self.live().where(F.col("key") == key).isEmpty()

    def keys(self) -> DataFrame:
        return self.live().select("key").orderBy("key")

    def size(self) -> int:
        return self.live().count()

    def garbage_ratio(self) -> float:
        total = self.versions().count()
        return 1 - self.size() / total if total else 0.0

    def compact(self) -> None:
        """Keep only what live() has now, sorted by key. What others write meanwhile is newer and stays. Replaced folders stay
        for their readers until vacuum()."""
        self._read_on()
        old, folder = sorted(self.folders), f"data/{uuid.uuid4().hex}"
        if not old:
            return
        self.live().select("key", "value", F.lit(False).alias("deleted")).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{self.path}/{folder}")
        if self._publish({"folder": folder, "replaces": old}) < 0:  # another writer has compacted some of them
            self.files.delete(folder)

    def vacuum(self) -> list[str]:
        """Remove the folders that no entry in force names; for when no one reads older ones or writes."""
        self._read_on()
        named = {folder for _, folder in self.folders.values()}
        dead = [f"data/{n}" for n in self.files.names("data") if f"data/{n}" not in named]
        for folder in dead:
            self.files.delete(folder)
        return dead
