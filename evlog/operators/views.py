"""Queries on read models, which are DataFrames with a key column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import strictly


class View:
    """A keyed read model. Filters are plain predicates: laid out by layout(), a stored view is pruned by row-group statistics."""

    def __init__(self, rows: DataFrame, key: str):
        self.rows, self.key = rows, key

    def all(self) -> DataFrame:
        return self.rows

    def query(self, **fields) -> DataFrame:
        """Rows whose fields all equal the given values strictly; no fields: all rows."""
        tests = [strictly(F.col(k), v) for k, v in fields.items()]
        return self.rows.where(reduce(lambda a, b: a & b, tests)) if tests else self.rows

    def query_range(self, start=None, end=None) -> DataFrame:
        """Rows by key, both bounds inclusive, in key order."""
        return self.query_field_range(self.key, start, end)

    def query_field_range(self, field: str, start=None, end=None) -> DataFrame:
        rows = self.rows
        if start is not None:
            rows = rows.where(F.col(field) >= F.lit(start))
        if end is not None:
            rows = rows.where(F.col(field) <= F.lit(end))
        return rows.orderBy(field)

    def get(self, key) -> DataFrame:
        return self.rows.where(F.col(self.key) == F.lit(key))

    def find_one(self, **fields) -> DataFrame:
        """The first of the matching rows in key order."""
        return self.query(**fields).orderBy(self.key).limit(1)

    def value_counts(self, field: str) -> DataFrame:
        return self.rows.groupBy(field).agg(F.count("*").alias("n"))

    def distinct_values(self, field: str) -> DataFrame:
        return self.rows.select(field).distinct().orderBy(field)

    def range_total(self, start=None, end=None, value: str = "value") -> DataFrame:
        """The sum over a key range, nulls as 0, and how many rows it has."""
        return self.query_range(start, end).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("total"), F.count("*").alias("n_rows"))

    def cached(self) -> View:
        """The view with its rows kept in memory, as far as it holds them, least lately used first out; release() gives them up."""
        return View(self.rows.persist(), self.key)

    def release(self) -> None:
        self.rows.unpersist()

    def layout(self, *fields: str) -> DataFrame:
        """The rows range-partitioned and sorted by fields that queries name, to be written: the index of a Parquet table."""
        by = list(fields) or [self.key]
        return self.rows.repartitionByRange(*by).sortWithinPartitions(*by)
