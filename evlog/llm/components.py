"""Connected components of a table of links, by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, join_hot


def _starred(work: Work, edges: DataFrame, name: str, large: bool) -> DataFrame:
    """Each node's links moved to the smallest node it knows: those to larger nodes (large) or those to smaller ones."""
    if large:
        edges = work.save(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-both")
    least = work.save(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), f"{name}-least")
    joined = join_hot(edges, least, "a", "n", edges.count())
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:
        moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    out = work.save(moved.where("a <> b").distinct(), name)
    for gone in ([f"{name}-both"] if large else []) + [f"{name}-least"]:
        work.drop(gone)
    return out


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(a, b): every linked node a that is not the smallest of its component, with that smallest node b. edges: (a, b) of a
    type that orders, a > b. Each round is a table of its own, so no lineage grows and a lost executor costs one round."""
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = work.save(edges.distinct(), "star-0")
    before, number = mark(edges), 0
    while before[0]:
        number += 1
        wide = _starred(work, edges, f"wide-{number}", True)
        edges = _starred(work, wide, f"star-{number}", False)
        work.drop(f"wide-{number}")
        work.drop(f"star-{number - 1}")
        if (now := mark(edges)) == before:
            break
        before = now
    return edges
