"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """Points the neighbours v of each u (those above u, or all given) at the least of u's neighbourhood."""
    # least is written out, so that the join below has plain exchanges on both sides and a hub can be split
    least = materialize(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    told = pairs.join(least, "u")
    moved = told.where(F.col("v") > F.col("u")) if larger_only else told
    out = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not larger_only:
        out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs -> (node, component): the least node that each node of an edge reaches.

    Self-loops, repeated and null edges are ignored; nodes without an edge do not appear. Each round is written to
    the shared folder. Only two numbers a round reach the driver.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = materialize(clean), None
    while True:
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign[0] == 0 or sign == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = sign
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            now.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = materialize(_star(both, larger_only=True))
        # a > b in every row: the smaller neighbours of each node
        now = materialize(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), larger_only=False))
