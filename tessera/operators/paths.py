"""Paths among paths: the nearest container of a picked one, and the places of a tree's nodes in pre-order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ancestors
from tessera.sources.tables import apart, written


def bare(path: Column) -> Column:
    """A path without what marks a remainder (/*) or a part (#...)."""
    return F.get(F.split(F.regexp_replace(path, r"/?\*$", ""), "#"), F.lit(0))


def nearest_container(picked: DataFrame, held: DataFrame) -> DataFrame:
    """(path, container, how): for each picked path that of held (path) which is it ('same'), else the deepest one above or
    at it ('over'), else the shallowest below it ('under'), else null. Of equally deep ones the lesser path counts.

    Both sides meet on whole beginnings. Of all that lies below a beginning only the shallowest is kept before they meet,
    so that a picked root does not gather the tree.
    """
    want = picked.select("path").distinct().where("path <> ''")
    nodes = written(held.select(F.col("path").alias("container"), bare(F.col("path")).alias("b")).distinct())
    same = want.join(nodes.select(F.col("container").alias("path")), "path", "left_semi").select("path", F.col("path").alias("same"))
    at = nodes.groupBy("b").agg(F.min("container").alias("container"))
    above = want.select("path", F.explode(F.filter(ancestors(bare(F.col("path"))), lambda b: b != "")).alias("b")).join(at, "b").groupBy("path").agg(F.max_by("container", F.length("b")).alias("over"))
    inside = nodes.select(F.explode(F.filter(ancestors(F.col("b")), lambda h: (h != "") & (h != F.col("b")))).alias("head"), F.struct(F.length("b").alias("n"), "container").alias("c"))
    first = inside.groupBy("head").agg(F.min("c").alias("c"))
    under = want.withColumn("head", bare(F.col("path"))).join(first, "head").select("path", F.col("c.container").alias("under"))
    told = want.join(same, "path", "left").join(above, "path", "left").join(under, "path", "left")
    how = F.when(F.col("same").isNotNull(), "same").when(F.col("over").isNotNull(), "over").when(F.col("under").isNotNull(), "under")
    return told.select("path", F.coalesce("same", "over", "under").alias("container"), how.alias("how"))


def preorder(nodes: DataFrame, weight: str) -> DataFrame:
    """(path, depth, place): nodes (path, weight) of a tree with their places in pre-order, from 1, the heaviest sibling
    first, ties to the lesser path.

    A node stands one behind its parent, plus the sizes of the siblings before it. These distances are counted within
    siblings and summed along each node's ancestors, so nothing is sorted as a whole. The root is ''; each path's
    parents are expected among the nodes.
    """
    parent = F.when(F.col("path") == "", None).when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    chain = F.when(F.col("path") == "", F.array(F.lit(""))).otherwise(ancestors(F.col("path")))
    own = nodes.select("path", F.col(weight).alias("w"), parent.alias("parent"), chain.alias("chain"))
    size = own.select(F.explode("chain").alias("path")).groupBy("path").agg(F.count("*").alias("size"))
    before = Window.partitionBy("parent").orderBy(F.desc("w"), "path").rowsBetween(Window.unboundedPreceding, -1)
    step = written(own.join(apart(size), "path").select("path", (F.lit(1) + F.coalesce(F.sum("size").over(before), F.lit(0))).alias("step")))
    each = own.select("path", (F.size("chain") - 1).alias("depth"), F.explode("chain").alias("at"))
    return each.join(apart(step.select(F.col("path").alias("at"), "step")), "at").groupBy("path", "depth").agg(F.sum("step").alias("place"))
