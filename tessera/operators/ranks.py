"""Ranked and capped outputs, gaps, bundles and shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_within(rows: DataFrame, by: Sequence[str], order: Sequence[Column], most: int | None = None, name: str = "place") -> DataFrame:
    """rows with their place, from 1, among those equal in `by`; only the first `most`, if given. Order the columns so
    that no two rows tie, else which of them comes first is open. Null keys are one group."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out.where(F.col(name) <= most) if most is not None else out


def new_findings(base: DataFrame, head: DataFrame, measure: str, thing: str, most: int = 20) -> DataFrame:
    """(measure, thing, before, now): things that head counts more often than base, the `most` greatest rises of each
    measure, ties to the smaller thing. Counted on both sides before they meet."""
    was = base.groupBy(measure, thing).agg(F.count("*").alias("before"))
    now = head.groupBy(measure, thing).agg(F.count("*").alias("now"))
    both = now.join(was, [measure, thing], "left").na.fill(0, ["before"]).where("now > before")
    return ranked_within(both, [measure], [F.desc(F.col("now") - F.col("before")), F.asc(thing)], most).drop("place")


def called(endpoints: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """endpoints with the number of their calls, 0 without any. Calls are counted before the join; calls of no
    endpoint and null keys count for none."""
    return endpoints.join(calls.groupBy(key).agg(F.count("*").alias("calls")), key, "left").na.fill(0, ["calls"])


def windowed_gaps(rows: DataFrame, kind: str, ts: str) -> DataFrame:
    """(kind, at, n): rows of each kind and day on the axis of all days. Days without rows are 0 between a kind's
    first and last day, and null outside, where nothing was looked at."""
    days = rows.where(F.col(ts).isNotNull()).groupBy(F.col(kind).alias("kind"), F.date_trunc("day", ts).alias("at")).agg(F.count("*").alias("n"))
    span = days.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))  # one row
    kinds = days.groupBy("kind").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    axis = kinds.join(F.broadcast(span)).select("kind", "a", "b", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("at"))
    inside = F.col("at").between(F.col("a"), F.col("b"))
    return axis.join(days, ["kind", "at"], "left").select("kind", "at", F.when(inside, F.coalesce("n", F.lit(0))).alias("n"))


def bundled(wires: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, weight): wires (src, dst, weight) between modules folded to one a pair of units (node, unit); within
    one unit the pair of nodes is kept apart."""
    a, b = units.select(F.col("node").alias("src"), F.col("unit").alias("ua")), units.select(F.col("node").alias("dst"), F.col("unit").alias("ub"))
    told = wires.join(a, "src").join(b, "dst")
    one = F.col("ua") == F.col("ub")
    name = lambda unit, node: F.when(one, F.concat_ws("/", unit, F.col(node).cast("string"))).otherwise(F.col(unit))
    return told.select(name("ua", "src").alias("src"), name("ub", "dst").alias("dst"), "weight").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def inside_share(wires: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, inside, total, share): weight of each unit's wires, of those within it, and the share in per cent, never
    100 while anything leaves."""
    a, b = units.select(F.col("node").alias("src"), F.col("unit").alias("ua")), units.select(F.col("node").alias("dst"), F.col("unit").alias("ub"))
    told = wires.join(a, "src").join(b, "dst").select("ua", F.when(F.col("ua") == F.col("ub"), F.col("weight")).otherwise(F.lit(0)).alias("inside"), "weight")
    by = told.groupBy(F.col("ua").alias("unit")).agg(F.sum("inside").alias("inside"), F.sum("weight").alias("total"))
    rounded = F.floor(F.col("inside") * 100 / F.col("total") + 0.5).cast("long")
    return by.withColumn("share", F.when(F.col("inside") == F.col("total"), F.lit(100).cast("long")).otherwise(F.least(F.lit(99).cast("long"), rounded)))


def ordered_union(rows: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """(key, labels): the different labels of each key, comma-joined in the order of their first occurrence, ties to
    the smaller label. First occurrences are found before anything is collected, so a key holds its labels only."""
    first = rows.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.min(order).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", label)))
    return first.groupBy(key).agg(F.array_join(F.transform(listed, lambda s: s[label]), ",").alias("labels"))


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) both of whose ends are among the nodes (node)."""
    inside = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    return inside.select(*edges.columns)


def spread(paths: DataFrame, path: str) -> DataFrame:
    """(unit, entries, folders): different direct entries under each first segment, and how many of them hold more."""
    parts = F.split(path, "/")
    told = paths.where(F.size(parts) > 1).select(parts[0].alias("unit"), parts[1].alias("entry"), (F.size(parts) > 2).alias("deep"))
    each = told.groupBy("unit", "entry").agg(F.max("deep").alias("deep"))
    return each.groupBy("unit").agg(F.count("*").alias("entries"), F.sum(F.col("deep").cast("long")).alias("folders"))
