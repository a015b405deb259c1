"""Groups of files and names: usual names, rings with their edges, loudest members, names told apart, nearest holders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ancestors
from tessera.operators.graph import components
from tessera.sources.tables import apart, written


def usual(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, value): each key's most frequent value, ties to the one seen first."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(at).alias("first"))
    return n.groupBy(key).agg(F.max_by(value, F.struct(F.col("n"), (-F.col("first")).alias("f"))).alias(value))


def tangles(edges: DataFrame) -> DataFrame:
    """(ring, size, edges): rings of more than one node with the number of their different inner edges."""
    ring = written(components(edges))
    inner = edges.select("src", "dst").distinct().join(ring.select(F.col("node").alias("src"), "ring"), "src").join(ring.select(F.col("node").alias("dst"), F.col("ring").alias("other")), "dst").where("ring = other")
    sizes = ring.groupBy("ring").agg(F.count("*").alias("size")).where("size > 1")
    return sizes.join(inner.groupBy("ring").agg(F.count("*").alias("edges")), "ring")


def flagged_tangles(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(tangle, size, edges, runtime, deep) of edges (src, dst, type) between nodes of units (node, unit): the rings of units,
    with the pairs of units that depend within them.

    runtime: some of it is left without the edges that only carry a type. deep: a ring of nodes, types apart, spans two
    of its units; drawing nodes together hides such rings and invents others.
    """
    a, b = units.select(F.col("node").alias("src"), F.col("unit").alias("ua")), units.select(F.col("node").alias("dst"), F.col("unit").alias("ub"))
    between = written(edges.join(apart(a), "src").join(apart(b), "dst").where("ua <> ub").groupBy(F.col("ua").alias("src"), F.col("ub").alias("dst")).agg(F.count("*").alias("n"), F.count_if("type").alias("types")))
    ring = written(components(between))
    within = between.join(ring.select(F.col("node").alias("src"), F.col("ring").alias("tangle")), "src").join(ring.select(F.col("node").alias("dst"), F.col("ring").alias("other")), "dst").where("tangle = other")
    sizes = ring.groupBy(F.col("ring").alias("tangle")).agg(F.count("*").alias("size")).where("size > 1")
    still = components(between.where("n > types"))
    real = still.join(still.groupBy("ring").count().where("count > 1"), "ring", "left_semi").join(ring.select("node", F.col("ring").alias("tangle")), "node").select("tangle").distinct().withColumn("runtime", F.lit(True))
    spans = spanning(edges, units).join(ring.select(F.col("node").alias("unit"), F.col("ring").alias("tangle")), "unit")
    deep = spans.groupBy("tangle", "ring").agg(F.count("*").alias("n")).where("n > 1").select("tangle").distinct().withColumn("deep", F.lit(True))
    told = sizes.join(within.groupBy("tangle").agg(F.count("*").alias("edges")), "tangle").join(real, "tangle", "left").join(deep, "tangle", "left")
    return told.select("tangle", "size", "edges", F.coalesce("runtime", F.lit(False)).alias("runtime"), F.coalesce("deep", F.lit(False)).alias("deep"))


def spanning(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(ring, unit): the units of each ring of nodes that has several, edges that only carry a type apart."""
    ring = components(edges.where("not type").select("src", "dst"))
    held = written(ring.join(apart(units), "node").select("ring", "unit").distinct())
    return held.join(held.groupBy("ring").count().where("count > 1"), "ring", "left_semi")


def ring_edges(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, n): how many edges of node rings lead from one unit to another, edges that only carry a type apart."""
    real = edges.where("not type").select("src", "dst")
    ring = written(components(real).join(apart(units), "node"))
    a, b = (ring.select(F.col("node").alias(c), F.col("ring").alias(f"r{c}"), F.col("unit").alias(f"u{c}")) for c in ("src", "dst"))
    met = real.join(apart(a), "src").join(apart(b), "dst").where("rsrc = rdst and usrc <> udst")
    return met.groupBy(F.col("usrc").alias("src"), F.col("udst").alias("dst")).agg(F.count("*").alias("n"))


def loudest(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, node, arriving, rest): the member that most weight reaches from outside, and what reaches the others."""
    a, b = units.select(F.col("node").alias("src"), F.col("unit").alias("ua")), units.select(F.col("node").alias("dst"), F.col("unit").alias("unit"))
    into = edges.join(a, "src").join(b, "dst").where("ua <> unit").groupBy("unit", "dst").agg(F.sum("weight").alias("w"))
    best = into.groupBy("unit").agg(F.max(F.struct("w", (-F.col("dst")).alias("d"))).alias("m"), F.sum("w").alias("all"))
    return best.select("unit", (-F.col("m.d")).alias("node"), F.col("m.w").alias("arriving"), (F.col("all") - F.col("m.w")).alias("rest"))


def told_apart(paths: DataFrame) -> DataFrame:
    """(path, name): the shortest end of each path (path) that no other path has; the whole path where all are shared.

    All ends are counted at once, so names need no rounds.
    """
    parts = F.split("path", "/")
    ends = paths.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("n"), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "/").alias("name")))).alias("x")).select("path", "x.*")
    alone = ends.groupBy("name").agg(F.count("*").alias("c"), F.min("path").alias("path"), F.min("n").alias("n")).where("c = 1")
    best = alone.groupBy("path").agg(F.min_by("name", "n").alias("name"))
    return paths.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("name", "path").alias("name"))


def shared_folder(files: DataFrame, key: str) -> DataFrame:
    """(key, folder): the deepest folder that holds all files (path) of a key; '.' at the root."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    above = files.select(key, F.explode(F.when(folder == "", F.array(F.lit(""))).otherwise(ancestors(folder))).alias("folder"))
    n = above.groupBy(key, "folder").agg(F.count("*").alias("n"))
    total = files.groupBy(key).agg(F.count("*").alias("total"))
    return n.join(total, key).where("n = total").groupBy(key).agg(F.max_by("folder", F.length("folder")).alias("folder")).select(key, F.when(F.col("folder") == "", ".").otherwise(F.col("folder")).alias("folder"))


def nearest_declaring(asked: DataFrame, declared: DataFrame) -> DataFrame:
    """(name, src, dst): for each use (name, file) the declaring file (name, file) that shares most leading folders; null
    where two share as many. Uses and declarations meet on folders, so no name's files are compared with each other."""
    above = lambda df: df.withColumn("folder", F.explode(ancestors(F.regexp_replace("file", "/?[^/]*$", ""))))
    held = above(declared.select("name", "file").distinct()).groupBy("name", F.col("folder")).agg(F.countDistinct("file").alias("n"), F.min("file").alias("dst"))
    met = above(asked.select("name", "file").distinct()).distinct().join(held, ["name", "folder"])
    best = met.groupBy("name", "file").agg(F.max_by(F.struct("n", "dst"), F.length("folder")).alias("m"))
    return best.select("name", F.col("file").alias("src"), F.when(F.col("m.n") == 1, F.col("m.dst")).alias("dst"))


def labelled(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, label): the label (key, label) of the name itself, else of the longest key ending in / that begins it."""
    heads = F.transform(F.filter(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring(F.col("name"), i, F.lit(1)) == "/"), lambda i: F.left(F.col("name"), i))
    tried = names.select("name").distinct().select("name", F.explode(F.array_distinct(F.concat(F.array("name"), heads))).alias("key")).join(labels, "key")
    best = tried.groupBy("name").agg(F.max_by("label", F.struct((F.col("key") == F.col("name")).alias("own"), F.length("key").alias("n"))).alias("label"))
    return names.select("name").distinct().join(best, "name", "left")


def facing(edges: DataFrame) -> DataFrame:
    """(node, facing): what a node serves less what it asks for, over both; its own edges do not count."""
    out = edges.where("src <> dst")
    both = out.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("serves"), F.col("weight").alias("asks")).unionByName(out.select(F.col("dst").alias("node"), F.col("weight").alias("serves"), F.lit(0).cast("long").alias("asks")))
    by = both.groupBy("node").agg(F.sum("serves").alias("s"), F.sum("asks").alias("a"))
    return by.select("node", F.round((F.col("s") - F.col("a")) / (F.col("s") + F.col("a")), 6).alias("facing"))


def samples(rows: DataFrame, key: str, value: str, most: int = 4) -> DataFrame:
    """(key, n, samples): how many rows a key has, and its `most` least values, comma-joined."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    few = rows.select(key, value).withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(value))).where(F.col("k") <= most)
    told = few.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(value)), lambda v: v.cast("string")), ",").alias("samples"))
    return n.join(told, key)
