"""Directed graphs: reach, rings, levels, unit folds, identity clusters and scored route links.

Loops keep their state in written tables; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import LOCAL
from tessera.sources.tables import MOST, ROWS, apart, dealt, fresh_path, written


# A fixed value: steps along the edges between two writes of the marks.
STEPS = 3


class Rows:
    """A table in the shared folder that rounds append to; its plan stays as small as a file list."""

    def __init__(self, like: DataFrame):
        self.spark, self.schema, self.paths = like.sparkSession, like.schema, []

    def add(self, more: DataFrame) -> DataFrame:
        """more, written once: read back alone for the next round, with all others at the end."""
        self.paths.append(fresh_path(self.spark))
        more.write.parquet(self.paths[-1])
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths) if self.paths else self.spark.createDataFrame([], self.schema)


def inner_nodes(edges: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(node, before, after, ahead, low, circle) of the nodes of distinct edges (src, dst) that one edge enters and one
    leaves, without those in kept (node): the nearest other nodes before and after each on its chain, and the edges to
    the latter. On a circle of such nodes only, low is its least member.

    Pointers double, so a chain of n takes log2(n) rounds.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("before")).where("n = 1").drop("n")
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("after")).where("n = 1").drop("n")
    rows = into.join(apart(out), "node").where("before <> after or before <> node")
    if kept is not None:
        rows = rows.join(apart(kept.select("node")), "node", "left_anti")
    now, last = written(rows.select("node", "before", "after", F.lit(1).cast("long").alias("ahead"), F.col("node").alias("low"), F.lit(False).alias("circle"))), None
    if now.isEmpty():
        return now
    while True:
        to = now.select(F.col("node").alias("after"), F.col("after").alias("to"), F.col("ahead").alias("more"), F.col("low").alias("least"))
        back = now.select(F.col("node").alias("before"), F.col("before").alias("from"))
        step = now.join(apart(to), "after", "left").join(apart(back), "before", "left")
        now = written(step.select("node", F.coalesce("from", "before").alias("before"), F.coalesce("to", "after").alias("after"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead"), F.least("low", "least").alias("low"), F.col("to").isNotNull().alias("circle")))
        # chains have ended when nothing moves; what still does goes in circles, until it knows its least member
        moved = now.where("circle").agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("node", "low").cast("decimal(38,0)")), F.lit(0))).first()
        if moved[0] == 0 or tuple(moved) == last:
            return now
        last = tuple(moved)


def _contracted(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """(src, dst, w): edges between nodes that are not inner, of 1, and one for each two that chains join, of the longest."""
    own = edges.join(apart(inner.select(F.col("node").alias("src"))), "src", "left_anti").join(apart(inner.select(F.col("node").alias("dst"))), "dst", "left_anti").select("src", "dst", F.lit(1).cast("long").alias("w"))
    chains = inner.where("not circle").groupBy(F.col("before").alias("src"), F.col("after").alias("dst")).agg((F.max("ahead") + 1).alias("w"))
    return own.unionByName(chains).groupBy("src", "dst").agg(F.max("w").alias("w"))


def reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): all that the roots (node) lead to over edges (src, dst), themselves included. Chains are walked as one step;
    each round writes only what it adds."""
    edges = written(edges.select("src", "dst").where("src <> dst").distinct())
    roots = written(roots.select("node").distinct())
    inner = inner_nodes(edges, roots)
    short = written(_contracted(edges, inner))
    seen = Rows(roots)
    front = seen.add(roots)
    while not front.isEmpty():
        front = seen.add(short.join(apart(front), short.src == front.node, "left_semi").select(F.col("dst").alias("node")).distinct().join(apart(seen.read()), "node", "left_anti"))
    within = inner.where("not circle").join(apart(seen.read().select(F.col("node").alias("before"))), "before", "left_semi").select("node")
    return seen.read().unionByName(within)


def _least_reached(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, mark): the least node that leads to each node, by label propagation along the edges."""
    now = written(nodes.select("node", F.col("node").alias("mark")))
    while True:
        told = edges.join(apart(now), edges.src == now.node).groupBy(F.col("dst").alias("node")).agg(F.min("mark").alias("new"))
        after = written(now.join(apart(told), "node", "left").select("node", F.least("mark", "new").alias("mark"), (F.coalesce("new", "mark") < F.col("mark")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("node", "mark")
        now = after.select("node", "mark")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges whose source something enters and whose destination something leaves: all of those within a component."""
    into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(apart(into), "src", "left_semi").join(apart(out), "dst", "left_semi").select("src", "dst")


def _ranked(both: DataFrame) -> DataFrame:
    """(node, first, last): a different number for each node at (at, way), the greatest ones where most edges meet."""
    degrees = both.groupBy(F.col("at").alias("node")).agg(F.count_if(F.col("way") > 0).alias("out"), F.count_if(F.col("way") < 0).alias("into"))
    score = F.least(F.col("out"), F.lit(11)) * F.least(F.col("into"), F.lit(11))
    seed = 0
    while True:
        rank = F.shiftleft(score, 56).bitwiseOR(F.xxhash64("node", F.lit(seed)).bitwiseAND(F.lit((1 << 56) - 1)))
        nodes = written(degrees.select("node", rank.alias("first")))
        if nodes.groupBy("first").count().where("count > 1").isEmpty():
            return nodes.select("node", "first", F.col("first").alias("last"))
        seed += 1


def _by_marks(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, ring) of the components found, and the edges (src, dst, first, last) that components not found yet may hold.

    Each node is marked with the node of the greatest number that leads to it and with the one that it leads to. Where
    both are the same, they form a component; all of one component agree in both, so only edges between nodes that
    agree are left. Numbers are dealt by a hash, so what lies one behind the other is halved, not taken off by one.
    """
    both = rest.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.lit(1).alias("way")).unionByName(rest.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(-1).alias("way")))
    now = _ranked(both)
    both = written(both.unionByName(now.select(F.col("node").alias("at"), F.col("node").alias("to"), F.lit(0).alias("way"))))
    told = [F.max(F.when(F.col("way") >= 0, F.col("first"))).alias("first"), F.max(F.when(F.col("way") <= 0, F.col("last"))).alias("last")]
    while True:
        for _ in range(STEPS - 1):
            now = both.join(now.hint("shuffle_hash"), F.col("at") == F.col("node")).groupBy(F.col("to").alias("node")).agg(*told)
        was = [F.max(F.when(F.col("way") == 0, F.col(c))).alias(f"{c}_was") for c in ("first", "last")]
        now = both.join(now.hint("shuffle_hash"), F.col("at") == F.col("node")).groupBy(F.col("to").alias("node")).agg(*told, *was)
        now = written(now.select("node", "first", "last", ((F.col("first") > F.col("first_was")) | (F.col("last") > F.col("last_was"))).alias("moved")))
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    same = now.where("first = last")
    ringed = same.join(apart(same.groupBy("first").agg(F.min("node").alias("ring"))), "first").select("node", "ring")
    open_ = now.where("first <> last")
    a, b = (open_.select(F.col("node").alias(c), "first", "last") for c in ("src", "dst"))
    return ringed, rest.join(apart(a), "src").join(apart(b), ["dst", "first", "last"]).select("src", "dst", "first", "last")


def _walked(edges: DataFrame) -> DataFrame:
    """(node, ring) of the components of several nodes, those of each task's edges (src, dst) by depth first walks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        edges = pa.Table.from_batches(held)
        names = pa.chunked_array(edges["src"].chunks + edges["dst"].chunks).unique()
        src, dst = (pc.index_in(edges[c], value_set=names).to_numpy() for c in ("src", "dst"))
        order, n = np.argsort(src, kind="stable"), len(names)
        to, ends = dst[order].tolist(), np.searchsorted(src[order], np.arange(1, n + 1)).tolist()
        at, low, seen, rings = [0, *ends[:-1]], [0] * n, 0, [-1] * n
        stack, path = [], []
        for root in range(n):
            if low[root]:
                continue
            path.append((root, seen + 1))
            while path:
                v, first = path[-1]
                if not low[v]:
                    low[v] = seen = first
                    stack.append(v)
                while at[v] < ends[v]:
                    w = to[at[v]]
                    if not low[w]:
                        path.append((w, seen + 1))
                        break
                    at[v] += 1
                    if rings[w] < 0 and low[w] < low[v]:
                        low[v] = low[w]
                else:
                    path.pop()
                    if low[v] == first:
                        while rings[v] < 0:
                            rings[stack.pop()] = v
        rings = np.array(rings)
        several = np.flatnonzero(np.bincount(rings, minlength=n)[rings] > 1)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(several)), names.take(pa.array(rings[several]))], ["node", "ring"])

    node = edges.schema["src"].dataType.simpleString()
    return edges.select("src", "dst").mapInArrow(run, f"node {node}, ring {node}")


def components(edges: DataFrame) -> DataFrame:
    """(node, ring): strongly connected components, ring being the least member.

    Only the edges are kept that components may still hold. A round drops those of nodes that nothing enters or leaves;
    where that is not a tenth of them, it draws chains of single edges together to one edge; where that is not a tenth
    either, nodes are marked along the edges. Of the classes that marks leave, those of up to 16,384 edges are dealt over
    tasks that walk them, larger ones go on. Nodes of a chain belong to a component if both of its ends do.
    """
    every = written(edges.select("src", "dst").distinct())
    rest = every.where("src <> dst")
    found, chains = Rows(every.select(F.col("src").alias("node"), F.col("src").alias("ring"))), []
    n = rest.count()
    while n:
        rest = written(_trimmed(_trimmed(rest)))
        left = rest.count()
        if left > 0.9 * n:
            inner = inner_nodes(rest)
            found.add(inner.where("circle").select("node", F.col("low").alias("ring")))
            chains.append(inner.where("not circle"))
            rest = written(_contracted(rest, inner).where("src <> dst").select("src", "dst"))
            left = rest.count()
        if left > 0.9 * n:
            ringed, held = _by_marks(rest)
            found.add(ringed)
            held = written(held)
            sizes = held.groupBy("first", "last").count()
            small = written(held.join(apart(sizes.where(F.col("count") <= ROWS)), ["first", "last"], "left_semi"))
            found.add(_walked(dealt(small, "first", "last", most=MOST)))
            rest = written(held.join(apart(sizes.where(F.col("count") > ROWS)), ["first", "last"], "left_semi").select("src", "dst"))
            left = rest.count()
        n = left
    told = found.read()
    for inner in reversed(chains):
        # a node that is in no component told is one by itself
        ends = [told.select(F.col("node").alias(c), F.col("ring").alias(f"ring_{c}")) for c in ("before", "after")]
        one = inner.join(apart(ends[0]), "before", "left").join(apart(ends[1]), "after", "left")
        one = one.select("node", F.coalesce("ring_before", "before").alias("ring"), F.coalesce("ring_after", "after").alias("other")).where("ring = other")
        told = written(told.unionByName(one.select("node", "ring")))
    least = told.groupBy("ring").agg(F.least(F.min("node"), F.col("ring")).alias("least"))
    nodes = every.select(F.col("src").alias("node")).union(every.select("dst")).distinct()
    ring = nodes.join(apart(told), "node", "left").select("node", F.coalesce("ring", "node").alias("ring"))
    return ring.join(apart(least), "ring", "left").select("node", F.coalesce("least", "ring").alias("ring"))


def rings(edges: DataFrame) -> DataFrame:
    """(ring, size, members): components of more than one node."""
    return components(edges).groupBy("ring").agg(F.count("*").alias("size"), F.array_join(F.sort_array(F.collect_list("node")), ",").alias("members")).where("size > 1")


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): 0 where nothing outside the node's own ring is needed, else 1 over the highest that is.

    Counted on the condensed graph with its chains drawn together; rounds go by what is left of its longest path.
    """
    ring = written(components(edges))
    a, b = ring.select(F.col("node").alias("src"), F.col("ring").alias("ra")), ring.select(F.col("node").alias("dst"), F.col("ring").alias("rb"))
    over = written(edges.join(apart(a), "src").join(apart(b), "dst").where("ra <> rb").select(F.col("ra").alias("src"), F.col("rb").alias("dst")).distinct())
    inner = inner_nodes(over)
    short = written(_contracted(over, inner))
    outer = ring.select(F.col("ring").alias("r")).distinct().join(apart(inner.select(F.col("node").alias("r"))), "r", "left_anti")
    now = written(outer.select("r", F.lit(0).cast("long").alias("level")))
    while True:
        needed = short.join(apart(now), short.dst == now.r).groupBy(F.col("src").alias("r")).agg(F.max(F.col("level") + F.col("w")).alias("new"))
        after = written(now.join(apart(needed), "r", "left").select("r", F.coalesce("new", F.lit(0)).alias("level"), (F.coalesce("new", F.lit(0)) != F.col("level")).alias("moved")))
        if after.where("moved").isEmpty():
            break
        now = after.select("r", "level")
    chained = inner.join(apart(after.select(F.col("r").alias("after"), "level")), "after").select(F.col("node").alias("r"), (F.col("level") + F.col("ahead")).alias("level"))
    every = after.select("r", "level").unionByName(chained)
    return ring.join(apart(every), ring.ring == every.r).select("node", "level")


def unit_fold(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, inside, out, into, needs, needed_by, instability) of weighted edges (src, dst, weight) and (node, unit)."""
    a, b = units.select(F.col("node").alias("src"), F.col("unit").alias("ua")), units.select(F.col("node").alias("dst"), F.col("unit").alias("ub"))
    pairs = edges.join(a, "src").join(b, "dst").groupBy("ua", "ub").agg(F.sum("weight").alias("w"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("ua").alias("unit"), F.lit(True).alias("leaves"), F.col("ub").alias("other"), "w"), F.struct(F.col("ub").alias("unit"), F.lit(False).alias("leaves"), F.col("ua").alias("other"), "w"))).alias("x")).select("x.*")
    away = F.col("unit") != F.col("other")
    zero = F.lit(0)
    by = both.groupBy("unit").agg(
        F.coalesce(F.sum(F.when(~away & F.col("leaves"), F.col("w"))), zero).alias("inside"), F.coalesce(F.sum(F.when(away & F.col("leaves"), F.col("w"))), zero).alias("out"), F.coalesce(F.sum(F.when(away & ~F.col("leaves"), F.col("w"))), zero).alias("into"),
        F.count(F.when(away & F.col("leaves"), 1)).alias("needs"), F.count(F.when(away & ~F.col("leaves"), 1)).alias("needed_by"),
    )
    return by.withColumn("instability", F.when(F.col("needs") + F.col("needed_by") > 0, F.col("needs") / (F.col("needs") + F.col("needed_by"))).otherwise(F.lit(0.0)))


def same_people(names: DataFrame, least: int = 5) -> DataFrame:
    """(id, person): identities (id, name) whose normalised names begin one another, as one person, the least id.

    Names are lowered letters and digits; only those of `least` characters or more meet. Each different name is linked
    with its longest beginning that is itself a name, which connects what begins one another without comparing pairs.
    """
    plain = written(names.select("id", F.regexp_replace(F.lower("name"), "[^a-z0-9]", "").alias("name")))
    known = plain.where(F.length("name") >= least).groupBy("name").agg(F.min("id").alias("first"))
    heads = known.where(F.length("name") > least).select("name", F.explode(F.transform(F.sequence(F.lit(least), F.length("name") - 1), lambda n: F.left(F.col("name"), n))).alias("head"))
    met = heads.join(known.select(F.col("name").alias("head"), F.col("first").alias("dst")), "head")
    pairs = met.groupBy("name").agg(F.max_by("dst", F.length("head")).alias("dst")).join(known, "name").select(F.col("first").alias("src"), "dst")
    edges = written(pairs.union(pairs.select("dst", "src")).distinct())
    marks = _least_reached(edges, known.select(F.col("first").alias("node"))).join(known, F.col("node") == F.col("first"))
    return plain.join(marks.select("name", "mark"), "name", "left").select("id", F.coalesce("mark", "id").alias("person"))


def _holes(segments: str) -> Column:
    """A digit for each segment, 1 where it is open."""
    return F.array_join(F.transform(segments, lambda s: F.when(s == "*", "1").otherwise("0")), "")


def route_links(clients: DataFrame, endpoints: DataFrame, hosts: list[str] | DataFrame | None = None) -> DataFrame:
    """(client, endpoint, score, how): each client (id, method, path, host) with the endpoint that it calls best.

    A client that names a host counts if that is a local one or one of hosts, a list or a table (host).
    Up to four leading segments of the client may be a base address that the endpoint does not know; the fewest that
    find an endpoint count. Scores are 4 for each literal segment less those dropped and less 1 for a verb that only
    one side leaves open; ties go to the smaller endpoint id. Sides meet on all segments that are literal in both: their
    forms, which tell where the open ones stand, are paired first, and of the endpoints that agree in a pair's segments
    and in the verb only the smallest id is met. So a client meets as many endpoints as there are forms and verbs.
    """
    parts = lambda c: F.filter(F.split(c, "/"), lambda p: p != "")
    local = (F.col("host") == "") | F.col("host").rlike(LOCAL)
    named = F.lower(F.regexp_replace("host", r":\d+$", ""))
    if isinstance(hosts, DataFrame):
        ours = hosts.select(F.lower("host").alias("_host")).distinct().withColumn("_ours", F.lit(True))
        clients = clients.join(ours, named == F.col("_host"), "left")
        local = local | F.coalesce("_ours", F.lit(False))
    elif hosts:
        local = local | named.isin(*map(str.lower, hosts))
    want = clients.where(local).select(F.col("id").alias("client"), F.col("method").alias("asked"), parts(F.col("path")).alias("said"))
    tails = want.where(F.size("said") > 0).select("client", "asked", "said", F.explode(F.sequence(F.lit(0), F.least(F.lit(4), F.size("said") - 1))).alias("dropped"))
    tails = tails.withColumn("said", F.expr("slice(said, dropped + 1, size(said) - dropped)")).withColumn("n", F.size("said"))
    tails = tails.withColumn("said", F.transform("said", F.lower)).withColumn("open", _holes("said"))
    told = endpoints.select(F.col("id").alias("endpoint"), F.col("method").alias("answers"), parts(F.col("path")).alias("segs")).where(F.size("segs") > 0)
    told = told.withColumn("wide", F.element_at(F.reverse("segs"), 1) == "**").withColumn("k", F.size("segs") - F.col("wide").cast("int")).where("k > 0")
    # a ** elsewhere leaves a segment over at the end, which only an open one of the client meets
    own = F.transform(F.filter("segs", lambda s: s != "**"), F.lower)
    told = told.withColumn("segs", F.concat(own, F.array_repeat(F.lit("/"), F.col("k") - F.size(own)))).withColumn("holes", _holes("segs"))
    forms, asked = told.select("wide", "k", "holes").distinct(), tails.select("n", "open").distinct()
    pairs = forms.join(asked, (F.col("n") == F.col("k")) | (F.col("wide") & (F.col("n") >= F.col("k")))).withColumn("cut", F.left("open", F.col("k")))
    is_ = lambda c, i, bit: F.substring(F.col(c), i, F.lit(1)) == bit
    every = F.sequence(F.lit(1), "k")
    pairs = pairs.withColumn("at", F.filter(every, lambda i: is_("holes", i, "0") & is_("cut", i, "0"))).withColumn("loose", F.exists(every, lambda i: is_("holes", i, "0") & is_("cut", i, "1")))
    pairs = written(pairs.where(F.size("at") >= F.when(F.col("loose"), 2).otherwise(1)).drop("loose"))
    form = ["wide", "k", "holes", "cut"]
    key = lambda c: F.array_join(F.transform("at", lambda i: F.get(F.col(c), i - 1)), "/").alias("key")
    # pairs of forms are as many as there are ways to place open segments, not as rows
    ends = told.join(F.broadcast(pairs.select(*form, "at").distinct()), form[:3]).groupBy(*form, key("segs"), "answers").agg(F.min("endpoint").alias("endpoint"))
    wants = tails.join(F.broadcast(pairs), ["n", "open"]).select("client", "asked", "dropped", *form, F.size("at").alias("literal"), key("said"))
    met = wants.join(ends, [*form, "key"]).where((F.col("answers") == "ANY") | (F.col("asked") == "ANY") | (F.col("answers") == F.col("asked")))
    met = met.withColumn("score", (F.col("literal") * 4 - F.col("dropped") - (F.col("answers") != F.col("asked")).cast("int")).cast("long"))
    best = met.withColumn("place", F.row_number().over(Window.partitionBy("client").orderBy("dropped", F.desc("score"), "endpoint"))).where("place = 1")
    return best.select("client", "endpoint", "score", F.when(F.col("dropped") > 0, "tail").otherwise("exact").alias("how"))


def mounted(mounts: DataFrame, files: DataFrame) -> DataFrame:
    """(file, prefix): the prefixes under which each file (file) answers, joined along mounts (src, dst, prefix) from the
    files that nothing mounts, however many mounts that takes. A file that nothing leads to answers under ''. No path
    visits a file twice: only files of the ring that it is in can be met again, so only those are remembered until it
    leaves the ring, and paths that agree in file, prefix and these are one."""
    mounts = written(mounts.select("src", "dst", "prefix").distinct())
    every = files.select("file").union(mounts.select("src")).union(mounts.select("dst")).distinct()
    ring = written(components(mounts))
    crowded = written(ring.join(apart(ring.groupBy("ring").count().where("count > 1")), "ring", "left_semi"))
    a, b = (crowded.select(F.col("node").alias(c), F.col("ring").alias(f"ring_{c}")) for c in ("src", "dst"))
    met = mounts.where("src <> dst").join(apart(a), "src", "left").join(apart(b), "dst", "left")
    told = written(met.select("src", "dst", "prefix", F.col("ring_dst").isNotNull().alias("ringed"), F.coalesce(F.col("ring_src") == F.col("ring_dst"), F.lit(False)).alias("within")))
    roots = every.join(apart(mounts.select(F.col("dst").alias("file"))), "file", "left_anti").select("file", F.lit("").alias("prefix"), F.array().cast("array<string>").alias("seen"))
    found = Rows(roots)
    front = found.add(roots)
    slashless = F.regexp_replace(F.regexp_replace(F.concat(F.col("a"), F.lit("/"), F.col("prefix")), "/+", "/"), "/$", "")
    name = F.col("dst").cast("string")
    seen = F.when(F.col("within"), F.array_sort(F.concat("seen", F.array(name)))).when(F.col("ringed"), F.array(name)).otherwise(F.array().cast("array<string>"))
    while not front.isEmpty():
        steps = front.select(F.col("file").alias("src"), F.col("prefix").alias("a"), "seen").join(apart(told), "src").where(~F.col("within") | ~F.array_contains("seen", name))
        front = found.add(steps.select(F.col("dst").alias("file"), slashless.alias("prefix"), seen.alias("seen")).distinct())
    led = found.read().select("file", "prefix").distinct()
    return led.unionByName(every.join(apart(found.read().select("file").distinct()), "file", "left_anti").select("file", F.lit("").alias("prefix")))
