"""Clients and endpoints of routes against a plain comparison of all pairs."""

import random

from pyspark.sql import functions as F

from tessera.operators import api, graph


def plain(clients, ends):
    out = {}
    for c, asked, path in clients:
        said, best = [p for p in path.split("/") if p], None
        for d in range(min(5, len(said))):
            t = said[d:]
            for e, answers, route in ends:
                segs = [p for p in route.split("/") if p]
                wide = bool(segs) and segs[-1] == "**"
                k = len(segs) - wide
                if not segs or not (len(t) == k or wide and len(t) >= k) or not ("ANY" in (asked, answers) or asked == answers):
                    continue
                kinds = ["any" if s == "*" else "loose" if x == "*" else "literal" if s.lower() == x.lower() else "no" for s, x in zip(segs[:k], t)]
                n = kinds.count("literal")
                if "no" in kinds or n < (2 if "loose" in kinds else 1):
                    continue
                found = (d, -(n * 4 - d - (asked != answers)), e)
                best = min(best or found, found)
        if best:
            out[c] = (best[2], -best[1], "tail" if best[0] else "exact")
    return out


def test_links_of_random_routes(spark):
    rng = random.Random(4)
    some = lambda words, n: "/" + "/".join(rng.choice(words) for _ in range(n))
    ends = [(f"e{i}", rng.choice(["GET", "POST", "ANY"]), some(["a", "B", "c", "*"], rng.randint(1, 4)) + rng.choice(["", "", "/**"])) for i in range(150)]
    clients = [(i, rng.choice(["GET", "POST", "PUT", "ANY"]), some(["a", "b", "C", "*", "d"], rng.randint(0, 7))) for i in range(400)]
    want = plain(clients, ends)
    asked = spark.createDataFrame([(*c, "") for c in clients], "id long, method string, path string, host string")
    got = graph.route_links(asked, spark.createDataFrame(ends, "id string, method string, path string"))
    assert len(want) > 150
    assert {r["client"]: (r["endpoint"], r["score"], r["how"]) for r in got.collect()} == want


def test_routes_of_one_beginning_are_not_compared_in_pairs(spark):
    # 300,000 clients and as many endpoints that differ in their last segment only: 90,000,000,000 pairs
    rows = spark.range(300_000)
    path = F.concat(F.lit("/a/"), F.col("id").cast("string"))
    ends = rows.select(F.concat(F.lit("e"), "id").alias("id"), F.lit("GET").alias("method"), path.alias("path"))
    clients = rows.select("id", F.lit("GET").alias("method"), path.alias("path"), F.lit("").alias("host"))
    got = graph.route_links(clients, ends)
    assert got.where(F.concat(F.lit("e"), "client") == F.col("endpoint")).count() == 300_000


def test_calls_of_many_routes_of_one_beginning(spark):
    rows = spark.range(200_000)
    path = F.concat(F.lit("/a/"), F.col("id").cast("string"))
    ends = rows.select(F.concat(F.lit("e"), "id").alias("id"), F.lit("ANY").alias("method"), path.alias("path"), F.lit("web").alias("framework"))
    clients = rows.where("id % 2 = 0").select("id", F.lit("GET").alias("method"), path.alias("path"), F.lit("").alias("host"), F.lit("fetch").alias("framework"))
    links, _ = api.joined(ends, clients)
    assert {r["calls"]: r["n"] for r in api.by_calls(ends, links).groupBy("calls").agg(F.count("*").alias("n")).collect()} == {0: 100_000, 1: 100_000}
