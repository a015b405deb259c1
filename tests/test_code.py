"""Imports, endpoints, findings and fleets on rows told by hand."""

from pyspark.sql import functions as F

from tessera.operators import api, fleet, graph, imports, tasks


def told(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


FILES = [
    ("src/a.ts", "import x from './b'\nimport y from './c.js'\nimport '../../up'\nimport z from '@/deep'\nimport q from '@/none'\nimport 'kit/part'\nimport 'kit'\nimport 'far'\nimport '@s/far/x'\nimport '/abs'\nimport 'only'"),
    ("src/b.ts", "export * from './c'"), ("src/c.tsx", "export const c = 1\nexport class D {}\nfunction e() {}"), ("src/c.js", ""), ("alt/deep/index.ts", ""), ("lib/kit/part.ts", ""), ("lib/kit/main.ts", ""), ("low/only.mjs", ""), ("src/null.ts", None),
]


def test_resolved(spark):
    files = spark.createDataFrame(FILES, "path string, text string")
    homes = spark.createDataFrame([("kit", "lib/kit", "main.ts")], "name string, folder string, entry string")
    found = imports.resolved(files, [("@/*", ("src/*", "alt/*"))], homes, "low")
    assert told(found, "src", "specifier", "kind", "dst", "package") == {
        ("src/a.ts", "./b", "file", "src/b.ts", None), ("src/a.ts", "./c.js", "file", "src/c.tsx", None), ("src/a.ts", "../../up", "missing", None, None), ("src/a.ts", "@/deep", "file", "alt/deep/index.ts", None),
        ("src/a.ts", "@/none", "missing", None, None), ("src/a.ts", "kit/part", "file", "lib/kit/part.ts", None), ("src/a.ts", "kit", "file", "lib/kit/main.ts", None), ("src/a.ts", "far", "package", None, "far"),
        ("src/a.ts", "@s/far/x", "package", None, "@s/far"), ("src/a.ts", "/abs", "missing", None, None), ("src/a.ts", "only", "file", "low/only.mjs", None), ("src/b.ts", "./c", "file", "src/c.tsx", None),
    }
    all_ = imports.totals(found, files)
    assert told(all_, "part", "files", "edges", "external", "missing", "seen", "coverage") == {("", 9, 7, 2, 3, 12, 0.75)}
    assert told(imports.summed(all_), "files", "seen", "coverage") == {(9, 12, 0.75)}
    counts = imports.symbols(files)
    assert told(counts.where("path = 'src/c.tsx'"), "exports", "declares", "functions", "classes", "forwards") == {(2, 3, 1, 1, False)}
    assert told(imports.forwarding(found, counts).where("barrel"), "path") == {("src/b.ts",)}
    none = files.where("false")
    assert imports.resolved(none).count() == 0 and told(imports.summed(imports.totals(imports.resolved(none), none)), "files", "coverage") == {(0, 1.0)}


def test_siblings_and_folders(spark):
    files = spark.createDataFrame([("p/A.java", "class A { B b; }"), ("p/B.java", "class B { A a; }"), ("q/C.java", "A B")], "path string, text string")
    edges = spark.createDataFrame([("p/A.java", "p/B.java")], "src string, dst string")
    assert told(imports.siblings(files, edges), "src", "dst") == {("p/B.java", "p/A.java")}
    asked = spark.createDataFrame([("p/A.java", "p"), ("q/C.java", "p")], "src string, folder string")
    assert told(imports.into_folders(asked, files), "src", "dst") == {("p/A.java", "p/B.java"), ("q/C.java", "p/A.java"), ("q/C.java", "p/B.java")}


def test_tasks(spark):
    rows = spark.createDataFrame([(1, "a.ts", 5), (2, "a.ts", 7), (3, "b.ts", 1), (4, "b.ts", 1), (5, "tests/t.ts", 9), (6, "index.ts", 9)], "node long, file string, lines long")
    called = spark.createDataFrame([(4,)], "node long")
    assert told(tasks.open_exports(rows, called), "id", "place", "reach", "lines", "minutes") == {("open:surface", "a.ts", 3, 13, 7)}
    assert tasks.open_exports(rows, rows.select("node")).count() == 0
    deps = spark.createDataFrame([("a", True, False, "1", "GPL-3.0"), ("b", True, True, "1", "GPL-3.0"), ("c", True, False, "", None), ("d", True, False, "1", None), ("d", True, False, "2", "")], "name string, direct boolean, dev boolean, version string, licence string")
    warned = spark.createDataFrame([("b", "CRITICAL", "1"), ("b", None, "2"), ("z", "low", "1")], "name string, severity string, version string")
    assert told(tasks.dependencies(deps, warned), "id", "reach", "minutes") == {("advisory:b", 5, 4), ("licence:a", 1, 6), ("licence:d", 1, 6)}
    news = spark.createDataFrame([("b", "3"), ("b", "2")], "name string, newest string")
    assert told(tasks.installed(deps.where("name in ('a', 'b')"), warned, news), "name", "advisories", "newest") == {("a", 0, None), ("b", 1, "3")}
    units = spark.createDataFrame([("u", 60, "source"), ("v", 25, "source"), ("w", 90, "test")], "unit string, entries long, role string")
    assert told(tasks.wide_folders(units), "id", "reach", "minutes") == {("spread:u", 60, 45)}


def test_api(spark):
    ends = spark.createDataFrame([("1", "GET", "/a", "web"), ("2", "GET", "/a", "openapi"), ("3", "POST", "/a", "openapi")], "id string, method string, path string, framework string")
    calls = spark.createDataFrame([("x", "GET", "/a", "", "fetch"), ("y", "POST", "/b", "", "fetch"), ("z", "GET", "/q/a", "", "fetch")], "id string, method string, path string, host string, framework string")
    links, totals = api.joined(ends, calls)
    assert told(links, "client", "endpoint", "how") == {("x", "1", "exact"), ("z", "1", "tail")}
    assert told(totals, "endpoints", "described", "clients", "linked", "outside", "frameworks") == {(2, 1, 3, 2, 1, "fetch,openapi,web")}
    assert [tuple(r) for r in api.by_calls(api.held(ends), links).select("id", "calls").collect()] == [("1", 2), ("3", 0)]


def test_route_links_against_every_pair(spark):
    """Random sides against a comparison of every client with every endpoint."""
    import random

    deal = random.Random(7)
    seg = lambda: deal.choice(["a", "A", "b", "c", "*"])
    path = lambda n: "/" + "/".join(seg() for _ in range(n))
    ends = [(f"e{i:02}", deal.choice(["GET", "POST", "ANY"]), path(deal.randint(1, 3)) + deal.choice(["", "", "/**"])) for i in range(40)]
    asks = [(f"c{i:03}", deal.choice(["GET", "POST", "ANY"]), path(deal.randint(1, 5)), "") for i in range(150)]

    def fits(segs, said):
        wide = segs[-1] == "**"
        own = segs[:-1] if wide else segs
        if (len(said) < len(own)) if wide else (len(said) != len(own)):
            return None
        lit = loose = 0
        for s, t in zip(own, said):
            if s == "*":
                continue
            if t == "*":
                loose += 1
            elif s.lower() == t.lower():
                lit += 1
            else:
                return None
        return lit if lit >= (2 if loose else 1) else None

    want = set()
    for c, m, p, _ in asks:
        parts, best = p.strip("/").split("/"), []
        for d in range(min(4, len(parts) - 1) + 1):
            for e, am, ep in ends:
                n = fits(ep.strip("/").split("/"), parts[d:])
                if n is not None and (am == "ANY" or m == "ANY" or am == m):
                    best.append((d, -(n * 4 - d - (am != m)), e))
        if best:
            d, s, e = min(best)
            want.add((c, e, -s, "tail" if d else "exact"))
    out = graph.route_links(spark.createDataFrame(asks, "id string, method string, path string, host string"), spark.createDataFrame(ends, "id string, method string, path string"))
    assert told(out, "client", "endpoint", "score", "how") == want


def test_fleet(spark):
    rows = spark.createDataFrame([("r", "", "2024-01-01", 5), ("r", "a/b", "2024-01-03", 7), ("s", None, "2024-01-02", 1)], "repo string, path string, ts string, size long").withColumn("ts", F.col("ts").cast("timestamp"))
    assert told(fleet.rooted(rows, "repo", ["path"]), "path") == {("r",), ("r/a/b",), (None,)}
    days = fleet.sizes(rows, "repo", "ts", "size")
    assert sorted((str(r["at"])[:10], r["size"], r["repos"]) for r in days.collect()) == [("2024-01-01", 5, 1), ("2024-01-02", 6, 2), ("2024-01-03", 8, 2)]
    assert fleet.chosen(rows, "repo", ["s"]).count() == 1 and fleet.chosen(rows, "repo", []).count() == 3
