"""Graphs by brute force and of great depth, literals, paths, stacks and sorts on rows written by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import compare, graph, history, literals, paths, stack, units


def told(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def edges_of(spark, pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def plain(pairs):
    """(component, level) of each node, by closure."""
    nodes = {n for p in pairs for n in p}
    reach = {n: {n} for n in nodes}
    while True:
        more = {n: reach[n].union(*(reach[b] for a, b in pairs if a == n)) for n in nodes}
        if more == reach:
            break
        reach = more
    ring = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    level = {}

    def of(r):
        if r not in level:
            level[r] = max((of(ring[b]) + 1 for a, b in pairs if ring[a] == r and ring[b] != r), default=0)
        return level[r]

    return reach, ring, {n: of(ring[n]) for n in nodes}


@pytest.mark.parametrize(("seed", "nodes", "n"), [(1, 12, 14), (2, 40, 44), (3, 40, 120)])
def test_rings_levels_and_reach_of_random_graphs(spark, seed, nodes, n):
    rng = random.Random(seed)
    pairs = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)}
    # long chains between, into and out of what is there, and a circle by itself
    pairs |= {(100 + i, 101 + i) for i in range(9)} | {(0, 100), (109, 1), (200, 201), (201, 202), (202, 0), (300, 301), (301, 302), (302, 300)}
    reach, ring, level = plain(pairs)
    edges = edges_of(spark, pairs)
    assert {r["node"]: r["ring"] for r in graph.components(edges).collect()} == ring
    assert {r["node"]: r["level"] for r in graph.levels(edges).collect()} == level
    roots = [103, 5, 301, 777]
    want = set(roots).union(*(reach[r] for r in roots if r in reach))
    assert {r[0] for r in graph.reached(edges, spark.createDataFrame([(r,) for r in roots], "node long")).collect()} == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or kept(df))
    n = 10_000
    edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(edges_of(spark, [(n, n - 3)]))
    got = graph.components(edges).groupBy("ring").count().where("count > 1").collect()
    assert [tuple(r) for r in got] == [(n - 3, 4)] and len(rounds) < 60
    rounds.clear()
    assert graph.levels(edges).agg(F.max("level")).first()[0] == n - 3


def test_mounts_of_diamonds_and_rings(spark):
    rows = [(f"a{i}", f"b{i}{j}", "x") for i in range(8) for j in range(2)] + [(f"b{i}{j}", f"a{i + 1}", "/y") for i in range(8) for j in range(2)]
    rows += [("a8", "r", "/r"), ("r", "s", "/s/"), ("s", "r", "/t"), ("s", "q", "q"), ("alone", "alone2", "")]
    got = told(graph.mounted(spark.createDataFrame(rows, "src string, dst string, prefix string"), spark.createDataFrame([("solo",)], "file string")), "file", "prefix")
    # paths that agree are one, so the eight diamonds do not make 256
    whole = "/x/y" * 8
    assert {("a8", whole), ("r", whole + "/r"), ("s", whole + "/r/s"), ("q", whole + "/r/s/q"), ("solo", ""), ("alone", ""), ("alone2", "")} <= got
    assert len(got) == 1 + 8 * 3 + 3 + 3 and ("r", whole + "/r/s/t") not in got


def test_rings_one_under_the_other_take_few_rounds(spark, monkeypatch):
    # each number leads to the two of twice it, each fifth back to a quarter of it, as registered mounts do
    n = 3_000
    pairs = {(k // 2, k) for k in range(1, n)} | {(k, k // 4) for k in range(20, n, 5)}
    above = {k: {k} for k in range(n)}  # nothing leads into a node's subtree but from above it, so rings are told from the leaves on
    for k in reversed(range(1, n)):
        above[k // 2] |= above[k]
    out = {k: {k // 4} if k >= 20 and k % 5 == 0 else set() for k in range(n)}
    ring = {}
    for top in range(n):
        if top in ring:
            continue
        back, grown = {top}, True
        while grown:
            new = {k for k in above[top] - back if out[k] & back or (2 * k in back or 2 * k + 1 in back)}
            grown = bool(new)
            back |= new
        ring |= {k: top for k in back if k not in ring}
    rounds = []
    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or kept(df))
    got = {r["node"]: r["ring"] for r in graph.components(edges_of(spark, pairs)).collect()}
    assert got == ring and len(rounds) < 45


def test_marks_tell_one_ring_from_those_before_and_behind_it(spark):
    ringed, left = graph._by_marks(edges_of(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3)]))
    found, still = told(ringed, "node", "ring"), told(left, "src", "dst")
    assert (found, still) in (({(1, 1), (2, 1)}, {(3, 4), (4, 3)}), ({(3, 3), (4, 3)}, {(1, 2), (2, 1)}))


@pytest.mark.parametrize("seed", [5, 6])
def test_rings_by_marks_alone(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "ROWS", 0)  # no class is small enough for one task
    rng = random.Random(seed)
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(100)} | {(70, 71), (71, 72), (72, 70), (71, 70), (72, 71), (70, 72)}
    assert {r["node"]: r["ring"] for r in graph.components(edges_of(spark, pairs)).collect()} == plain(pairs)[1]


def test_mounts_of_itself_and_of_rings_left(spark):
    # c and d follow two rings one after the other; what was passed in the first is forgotten in the second
    rows = [("r", "a", "/p"), ("a", "a", "x"), ("a", "b", ""), ("b", "a", ""), ("a", "c", "/q"), ("b", "c", "/q"), ("c", "d", "/s"), ("d", "c", "/t"), ("d", "e", "")]
    got = told(graph.mounted(spark.createDataFrame(rows, "src string, dst string, prefix string"), spark.createDataFrame([("r",)], "file string")), "file", "prefix")
    assert got == {("r", ""), ("a", "/p"), ("b", "/p"), ("c", "/p/q"), ("d", "/p/q/s"), ("e", "/p/q/s")}


def test_tangles_with_flags(spark):
    # X and Y depend on each other by types only in one direction; P and Q really, through a ring of files; M and N without one
    edges = [(1, 2, False), (2, 1, True), (3, 4, False), (4, 3, False), (5, 6, False), (7, 8, False), (1, 3, False)]
    of = {1: "X", 2: "Y", 3: "P", 4: "Q", 5: "M", 8: "M", 6: "N", 7: "N"}
    rows, parts = spark.createDataFrame(edges, "src long, dst long, type boolean"), spark.createDataFrame(list(of.items()), "node long, unit string")
    assert told(units.flagged_tangles(rows, parts), "tangle", "size", "edges", "runtime", "deep") == {("X", 2, 2, False, False), ("P", 2, 2, True, True), ("M", 2, 2, True, False)}
    assert told(units.ring_edges(rows, parts), "src", "dst", "n") == {("P", "Q", 1), ("Q", "P", 1)}


def test_literals(spark):
    files = {
        "src/a.ts": "const x = 'said in many of the files'\nimport 'imported by this very module'\nf('imported by this very module', './path/that/is/long/enough', \"don't stop at the other quote\", `short`)\n'a \\\\ backslash is never in one of these'\n'open until the end of the line\n",
        "src/b.tsx": "'said in many of the files' 'said in many of the files' \"p-4 m-2 flex items-center\" '0123456789abcdef0123456789abcdef' 'M10 20 30 40 50 60 70 80 90 100'", "src/c.js": "'said in many of the files'",
        "vendor/d.js": "'said in many of the files'", "src/e.min.js": "'said in many of the files'", "src/f.py": "'said in many of the files'", "tests/g.ts": "'only tests and mocks say this'", "tests/h.ts": "'only tests and mocks say this'", "src/x.mock.ts": "'only tests and mocks say this'", "src/n.ts": None,
    }
    found = literals.literals(spark.createDataFrame(list(files.items()), "path string, text string"))
    assert told(found, "path", "said") == {
        ("src/a.ts", "said in many of the files"), ("src/a.ts", "don't stop at the other quote"), ("src/b.tsx", "said in many of the files"), ("src/b.tsx", "p-4 m-2 flex items-center"), ("src/c.js", "said in many of the files"),
        ("tests/g.ts", "only tests and mocks say this"), ("tests/h.ts", "only tests and mocks say this"), ("src/x.mock.ts", "only tests and mocks say this"),
    }
    more = found.unionByName(spark.createDataFrame([(f"src/y{i}.ts", s) for i in range(5) for s in ("flex p-4 m-2 text-center", "hover:p-4 hover:m-12345678")], "path string, said string"))
    assert [tuple(r) for r in literals.repeated(more).collect()] == [("flex p-4 m-2 text-center", 5, True, "src/y0.ts", 120), ("said in many of the files", 3, False, "src/a.ts", 75)]
    assert literals.repeated(found.where("false")).count() == 0


def test_containers(spark):
    held = spark.createDataFrame([("src/*",), ("src/a",), ("src/a/b/c",), ("src/a/b#part",), ("lib/x/y",), ("lib/x/z/w",), ("libs",)], "path string")
    asked = ["src/a", "src/a/b", "src/a/b/q.ts", "src/z", "src", "lib", "lib/x", "other", "libs/q", "src/*", None, ""]
    got = told(paths.nearest_container(spark.createDataFrame([(p,) for p in asked], "path string"), held), "path", "container", "how")
    assert got == {
        ("src/a", "src/a", "same"), ("src/a/b", "src/a/b#part", "over"), ("src/a/b/q.ts", "src/a/b#part", "over"), ("src/z", "src/*", "over"), ("src", "src/*", "over"), ("lib", "lib/x/y", "under"), ("lib/x", "lib/x/y", "under"),
        ("other", None, None), ("libs/q", "libs", "over"), ("src/*", "src/*", "same"),
    }


def test_preorder_by_walking(spark):
    rng = random.Random(4)
    nodes = {"": 0}
    for _ in range(150):
        up = rng.choice(list(nodes))
        nodes[f"{up}/n{rng.randrange(9)}".lstrip("/")] = rng.randrange(5)
    got = {r["path"]: (r["depth"], r["place"]) for r in paths.preorder(spark.createDataFrame(list(nodes.items()), "path string, w long"), "w").collect()}
    want = {}

    def walk(path, depth):
        want[path] = (depth, len(want) + 1)
        below = [p for p in nodes if p and (p.rsplit("/", 1)[0] if "/" in p else "") == path]
        for p in sorted(below, key=lambda p: (-nodes[p], p)):
            walk(p, depth + 1)

    walk("", 0)
    assert got == want


def test_marks_packages_and_parts(spark):
    rules = [(0, "boxes", None, "stem", "Dockerfile", None, None, None, None), (1, "strict", "on", "stem", "tsconfig", r"\.json$", "strict", None, "s"), (2, "strict", "off", "stem", "tsconfig", r"\.json$", None, None, "s"), (3, "ports", None, "name", "Dockerfile", None, None, r"EXPOSE (\d+)", None), (4, "ci", "CI", "below", ".ci/flows", None, None, None, None), (5, "apps", "iOS", "folder", "ios", None, None, None, None)]
    files = [("r", "Dockerfile", "EXPOSE 1 EXPOSE 2"), ("r", "a/Dockerfile", "EXPOSE 2"), ("r", "vendor/Dockerfile", "EXPOSE 3"), ("r", "tsconfig.base.json", "strict"), ("r", "b/tsconfig.json", "{}"), ("r", "tsconfigs.json", "strict"), ("r", ".ci/flows/x/y.yml", None), ("r", "x/.ci/flows/y.yml", None), ("q", "x/ios/y/Z.m", None), ("q", "Dockerfile", None)]
    got = told(stack.marks(spark.createDataFrame(files, "repo string, path string, text string"), spark.createDataFrame(rules, stack.RULE)), "repo", "facet", "label", "files", "first")
    assert got == {
        ("r", "boxes", "Dockerfile", 2, "Dockerfile"), ("r", "strict", "on", 1, "tsconfig.base.json"), ("r", "strict", "off", 1, "b/tsconfig.json"), ("r", "ports", "1", 1, "Dockerfile"), ("r", "ports", "2", 2, "Dockerfile"), ("r", "ci", "CI", 1, ".ci/flows/x/y.yml"),
        ("q", "apps", "iOS", 1, "x/ios/y/Z.m"), ("q", "boxes", "Dockerfile", 1, "Dockerfile"),
    }
    labels = spark.createDataFrame([("frameworks", "react", "React"), ("frameworks", "@x/", "Vue"), ("frameworks", "@x/k", "Koa"), ("connects", "react", "Wire")], "facet string, key string, label string")
    asked = spark.createDataFrame([("r", "g:react", "Maven", 2), ("r", "react", "npm", 5), ("r", "@x/k", "npm", 1), ("q", "@x/other", "npm", 1), ("q", "reactive", "npm", 1)], "repo string, name string, ecosystem string, place int")
    facets = stack.packaged(asked, labels)
    assert told(facets, "repo", "facet", "label", "package", "ecosystem") == {("r", "frameworks", "React", "g:react", "Maven"), ("r", "connects", "Wire", "g:react", "Maven"), ("r", "frameworks", "Koa", "@x/k", "npm"), ("q", "frameworks", "Vue", "@x/other", "npm")}
    manifests = spark.createDataFrame([("r", 0, True, False), ("s", 3, False, True)], "repo string, packages int, workspaces boolean, bin boolean")
    both = facets.select("repo", "facet", "label").unionByName(spark.createDataFrame([("q", "apps", "iOS"), ("q", "compose", "Compose")], "repo string, facet string, label string"))
    assert told(stack.parts(both, manifests), "repo", "place", "part") == {("r", 0, "frontend"), ("r", 1, "backend"), ("r", 2, "monorepo root"), ("r", 3, "monorepo"), ("q", 0, "frontend"), ("q", 1, "ios"), ("q", 2, "infra"), ("s", 0, "cli")}


def test_three_states_of_a_sort(spark):
    rows = spark.createDataFrame([(1, "beta", 10), (2, "Alpha", 9), (3, "alpha", 100), (4, None, None), (5, "äpfel", 9)], "k long, name string, n long")
    sort, seen = None, []
    for key in ("name", "name", "name", "n", "name", "name", "n"):
        sort = compare.cycled(sort, key)
        seen.append(sort)
    assert seen == [("name", False), ("name", True), None, ("n", False), ("name", False), ("name", True), ("n", False)]
    by = lambda s: [r["k"] for r in rows.orderBy(*compare.order_of(rows, s, "k")).collect()]
    assert by(("name", True)) == [4, 3, 2, 5, 1] and by(("name", False)) == [1, 5, 2, 3, 4] and by(None) == [1, 2, 3, 4, 5]
    assert by(("n", False)) == [3, 1, 2, 5, 4] and by(("n", True)) == [4, 2, 5, 1, 3]


def test_zoom_shows_all_where_nothing_overlaps(spark):
    rows = spark.createDataFrame([(1, 0, 9), (2, 10, 19), (3, 20, 29)], "k int, a int, b int")
    zoom = lambda x, y: {r["k"] for r in history.zoomed(rows, "a", "b", F.lit(x), F.lit(y)).collect()}
    assert zoom(9, 10) == {1, 2} and zoom(40, 50) == {1, 2, 3} and zoom(12, 13) == {2}
