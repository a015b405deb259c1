"""The engine's operators on rows written out: states and ties that the driver's tables do not hold."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import compare, exports, graph, history, markup, text
from tessera.streaming import activity


def edges(spark, *pairs):
    return spark.createDataFrame([*pairs], "src long, dst long")


@pytest.mark.parametrize(
    ("source", "lang", "expected"),
    [
        ("let a = 1\n\n// said\n/* one\n two */\nlet b = 2\n", "TypeScript", (2, 3, 1, 0)),
        ("# said\nx = 1\n// floor\n", "Python", (2, 1, 0, 0)),
        ("a()\r\n\r\n// b\r\n", "TypeScript", (1, 1, 1, 0)),
        ("<!-- a\nb -->\n    <p>\n\t\t\t</p>", "HTML", (2, 2, 0, 5)),
        ("", "Go", (0, 0, 0, 0)),
        (None, "Go", (0, 0, 0, 0)),
        ("\n\n", "Go", (0, 0, 2, 0)),
    ],
)
def test_line_classes(spark, source, lang, expected):
    row = spark.createDataFrame([(source, lang)], "t string, l string").select(text.line_classes(F.col("t"), F.col("l")).alias("x")).first()["x"]
    assert tuple(row)[:4] == expected


def test_copied_runs(spark):
    body = "\n".join(f"const value{i} = compute({i})" for i in range(6))
    docs = spark.createDataFrame([(1, "// a\n" + body), (2, "// b\n" + body), (3, ")\n}\n]")], "doc_id long, text string")
    assert [tuple(r) for r in text.copied_runs(docs, run=5).collect()] == [(1, 2, 2, 2, 6)]
    assert text.copied_runs(docs.where("doc_id = 3"), run=1).count() == 0
    assert text.copied_runs(docs.where("doc_id > 9")).count() == 0


def test_copied_runs_grow_through_shared_and_common_lines(spark):
    """A line that a document between holds, and one that most hold, do not cut a copy in two."""
    lines = [f"const value{i} = compute({i})" for i in range(9)]
    shared, common = lines[4], lines[6]
    rows = [(1, "\n".join(["// a", *lines])), (2, f"other text of its own\n{shared}"), (3, "\n".join(["x = another line of text", "", *lines])), (4, None)]
    rows += [(10 + i, f"line {i} of yet another text\n{common}") for i in range(70)]
    got = {tuple(r) for r in text.copied_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2, 3, 3, 9)}


def test_repeated_and_talky(spark):
    said = "one long sentence that is said again"
    docs = spark.createDataFrame([(i, f"{said}\nother {i}" if i < 3 else "/* " + "x" * 9000 + "\n*/\ncode") for i in range(4)], "doc_id long, text string")
    assert [tuple(r) for r in text.repeated_lines(docs).collect()] == [(said, 3)]
    assert text.repeated_lines(docs.where("doc_id < 2")).count() == 0
    assert [r["doc_id"] for r in text.talky(docs).collect()] == [3]


def test_transcript_runs(spark):
    turns = spark.createDataFrame([(1, 1, "agent", "a"), (1, 2, "agent", "b"), (1, 3, "tool", "c"), (1, 4, "agent", None)], "conv_id long, turn long, role string, text string")
    assert [(r["role"], r["turns"], r["chars"]) for r in text.runs(turns).orderBy("first").collect()] == [("agent", 2, 2), ("tool", 1, 1), ("agent", 1, None)]


def test_rings_levels_reach(spark):
    g = edges(spark, (1, 2), (2, 3), (3, 1), (9, 1), (3, 4), (5, 6), (6, 5), (4, 5), (7, 7))
    assert {(r["ring"], r["size"], r["members"]) for r in graph.rings(g).collect()} == {(1, 3, "1,2,3"), (5, 2, "5,6")}
    assert {r["node"]: r["level"] for r in graph.levels(g).collect()} == {5: 0, 6: 0, 4: 1, 1: 2, 2: 2, 3: 2, 9: 3, 7: 0}
    assert {r[0] for r in graph.reached(g, spark.createDataFrame([(4,)], "node long")).collect()} == {4, 5, 6}
    assert graph.rings(edges(spark, (1, 2))).count() == 0


def test_rings_by_brute_force(spark):
    import random

    rng = random.Random(6)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    reach = {n: {n} for p in pairs for n in p}
    for _ in range(31):
        for a, b in pairs:
            reach[a] |= reach[b]
    expected = {n: min(m for m in reach[n] if n in reach[m]) for n in reach}
    assert {r["node"]: r["ring"] for r in graph.components(edges(spark, *pairs)).collect()} == expected


def test_same_people(spark):
    names = spark.createDataFrame([(1, "Ada Lovelace"), (2, "ada-love"), (3, "ada"), (4, "Grace"), (5, "Grace Hopper"), (6, None)], "id long, name string")
    assert {r["id"]: r["person"] for r in graph.same_people(names).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}


@pytest.mark.parametrize(
    ("raw", "host", "path"),
    [("/a/:id/b?x=1", "", "/a/*/b"), ("https://x.org/a/{id}", "x.org", "/a/*"), ("/a/[id]/", "", "/a/*"), ("/f/[...rest]", "", "/f/*"), ("users/<int:id>", "", "/users/*"), ("//x.org", "x.org", "/"), ("/f/**", "", "/f/**"), (r"^/a/(?P<id>\d+)$", "", "/a/*")],
)
def test_routes(spark, raw, host, path):
    row = spark.createDataFrame([(raw,)], "r string").select(S.route_host(F.col("r")), S.route_path(F.col("r"))).first()
    assert tuple(row) == (host, path)


@pytest.mark.parametrize(("given", "label", "certain"), [((0, 0, 3, 0), "Module", True), ((10, 0, 0, 0), "Module", True), ((9, 1, 0, 1), "Module*", False), ((10, 90, 300, 3), "Shared", True), ((1, 9, 0, 3), "Entrypoint", True), ((10, 90, 5, 3), "Entrypoint*", True), ((10, 90, 40, 3), "Collection", True), ((10, 100, 100, 3), "Shared*", True), ((5, 5, 0, 1), "Module*", False)])
def test_shapes(spark, given, label, certain):
    row = spark.createDataFrame([given], "a long, b long, c long, d long")
    cols = [F.col(c) for c in "abcd"]
    assert tuple(row.select(S.shape(*cols), S.sure(*cols)).first()) == (label, certain)


def test_paths_and_pins(spark):
    rows = spark.createDataFrame([("src/a.ts",), ("src/tests/a.ts",), ("build.ts",), ("a/b_test/c.py",), ("docs/x.md",)], "p string")
    assert [r[0] for r in rows.select(S.role_of(F.col("p"))).collect()] == ["source", "test", "support", "test", "support"]
    pins = spark.createDataFrame([("^1.0",), ("~1",), ("1.2.3",), ("file:x",), (">=1",)], "p string")
    assert [r[0] for r in pins.select(S.pin(F.col("p"))).collect()] == ["caret", "tilde", "exact", "linked", "range"]


def test_imports(spark):
    files = spark.createDataFrame([("src/a.ts", "import x from './b'\n// import y from './no'\nexport * from '../lib'\nconst z = require('@s/pkg/deep')\nimport('./gone')"), ("src/b.ts", ""), ("lib/index.ts", None)], "path string, text string")
    assert {(r["specifier"], r["dst"]) for r in markup.resolved_imports(files).collect()} == {("./b", "src/b.ts"), ("../lib", "lib/index.ts"), ("./gone", None)}
    names = spark.createDataFrame([("@s/pkg/deep",), ("lodash/fp",), ("./x",)], "s string")
    assert [r[0] for r in names.select(markup.package_of(F.col("s"))).collect()] == ["@s/pkg", "lodash", None]


def test_calendar_and_carry(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 05:00:00", 1), ("a", "2024-01-04 00:00:00", 2)], "k string, t string, v long").withColumn("t", F.col("t").cast("timestamp"))
    days = history.calendar(rows, "t", "day", [F.count("*")], ["n"])
    assert [r["n"] for r in days.orderBy("at").collect()] == [1, 0, 0, 1]
    facts = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None)], "k string, at long, v long")
    assert [r["carried_v"] for r in history.carried(facts, "k", "at", "v").orderBy("at").collect()] == [None, 5, 5]
    assert history.calendar(rows.limit(0), "t", "day", [F.count("*")], ["n"]).count() == 0


def test_carried_days(spark):
    rows = [("a", "2023-12-30 05:00:00", 4), ("a", "2023-12-30 23:00:00", 2), ("b", "2024-02-01 12:00:00", 9), ("a", "2024-02-02 00:00:00", 1)]
    events = spark.createDataFrame(rows, "kind string, t string, event_id long").select("kind", F.col("t").cast("timestamp").alias("ts"), "event_id")
    got = {(r["kind"], str(r["at"])[:10]): (r["size"], r["carried_size"]) for r in history.carried_days(events, "kind", "ts", "event_id", "size").collect()}
    assert len(got) == 2 * 35
    assert got["a", "2023-12-30"] == (4, 4) and got["a", "2024-02-01"] == (None, 4) and got["a", "2024-02-02"] == (1, 1)
    assert got["b", "2024-01-31"] == (None, None) and got["b", "2024-02-01"] == (9, 9) and got["b", "2024-02-02"] == (None, 9)


def test_merging(spark):
    rows = spark.createDataFrame([("x", True, 1, "any"), ("x", False, 2, "express"), ("y", True, 3, "any")], "id string, generic boolean, seq long, framework string")
    assert {r["id"]: r["framework"] for r in compare.first_named(rows, "id", "generic", "seq").collect()} == {"x": "express", "y": "any"}
    assert {(r["id"], r["seq"], r["framework"]) for r in compare.last_value_first_place(rows, "id", "seq").collect()} == {("x", 1, "express"), ("y", 3, "any")}


def test_exports(spark, tmp_path):
    cells = spark.createDataFrame([("=1+1",), ("-5",), ("-x",), ("@a/b",), ("1.10",), ("12",), ("0123",), ("1e5",)], "c string")
    assert [r[0] for r in cells.select(exports.guarded(F.col("c"))).collect()] == ["'=1+1", "-5", "'-x", "'@a/b", "1.10", "12", "0123", "1e5"]
    assert [r[0] for r in cells.select(exports.typed_number(F.col("c"))).collect()] == [None, -5.0, None, None, None, 12.0, None, None]
    exports.write_csv(cells, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 8
    assert exports.wrapped(cells.limit(1), "cells").first()[0].startswith('{"version":"1","kind":"cells"')


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 00:00:0{i % 10}", i % 4, "ab"[i % 2], 1.0) for i in range(60)], "event_id long, t string, who long, kind string, value double").select("event_id", F.col("t").cast("timestamp").alias("ts"), "who", "kind", "value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = activity.windowed(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("held").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert sorted(spark.table("held").collect()) == sorted(activity.windowed(rows).collect())


def test_every_query_has_sql():
    import __spark_entry__ as e

    assert {n for n in e.queries() if not n.startswith(("op", "pipeline"))} == {n for n in e.oracle_sql() if not n.startswith(("op", "pipeline"))}
