"""What grows with the tables goes to no single task and to no driver."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import files as kinds
from tessera.operators import configs, graph, history, imports, literals, markup, paths, units
from tessera.plans import catalog
from tessera.sources import tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """A folder with 40,000 parts in one file."""
    at = str(tmp_path_factory.mktemp("parts"))
    key = F.col("id")
    rows = spark.range(40_000).select(key.alias("p_partkey"), F.concat(F.lit("B"), (key % 5).cast("string")).alias("p_brand"), F.concat(F.lit("T"), (key % 3).cast("string")).alias("p_type"), (key % 7 + 1).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{at}/part.parquet")
    return at


def test_texts_of_one_file_are_made_by_several_tasks(spark, parts):
    assert tables.table(spark, parts, "part").rdd.getNumPartitions() == 1
    assert tables.code(spark, parts).rdd.getNumPartitions() == 3


def test_siblings_send_no_side_whole(spark, parts):
    files = tables.code(spark, parts)
    edges = files.select(F.col("path").alias("src"), F.col("path").alias("dst"))
    found = imports.siblings(files, edges)
    assert "Broadcast" not in plan_of(found)
    assert found.where("src like 'src/B0/m1000%'").count() == 0  # a brand's next key is five further on


def test_found_imports_and_files_meet_without_sending_them(spark, parts):
    files = tables.code(spark, parts)
    found = imports.resolved(files)
    assert "Broadcast" not in plan_of(found)
    assert "Broadcast" not in plan_of(imports.forwarding(found, imports.symbols(files)))


def test_imports_and_what_they_are_tried_as_are_dealt_by_their_rows(spark, parts, monkeypatch):
    monkeypatch.setattr(imports, "MOST", 20_000)
    found = imports.resolved(tables.code(spark, parts))
    assert found.rdd.getNumPartitions() == 24  # twice 240,000 imports by 20,000, however few bytes they are
    assert found.count() == 240_000 and found.select("src", "specifier").distinct().count() == 240_000


def test_ways_through_folders_are_walked_as_by_hand(spark):
    def by_hand(start, said):
        steps = []
        for p in f"{start}/{said}".split("/"):
            if p == ".." and not steps:
                return None
            steps = steps[:-1] if p == ".." else steps if p in ("", ".") else [*steps, p]
        return "/".join(steps)

    starts, said = ("", "a", "a/b", "a/./b", "a/../b", "a//b", "..", "/a", "a/", "a/b/c"), ("./x", "../x", "../../x", "..", ".", "", "x", "./../x", ".././x", "x//y", "..x/.y", "../..x", "x/..", "/x", "././x.js", "../../../x", "x/y/../../z", "...")
    rows = spark.createDataFrame([(a, b, by_hand(a, b)) for a in starts for b in said] + [("a", None, None)], "a string, b string, c string")
    assert rows.where(~F.col("c").eqNullSafe(imports.walked(F.col("a"), F.col("b")))).collect() == []


def test_a_text_is_read_once_for_literals_and_once_for_imports(spark):
    files = spark.createDataFrame([("a.ts", "say('one text that is long enough')\nimport a,\n b from 'x'\nx = require( \"./y\") + import('z\"z') // require('no')\n")], "path string, text string")
    found = literals.literals(files)
    assert plan_of(found).count("regexp_extract_all") == 2
    assert [r.said for r in found.collect()] == ["one text that is long enough"]
    assert files.select(markup.specifiers(F.col("text")).alias("s")).first().s == ["x", "./y", "z"]


def test_only_repeated_literals_are_split_into_classes(spark):
    rows = spark.createDataFrame([("a.ts", "flex p-4 m-2 text-center")], "path string, said string")
    plan = plan_of(literals.tasks(literals.repeated(rows)))
    assert "forall" not in plan[plan.rindex("Exchange hashpartitioning(said") :]


def test_signs_are_counted_by_code_points_and_kinds_of_blanks(spark):
    said = ["\U0001f600" * 4 + "1\t\n\x0b\f\r 9%|", "\U0001f600" * 6 + "1\t\n\x0b\f\r", "b\u00a0\u00a0\u00a0\u2003"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, said string")
    assert [r.m for r in rows.orderBy("i").select(kinds.machine_made(F.col("said")).alias("m")).collect()] == [True, False, False]


def test_graph_states_are_not_sent_whole(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4)], "src long, dst long")
    levels = graph.levels(edges)
    assert "Broadcast" not in plan_of(levels)
    assert {r["node"]: r["level"] for r in levels.collect()} == {1: 2, 2: 2, 3: 1, 4: 0}


def test_rings_are_not_sent_whole(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4)], "src long, dst long")
    rings = graph.components(edges)
    assert "Broadcast" not in plan_of(rings)
    assert {r["node"]: r["ring"] for r in rings.collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_configurations_are_read_by_several_tasks_and_not_sent(spark, parts):
    assert tables.projects(spark, parts).where("path like 'c%'").rdd.getNumPartitions() >= 3
    told = configs.merged(configs.read(tables.projects(spark, parts).where("path like 'c%.json'")))
    assert "Broadcast" not in plan_of(told)


def test_owners_are_grouped_by_tasks_for_their_number(spark, monkeypatch):
    monkeypatch.setattr(history, "MOST", 1_000)
    rows = spark.range(20_000)
    files = spark.range(100).select(F.col("id").alias("file"), F.concat(F.lit("a/b/f"), F.col("id").cast("string")).alias("path"))
    changes = rows.select(F.col("id").alias("hash"), (F.col("id") % 100).alias("file"))
    commits = rows.select(F.col("id").alias("hash"), (F.col("id") % 7).alias("who"))
    found = history.folder_owners(files, changes, commits)
    assert "REPARTITION_BY_NUM" in plan_of(found)
    assert {(r["folder"], r["people"]) for r in found.where("folder in ('a', 'a/b', 'a/b/f3')").collect()} == {("a", 7), ("a/b", 7), ("a/b/f3", 7)}


def test_places_are_not_sent_whole(spark):
    nodes = spark.createDataFrame([("", 3), ("a", 2), ("a/x", 2), ("b", 1)], "path string, w long")
    places = paths.preorder(nodes, "w")
    assert "Broadcast" not in plan_of(places)
    assert {r["path"]: r["place"] for r in places.collect()} == {"": 1, "a": 2, "a/x": 3, "b": 4}


def test_changes_of_idle_files_meet_them_once(spark):
    plan = plan_of(catalog.QUERIES["tasks_union"](spark, "/root/testdata/sf0.001"))
    assert "HashAggregate(keys=[l_partkey" in plan or "HashAggregate(keys=[file" in plan


def test_ring_edges_of_units_are_not_sent_whole(spark):
    edges = spark.createDataFrame([(1, 2, False), (2, 1, False)], "src long, dst long, type boolean")
    found = units.ring_edges(edges, spark.createDataFrame([(1, "a"), (2, "b")], "node long, unit string"))
    assert "Broadcast" not in plan_of(found)
    assert {tuple(r) for r in found.select("src", "dst", "n").collect()} == {("a", "b", 1), ("b", "a", 1)}
