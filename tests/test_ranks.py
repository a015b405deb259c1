"""Ranks, caps, gaps, bundles and shares on small rows, nulls and empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import ranks


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_ranked_and_new(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 5), ("b", 1), (None, 2)], "unit string, n int")
    assert rows_of(ranks.ranked_within(rows, ["unit"], [F.desc("n")], 1)) == [("a", 5, 1), ("b", 1, 1), (None, 2, 1)]
    base = spark.createDataFrame([("m", 1), ("m", 2)], "measure string, thing long")
    head = spark.createDataFrame([("m", 1), ("m", 1), ("m", 2), ("m", 3), ("m", 4), ("m", 4)], "measure string, thing long")
    assert [tuple(r) for r in ranks.new_findings(base, head, "measure", "thing", 2).select("thing", "before", "now").orderBy("thing").collect()] == [(1, 1, 2), (4, 0, 2)]
    assert ranks.new_findings(base, head.where("false"), "measure", "thing").count() == 0


def test_gaps(spark):
    day = lambda d: dt.datetime(2024, 1, d, 5)
    rows = spark.createDataFrame([(1, day(1)), (1, day(3)), (1, day(3)), (2, day(2)), (2, None)], "who int, ts timestamp")
    got = {(r["kind"], r["at"].day): r["n"] for r in ranks.windowed_gaps(rows, "who", "ts").collect()}
    assert got == {(1, 1): 1, (1, 2): 0, (1, 3): 2, (2, 1): None, (2, 2): 1, (2, 3): None}
    assert ranks.windowed_gaps(rows.where("false"), "who", "ts").count() == 0


def test_bundles_and_shares(spark):
    units = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "node int, unit string")
    wires = spark.createDataFrame([(1, 2, 999), (1, 3, 1), (2, 3, 2), (3, 3, 5)], "src int, dst int, weight int")
    assert rows_of(ranks.bundled(wires, units)) == [("x", "y", 3), ("x/1", "x/2", 999), ("y/3", "y/3", 5)]
    assert rows_of(ranks.inside_share(wires, units)) == [("x", 999, 1002, 99), ("y", 5, 5, 100)]
    assert rows_of(ranks.within(wires, units.where("unit = 'x'"))) == [(1, 2, 999)]


def test_unions_spread_and_calls(spark):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, None, 0), (2, "z", 1), (2, "c", 1)], "who int, label string, at int")
    assert rows_of(ranks.ordered_union(rows, "who", "label", "at")) == [(1, "b,a"), (2, "c,z")]
    paths = spark.createDataFrame([("u/a/x",), ("u/a/y",), ("u/b",), ("v",), (None,)], "path string")
    assert rows_of(ranks.spread(paths, "path")) == [("u", 2, 1)]
    ends = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows_of(ranks.called(ends, spark.createDataFrame([(1,), (1,), (9,), (None,)], "id int"), "id")) == [(1, 2), (2, 0)]
