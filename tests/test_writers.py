"""Text formats written and read back, and transcripts as a stream and as a table."""

import datetime
import html
import json
import os
import re
import tomllib

import pytest
from pyspark.sql import functions as F

from tessera.sources import formats
from tessera.streaming import transcripts

ROWS = [("plain", 1, 1.5, True), ("it's \"said\" | a\\b\n2", -7, None, False), (None, None, 0.25, None), ("007", 10**12, -2.0, True), ("42", 0, 3.0, None), ("<b> & é 日本", 5, 1e-7, False)]


@pytest.fixture(scope="module")
def rows(spark):
    formats.register(spark)
    return spark.createDataFrame(ROWS, "`a name` string, n long, x double, ok boolean")


def saved(rows, kind, at, mode="overwrite"):
    rows.write.format("tessera_table").option("as", kind).option("name", "my rows").mode(mode).save(str(at))
    assert not [f for f in os.listdir(at) if not f.startswith("part-")]
    return [open(os.path.join(at, f), encoding="utf-8").read() for f in sorted(os.listdir(at))]


def test_toml_reads_back(rows, tmp_path):
    texts = saved(rows.repartition(2), "toml", tmp_path / "t")
    got = [r for t in texts for r in tomllib.loads(t).get("my_rows", [])]
    want = [{k: 42 if v == "42" else v for k, v in zip(("a_name", "n", "x", "ok"), r, strict=True) if v is not None} for r in ROWS]
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(got, key=key) == sorted(want, key=key)
    # a second write takes the first one's place, an appended one stands beside it
    assert len(saved(rows.coalesce(1), "toml", tmp_path / "t")) == 1
    assert len(saved(rows.coalesce(1), "toml", tmp_path / "t", "append")) == 2


def test_padded_tables(rows, tmp_path):
    plain = rows.where("n is not null and not contains(`a name`, '\n')").coalesce(1)
    (text,) = saved(plain, "markdown", tmp_path / "m")
    lines = text.split("\n")
    assert lines[:2] == ["## my rows", ""] and set(lines[3]) == set("|- ")
    assert [c.strip() for c in lines[2].strip("|").split("|")] == ["a name", "n", "x", "ok"]
    assert len({len(line) for line in lines[2:-1]}) == 1 and len(lines[4:-1]) == plain.count()
    (text,) = saved(plain, "grid", tmp_path / "g")
    assert len({len(x) for x in text.split("\n")[:-1]}) == 1 and text.startswith("a name  ")
    (text,) = saved(rows.coalesce(1), "sheet", tmp_path / "s")
    cells = re.findall(r"<td( x:num)?>(.*?)</td>", text, re.S)
    assert [html.unescape(c) for _, c in cells] == [formats.shown(v) for r in ROWS for v in r]
    assert [bool(n) for n, _ in cells] == [formats.number(v) for r in ROWS for v in r]


def test_no_rows_and_failed_tasks(spark, rows, tmp_path):
    assert "".join(saved(rows.where("false"), "toml", tmp_path / "none")) == ""
    saved(rows.coalesce(1), "toml", tmp_path / "kept")
    before = os.listdir(tmp_path / "kept")
    bad = rows.repartition(2).withColumn("n", F.when(F.col("a name") == "007", F.raise_error(F.lit("broken"))).otherwise(F.col("n")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        saved(bad, "toml", tmp_path / "kept")
    assert os.listdir(tmp_path / "kept") == before
    with pytest.raises(Exception, match="as: one of"):
        saved(rows, "odt", tmp_path / "odd")


def line(kind, *parts, **more):
    return json.dumps({"type": kind, "message": {"content": list(parts)}} | more)


def said(text):
    return {"type": "text", "text": text}


TALK = [
    '{"type": "system", "subtype": "init"}', line("assistant", said("Hel")), line("assistant", said("lo "), {"type": "odd"}, said(" ")), "", "  ", line("user", {"type": "tool_result", "is_error": False, "content": "fine"}), line("assistant", said("again"), {"type": "tool_use", "name": "Read", "input": {"n": 1, "path": "p" * 130}}),
    line("assistant", {"type": "tool_use", "name": "Do", "input": {"b": [1], "a": "é"}}), line("user", {"type": "tool_result", "is_error": True, "content": "c" * 250}, {"type": "tool_result", "is_error": True, "content": [{"x": 1}]}), "not json", line("assistant", said("joined")), "[1]", "5",
    json.dumps({"type": "result", "total_cost_usd": 0.5, "is_error": True, "result": "went wrong"}), json.dumps({"type": "result", "total_cost_usd": 0.25}), line("assistant", said("after")), line("assistant", said("never ended")),
]
TURNS = [("agent", None, "Hello again"), ("tool", "Read", "p" * 120 + "…"), ("tool", "Do", '{"a":"é","b":[1]}'), ("note", None, "that failed: " + "c" * 200), ("note", None, 'that failed: [{"x":1}]'), ("agent", None, "not json\njoined"), ("note", None, "went wrong"), ("agent", None, "after")]


def cut(talk, size, day=1):
    text = "\n".join(TALK)
    start = datetime.datetime(2024, 1, day)
    return [(talk, i, start + datetime.timedelta(seconds=i), text[a : a + size]) for i, a in enumerate(range(0, len(text), size))]


CHUNK = "talk string, seq long, ts timestamp, chunk string"


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_transcripts_of_chunks(spark, size):
    chunks = spark.createDataFrame(cut("a", size)[::-1] + [("b", 0, None, None), (None, 0, None, "x\n")], CHUNK)
    got = transcripts.turns(chunks).orderBy("place").collect()
    assert [(r["who"], r["tool"], r["text"]) for r in got] == TURNS and [r["place"] for r in got] == list(range(1, len(TURNS) + 1))
    assert [tuple(r) for r in transcripts.costs(chunks).collect()] == [("a", 0.75, 2)]


def test_transcripts_as_a_stream(spark, tmp_path):
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rows = cut("a", 40) + cut("b", 90)
        # three files that cut both talks, then a later day that lets them end
        for k in range(3):
            part = [r for r in rows if r[1] * 3 // max(x[1] + 1 for x in rows if x[0] == r[0]) == k]
            spark.createDataFrame(part, CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for day in (3, 5):
            spark.createDataFrame([("z", day, datetime.datetime(2024, 1, day), "open\n")], CHUNK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        run = transcripts.followed(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
        run.awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out")).where("talk <> 'z'").orderBy("talk", "place").collect()
        for talk in ("a", "b"):
            own = [r for r in got if r["talk"] == talk]
            assert [(r["who"], r["tool"], r["text"]) for r in own[:-1]] == TURNS
            assert (own[-1]["who"], own[-1]["cost"], own[-1]["place"]) == (None, 0.75, len(TURNS) + 1)
    finally:
        spark.conf.unset(store)
