"""Transcripts that arrive in chunks of JSON lines: whole lines only, pieces of one speaker joined, costs summed.

`turns` reads a finished table of chunks, `followed` a stream of them with the same result. What a line says: text and tools of
an assistant, failed tools of a user, errors and costs of a result; a line that is no JSON is said as it stands. The last
line of a talk counts only once its line break has come.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions.tolerant import held

# What of a tool's input tells what it is about, in this order, and how much of it and of a failure is shown.
ABOUT, SHOWN, FAILED = ("file_path", "path", "command", "pattern", "url", "prompt"), 120, 200
TURN = "talk string, place long, who string, tool string, text string"
STATE = "rest string, who string, tool string, text string, place long, cost double, fed long"


def _cut(text: Column, most: int, mark: str = "") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def said_by(lines: DataFrame) -> DataFrame:
    """(talk, line, part, who, tool, text, cost): what the lines (talk, line, said) of talks say, in their order; a cost has a
    null speaker."""
    v = lines.where(F.trim("said") != "").withColumn("v", F.try_parse_json("said"))
    kind = held(F.col("v"), "$.type", "string")
    parts = v.where(kind.isin("assistant", "user")).select("talk", "line", kind.alias("kind"), F.posexplode(held(F.col("v"), "$.message.content", "array<variant>")).alias("part", "p"))
    at = lambda path, to="string": held(F.col("p"), path, to)
    whole = at("$.input", "variant")
    first = F.coalesce(*(F.coalesce(held(whole, f"$.{n}", "string")) for n in ABOUT), F.to_json(whole), F.lit("{}"))
    mine = F.col("kind") == "assistant"
    text, tool, failed = mine & (at("$.type") == "text") & (F.trim(at("$.text")) != ""), mine & (at("$.type") == "tool_use"), ~mine & (at("$.type") == "tool_result") & at("$.is_error", "boolean")
    content = at("$.content", "variant")
    content = F.coalesce(F.when(F.schema_of_variant(content) == "STRING", at("$.content")), F.to_json(content), F.lit('""'))
    rows = parts.select(
        "talk", "line", "part", F.when(text, "agent").when(tool, "tool").when(failed, "note").alias("who"), F.when(tool, at("$.name")).alias("tool"),
        F.when(text, at("$.text")).when(tool, _cut(first, SHOWN, "…")).when(failed, F.concat(F.lit("that failed: "), _cut(content, FAILED))).alias("text"), F.lit(None).cast("double").alias("cost"),
    ).where("who is not null")
    none = lambda c: F.lit(None).cast(c)
    raw = v.where("v is null").select("talk", "line", F.lit(0).alias("part"), F.lit("agent").alias("who"), none("string").alias("tool"), F.concat("said", F.lit("\n")).alias("text"), none("double").alias("cost"))
    ends = v.where(kind == "result").select("talk", "line", "v")
    wrong = held(F.col("v"), "$.is_error", "boolean") & (held(F.col("v"), "$.result", "string") != "")
    notes = ends.where(wrong).select("talk", "line", F.lit(0).alias("part"), F.lit("note").alias("who"), none("string").alias("tool"), held(F.col("v"), "$.result", "string").alias("text"), none("double").alias("cost"))
    costs = ends.select("talk", "line", F.lit(1).alias("part"), none("string").alias("who"), none("string").alias("tool"), none("string").alias("text"), F.coalesce(held(F.col("v"), "$.total_cost_usd", "double"), F.lit(0.0)).alias("cost"))
    return rows.unionByName(raw).unionByName(notes).unionByName(costs)


def lines_of(chunks: DataFrame) -> DataFrame:
    """(talk, line, said): the whole lines of chunks (talk, seq, chunk), which may be cut anywhere. A talk's chunks meet in one
    row, as a talk is what one reader follows."""
    joined = chunks.where("talk is not null").groupBy("talk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("chunk", F.lit("")).alias("chunk")))), lambda c: c["chunk"]), "").alias("text"))
    split = F.split("text", "\n", -1)
    return joined.select("talk", F.posexplode(F.slice(split, 1, F.size(split) - 1)).alias("line", "said"))


def turns(chunks: DataFrame) -> DataFrame:
    """(talk, place, who, tool, text) of finished chunks (talk, seq, chunk): consecutive pieces of an agent as one turn."""
    said = said_by(lines_of(chunks)).where("who is not null")
    order = Window.partitionBy("talk").orderBy("line", "part")
    goes_on = (F.col("who") == "agent") & F.coalesce(F.lag("who").over(order) == "agent", F.lit(False))
    placed = said.withColumn("new", (~goes_on).cast("long")).withColumn("place", F.sum("new").over(order))
    pieces = F.array_sort(F.collect_list(F.struct("line", "part", "who", "tool", "text")))
    return placed.groupBy("talk", "place").agg(pieces.alias("p")).select("talk", "place", F.col("p")[0]["who"].alias("who"), F.col("p")[0]["tool"].alias("tool"), F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


def costs(chunks: DataFrame) -> DataFrame:
    """(talk, cost, results): the sum of what the results of each talk cost."""
    return said_by(lines_of(chunks)).where("cost is not null").groupBy("talk").agg(F.sum("cost").alias("cost"), F.count("*").alias("results"))


def heard(line: str) -> Iterator[tuple[str | None, str | None, str, float]]:
    """(who, tool, text, cost) of what one line says, as said_by tells it."""
    if not line.strip(" "):
        return
    try:
        said = json.loads(line)
    except ValueError:
        yield "agent", None, line + "\n", 0.0
        return
    said = said if isinstance(said, dict) else {}
    shown = lambda x: x if isinstance(x, str) else json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    kind, content = said.get("type"), (said.get("message") or {}).get("content") if isinstance(said.get("message"), dict) else None
    for part in content if isinstance(content, list) else []:
        part = part if isinstance(part, dict) else {}
        if kind == "assistant" and part.get("type") == "text" and isinstance(part.get("text"), str) and part["text"].strip(" "):
            yield "agent", None, part["text"], 0.0
        elif kind == "assistant" and part.get("type") == "tool_use":
            given = part.get("input", {})
            first = next((given[n] for n in ABOUT if isinstance(given, dict) and given.get(n) is not None), given)
            text = shown(first)
            yield "tool", part.get("name"), text[:SHOWN] + "…" if len(text) > SHOWN else text, 0.0
        elif kind == "user" and part.get("type") == "tool_result" and part.get("is_error") is True:
            yield "note", None, "that failed: " + shown(part.get("content", ""))[:FAILED], 0.0
    if kind == "result":
        if said.get("is_error") is True and isinstance(said.get("result"), str) and said["result"]:
            yield "note", None, said["result"], 0.0
        yield None, None, "", float(said.get("total_cost_usd") or 0.0)


class Transcript(StatefulProcessor):
    """Keeps of each talk the unfinished line, the open turn and the cost. A turn is handed on when the next one begins, the
    last one with the cost when the talk has been quiet for `quiet_ms` of event time."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rest, who, tool, text, place, cost, fed = self.state.get() if self.state.exists() else ("", None, None, "", 0, 0.0, 0)
        out, last = [], 0
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            last = max(last, int(r.ts.timestamp() * 1000))
            *lines, rest = (rest + (r.chunk or "")).split("\n")
            for speaker, name, piece, more in (x for line in lines for x in heard(line)):
                cost += more
                if speaker is None:
                    continue
                if speaker == who == "agent":
                    text += piece
                    continue
                if who is not None:
                    out.append((key[0], place, who, tool, text, None))
                who, tool, text, place = speaker, name, piece, place + 1
        self.state.update((rest, who, tool, text, place, cost, max(fed, last)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(fed, last) + self.quiet_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, who, tool, text, place, cost, _ = self.state.get()
        self.state.clear()
        yield self._frame(([(key[0], place, who, tool, text, None)] if who is not None else []) + [(key[0], place + 1, None, None, None, cost)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["talk", "place", "who", "tool", "text", "cost"])

    def close(self) -> None:
        pass


def followed(chunks: DataFrame, quiet: str = "10 minutes", quiet_ms: int = 600_000) -> DataFrame:
    """The turns of streamed chunks (talk, seq, ts, chunk), and for each talk that has ended a row with its cost and no
    speaker. Chunks of a talk come in the order of seq from batch to batch. Needs a state store with timers (RocksDB)."""
    return chunks.withWatermark("ts", quiet).groupBy("talk").transformWithStateInPandas(Transcript(quiet_ms), outputStructType=TURN + ", cost double", outputMode="append", timeMode="EventTime")
