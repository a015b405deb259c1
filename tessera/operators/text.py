"""Lines of text: classes, repeated lines, copied runs and wordy comments."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import nesting, tidy
from tessera.sources.tables import written

# Languages whose comments begin with #, and those of markup.
HASH = ("Python", "Shell", "YAML", "TOML", "Ruby", "Make", "Docker", "just")
MARKUP = ("HTML", "Markdown", "Vue", "Svelte", "xml")


def lines_of(text: Column) -> Column:
    """The lines; what ends the last one opens no other."""
    found = F.split(text, "\n", -1)
    ended = F.element_at(found, -1) == ""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.when(ended, F.slice(found, 1, F.size(found) - 1)).otherwise(found))


def line_classes(text: Column, lang: Column) -> Column:
    """struct<code, comment, blank, indent, block>: counts of lines by class, in one ordered fold over the lines."""
    hashed = F.coalesce(lang.isin(*HASH), F.lit(False))
    markup = F.coalesce(lang.isin(*MARKUP), F.lit(False))
    opens, closes = F.when(markup, "<!--").otherwise("/*"), F.when(markup, "-->").otherwise("*/")
    solo = F.when(hashed, "#").otherwise("//")
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("code"), zero.alias("comment"), zero.alias("blank"), zero.alias("indent"), F.lit(False).alias("block"))

    def step(acc: Column, told: Column) -> Column:
        line = told["line"]
        opened = ~hashed & F.startswith(line, opens)
        comment = acc["block"] | (line != "") & (F.startswith(line, solo) | opened)
        blank = ~acc["block"] & (line == "")
        code = ~comment & ~blank
        block = F.when(acc["block"], ~F.contains(line, closes)).otherwise(~F.startswith(line, solo) & opened & ~F.contains(line, closes))
        return F.struct((acc["code"] + code.cast("long")).alias("code"), (acc["comment"] + comment.cast("long")).alias("comment"), (acc["blank"] + blank.cast("long")).alias("blank"), (acc["indent"] + F.when(code, told["nesting"]).otherwise(zero)).alias("indent"), block.alias("block"))

    # each line is told once, before the fold uses what is told of it many times
    told = F.transform(lines_of(text), lambda raw: F.struct(tidy(raw).alias("line"), nesting(raw).alias("nesting")))
    return F.aggregate(told, start, step)


def language_report(docs: DataFrame) -> DataFrame:
    """By language: files, lines of each class, characters, tokens, mean nesting and share of all code."""
    counted = docs.select("lang", F.length("text").alias("chars"), line_classes(F.col("text"), F.col("lang")).alias("l"))
    by = counted.groupBy("lang").agg(F.count("*").alias("files"), *(F.sum(f"l.{c}").alias(c) for c in ("code", "comment", "blank", "indent")), F.sum("chars").alias("chars"))
    total = F.sum("code").over(Window.partitionBy())  # over the few languages
    return by.withColumn("tokens", F.floor(F.col("chars") / 4 + 0.5).cast("long")).withColumn("share", F.when(total > 0, F.round(F.col("code") / total, 6)).otherwise(F.lit(0.0)))


def seats(docs: DataFrame) -> DataFrame:
    """(doc_id, at, line): each line with its place from 0, trimmed and its blanks collapsed."""
    return docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("at", "raw")).select("doc_id", "at", F.regexp_replace(tidy(F.col("raw")), r"\s+", " ").alias("line"))


# What begins a line that begins no copy, and brackets that are no line by themselves.
DULL, BRACKETS, SHORT = ("//", "*", "/*", "import ", "export "), r"^[)\]}>,;]+$", 12


def dull(line: Column) -> Column:
    """Lines that are no part of a copy: short ones, comments, imports and bare brackets."""
    return functools.reduce(lambda a, b: a | b, (line.startswith(d) for d in DULL), (F.length(line) < SHORT) | line.rlike(BRACKETS))


def repeated_lines(docs: DataFrame, least: int = 24, spread: int = 3) -> DataFrame:
    """(line, files): lines of `least` characters or more that `spread` documents or more hold."""
    each = seats(docs).where(F.length("line") >= least).select("doc_id", "line").distinct()
    return each.groupBy("line").agg(F.count("*").alias("files")).where(F.col("files") >= spread)


def line_hashes(text: Column) -> Column:
    """The lines' hashes, null for dull ones."""

    def one(raw: Column) -> Column:
        return F.transform(F.array(F.regexp_replace(tidy(raw), r"\s+", " ")), lambda line: F.when(~dull(line), F.xxhash64(line)))[0]

    return F.transform(lines_of(text), one)


def copied_runs(docs: DataFrame, run: int = 5, common: int = 60) -> DataFrame:
    """(one, one_at, two, two_at, lines): `run` or more lines that are equal in two documents, places from 1.

    A copy begins at a line that 2 to `common` seats hold, paired with the next document's first seat of it, and where
    the lines before differ; it goes on as long as the lines are equal and not dull, common ones included. Lines travel
    as hashes; the `run` first ones are compared by one hash where the seats meet, the rest on the two documents'
    arrays. Null texts have no lines; a doc_id is expected once.
    """
    held = written(docs.select("doc_id", line_hashes(F.col("text")).alias("lines")))
    place = F.col("at")
    first_ones = F.slice("lines", place + 1, run)
    whole = F.when((F.size(first_ones) == run) & ~F.exists(first_ones, lambda x: x.isNull()), F.xxhash64(first_ones))
    all_seats = held.select("doc_id", F.posexplode("lines").alias("at", "line"), "lines").where("line is not null")
    all_seats = all_seats.select("doc_id", "at", "line", F.when(place > 0, F.get("lines", place - 1)).alias("before"), whole.alias("start"))
    frequent = all_seats.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n").between(2, common)).select("line")
    seated = written(all_seats.join(frequent, "line"))
    # the next document's first seat is the first later seat elsewhere
    first = seated.groupBy("line", "doc_id").agg(F.min(F.struct("at", "before", "start")).alias("seat"))
    after = Window.partitionBy("line").orderBy("doc_id")
    others = first.select("line", "doc_id", F.lead("doc_id").over(after).alias("two"), F.lead("seat").over(after).alias("seat")).where("two is not null")
    met = seated.join(others, ["line", "doc_id"]).where((F.col("start") == F.col("seat.start")) & F.coalesce(F.col("before") != F.col("seat.before"), F.lit(True)))
    starts = met.select(F.col("doc_id").alias("one"), F.col("at").alias("one_at"), "two", F.col("seat.at").alias("two_at"))
    each = starts.join(held.select(F.col("doc_id").alias("one"), F.col("lines").alias("here")), "one").join(held.select(F.col("doc_id").alias("two"), F.col("lines").alias("there")), "two")
    rest = lambda lines, at: F.slice(lines, F.col(at) + 1, F.greatest(F.size(lines) - F.col(at), F.lit(0)))
    same = F.zip_with(rest("here", "one_at"), rest("there", "two_at"), lambda a, b: F.coalesce(a == b, F.lit(False)))
    ends = F.array_position(same, False)
    lines = F.when(ends > 0, ends - 1).otherwise(F.size(same)).cast("long")
    return each.select("one", (F.col("one_at") + 1).cast("long").alias("one_at"), "two", (F.col("two_at") + 1).cast("long").alias("two_at"), lines.alias("lines")).where(F.col("lines") >= run)


def comment_chars(text: Column) -> Column:
    """Characters of a text's comments, by an ordered fold."""
    start = F.struct(F.lit(0).cast("long").alias("said"), F.lit(False).alias("block"))

    def step(acc: Column, raw: Column) -> Column:
        line = tidy(raw)
        opened = line.startswith("/*")
        counts = acc["block"] | opened | line.startswith("//")
        block = (acc["block"] | opened) & ~line.contains("*/")
        return F.struct((acc["said"] + F.when(counts, F.length(line)).otherwise(0)).alias("said"), block.alias("block"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n", -1), start, step, lambda acc: acc["said"])


def talky(docs: DataFrame, enough: int = 8000, share: float = 0.4) -> DataFrame:
    """Documents with `enough` characters of comment that make up `share` of the text or more."""
    told = docs.select("doc_id", comment_chars(F.col("text")).alias("said"), F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "")).cast("long").alias("chars"))
    return told.withColumn("share", F.col("said") / F.greatest(F.col("chars"), F.lit(1))).where((F.col("said") >= enough) & (F.col("share") >= share))


def runs(turns: DataFrame, key: str = "conv_id", at: str = "turn", by: str = "role") -> DataFrame:
    """Consecutive turns of one role as one: first and last turn, their number and characters."""
    w = Window.partitionBy(key).orderBy(at)
    marked = turns.withColumn("new", F.coalesce((F.col(by) != F.lag(by).over(w)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(w))
    return marked.groupBy(key, "run", by).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
