"""Logs: churn, contributors, owners, calendars, buckets, carried values, windows, samples and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ancestors
from tessera.sources.tables import MOST, apart, dealt, written


def path_churn(files: DataFrame, changes: DataFrame, commits: DataFrame) -> DataFrame:
    """Every file with its touches, lines and newest touch; files without a change get zeros."""
    dated = changes.join(commits.select("hash", "ts"), "hash")
    churn = dated.groupBy("file").agg(F.count("*").alias("touches"), F.sum("ins").alias("ins"), F.sum("del").alias("del"), F.max("ts").alias("last"))
    return files.join(churn, "file", "left").select("path", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("touches", "ins", "del")), "last")


def tree_rollup(leaves: DataFrame, path: str, measures: Sequence[str]) -> DataFrame:
    """(path, files, measures...): each folder and leaf with the totals of all below it."""
    up = leaves.select(F.explode(ancestors(F.col(path))).alias("path"), *measures)
    return up.groupBy("path").agg(F.count("*").alias("files"), *(F.sum(m).alias(m) for m in measures))


def contributor_totals(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """(who, commits, ins, del, files, first, last)."""
    # lines by commit first: a commit has one author
    moved = changes.groupBy("hash").agg(F.sum("ins").alias("ins"), F.sum("del").alias("del"))
    totals = commits.join(moved, "hash", "left").groupBy("who").agg(F.count("*").alias("commits"), F.coalesce(F.sum("ins"), F.lit(0)).alias("ins"), F.coalesce(F.sum("del"), F.lit(0)).alias("del"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    touched = changes.select("hash", "file").join(commits.select("hash", "who"), "hash").groupBy("who").agg(F.countDistinct("file").alias("files"))
    return totals.join(touched, "who", "left").select("who", "commits", "ins", "del", F.coalesce("files", F.lit(0)).alias("files"), "first", "last")


def folder_owners(files: DataFrame, changes: DataFrame, commits: DataFrame) -> DataFrame:
    """(folder, who, touches, people): who touched a folder's files most, ties to the smaller number."""
    # the tasks of each grouping are as many as its rows ask for
    lines, paths = changes.count(), files.count()
    touches = dealt(changes.join(apart(commits.select("hash", "who")), "hash"), "file", n=lines, most=MOST).groupBy("file", "who").agg(F.count("*").alias("n"))
    above = files.select("file", F.explode(F.expr("slice(transform(sequence(0, size(split(path, '/'))), n -> array_join(slice(split(path, '/'), 1, n), '/')), 2, size(split(path, '/')))")).alias("folder"))
    by = dealt(touches.join(apart(above), "file"), "folder", "who", n=lines * (above.count() // max(paths, 1) + 1), most=MOST).groupBy("folder", "who").agg(F.sum("n").alias("n"))
    return by.groupBy("folder").agg(F.max(F.struct("n", (-F.col("who")).alias("w"))).alias("m"), F.count("*").alias("people")).select("folder", (-F.col("m.w")).alias("who"), F.col("m.n").alias("touches"), "people")


def calendar(rows: DataFrame, ts: str, unit: str, measures: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """Measures by unit ('day' or 'hour') from the first to the last one, zeros where nothing was."""
    seen = rows.groupBy(F.date_trunc(unit, ts).alias("at")).agg(*(m.alias(n) for m, n in zip(measures, names, strict=True)))
    ends = seen.agg(F.min("at").alias("a"), F.max("at").alias("b"))
    axis = ends.select(F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("at"))
    return axis.join(seen, "at", "left").select("at", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def bucketed(rows: DataFrame, ts: str, grain: str, who: str) -> DataFrame:
    """(bucket, events, people) by calendar week (from Monday), month or year."""
    return rows.groupBy(F.date_trunc(grain, ts).alias("bucket")).agg(F.count("*").alias("events"), F.countDistinct(who).alias("people"))


def carried(days: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds carried_<value>: the last value at or before each row of a key; null before its first."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn(f"carried_{value}", F.last(value, ignorenulls=True).over(w))


def carried_days(rows: DataFrame, key: str, ts: str, value: str, name: str) -> DataFrame:
    """(key, at, <name>, carried_<name>): the greatest value of each key and day from the table's first day to its last,
    and the last one at or before it; null before a key's first."""
    seen = rows.groupBy(key, F.date_trunc("day", ts).alias("at")).agg(F.max(value).alias(name))
    ends = seen.agg(F.min("at").alias("a"), F.max("at").alias("b"))
    axis = seen.select(key).distinct().join(F.broadcast(ends)).select(key, F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("at"))  # one row
    return carried(axis.join(seen, [key, "at"], "left"), key, "at", name)


def ordinals(commits: DataFrame) -> DataFrame:
    """Adds ordinal: 1 for the oldest. Counts before each day, then order within the day, so no task sees the whole log."""
    day = F.to_date("ts")
    days = commits.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    before = days.select("day", (F.sum("n").over(Window.orderBy("day")) - F.col("n")).alias("before"))  # one row for each day
    within = commits.withColumn("day", day).withColumn("k", F.row_number().over(Window.partitionBy("day").orderBy("ts", "hash")))
    return within.join(before, "day").select("hash", "who", "ts", (F.col("before") + F.col("k")).alias("ordinal"))


def sampled(numbered: DataFrame, want: int) -> DataFrame:
    """Every k-th row of a numbered log from the first on and the last, k being the count over `want`, at least 1."""
    total = numbered.agg(F.max("ordinal").alias("total"))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / want))
    return numbered.join(F.broadcast(total)).where(((F.col("ordinal") - 1) % step == 0) | (F.col("ordinal") == F.col("total"))).drop("total")  # one row


def as_of(points: DataFrame, facts: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Each point with the value of the key's last fact at or before it: a union ordered by time, no range join."""
    both = points.select(key, at, F.col("id"), F.lit(None).cast(facts.schema[value].dataType).alias(value), F.lit(1).alias("side")).unionByName(facts.select(key, at, F.lit(None).cast(points.schema["id"].dataType).alias("id"), value, F.lit(0).alias("side")))
    w = Window.partitionBy(key).orderBy(at, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).where("side = 1").drop("side")


def rename_ends(raw: Column) -> tuple[Column, Column]:
    """Old and new path of a change, written as a{b => c}d or b => c; both are the path itself where it kept its name."""
    braces, plain = r"^(.*?)\{(.*?) => (.*?)\}(.*)$", r"^(.*?) => (.*)$"

    def end(inner: int, whole: int) -> Column:
        return F.when(raw.rlike(braces), F.concat(F.regexp_extract(raw, braces, 1), F.regexp_extract(raw, braces, inner), F.regexp_extract(raw, braces, 4))).when(raw.rlike(plain), F.regexp_extract(raw, plain, whole)).otherwise(raw)

    return end(2, 1), end(3, 2)


def followed(changes: DataFrame, hops: int = 20) -> DataFrame:
    """changes (seq from 0 for the newest, raw_path, ...) with path: the name that each changed file has today.

    Each round takes a path over its next later rename, found by a union in time order, until none moves.
    """
    old, new = rename_ends(F.col("raw_path"))
    rows = written(changes.withColumn("_id", F.xxhash64("seq", "raw_path")).withColumn("path", new).withColumn("_at", F.col("seq")))
    moves = written(changes.where(F.col("raw_path").contains(" => ")).select(old.alias("path"), new.alias("to"), F.col("seq").alias("_at")))
    held = ["_id", "path", "_at"]
    for _ in range(hops):
        asked = rows.select(*held).distinct()
        both = asked.withColumn("to", F.lit(None).cast("string")).unionByName(moves.withColumn("_id", F.lit(None).cast("long")))
        # newest first: the last rename seen before a change is the next one after it
        later = Window.partitionBy("path").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
        step = F.last(F.when(F.col("to").isNotNull(), F.struct("to", F.col("_at").alias("at"))), ignorenulls=True).over(later)
        next_ = written(both.withColumn("m", step).where("to is null and m is not null").select(*held, F.col("m.to").alias("to"), F.col("m.at").alias("at")))
        if next_.isEmpty():
            break
        rows = written(rows.join(next_, held, "left").withColumn("path", F.coalesce("to", "path")).withColumn("_at", F.coalesce("at", "_at")).drop("to", "at"))
    return rows.drop("_id", "_at")


def signed(commits: DataFrame, signers: Sequence[tuple[str, str]]) -> DataFrame:
    """(tool, commits) of commits (hash, author, body): how many each tool signed, as a bot author or in a trailer; a
    commit counts once for a tool. signers: (pattern, tool)."""
    trailers = F.filter(F.split("body", "\n"), lambda t: t.rlike(r"(?i)^\s*(co-authored-by|assisted-by|generated with)"))
    author = F.when(F.col("author").rlike(r"(?i)\[bot\]|noreply"), F.array("author")).otherwise(F.array().cast("array<string>"))
    claims = F.concat(author, F.coalesce(trailers, F.array().cast("array<string>")))

    def by(pattern: str, tool: str) -> Column:
        return F.when(F.exists("claims", lambda c: c.rlike(pattern)), F.lit(tool))

    tools = F.array_distinct(F.array_compact(F.array(*(by(p, t) for p, t in signers))))
    return commits.withColumn("claims", claims).select("hash", F.explode(tools).alias("tool")).distinct().groupBy("tool").agg(F.count("*").alias("commits"))


# Grains, the shortest span of days that each can show, and the longest, if it has one.
GRAINS = (("hour", 0, 31), ("day", 0, None), ("week", 7, None), ("month", 31, None), ("year", 365, None))


def grains(spans: DataFrame) -> DataFrame:
    """(key, days, offered, wanted, nearest): for spans (key, first, last, wanted) the grains that they can show, and of
    these the one that is nearest to the wanted one, ties to the finer."""
    names = [g for g, _, _ in GRAINS]
    days = F.date_diff("last", "first")
    fits = F.array_compact(F.array(*(F.when((F.col("days") >= low) & (F.lit(True) if high is None else F.col("days") <= high), F.struct(F.lit(i).alias("i"), F.lit(g).alias("g"))) for i, (g, low, high) in enumerate(GRAINS))))
    want = F.array_position(F.array(*map(F.lit, names)), F.col("wanted")) - 1
    told = spans.withColumn("days", days).withColumn("fits", fits)
    near = F.array_min(F.transform("fits", lambda f: F.struct(F.abs(f["i"] - want).alias("away"), f["i"].alias("i"), f["g"].alias("g"))))
    return told.select("key", "days", F.array_join(F.transform("fits", lambda f: f["g"]), ",").alias("offered"), "wanted", F.coalesce(near["g"], F.lit("day")).alias("nearest"))


def zoomed(buckets: DataFrame, starts: str, ends: str, first: Column, last: Column) -> DataFrame:
    """The buckets that overlap the instants from first to last; all of them where none does. One flag decides."""
    inside = (F.col(starts) <= last) & (F.col(ends) >= first)
    some = buckets.agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("_some"))  # one row
    return buckets.join(F.broadcast(some)).where(~F.col("_some") | inside).drop("_some")
