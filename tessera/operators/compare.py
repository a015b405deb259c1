"""Two snapshots compared, rows merged by precedence, and the ranked list of findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(base: DataFrame, head: DataFrame, key: str, measure: str) -> DataFrame:
    """(key, was, now, added): by key, what both snapshots hold; `added` where only head has the key."""
    a = base.groupBy(key).agg(F.sum(measure).alias("was"))
    b = head.groupBy(key).agg(F.sum(measure).alias("now"))
    both = a.join(b, key, "full")
    return both.select(key, F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now"), F.col("was").isNull().alias("added"))


def first_named(rows: DataFrame, key: str, generic: str, at: str) -> DataFrame:
    """One row of each key: a specific one before a generic one, then the earliest."""
    w = Window.partitionBy(key).orderBy(F.col(generic).cast("int"), at)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def last_value_first_place(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row of each key: the latest one's values, at the place of the earliest."""
    values = [c for c in rows.columns if c not in (key, at)]
    return rows.groupBy(key).agg(F.min(at).alias(at), F.max(F.struct(at, *values)).alias("m")).select(key, at, *(F.col(f"m.{c}").alias(c) for c in values))


def ranked_tasks(parts: Sequence[DataFrame]) -> DataFrame:
    """Findings (id, kind, reach, minutes) of all generators, each id once, with their weight: reach by the minute."""
    every = parts[0].withColumn("seq", F.lit(0))
    for n, part in enumerate(parts[1:], 1):
        every = every.unionByName(part.withColumn("seq", F.lit(n)))
    once = last_value_first_place(every, "id", "seq").drop("seq")
    return once.withColumn("weight", F.round(F.col("reach") / F.greatest(F.col("minutes"), F.lit(1)), 6))


def matching(rows: DataFrame, text: str) -> DataFrame:
    """Rows of which any column holds the text, in either case."""
    found = F.lit(False)
    for c in rows.columns:
        found = found | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
    return rows.where(found)


def cycled(sort: tuple[str, bool] | None, key: str) -> tuple[str, bool] | None:
    """The next state of a sort (column, ascending) when a column is asked for: descending, ascending, none."""
    if sort is None or sort[0] != key:
        return key, False
    return None if sort[1] else (key, True)


def order_of(rows: DataFrame, sort: tuple[str, bool] | None, place: str) -> list[Column]:
    """How rows stand under a sort (column, ascending): numbers as numbers, text by a collation in which case decides last,
    ties by `place`, upwards in either direction. Without a sort they stand by `place`."""
    if sort is None:
        return [F.asc(place)]
    key, up = sort
    value = F.collate(F.col(key), "UNICODE") if dict(rows.dtypes)[key] == "string" else F.col(key)
    return [value.asc_nulls_first() if up else value.desc_nulls_last(), F.asc(place)]


def answered(documented: DataFrame, served: DataFrame) -> DataFrame:
    """The documented endpoints (method, path, ...) that no code serves under the same verb and path."""
    return documented.join(served.select("method", "path"), ["method", "path"], "left_anti")
