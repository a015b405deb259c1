"""Several repositories as one: keys under the repository's name, sizes summed over time, and a choice of repositories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rooted(rows: DataFrame, repo: str, keys: Sequence[str]) -> DataFrame:
    """rows with each of the keys under the name of its repository, so that nothing meets over repositories; the root,
    '', becomes the repository itself. Null keys stay null."""
    return rows.withColumns({k: F.when(F.col(k).isNotNull(), F.concat_ws("/", F.col(repo), F.when(F.col(k) != "", F.col(k)))) for k in keys})


def sizes(samples: DataFrame, repo: str, ts: str, size: str) -> DataFrame:
    """(at, size, repos): for each day from the first to the last, the last sizes of all repositories added up, and how
    many have one by then; size is null before any has. Within a repository the greatest size of a day counts.

    A repository's days become changes against its day before; those are summed by day, and then along the days, of which
    there is one row each. So repositories are never spread over all days.
    """
    days = samples.where(F.col(ts).isNotNull()).groupBy(F.col(repo).alias("_repo"), F.date_trunc("day", ts).alias("at")).agg(F.max(size).alias("held"))
    before = F.lag("held").over(Window.partitionBy("_repo").orderBy("at"))
    moved = days.where("held is not null and _repo is not null").select("at", (F.col("held") - F.coalesce(before, F.lit(0))).alias("more"), before.isNull().cast("long").alias("new"))
    changes = moved.groupBy("at").agg(F.sum("more").alias("more"), F.sum("new").alias("new"))
    axis = days.agg(F.min("at").alias("a"), F.max("at").alias("b")).where("a is not null").select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("at"))
    along = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return axis.join(changes, "at", "left").select("at", F.sum("more").over(along).alias("size"), F.coalesce(F.sum("new").over(along), F.lit(0)).alias("repos"))


def chosen(rows: DataFrame, repo: str, only: Sequence[str]) -> DataFrame:
    """rows of the named repositories; of all where none is named."""
    return rows.where(F.col(repo).isin(*only)) if only else rows
