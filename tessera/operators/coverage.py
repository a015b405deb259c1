"""Coverage reports that lie about: what share of lines, branches and functions the tests reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.tolerant import document, held
from tessera.operators.manifests import lcov_coverage

# Where each kind of report lies below a folder, the first one counting.
REPORTS = (("istanbul", r"(^|/)coverage/coverage-summary\.json$"), ("coverage.py", r"(^|/)coverage\.json$"), ("lcov", r"(^|/)coverage/lcov\.info$"), ("lcov", r"(^|/)coverage\.lcov$"))
PARTS = ("lines", "statements", "branches", "functions")


def reports(files: DataFrame) -> DataFrame:
    """(folder, source, kind, lines, statements, branches, functions): the report of each folder of files (path, text) that
    has one, in per cent; null texts and those that do not parse are no reports.

    Istanbul's summary has its totals, coverage.py one share for lines and statements and none for functions, lcov counts
    that are summed. Of a folder's several reports the first in this order counts. What a report leaves out is 0.
    """
    path = F.col("path")
    kind, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (name, match) in reversed(list(enumerate(REPORTS))):
        kind, rank = F.when(path.rlike(match), name).otherwise(kind), F.when(path.rlike(match), i).otherwise(rank)
    folder = path
    for _, match in REPORTS:
        folder = F.regexp_replace(folder, match, "")
    told = files.where("text is not null").select(folder.alias("folder"), path.alias("source"), kind.alias("kind"), rank.alias("rank"), "text").where("kind is not null")
    json = told.where("kind <> 'lcov'").select("folder", "source", "kind", "rank", document(F.col("text")).alias("v"))
    number = lambda at: F.coalesce(held(F.col("v"), at, "double"), F.lit(0.0))
    there = lambda at: held(F.col("v"), at, "variant").isNotNull()

    def told_as(rows: DataFrame, shares: dict[str, Column]) -> DataFrame:
        return rows.select("folder", "source", "kind", "rank", *(shares[p].alias(p) for p in PARTS))

    summary = told_as(json.where((F.col("kind") == "istanbul") & there("$.total")), {p: number(f"$.total.{p}.pct") for p in PARTS})
    whole = number("$.totals.percent_covered")
    python = told_as(json.where((F.col("kind") == "coverage.py") & there("$.totals")), {"lines": whole, "statements": whole, "branches": number("$.totals.percent_covered_branches"), "functions": F.lit(0.0)})
    counts = lcov_coverage(told.where("kind = 'lcov'").select(F.col("source").alias("path"), "text"))
    lcov = told_as(told.where("kind = 'lcov'").drop("text").join(counts, F.col("source") == F.col("path")), {p: F.col("lines" if p == "statements" else p) for p in PARTS})
    every = summary.unionByName(python).unionByName(lcov)
    best = every.groupBy("folder").agg(F.min_by(F.struct("source", "kind", *PARTS), F.struct("rank", "source")).alias("b"))
    return best.select("folder", "b.*")
