"""Generators of findings (id, kind, reach, minutes): open exports, missing imports, dependencies, wide folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.files import in_suite, loaded_by_name
from tessera.functions.scalars import licence_family, minutes, spread_band

# What an advisory weighs.
SEVERITY = {"critical": 4, "high": 3, "moderate": 2, "low": 1}


def severity(said: Column) -> Column:
    found = F.when(F.lit(False), 0)
    for name, n in SEVERITY.items():
        found = found.when(F.lower(said) == name, n)
    return found.otherwise(1).cast("long")


def open_exports(declared: DataFrame, called: DataFrame, least: int = 3) -> DataFrame:
    """(id, kind, place, reach, lines, minutes): one row for all exported declarations (node, file, lines) that are not
    called (node), if there are `least` or more; place is the file with most of them, ties to the smaller. Suites and
    files that are loaded by name do not count."""
    rows = declared.join(called.select("node").distinct(), "node", "left_anti").where(~in_suite(F.col("file")) & ~loaded_by_name(F.col("file")))
    by = rows.groupBy("file").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))
    out = by.agg(F.sum("n").alias("reach"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.min(F.struct((-F.col("n")).alias("n"), "file")).alias("m")).where(F.col("reach") >= least)
    return out.select(F.lit("open:surface").alias("id"), F.lit("dead").alias("kind"), F.col("m.file").alias("place"), "reach", "lines", minutes(F.least("reach", F.lit(12)), F.lit(0)).alias("minutes"))


def missing_imports(found: DataFrame) -> DataFrame:
    """A finding for each missing import (src, specifier, kind, ...)."""
    one = F.lit(1).cast("long")
    return found.where("kind = 'missing'").select(F.concat(F.lit("missing:"), "src", F.lit(":"), "specifier").alias("id"), F.lit("broken").alias("kind"), one.alias("reach"), minutes(one, F.lit(0)).alias("minutes"))


def dependencies(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings of dependencies (name, direct, dev, version, licence): one for the advisories (name, severity) against a
    name, reaching the sum of what they weigh, and one for the licence of what ships, is installed and is strict, closed
    or not said. A name installed several times is one finding. Advisories are summed before they meet names."""
    weighed = advisories.groupBy("name").agg(F.sum(severity(F.col("severity"))).alias("reach"))
    told = deps.select("name").distinct().join(weighed, "name").select(F.concat(F.lit("advisory:"), "name").alias("id"), F.lit("security").alias("kind"), "reach", F.lit(4).cast("long").alias("minutes"))
    odd = deps.where(F.col("direct") & ~F.col("dev") & (F.col("version") != "") & licence_family(F.col("licence")).isin("strong", "closed", "unknown"))
    said = odd.select("name").distinct().select(F.concat(F.lit("licence:"), "name").alias("id"), F.lit("licence").alias("kind"), F.lit(1).cast("long").alias("reach"), F.lit(6).cast("long").alias("minutes"))
    return told.unionByName(said)


def wide_folders(units: DataFrame) -> DataFrame:
    """A finding for each unit (unit, entries, role) of sources whose band is oversize or bloated."""
    rows = units.where("role = 'source'").where(spread_band(F.col("entries")).isin("oversize", "bloated"))
    return rows.select(F.concat(F.lit("spread:"), "unit").alias("id"), F.lit("shape").alias("kind"), F.col("entries").alias("reach"), minutes(F.col("entries") * 0.5, F.lit(0)).alias("minutes"))


def asked(found: DataFrame, kind: str | None = None, most: int | None = None) -> DataFrame:
    """Findings with a weight (id, kind, reach, minutes, weight), the heaviest first, then the widest, ties to the id; of
    one kind and the first ones only, where that is asked for."""
    rows = (found if kind is None else found.where(F.col("kind") == kind)).orderBy(F.desc("weight"), F.desc("reach"), "id")
    return rows if most is None else rows.limit(most)


def totals(found: DataFrame) -> DataFrame:
    """(kind, tasks, reach, minutes) of findings."""
    return found.groupBy("kind").agg(F.count("*").alias("tasks"), F.sum("reach").alias("reach"), F.sum("minutes").alias("minutes"))


def installed(deps: DataFrame, advisories: DataFrame, registry: DataFrame) -> DataFrame:
    """deps (name, version, ...) with the number of advisories (name, version) against exactly that version and the newest
    version (name, newest) known; 0 and null where none is. Advisories are counted first."""
    told = advisories.groupBy("name", "version").agg(F.count("*").alias("advisories"))
    out = deps.join(told, ["name", "version"], "left").join(registry.groupBy("name").agg(F.max("newest").alias("newest")), "name", "left")
    return out.na.fill(0, ["advisories"])
