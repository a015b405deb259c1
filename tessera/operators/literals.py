"""Quoted literals of scripts, and those that several files repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.files import machine_made, vendored
from tessera.functions.scalars import minutes, role_of
from tessera.operators.markup import specifiers

# Which files are read, how long a literal is, in how many files it is worth a name (class lists need more and
# so many words), what names a thing by itself, and stand-ins that no folder gives away.
CODE, MINIFIED = r"\.(tsx?|jsx?|mts|cts)$", r"\.min\.[jt]s$"
LONG, SPREAD, WIDE, FEW = 24, 3, 5, 4
NAMED = r"^[./~@]|^https?:|^node:"
MOCK = r"(?i)(^|/|\.)(mock|mocks|stub|stubs|fake|fakes|fixture|fixtures)\.[cm]?[jt]sx?$"
QUOTED = r"""\"[^\"\\\n]*+\"|'[^'\\\n]*+'|`[^`\\\n]*+`"""
# What comes before a utility class, and the properties that one names.
VARIANTS = r"hover|focus|focus-visible|active|group|group-hover|peer|peer-focus|dark|first|last|odd|even|disabled|checked|open|sm|md|lg|xl|2xl|print|motion-safe|motion-reduce|rtl|ltr|data-\[[^\]]*\]|aria-\[[^\]]*\]|has-\[[^\]]*\]|max-\w+|min-\w+"
PROPERTIES = (
    "flex|grid|table|block|inline|inline-block|inline-flex|contents|hidden|absolute|relative|fixed|sticky|static|truncate|italic|underline|uppercase|lowercase|capitalize|antialiased|sr-only|group|text|bg|from|via|to|border|divide|ring|outline|shadow|rounded|opacity|font|leading|tracking|decoration|line|list|placeholder|caret|accent|fill|stroke|caption|"
    "p|px|py|pt|pb|pl|pr|ps|pe|m|mx|my|mt|mb|ml|mr|ms|me|w|h|size|min|max|gap|space|items|justify|content|self|place|order|col|row|basis|grow|shrink|flex-1|top|left|right|bottom|inset|z|overflow|overscroll|object|aspect|cursor|pointer|select|resize|transition|duration|delay|ease|animate|fade|zoom|slide|spin|transform|translate|rotate|scale|skew|origin|whitespace|break|tabular|align|indent|columns|backdrop|blur|brightness|container|touch|scroll"
)
UTILITY = rf"^(?:(?:{VARIANTS}):)*-?(?:{PROPERTIES})(?:-|$)"


def styled(said: Column) -> Column:
    """Whether a literal is a list of utility classes: several words, each of them one."""
    words = F.split(said, r"\s+")
    return (F.size(words) > 1) & F.forall(words, lambda w: w.rlike(UTILITY))


def literals(files: DataFrame) -> DataFrame:
    """(path, said): the different literals of each script of files (path, text) that somebody may have typed.

    A literal stands between two equal quotes on one line, without escapes. Short ones, paths and addresses, what a
    machine has made, and what the file imports do not count. Copies of others' code and minified files are not read;
    a null text has none.
    """
    ours = files.where(F.col("path").rlike(CODE) & ~vendored(F.col("path")) & ~F.col("path").rlike(MINIFIED))
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(QUOTED), F.lit(0)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2)))
    own = F.array_except(F.filter(found, lambda s: (F.length(s) >= LONG) & ~s.rlike(NAMED)), specifiers(F.col("text")))
    each = ours.select("path", F.explode(own).alias("said"))
    return each.where(~machine_made(F.col("said")))


def repeated(found: DataFrame) -> DataFrame:
    """(said, files, styled, first, weight): the literals (path, said) that enough files hold, unless only tests and stand-ins
    do; first is the least path. The greatest weight, files times length, comes first, ties by the literal."""
    real = (role_of(F.col("path")) != "test") & ~F.col("path").rlike(MOCK)
    by = found.groupBy("said").agg(F.count("*").alias("files"), F.bool_or(real).alias("real"), F.min("path").alias("first")).where(F.col("real") & (F.col("files") >= SPREAD))
    # said beside the count, or Spark would ask it of every literal of every file
    told = by.withColumn("styled", (F.col("files") >= SPREAD) & styled(F.col("said"))).where(~F.col("styled") | ((F.col("files") >= WIDE) & (F.size(F.split("said", r"\s+")) >= FEW)))
    return told.select("said", "files", "styled", "first", (F.col("files") * F.length("said")).alias("weight")).orderBy(F.desc("weight"), "said")


def tasks(told: DataFrame) -> DataFrame:
    """A finding (id, kind, reach, minutes) for each repeated literal that is words."""
    words = told.where("not styled")
    return words.select(F.concat(F.lit("text:"), "said").alias("id"), F.lit("text").alias("kind"), F.col("files").alias("reach"), minutes(F.col("files"), F.lit(0)).alias("minutes"))
