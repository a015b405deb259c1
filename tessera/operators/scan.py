"""Files of a tree told by language, their exclusion, test suites, folders and endings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import files as P
from tessera.functions.scalars import role_of
from tessera.operators.text import line_classes


def judged(files: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """files (path, text) with lang and state: skipped (copies, output and globs), document, binary, unknown or read.

    Documents are told by their ending and keep their kind as language. A null text is a link or a file that is gone and
    counts as unknown, a null path as well.
    """
    state = (
        F.when(F.col("path").isNull(), "unknown").when(P.vendored(F.col("path")) | P.ignored(F.col("path"), globs), "skipped").when(P.document_of(F.col("path")).isNotNull(), "document").when(F.col("text").isNull(), "unknown")
        .when(P.binary(F.col("text")), "binary").when(F.col("lang") == "", "unknown").otherwise("read")
    )
    told = files.withColumn("lang", F.coalesce(P.document_of(F.col("path")), P.language_of(F.col("path"), F.coalesce("text", F.lit("")))))
    return told.withColumn("state", state)


def scanned(files: DataFrame, globs: Sequence[str] = ()) -> DataFrame:
    """(path, lang, code, comment, blank, indent, chars) of the files that are read, and of documents with zeros."""
    kept = judged(files, globs).where("state in ('read', 'document')")
    text = F.when(F.col("state") == "read", F.col("text")).otherwise("")
    counted = kept.select("path", "lang", F.length(text).cast("long").alias("chars"), line_classes(text, F.col("lang")).alias("l"))
    return counted.select("path", "lang", *(F.col(f"l.{c}").alias(c) for c in ("code", "comment", "blank", "indent")), "chars")


def by_language(scan: DataFrame, churn: DataFrame) -> DataFrame:
    """(lang, files, code, touches, last): scan folded by language, with the churn (path, touches, last) of its files."""
    rows = scan.join(churn, "path", "left")
    return rows.groupBy("lang").agg(F.count("*").alias("files"), F.sum("code").alias("code"), F.coalesce(F.sum("touches"), F.lit(0)).alias("touches"), F.max("last").alias("last"))


def endings(scan: DataFrame) -> DataFrame:
    """(ending, files) of all files that have one."""
    return scan.select(P.ending(F.col("path")).alias("ending")).where("ending <> ''").groupBy("ending").agg(F.count("*").alias("files"))


def primary_language(scan: DataFrame) -> DataFrame:
    """(lang, code): one row, the language with most code among those that a project is written in, ties to the name;
    none where no such file is."""
    by = scan.where(F.col("lang").isin(*P.CODE)).groupBy("lang").agg(F.sum("code").alias("code"))
    return by.orderBy(F.desc("code"), "lang").limit(1)


# Suites by the names of their files and by what declares a case.
SUITES = (
    ("javascript", r"\.[cm]?[jt]sx?$", r"(^|[\s;{}])(test|it)(\.\w+)?\s*\("),
    ("pytest", r"(^|/)(test_[^/]+|[^/]+_test)\.py$", r"(?m)^[^\S\n]*(?:async\s+)?def\s+test\w*\s*\("),
    ("go test", r"_test\.go$", r"(?m)^func\s+(?:Test|Fuzz|Example)\w*\s*\("),
    ("cargo test", r"\.rs$", r"#\[(?:\w+::)?test\]"),
)


def suites(files: DataFrame) -> DataFrame:
    """(runner, files, cases) of files (path, text). JavaScript counts where the path's role is test, Rust only where a
    file holds a case. Comments and strings are read as they stand."""
    rows = None
    own = files.where(~P.vendored(F.col("path")))
    for runner, named, case in SUITES:
        part = own.where(F.col("path").rlike(named)).select(F.lit(runner).alias("runner"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(case)).cast("long").alias("n"), role_of(F.col("path")).alias("role"))
        part = part.where("role = 'test'") if runner == "javascript" else part.where("n > 0") if runner == "cargo test" else part
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("runner").agg(F.count("*").alias("files"), F.sum("n").alias("cases"))


def folders(paths: DataFrame, under: str = "") -> DataFrame:
    """(folder, leaves, below): every folder at or under one with the files directly in it and all below it; '' is the root."""
    own = F.regexp_replace("path", "/?[^/]*$", "")
    parts = F.split(own, "/")
    above = F.when(own == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    rows = paths.select(own.alias("own"), F.explode(above).alias("folder"))
    by = rows.groupBy("folder").agg(F.count_if(F.col("own") == F.col("folder")).alias("leaves"), F.count("*").alias("below"))
    return by.where((F.col("folder") == under) | F.startswith("folder", F.lit(f"{under}/" if under else "")))


def folder_languages(scan: DataFrame, depth: int = 1) -> DataFrame:
    """(folder, lang, code, share): a language's share in the code of each folder at a depth, files above it left out."""
    parts = F.split("path", "/")
    rows = scan.where(F.size(parts) > depth).select(F.array_join(F.slice(parts, 1, depth), "/").alias("folder"), "lang", "code")
    by = rows.groupBy("folder", "lang").agg(F.sum("code").alias("code"))
    total = by.groupBy("folder").agg(F.sum("code").alias("total"))
    return by.join(total, "folder").select("folder", "lang", "code", F.when(F.col("total") > 0, F.round(F.col("code") / F.col("total"), 6)).otherwise(F.lit(0.0)).alias("share"))


def licence_files(files: DataFrame) -> DataFrame:
    """(licence, files, nested): what the licence files (path, text) at the root say; those further down are only counted,
    under null."""
    held = files.where(F.col("path").rlike(r"(?i)^(.*/)?(LICEN[SC]E|COPYING)(\..+)?$")).select(F.col("path").contains("/").alias("deep"), "text")
    said = held.select(F.when(~F.col("deep"), P.licence_said(F.coalesce("text", F.lit("")))).alias("licence"), F.col("deep").cast("long").alias("deep"))
    return said.groupBy("licence").agg(F.count("*").alias("files"), F.sum("deep").alias("nested"))
