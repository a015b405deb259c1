"""Rows for export: guarded cells, numbers told from text, one flat row set, names hidden."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(cell: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets a quote before it; signed numbers stay."""
    number = cell.rlike(r"^[+-]?\d+(\.\d+)?$")
    return F.when(cell.rlike(r"^[=+\-@\t\r]") & ~number, F.concat(F.lit("'"), cell)).otherwise(cell)


def typed_number(cell: Column) -> Column:
    """The number that a text is, where it is written exactly as the number is; else null."""
    plain = cell.rlike(r"^-?(0|[1-9]\d{0,14})(\.\d*[1-9])?$") & (cell != "-0")
    return F.when(plain, cell.try_cast("double"))


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text with a header; every text cell is guarded."""
    kinds = dict(rows.dtypes)
    rows.select(*(guarded(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in rows.columns)).write.csv(path, header=True, sep=sep)


def wrapped(rows: DataFrame, kind: str, version: str = "1") -> DataFrame:
    """One JSON text a row, in an envelope that names its kind and version."""
    return rows.select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(kind).alias("kind"), F.struct(*rows.columns).alias("data"))).alias("value"))


def flat(things: DataFrame, links: DataFrame) -> DataFrame:
    """Things and links as one row set, the columns that a side lacks being null."""
    return things.withColumn("row", F.lit("thing")).unionByName(links.withColumn("row", F.lit("link")), allowMissingColumns=True)


def hidden(people: DataFrame, emails: Sequence[str] = ("email",), lists: Sequence[str] = ("also",)) -> DataFrame:
    """Without addresses: e-mail columns become empty and lists of other names empty lists."""
    out = people
    for c in emails:
        out = out.withColumn(c, F.lit(""))
    for c in lists:
        out = out.withColumn(c, F.array().cast("array<string>"))
    return out
