"""JSON with comments and trailing commas, as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive throughout, so that no text makes the matcher go back or need a stack; what a string holds stays.
STRING = r'("(?:[^"\\]++|\\[\s\S])*+"?+)'
COMMENT = STRING + r"|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/)?+"
COMMA = STRING + r"|,(?=\s*+[}\]])"


def plain_json(text: Column) -> Column:
    """text without line and block comments and without commas before a closing bracket."""
    return F.regexp_replace(F.regexp_replace(text, COMMENT, "$1"), COMMA, "$1")


def document(text: Column) -> Column:
    """What a tolerant JSON text holds; null where it is none."""
    return F.try_parse_json(plain_json(text))


def held(value: Column, path: str, kind: str) -> Column:
    """What stands at a path of a VARIANT, if it is of that kind; else null."""
    return F.try_variant_get(value, path, kind)
