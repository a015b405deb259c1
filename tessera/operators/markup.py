"""Links and imports read from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import route_host, route_path

HREF = r'href="([^"]*)"'
#: Static, forwarding and dynamic imports and require calls of JavaScript; group 1, 2 or 3 names what is imported.
IMPORT = r"""(?m)^\s*(?:import|export)\s(?:[^'"()]*?\sfrom\s*)?['"]([^'"]+)['"]|\bimport\(\s*['"]([^'"]+)['"]|\brequire\(\s*['"]([^'"]+)['"]"""


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, href, host, path) of every link of every page, in order."""
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("place", "href"))
    return found.select("page_id", "place", "href", route_host(F.col("href")).alias("host"), route_path(F.col("href")).alias("path"))


def specifiers(source: Column) -> Column:
    """Array of what a JavaScript source imports. Comments are dropped first; strings are taken as they stand."""
    bare = F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", " "), r"(?m)(^|\s)//[^\n]*$", "$1")
    # a match ends with what it names, in the only quotes that it has
    named = F.transform(F.regexp_extract_all(bare, F.lit(IMPORT), F.lit(0)), lambda m: F.regexp_extract(m, r"""['"]([^'"]+)['"]$""", 1))
    return F.when(F.contains(source, F.lit("import")) | F.contains(source, F.lit("export")) | F.contains(source, F.lit("require")), named).when(source.isNotNull(), F.array().cast("array<string>"))


def package_of(specifier: Column) -> Column:
    """The package of a specifier: two segments where it is scoped, else one; null for a relative one."""
    parts = F.split(specifier, "/")
    return F.when(specifier.rlike(r"^[./]"), None).when(specifier.startswith("@"), F.array_join(F.slice(parts, 1, 2), "/")).otherwise(F.get(parts, F.lit(0)))


def resolved_imports(files: DataFrame, endings: tuple[str, ...] = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")) -> DataFrame:
    """(src, specifier, dst): relative imports of files (path, text) to the first file that exists among the candidates;
    dst is null where none does."""
    asked = files.select(F.col("path").alias("src"), F.explode(specifiers(F.col("text"))).alias("specifier")).where(F.col("specifier").startswith("."))
    folder = F.filter(F.slice(F.split("src", "/"), 1, F.size(F.split("src", "/")) - 1), lambda p: p != "")
    walked = F.aggregate(F.split("specifier", "/"), folder, lambda acc, p: F.when(p.isin(".", ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    tried = asked.withColumn("at", F.array_join(walked, "/")).select("src", "specifier", F.posexplode(F.transform(F.array(*map(F.lit, endings)), lambda e: F.concat("at", e))).alias("place", "dst"))
    found = tried.join(files.select(F.col("path").alias("dst")), "dst", "left_semi").groupBy("src", "specifier").agg(F.min_by("dst", "place").alias("dst"))
    return asked.distinct().join(found, ["src", "specifier"], "left")
