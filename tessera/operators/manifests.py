"""Package manifests and API documents read from a table of files (path, text), by column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The calls that name a dependency, those among them that do not ship, and where a table of them stands.
GRADLE = r"""(?m)(?:^|\s)(implementation|api|compileOnly|runtimeOnly|testImplementation|testCompileOnly|androidTestImplementation|kapt|ksp|annotationProcessor)\s*[( ]\s*["']([^"':]+):([^"':]+):?([^"']*)["']"""
GRADLE_DEV = r"^(test|androidTest|kapt|ksp|annotationProcessor|compileOnly)"
CARGO = r"(^|\.)(dependencies|dev-dependencies|build-dependencies)"
GO = r"(?m)^\s*([\w.\-/]+\.[\w.\-/]+)\s+(v[\w.+-]+)"
CMAKE = r"(?i)(?:find_package|FetchContent_Declare)\s*\(\s*([A-Za-z0-9_.-]+)"
DEV = r"(?i)dev|test|lint|doc"
PUB = ("dependencies", "dev_dependencies", "dependency_overrides")
VERBS = ("get", "post", "put", "patch", "delete", "head", "options", "trace")
REQUEST = r"(?m)^\s*(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\s+(\S+)"

FOUND = ("path", "name", "range", "dev", "ecosystem")


def matches(text: Column, pattern: str, groups: int) -> Column:
    """Array of structs g1, g2 ... of all matches of a pattern."""
    return F.arrays_zip(*(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(1, groups + 1)))


def _found(rows: DataFrame, name: Column, wanted: Column, dev: Column, ecosystem: str) -> DataFrame:
    return rows.select("path", name.alias("name"), F.coalesce(wanted, F.lit("")).alias("range"), dev.alias("dev"), F.lit(ecosystem).alias("ecosystem"))


def sections(files: DataFrame) -> DataFrame:
    """(path, section, at, line): lines of TOML files without comments and blank lines, each with its table's name."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "raw")).select("path", "at", F.trim(F.regexp_replace("raw", r"#.*$", "")).alias("line"))
    head = F.when(F.col("line").rlike(r"^\[+[^\]]+\]+"), F.trim(F.regexp_extract("line", r"^\[+([^\]]+)\]+", 1)))
    within = lines.withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(Window.partitionBy("path").orderBy("at")))
    return within.where("head is null and section is not null and line <> ''").select("path", "section", "at", "line")


def toml_value(line: Column) -> Column:
    """What a line sets: its text, or the version within its braces; empty where it gives neither."""
    said = F.trim(F.regexp_replace(line, r"^[^=]*=", ""))
    return F.when(said.startswith("{"), F.regexp_extract(said, r'\bversion\s*=\s*"([^"]*)"', 1)).otherwise(F.regexp_extract(said, r'^"([^"]*)"', 1))


def npm(files: DataFrame) -> DataFrame:
    held = files.select("path", F.from_json("text", "dependencies map<string,string>, devDependencies map<string,string>").alias("j"))
    both = [held.select("path", F.explode(f"j.{c}").alias("name", "range"), F.lit(dev).alias("dev")) for c, dev in (("dependencies", False), ("devDependencies", True))]
    return _found(both[0].unionByName(both[1]), F.col("name"), F.col("range"), F.col("dev"), "npm")


def cargo(files: DataFrame) -> DataFrame:
    """A table of dependencies has one on each line; a table named for one spells it over several."""
    rows = sections(files)
    listed = rows.where(F.col("section").rlike(CARGO + "$")).withColumn("name", F.regexp_extract("line", r"^([\w-]+)(?:\.[\w.-]+)?\s*=", 1)).where("name <> ''")
    one = _found(listed, F.col("name"), toml_value(F.col("line")), F.col("section").endswith("dev-dependencies"), "crates.io")
    inner = CARGO + r"\.([\w-]+)$"
    spelled = rows.where(F.col("section").rlike(inner)).groupBy("path", "section").agg(F.max(F.when(F.col("line").rlike(r"^version\s*="), toml_value(F.col("line")))).alias("range"))
    return one.unionByName(_found(spelled, F.regexp_extract("section", inner, 3), F.col("range"), F.regexp_extract("section", inner, 2) == "dev-dependencies", "crates.io"))


def _required(lines: DataFrame, dev: Column) -> DataFrame:
    """What requirements (path, line) name and ask for; markers after a semicolon do not count."""
    asked = lines.withColumn("line", F.trim(F.get(F.split("line", ";"), F.lit(0)))).where(F.col("line").rlike(r"^[A-Za-z0-9._]"))
    form = r"^([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*(.*)$"
    return _found(asked, F.regexp_extract("line", form, 1), F.regexp_extract("line", form, 2), dev, "PyPI")


def requirements(files: DataFrame) -> DataFrame:
    lines = files.select("path", F.explode(F.split("text", "\n")).alias("line")).select("path", F.regexp_replace("line", "#.*$", "").alias("line"))
    return _required(lines, F.col("path").rlike(DEV))


def pyproject(files: DataFrame) -> DataFrame:
    """What a Python project lists: its dependencies, each group of optional ones, and tables of dependencies by name.

    A line belongs to the last key that a line of its table began with, so lists may go on over several lines. Groups and
    tables named for development, tests, checks or documents do not ship; the language itself is no dependency.
    """
    rows = sections(files).withColumn("head", F.regexp_extract("line", r"^([\w.-]+)\s*=", 1))
    rows = rows.withColumn("key", F.last(F.when(F.col("head") != "", F.col("head")), ignorenulls=True).over(Window.partitionBy("path", "section").orderBy("at")))
    quoted = F.regexp_extract_all("line", F.lit(r"""\"([^\"]+)\"|'([^']+)'"""), F.lit(0))
    optional = F.col("section").endswith("optional-dependencies")
    listed = rows.where(((F.col("section") == "project") & (F.col("key") == "dependencies")) | optional).select("path", "key", optional.alias("optional"), F.explode(quoted).alias("said"))
    lists = _required(listed.select("path", "key", "optional", F.expr("substring(said, 2, length(said) - 2)").alias("line")), F.col("optional") & F.col("key").rlike(DEV))
    named = rows.where(F.col("section").rlike(r"^tool\.poetry\.(group\..*\.)?dependencies$") & ~F.col("head").isin("", "python"))
    return lists.unionByName(_found(named, F.col("head"), toml_value(F.col("line")), F.col("section").rlike(DEV), "PyPI"))


def gradle(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.explode(matches(F.col("text"), GRADLE, 4)).alias("m"))
    return _found(rows, F.concat_ws(":", "m.g2", "m.g3"), F.col("m.g4"), F.col("m.g1").rlike(GRADLE_DEV), "Maven")


def maven(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<dependency>(.*?)</dependency>"), F.lit(1))).alias("b"))
    tag = lambda t: F.trim(F.regexp_extract("b", f"<{t}>([^<]+)<", 1))
    return _found(rows.where((tag("groupId") != "") & (tag("artifactId") != "")), F.concat_ws(":", tag("groupId"), tag("artifactId")), tag("version"), tag("scope").isin("test", "provided"), "Maven")


def golang(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.explode(matches(F.col("text"), GO, 2)).alias("m"))
    return _found(rows, F.col("m.g1"), F.col("m.g2"), F.lit(False), "Go")


def cmake(files: DataFrame) -> DataFrame:
    return _found(files.select("path", F.explode(F.regexp_extract_all("text", F.lit(CMAKE), F.lit(1))).alias("name")), F.col("name"), F.lit(""), F.lit(False), "")


def pub(files: DataFrame) -> DataFrame:
    """Of each section at the margin the entries at the first one's indent; deeper ones say how it is fetched."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("at", "raw")).select("path", "at", F.rtrim(F.regexp_replace("raw", r"(^|\s)#.*$", "")).alias("line"))
    ordered = Window.partitionBy("path").orderBy("at")
    told = lines.withColumn("head", F.when(F.col("line").rlike(r"^[\w-]+\s*:"), F.regexp_extract("line", r"^([\w-]+)", 1))).withColumn("section", F.last("head", ignorenulls=True).over(ordered)).withColumn("part", F.count("head").over(ordered))
    entry = r"^(\s+)([A-Za-z_][\w-]*)\s*:\s*(.*)$"
    rows = told.where(F.col("head").isNull() & F.col("section").isin(*PUB) & F.col("line").rlike(entry)).withColumn("deep", F.length(F.regexp_extract("line", entry, 1)))
    rows = rows.withColumn("first", F.first("deep").over(Window.partitionBy("path", "part").orderBy("at"))).where("deep <= first")
    said = F.regexp_extract("line", entry, 3)
    return _found(rows, F.regexp_extract("line", entry, 2), F.when(said.rlike(r"""^["']?[\d^~<>=]"""), F.trim(F.regexp_replace(said, "[\"']", ""))), F.col("section") == "dev_dependencies", "Pub")


READERS = (
    (r"(^|/)package\.json$", npm), (r"(^|/)Cargo\.toml$", cargo), (r"(^|/)requirements[\w.-]*\.txt$", requirements), (r"(^|/)(pyproject\.toml|setup\.cfg)$", pyproject), (r"(^|/)build\.gradle(\.kts)?$", gradle),
    (r"(^|/)pom\.xml$", maven), (r"(^|/)CMakeLists\.txt$", cmake), (r"(^|/)go\.mod$", golang), (r"(^|/)pubspec\.ya?ml$", pub),
)


def asked(files: DataFrame) -> DataFrame:
    """(path, name, range, dev, ecosystem) of all that the manifests among the files ask for. Null texts ask for nothing."""
    return reduce(DataFrame.unionByName, (read(files.where(F.col("path").rlike(match))) for match, read in READERS))


def document_kind(path: Column, text: Column) -> Column:
    """Which API document a file is, by its name and its first characters; null for none."""
    name, head = F.element_at(F.split(path, "/"), -1), F.left(text, F.lit(4096))
    openapi = name.rlike(r"(?i)\.(ya?ml|json)$") & (name.rlike(r"(?i)^(openapi|swagger)[.-]") | head.rlike(r"""["']?(openapi|swagger)["']?\s*:\s*["']?[23]\.\d"""))
    return (
        F.when(name.rlike(r"(?i)\.postman_collection\.json$"), "postman").when(name.rlike(r"(?i)\.bru$"), "bruno").when(name.rlike(r"(?i)\.(http|rest)$"), "rest").when(name.rlike(r"(?i)\.proto$"), "proto")
        .when(name.rlike(r"(?i)^(serverless|template)\.ya?ml$") & head.rlike(r"(?m)^functions:|^Resources:"), "serverless").when(openapi, "openapi")
    )


def described(files: DataFrame) -> DataFrame:
    """(path, kind, method, route): endpoints of OpenAPI (JSON) and protobuf documents and requests of .http files."""
    told = files.withColumn("kind", document_kind(F.col("path"), F.col("text"))).where("kind is not null")
    paths = told.where("kind = 'openapi'").select("path", "kind", F.explode(F.from_json("text", "paths map<string,map<string,string>>")["paths"]).alias("route", "item")).select("path", "kind", "route", F.explode(F.map_keys("item")).alias("verb"))
    spec = paths.where(F.lower("verb").isin(*VERBS)).select("path", "kind", F.upper("verb").alias("method"), "route")
    service = told.where("kind = 'proto'").select("path", "kind", F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"), F.explode(matches(F.col("text"), r"\bservice\s+(\w+)\s*\{([^}]*)\}", 2)).alias("s"))
    whole = F.when(F.col("package") == "", F.col("s.g1")).otherwise(F.concat_ws(".", "package", "s.g1"))
    rpc = service.select("path", "kind", whole.alias("service"), F.explode(F.regexp_extract_all("s.g2", F.lit(r"\brpc\s+(\w+)"), F.lit(1))).alias("rpc")).select("path", "kind", F.lit("POST").alias("method"), F.concat(F.lit("/"), "service", F.lit("/"), "rpc").alias("route"))
    rest = told.where("kind = 'rest'").select("path", "kind", F.explode(matches(F.col("text"), REQUEST, 2)).alias("m")).select("path", "kind", F.col("m.g1").alias("method"), F.col("m.g2").alias("route"))
    return spec.unionByName(rpc).unionByName(rest)


def lcov_coverage(files: DataFrame) -> DataFrame:
    """(path, lines, branches, functions): per cent with one decimal, of lcov reports; 0 where nothing was found."""

    def total(key: str) -> Column:
        return F.aggregate(F.regexp_extract_all("text", F.lit(rf"(?m)^{key}:(\d+)$"), F.lit(1)), F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long"))

    def share(of: str) -> Column:
        return F.when(total(f"{of}F") > 0, F.floor(total(f"{of}H") / total(f"{of}F") * 1000 + 0.5) / 10).otherwise(F.lit(0.0))

    return files.select("path", share("L").alias("lines"), share("BR").alias("branches"), share("FN").alias("functions"))
