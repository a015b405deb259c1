"""What API documents serve and what request collections ask for: OpenAPI in JSON and YAML, serverless templates, services of
protobuf, request files, Bruno and nested Postman collections.

Tables of files (path, text) with null texts allowed; a text that does not parse gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import route_host, route_path
from tessera.functions.tolerant import document, held
from tessera.operators.manifests import REQUEST, VERBS, document_kind, matches
from tessera.sources.tables import written

# A line of an outline, the verbs that a request may have, what names a service, and Bruno's forms.
LINE = re.compile(r"""^(\s*)((?:-\s+)*)(?:(["'])(.*?)\3|([^\s"'#][^:]*?))\s*:(?:\s+(.*?))?\s*$""")
ASKED = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "WS")
NAMED = r"^\{\{\s*([\w.-]+)\s*\}\}(?=$|[/?#])"
BRUNO_VERB, BRUNO_URL = r"(?m)^\s*(get|post|put|patch|delete|head|options)\s*\{", r"(?m)^\s*url\s*:[^\S\n]*(\S*[/{]\S*)"
BRUNO_GRAPH, OPERATION, BRUNO_NAME = r"(?m)^\s*body\s*:\s*graphql\b|\btype\s*:\s*graphql\b", r"\b(query|mutation|subscription)\s+(\w+)", r"(?m)^\s*name\s*:[^\S\n]*(.+)$"
# Lines after a path's within which its verb stands in a serverless template.
NEAR = 4


def outline(files: DataFrame) -> DataFrame:
    """(path, at, keys, value): each line `key: value` of indented texts with the keys that it stands under, its own last.

    A line's parent is the last one before it with less indent; a dash before a key is a key of its own, '-'. Blank
    lines, comments and lines of other forms are skipped. The stack holds one entry a level, whatever a text's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(4)]
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stack: list[tuple[int, str]] = []
                for at, line in enumerate((text or "").split("\n")):
                    m = LINE.match(line)
                    if not m or line.lstrip().startswith("#"):
                        continue
                    indent = len(m[1])
                    while stack and stack[-1][0] >= indent:
                        stack.pop()
                    for dash in re.finditer("-", m[2]):
                        stack.append((indent + dash.start(), "-"))
                    stack.append((indent + len(m[2]), m[4] if m[3] else m[5]))
                    value = re.sub(r"\s+#.*$", "", m[6] or "").strip("\"'")
                    for column, v in zip(rows, (path, at, [k for _, k in stack], value), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.list_(pa.string())), pa.array(rows[3], pa.string())], names=["path", "at", "keys", "value"])

    return files.select("path", "text").mapInArrow(run, "path string, at int, keys array<string>, value string")


def joined(*parts: Column) -> Column:
    """Paths one below the other, without doubled or closing slashes."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.concat_ws("/", *parts), "/"), lambda p: p != ""), "/"))


def _told(files: DataFrame) -> DataFrame:
    return files.select("path", "text", document_kind(F.col("path"), F.col("text")).alias("kind")).where("kind is not null")


def _openapi(told: DataFrame) -> DataFrame:
    """(path, kind, key, value): for each OpenAPI document what it serves, key being a path and value a verb, and under the
    keys base, server and host what it says of its place; JSON and YAML alike."""
    docs = told.where("kind = 'openapi'")
    braced = F.col("text").rlike(r"^\s*\{")
    json = docs.where(braced).select("path", document(F.col("text")).alias("d"))
    items = json.select("path", F.explode(held(F.col("d"), "$.paths", "map<string,variant>")).alias("key", "item")).select("path", "key", F.explode(F.map_keys(held(F.col("item"), "$", "map<string,variant>"))).alias("value"))
    said = lambda key, at: json.select("path", F.lit(key).alias("key"), held(F.col("d"), at, "string").alias("value")).where("value is not null")
    servers = json.select("path", F.explode(held(F.col("d"), "$.servers", "array<variant>")).alias("s")).select("path", F.lit("server").alias("key"), held(F.col("s"), "$.url", "string").alias("value")).where("value is not null")
    lines = written(outline(docs.where(~braced)))
    k = lambda i: F.get("keys", F.lit(i))
    n = F.size("keys")
    yaml = lines.select("path", F.when((n == 3) & (k(0) == "paths"), k(1)).when((n == 1) & (k(0) == "basePath"), "base").when((n == 1) & (k(0) == "host"), "host").when((n == 3) & (k(0) == "servers") & (k(1) == "-") & (k(2) == "url"), "server").alias("key"), F.when((n == 3) & (k(0) == "paths"), k(2)).otherwise(F.col("value")).alias("value")).where("key is not null")
    return reduce(DataFrame.unionByName, (items, said("base", "$.basePath"), said("host", "$.host"), servers, yaml))


def served(files: DataFrame) -> DataFrame:
    """(path, framework, method, route, raw): endpoints of OpenAPI documents, serverless templates and protobuf services.

    An OpenAPI document's routes stand under its basePath, else under the path of its first server.
    """
    told = _told(files)
    api = written(_openapi(told))
    first = api.where("key = 'server'").groupBy("path").agg(F.first("value").alias("server"))
    base = api.where("key = 'base'").groupBy("path").agg(F.first("value").alias("base"))
    routes = api.where(F.startswith("key", F.lit("/")) & F.lower("value").isin(*VERBS)).join(base, "path", "left").join(first, "path", "left")
    root = F.coalesce("base", F.when(F.col("server").isNotNull(), route_path(F.col("server"))), F.lit(""))
    spec = routes.select("path", F.lit("openapi").alias("framework"), F.upper("value").alias("method"), joined(root, route_path(F.col("key"))).alias("route"), F.col("key").alias("raw"))
    service = told.where("kind = 'proto'").select("path", F.regexp_extract("text", r"(?m)^\s*package\s+([\w.]+)\s*;", 1).alias("package"), F.explode(matches(F.col("text"), r"\bservice\s+(\w+)\s*\{([^}]*)\}", 2)).alias("s"))
    whole = F.when(F.col("package") == "", F.col("s.g1")).otherwise(F.concat_ws(".", "package", "s.g1"))
    rpc = service.select("path", whole.alias("service"), F.explode(F.regexp_extract_all("s.g2", F.lit(r"\brpc\s+(\w+)"), F.lit(1))).alias("rpc"))
    route = F.concat(F.lit("/"), "service", F.lit("/"), "rpc")
    return spec.unionByName(events(told)).unionByName(rpc.select("path", F.lit("grpc").alias("framework"), F.lit("POST").alias("method"), route.alias("route"), route.alias("raw")))


def events(told: DataFrame) -> DataFrame:
    """The http events of serverless templates: a path and the first method within the next lines."""
    lines = told.where("kind = 'serverless'").select("path", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    named = F.regexp_extract("line", r"""^\s*-?\s*(?:path|Path)\s*:\s*["']?([^"'#\s]+)""", 1)
    verb = F.regexp_extract("line", r"""^\s*(?:method|Method)\s*:\s*["']?(\w+)""", 1)
    rows = lines.select("path", "at", named.alias("raw"), verb.alias("verb")).where("raw <> '' or verb <> ''")
    last = Window.partitionBy("path").orderBy("at")
    seen = rows.withColumn("of", F.last(F.when(F.col("raw") != "", F.struct("at", "raw")), ignorenulls=True).over(last)).where(f"verb <> '' and of is not null and at - of.at <= {NEAR}")
    first = seen.groupBy("path", "of").agg(F.min_by("verb", "at").alias("verb"))
    route = route_path(F.col("of.raw"))
    return first.where(route != "/").select("path", F.lit("serverless").alias("framework"), F.upper("verb").alias("method"), route.alias("route"), F.col("of.raw").alias("raw"))


def hosts(files: DataFrame) -> DataFrame:
    """(host): where OpenAPI documents say that they are served, without ports."""
    said = _openapi(_told(files)).where("key in ('server', 'host')")
    host = F.when(F.col("key") == "server", route_host(F.col("value"))).otherwise(F.regexp_extract("value", r"^([\w.-]+)", 1))
    return said.select(F.regexp_replace(host, r":\d+$", "").alias("host")).where("host <> ''").distinct()


def collected(told: DataFrame) -> DataFrame:
    """(path, folders, name, method, url): the requests of Postman collections, however deep their folders lie.

    Each round opens one level of all collections at once and hands on only the folders that it finds.
    """
    docs = told.where("kind = 'postman'").select("path", F.array().cast("array<string>").alias("folders"), document(F.col("text")).alias("v"))
    found, front = None, written(docs.where("v is not null"))
    while not front.isEmpty():
        items = front.select("path", "folders", F.coalesce(held(F.col("v"), "$.item", "array<variant>"), F.array_compact(F.array(held(F.col("v"), "$.item", "variant")))).alias("items"))
        each = items.select("path", "folders", F.explode("items").alias("v"))
        name, url = held(F.col("v"), "$.name", "string"), held(F.col("v"), "$.request.url", "variant")
        spelled = F.when(F.schema_of_variant(url) == "STRING", held(url, "$", "string")).otherwise(F.coalesce(held(url, "$.raw", "string"), F.array_join(held(url, "$.path", "array<string>"), "/")))
        method = F.coalesce(held(F.col("v"), "$.request.method", "string"), F.lit("any"))
        level = written(each.select("path", "folders", name.alias("name"), method.alias("method"), spelled.alias("url"), F.when(held(F.col("v"), "$.item", "variant").isNotNull(), F.col("v")).alias("v")))
        asked = level.where("url <> ''").select("path", "folders", "name", "method", "url")
        found = asked if found is None else found.unionByName(asked)
        front = level.where("v is not null").select("path", F.concat("folders", F.array(F.coalesce("name", F.lit("")))).alias("folders"), "v")
    return found if found is not None else docs.select("path", "folders", F.lit("").alias("name"), F.lit("").alias("method"), F.lit("").alias("url"))


def requests(files: DataFrame) -> DataFrame:
    """(path, framework, method, route, host, name, raw): what the collections among the files ask for.

    A service written as a variable is its host, starred. name is that of a GraphQL operation, else ''; a request
    without path or name says nothing. A verb that is none of the usual ones is ANY.
    """
    told = written(_told(files))
    rest = told.where("kind = 'rest'").select("path", "kind", F.explode(matches(F.col("text"), REQUEST, 2)).alias("m")).select("path", "kind", F.col("m.g1").alias("method"), F.col("m.g2").alias("raw"), F.lit("").alias("name"))
    text = F.col("text")
    operation = F.concat_ws(" ", F.nullif(F.regexp_extract(text, OPERATION, 1), F.lit("")), F.nullif(F.regexp_extract(text, OPERATION, 2), F.lit("")))
    graph = F.when(text.rlike(BRUNO_GRAPH), F.coalesce(F.nullif(operation, F.lit("")), F.trim(F.regexp_extract(text, BRUNO_NAME, 1)))).otherwise("")
    bruno = told.where("kind = 'bruno'").select("path", "kind", F.coalesce(F.nullif(F.regexp_extract(text, BRUNO_VERB, 1), F.lit("")), F.lit("any")).alias("method"), F.explode(F.regexp_extract_all(text, F.lit(BRUNO_URL), F.lit(1))).alias("raw"), graph.alias("name"))
    postman = collected(told).select("path", F.lit("postman").alias("kind"), "method", F.col("url").alias("raw"), F.lit("").alias("name"))
    every = rest.unionByName(bruno).unionByName(postman)
    service = F.regexp_extract(F.trim("raw"), NAMED, 1)
    rows = every.withColumn("host", F.when(service != "", F.concat(F.lit("*"), service)).otherwise(route_host(F.col("raw")))).withColumn("route", route_path(F.regexp_replace(F.trim("raw"), NAMED, "")))
    verb = F.upper("method")
    return rows.where("route <> '/' or name <> ''").select("path", F.when(F.col("name") != "", "graphql").otherwise(F.col("kind")).alias("framework"), F.when(verb.isin(*ASKED), verb).otherwise("ANY").alias("method"), "route", "host", "name", "raw")
