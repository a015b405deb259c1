"""Operators on rows written by hand, each held against its rows in SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import compare, graph, history, manifests, units

CASES = []


def query(sql):
    return lambda f: CASES.append((f, sql)) or f


LICENCES = ["MIT", "Apache-2.0 OR GPL-3.0", "(MIT AND LGPL-2.1)", "GPL-2.0-only", "UNLICENSED", "The ISC License", "", "Strange", "CC-BY-NC-4.0", "CC-BY-4.0"]
ENDPOINTS = [("e1", "GET", "/user/*"), ("e2", "POST", "/user/auth/login"), ("e3", "ANY", "/files/**"), ("e4", "GET", "/user/auth/*")]
CLIENTS = [("c1", "POST", "/api/v1/user/auth/login", ""), ("c2", "GET", "/user/7", ""), ("c3", "GET", "/files/a/b/c", "localhost:80"), ("c4", "GET", "/user/7", "far.example.org"), ("c5", "GET", "/user/auth/*", ""), ("c6", "GET", "/*/*", "")]
API_FILES = [("x/openapi.json", '{"openapi": "3.0.1", "paths": {"/pets/{id}": {"get": {}, "parameters": []}, "/pets": {"post": {"x": 1}}}}'), ("shop.proto", "package a.b;\nservice Cart { rpc Add (X) returns (Y);\n rpc Drop (X) returns (Y); }"), ("calls.http", "### one\nGET https://x.org/a\n\nPOST /b"), ("notes.json", '{"a": 1}')]
MANIFESTS = [
    ("a/package.json", '{"dependencies": {"react": "^18.0"}, "devDependencies": {"vite": "5"}}'), ("b/package.json", "not json"), ("c/Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = { version = "1.0", features = ["a"] } # said\nrand = "0.8"\nown = { path = "../own" }\n[dev-dependencies.tokio]\nversion = "1"\nfull = true'),
    ("requirements-dev.txt", "pytest>=7 ; python_version > '3'\n# no\n-r other.txt\nrequests[socks] == 2.0"), ("d/build.gradle", "dependencies {\n  implementation 'g:a:1.2'\n  testImplementation(\"h:b\")\n}"), ("pom.xml", "<dependency>\n<groupId>g</groupId><artifactId>z</artifactId><scope>test</scope></dependency>"),
    ("CMakeLists.txt", "find_package(Boost REQUIRED)\nfetchcontent_declare( fmt )"), ("go.mod", "module x\nrequire (\n\tgithub.com/a/b v1.2.3\n)"), ("pubspec.yaml", "name: x\ndependencies:\n  flutter:\n    sdk: flutter\n  http: ^1.0 # said\ndev_dependencies:\n    lints: '2.0'\n"), ("e/package.json", None),
]


@query("SELECT * FROM (VALUES ('MIT', 'permissive'), ('Apache-2.0 OR GPL-3.0', 'permissive'), ('(MIT AND LGPL-2.1)', 'weak'), ('GPL-2.0-only', 'strong'), ('UNLICENSED', 'closed'), ('The ISC License', 'permissive'), ('', 'unknown'), ('Strange', 'unknown'), ('CC-BY-NC-4.0', 'strong'), ('CC-BY-4.0', 'permissive')) v(said, family)")
def licence_families(spark, at):
    return spark.createDataFrame([(x,) for x in LICENCES], "said string").withColumn("family", S.licence_family(F.col("said")))


@query("SELECT client, endpoint, score::BIGINT AS score, how FROM (VALUES ('c1', 'e2', 10, 'tail'), ('c2', 'e1', 4, 'exact'), ('c3', 'e3', 3, 'exact'), ('c5', 'e4', 8, 'exact')) v(client, endpoint, score, how)")
def route_links(spark, at):
    return graph.route_links(spark.createDataFrame(CLIENTS, "id string, method string, path string, host string"), spark.createDataFrame(ENDPOINTS, "id string, method string, path string"))


@query("""SELECT * FROM (VALUES ('a/package.json', 'react', '^18.0', false, 'npm'), ('a/package.json', 'vite', '5', true, 'npm'), ('c/Cargo.toml', 'serde', '1.0', false, 'crates.io'), ('c/Cargo.toml', 'rand', '0.8', false, 'crates.io'), ('c/Cargo.toml', 'own', '', false, 'crates.io'), ('c/Cargo.toml', 'tokio', '1', true, 'crates.io'),
  ('requirements-dev.txt', 'pytest', '>=7', true, 'PyPI'), ('requirements-dev.txt', 'requests', '== 2.0', true, 'PyPI'), ('d/build.gradle', 'g:a', '1.2', false, 'Maven'), ('d/build.gradle', 'h:b', '', true, 'Maven'), ('pom.xml', 'g:z', '', true, 'Maven'), ('CMakeLists.txt', 'Boost', '', false, ''), ('CMakeLists.txt', 'fmt', '', false, ''),
  ('go.mod', 'github.com/a/b', 'v1.2.3', false, 'Go'), ('pubspec.yaml', 'flutter', '', false, 'Pub'), ('pubspec.yaml', 'http', '^1.0', false, 'Pub'), ('pubspec.yaml', 'lints', '2.0', true, 'Pub')) v(path, name, range, dev, ecosystem)""")
def manifest_requests(spark, at):
    return manifests.asked(spark.createDataFrame(MANIFESTS, "path string, text string"))


@query("""SELECT * FROM (VALUES ('x/openapi.json', 'openapi', 'GET', '/pets/{id}'), ('x/openapi.json', 'openapi', 'POST', '/pets'), ('shop.proto', 'proto', 'POST', '/a.b.Cart/Add'), ('shop.proto', 'proto', 'POST', '/a.b.Cart/Drop'), ('calls.http', 'rest', 'GET', 'https://x.org/a'), ('calls.http', 'rest', 'POST', '/b')) v(path, kind, method, route)""")
def api_documents(spark, at):
    return manifests.described(spark.createDataFrame(API_FILES, "path string, text string"))


@query("SELECT * FROM (VALUES ('lcov.info', 75.0::DOUBLE, 33.3::DOUBLE, 0.0::DOUBLE)) v(path, lines, branches, functions)")
def lcov_coverage(spark, at):
    return manifests.lcov_coverage(spark.createDataFrame([("lcov.info", "LF:3\nLH:2\nBRF:3\nBRH:1\nLF:1\nLH:1\n")], "path string, text string"))


@query("SELECT * FROM (VALUES ('f', 'a/b/use.py', 'a/b/one.py'), ('g', 'a/b/use.py', NULL), ('f', 'z.py', NULL)) v(name, src, dst)")
def nearest_declaring(spark, at):
    told = spark.createDataFrame([("f", "a/b/one.py"), ("f", "a/c/two.py"), ("g", "a/x.py"), ("g", "a/y.py")], "name string, file string")
    return units.nearest_declaring(spark.createDataFrame([("f", "a/b/use.py"), ("g", "a/b/use.py"), ("f", "z.py"), ("h", "z.py")], "name string, file string"), told)


@query("SELECT * FROM (VALUES ('react', 'React'), ('@aws/s3', 'AWS'), ('@aws/core/x', 'Core'), ('left', NULL)) v(name, label)")
def package_labels(spark, at):
    keys = spark.createDataFrame([("react", "React"), ("@aws/", "AWS"), ("@aws/core/", "Core")], "key string, label string")
    return units.labelled(spark.createDataFrame([("react",), ("@aws/s3",), ("@aws/core/x",), ("left",)], "name string"), keys)


@query("SELECT * FROM (VALUES ('app', ''), ('users', '/api'), ('deep', '/api/v1'), ('deep', '/old'), ('alone', ''), ('x', ''), ('y', '')) v(file, prefix)")
def mounted_prefixes(spark, at):
    mounts = spark.createDataFrame([("app", "users", "/api/"), ("users", "deep", "v1"), ("app", "deep", "/old"), ("x", "y", "/r"), ("y", "x", "/s")], "src string, dst string, prefix string")
    return graph.mounted(mounts, spark.createDataFrame([("alone",), ("app",)], "file string"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'c.ts', 'c.ts'), (1, 'src/{b => c}.ts', 'src/c.ts'), (2, 'b.ts => c.ts', 'c.ts'), (3, 'b.ts', 'c.ts'), (4, 'a.ts => b.ts', 'c.ts'), (5, 'a.ts', 'c.ts'), (6, 'other', 'other')) v(seq, raw_path, path)")
def renames_followed(spark, at):
    rows = [(0, "c.ts"), (1, "src/{b => c}.ts"), (2, "b.ts => c.ts"), (3, "b.ts"), (4, "a.ts => b.ts"), (5, "a.ts"), (6, "other")]
    return history.followed(spark.createDataFrame(rows, "seq long, raw_path string"))


@query("SELECT * FROM (VALUES ('helper', 2::BIGINT), ('mender', 1)) v(tool, commits)")
def signed_commits(spark, at):
    rows = [("1", "A <a@x>", "fix\n\nCo-authored-by: Helper <h@x>\nco-authored-by: helper <h@x>"), ("2", "Helper <h@x>", "by hand"), ("3", "helper[bot] <1+h@users.noreply.x>", None), ("4", "B <b@x>", "assisted-by: mender:one")]
    return history.signed(spark.createDataFrame(rows, "hash string, author string, body string"), [("(?i)helper", "helper"), ("(?i)mender", "mender")])


@query("SELECT * FROM (VALUES ('POST', '/b')) v(method, path)")
def documents_only(spark, at):
    said = spark.createDataFrame([("GET", "/a"), ("POST", "/b"), ("GET", "/c")], "method string, path string")
    return compare.answered(said, spark.createDataFrame([("GET", "/a"), ("POST", "/c"), ("GET", "/c")], "method string, path string"))


@pytest.mark.parametrize(("made", "sql"), CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_rows_by_hand(spark, made, sql):
    got = made(spark, None)
    want = duckdb.sql(sql)
    order = [want.columns.index(c) for c in got.columns]
    rows = [tuple(r[i] for i in order) for r in want.fetchall()]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, rows))
