"""Configurations, API documents, collections and reports on files written by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.tolerant import document, held, plain_json
from tessera.operators import configs, coverage, documents, imports, manifests


def told(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def files_of(spark, rows):
    return spark.createDataFrame(list(rows.items()), "path string, text string")


def test_tolerant_json(spark):
    texts = {
        '{"a": 1, // one\n "b": [1, 2,],}': '{"a":1,"b":[1,2]}', '{"a": "x // y, }" /* no */}': '{"a":"x // y, }"}', '{"a": "\\" /* \\\\"}': '{"a":"\\" /* \\\\"}',
        "{ broken": None, "": None, '/* open': None, '[1, /* a ** b */ 2, // c': None, '{"s": "' + "\\n" * 20_000 + '",}': '{"s":"' + "\\n" * 20_000 + '"}',
    }
    rows = spark.createDataFrame([(k, v) for k, v in texts.items()] + [(None, None)], "t string, want string")
    got = rows.select("want", F.to_json(document(F.col("t"))).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    long = spark.createDataFrame([("/" * 500_000 + "\n1",), ('"' + "a\\\\" * 300_000,), ("/*" + "*a" * 300_000 + "*/2",)], "t string").select(F.length(plain_json(F.col("t"))).alias("n")).collect()
    assert [r["n"] for r in long] == [2, 900_001, 1]
    assert spark.createDataFrame([('{"a": {"b": "x"}}',)], "t string").select(held(document(F.col("t")), "$.a.b", "long")).first()[0] is None


CONFIGS = {
    "tsconfig.json": '{"extends": "./base", "compilerOptions": {"paths": {"own/*": ["o/*"], "@/*": ["near/*"]}}}',
    "base.json": '{"extends": "./lib/far.json", // up\n "compilerOptions": {"paths": {"@/*": ["far/*"], "deep": ["d",]},}}', "lib/far.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"last/*": ["l/*"]}}}',
    "a/tsconfig.json": "{ broken", "a/jsconfig.json": '{"compilerOptions": {"baseUrl": "x"}}', "b/jsconfig.json": '{"extends": "kit/strict"}', "b/node_modules/kit/strict": "{}", "c/one.json": '{"extends": "./two"}', "c/two.json": '{"extends": "./three", "compilerOptions": {"baseUrl": "t"}}',
    "c/three.json": '{"extends": "./two.json", "compilerOptions": {"baseUrl": ""}}', "d/tsconfig.json": '{"extends": "./none"}', "e/tsconfig.json": "[]",
    "src/f.ts": "", "a/g.ts": "", "b/h.ts": "", "d/i/j.ts": "", "e/k.ts": "",
}


def test_configurations_inherit_along_their_chains(spark):
    files = files_of(spark, CONFIGS | {"n.json": None})
    got = {r["path"]: (r["folder"], r["base_url"], [(a["pattern"], a["targets"]) for a in r["aliases"]]) for r in configs.merged(configs.read(files)).collect()}
    assert got["tsconfig.json"] == ("", ".", [("last/*", ["l/*"]), ("@/*", ["near/*"]), ("deep", ["d"]), ("own/*", ["o/*"])])
    assert got["base.json"] == ("", ".", [("last/*", ["l/*"]), ("@/*", ["far/*"]), ("deep", ["d"])])
    # a circle ends where it closes; an empty base counts as said but places nothing
    assert got["c/one.json"] == ("c", "t", []) and got["c/three.json"] == ("c", "", []) and got["c/two.json"] == ("c", "t", [])
    assert got["d/tsconfig.json"] == ("d", None, []) and "a/tsconfig.json" not in got and "e/tsconfig.json" not in got and "n.json" not in got
    near = told(configs.nearest(files, configs.read(files)), "folder", "path")
    # where the first name is broken the second one does not step in
    assert {("src", "tsconfig.json"), ("a", "tsconfig.json"), ("b", "b/jsconfig.json"), ("d/i", "d/tsconfig.json"), ("e", "tsconfig.json"), ("", "tsconfig.json")} <= near
    assert configs.settings(files.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 9, 40])
def test_chains_of_any_length(spark, n):
    links = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n)] + [(str(n), str(n // 2))], "path string, up string")
    got = {}
    for r in configs.chains(links).collect():
        got.setdefault(r["path"], {})[r["step"]] = r["at"]
    for i in range(n + 1):
        want, at = [], i
        while at not in want:
            want.append(at)
            at = at + 1 if at < n else n // 2
        assert [got[str(i)][k] for k in sorted(got[str(i)])] == list(map(str, want))


def test_imports_by_each_folders_configuration(spark):
    files = files_of(spark, {
        "tsconfig.json": '{"compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["none/*", "*"], "one": ["deep/x.js"]}}}', "app/tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["./*"]}}}',
        "src/a.ts": "import '@/deep/x'\nimport 'one'\nimport 'deep/x'\nimport '@/gone'\nimport 'far/x'\nimport 'onemore'", "app/b.ts": "import '@/c'\nimport 'deep/x'\nimport '@/deep/x'", "app/c.mts": "", "src/deep/x.ts": "", "src/deep/x.js": "",
    })
    got = told(imports.resolved(files.where("not path like '%.json'"), settings=configs.settings(files)), "src", "specifier", "kind", "dst", "package")
    assert got == {
        ("src/a.ts", "@/deep/x", "file", "src/deep/x.ts", None), ("src/a.ts", "one", "file", "src/deep/x.ts", None), ("src/a.ts", "deep/x", "file", "src/deep/x.ts", None), ("src/a.ts", "@/gone", "missing", None, None),
        ("src/a.ts", "far/x", "package", None, "far"), ("src/a.ts", "onemore", "package", None, "onemore"), ("app/b.ts", "@/c", "file", "app/c.mts", None), ("app/b.ts", "deep/x", "package", None, "deep"), ("app/b.ts", "@/deep/x", "missing", None, None),
    }


JSON = '{"openapi": "3.1.0", "servers": [{"url": "https://one.example.org/base/"}, {"url": "/two"}], "paths": {"/a/{id}": {"get": {}, "PUT": {}, "summary": "x"}, "/b": null, "x-note": {"get": 1}}, "components": {"/c": {"get": {}}}}'
YAML = """openapi: 3.1.0
servers:
  - url: "https://one.example.org/base/"  # first
  - url: /two
paths:
  /a/{id}:
    get:
      responses:
        delete: 1
    # no
    PUT: {}
    summary: x
  /b:
  x-note:
    get: 1
components:
  /c:
    get: {}
"""


def test_documents_in_json_and_yaml_serve_the_same(spark):
    files = files_of(spark, {"j/openapi.json": JSON, "y/openapi.yaml": YAML, "s/swagger.yml": "swagger: '2.0'\nbasePath: /v1\nhost: h.example.org:80\npaths:\n    '/q?x':\n        Post:\n", "n/openapi.json": None, "m/openapi.json": "{", "z/openapi.yaml": ""})
    got = told(documents.served(files), "path", "method", "route", "raw")
    want = {("GET", "/base/a/*", "/a/{id}"), ("PUT", "/base/a/*", "/a/{id}")}
    assert got == {("j/openapi.json", *w) for w in want} | {("y/openapi.yaml", *w) for w in want} | {("s/swagger.yml", "POST", "/v1/q", "/q?x")}
    assert told(documents.hosts(files), "host") == {("one.example.org",), ("h.example.org",)}


def test_outline_of_indented_lines(spark):
    text = "a: 1\nb:\n  - c: 2\n    d: 'x: y'\n  - - e: 3\n\n  # f: 4\n\tg: 5\n 'h i' : 6 # said\nplain\nj:k\n"
    rows = documents.outline(files_of(spark, {"x": text, "y": None})).orderBy("at").collect()
    assert [(r["at"], "/".join(r["keys"]), r["value"]) for r in rows] == [(0, "a", "1"), (1, "b", ""), (2, "b/-/c", "2"), (3, "b/-/d", "x: y"), (4, "b/-/-/e", "3"), (7, "b/g", "5"), (8, "b/h i", "6")]


def test_requests_of_collections(spark):
    deep = '{"name": "r", "request": {"method": "lock", "url": "{{ api }}/x?y"}}'
    for i in range(5):
        deep = f'{{"name": "f{i}", "item": [{deep}, 7, "s", null]}}'
    files = files_of(spark, {
        "a.postman_collection.json": f'{{"item": {deep}}}', "b.postman_collection.json": '{"item": [{"request": {"url": {"host": ["h"], "path": ["p", "q"]}}}, {"request": {"method": "GET", "url": ""}}, {"request": "GET /x"}]}', "c.postman_collection.json": "[]", "d.postman_collection.json": None,
        "e.bru": "meta {\n  name: Say\n}\nget {\n  url: https://h.example.org/a/:id\n}", "f.bru": "post {\n  url: {{api}}\n}\nbody:graphql {\n}\nmeta {\n  type: graphql\n  name: Say it \n}", "g.bru": "put {\n  url:\n}", "h.http": "GET /a\n### two\nDELETE https://h.example.org:8/b/",
    })
    assert told(documents.requests(files), "path", "framework", "method", "route", "host", "name") == {
        ("a.postman_collection.json", "postman", "ANY", "/x", "*api", ""), ("b.postman_collection.json", "postman", "ANY", "/p/q", "", ""), ("e.bru", "bruno", "GET", "/a/*", "h.example.org", ""),
        ("f.bru", "graphql", "POST", "/", "*api", "Say it"), ("h.http", "rest", "GET", "/a", "", ""), ("h.http", "rest", "DELETE", "/b", "h.example.org:8", ""),
    }
    assert [tuple(r["folders"]) for r in documents.collected(documents._told(files.where("path like 'a%'"))).collect()] == [("f4", "f3", "f2", "f1", "f0")]
    assert documents.requests(files.where("false")).count() == 0 and documents.served(files.where("false")).count() == 0


def test_serverless_events(spark):
    text = "Resources:\n  a:\n    Path: /x/{id}\n    RestApi: y\n    Method: get\n  b:\n    method: post\n  c:\n    path: /far\n\n\n\n\n\n    method: put\n  d:\n    - path: '/'\n      method: get\n    - path: /y\n      method: any\n      method: get\n"
    assert told(documents.served(files_of(spark, {"template.yaml": text})), "method", "route") == {("GET", "/x/*"), ("ANY", "/y")}


def test_reports(spark):
    files = files_of(spark, {
        "coverage/coverage-summary.json": '{"total": {"lines": {"pct": 81.5}, "branches": {"pct": "Unknown"}}}', "coverage.json": '{"totals": {"percent_covered": 1}}', "p/coverage.json": '{"totals": {"percent_covered": 90, "percent_covered_branches": 12.5},}',
        "q/coverage/coverage-summary.json": "{}", "q/coverage.lcov": "LF:3\nLH:1\n", "r/coverage.json": None, "coverage.py": "x",
    })
    assert told(coverage.reports(files), "folder", "kind", "lines", "statements", "branches", "functions") == {("", "istanbul", 81.5, 0.0, 0.0, 0.0), ("p", "coverage.py", 90.0, 90.0, 12.5, 0.0), ("q", "lcov", 33.3, 33.3, 0.0, 0.0)}


def test_python_projects(spark):
    text = '[project]\nname = "x"\ndependencies = [\n  "requests[socks]>=2", # said\n  \'flask\',\n  "tomli; python_version < \'3.11\'",\n]\nother = ["no"]\n[project.optional-dependencies]\ndev = ["pytest>=7"]\nfast = [\n  "uvloop",\n]\n[tool.poetry.dependencies]\npython = "^3.11"\ndjango = "^4.2"\nkit = { version = "1.0", extras = ["a"] }\n[tool.poetry.group.test.dependencies]\nnose = "*"\n[tool.black]\nline = "1"\n'
    got = told(manifests.asked(files_of(spark, {"a/pyproject.toml": text, "b/setup.cfg": "[options]\nx = 1", "c/pyproject.toml": None})), "path", "name", "range", "dev", "ecosystem")
    assert got == {("a/pyproject.toml", *r, "PyPI") for r in (("requests", ">=2", False), ("flask", "", False), ("tomli", "", False), ("pytest", ">=7", True), ("uvloop", "", False), ("django", "^4.2", False), ("kit", "1.0", False), ("nose", "*", True))}
