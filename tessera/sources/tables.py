"""Driver tables read as the entities of a code base: logs, changes, file trees, people, activity and graphs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}.parquet")


def fresh_path(spark: SparkSession) -> str:
    """A new path in the folder in spark.checkpoint.dir, which only a session on this machine alone may leave unset."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return f"{at}/round-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to a new path in the shared folder and read back, which cuts its lineage."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of a table that one task makes texts of, and that it groups.
ROWS, MOST = 16_384, 262_144


def dealt(rows: DataFrame, *keys: str, n: int | None = None, most: int = ROWS) -> DataFrame:
    """rows, n of them, dealt by keys over tasks of about `most`; counted where n is not given. Few bytes of a file may be many rows, all read by one
    task, which would then make and hold all that becomes of them."""
    return rows.repartition(max(1, -(-(rows.count() if n is None else n) // most)), *keys)


def apart(rows: DataFrame) -> DataFrame:
    """rows that a join meets by sorting both sides. Spark judges what to send to every task whole by the bytes of files,
    which columns made of few bytes outgrow; this side grows with the tables and is never sent."""
    return rows.hint("merge")


def commits(spark: SparkSession, at: str) -> DataFrame:
    """(hash, who, ts, refs): one row for each order."""
    return table(spark, at, "orders").select(F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("who"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("refs"))


def changes(spark: SparkSession, at: str) -> DataFrame:
    """(hash, line_no, file, ins, del): one row for each order line."""
    rows = table(spark, at, "lineitem")
    return rows.select(F.col("l_orderkey").alias("hash"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("file"), F.col("l_quantity").cast("long").alias("ins"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("long")).otherwise(F.lit(0).cast("long")).alias("del"))


def files(spark: SparkSession, at: str) -> DataFrame:
    """(file, path, weight): parts under brand/type."""
    return table(spark, at, "part").select(F.col("p_partkey").alias("file"), F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("weight"))


def activity(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "events").select("event_id", "ts", F.col("user_id").alias("who"), F.col("event_type").alias("kind"), "value")


def trade(spark: SparkSession, at: str) -> DataFrame:
    """(src, dst, weight): order lines from a customer's nation to a supplier's."""
    lines = table(spark, at, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, at, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, at, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = table(spark, at, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dst"))
    # the one large join is on the order, by which lines are grouped no further; what follows it is counts
    told = lines.join(orders, "l_orderkey").join(customers, "c_custkey").groupBy("src", "l_suppkey").agg(F.count("*").alias("n")).join(suppliers, "l_suppkey")
    return told.groupBy("src", "dst").agg(F.sum("n").alias("weight"))


def partners(spark: SparkSession, at: str) -> DataFrame:
    """(src, dst): each nation's heaviest foreign partner, ties to the smaller number."""
    best = trade(spark, at).where("src <> dst").groupBy("src").agg(F.max(F.struct("weight", (-F.col("dst")).alias("d"))).alias("m"))
    return best.select(F.col("src").cast("long").alias("src"), (-F.col("m.d")).cast("long").alias("dst"))


def tree(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, path, text): each document as a file, its folder and its name being dealt by its id."""
    turn = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.col("doc_id"), F.lit(len(names))) + 1).cast("int"))
    path = F.concat_ws("/", turn(FOLDERS), "source", F.concat(F.lit("d"), F.col("doc_id").cast("string")), turn(LEAVES))
    return table(spark, at, "documents").select("doc_id", path.alias("path"), "text")


FOLDERS = ("src", "app", "lib", "node_modules/x", "a/dist", "a/b/c/dist", "docs", "vendor", "tests", "pages", "theme/static/lib", "gen")
LEAVES = ("index.ts", "test_a.py", "Makefile", "run", "photo.PNG", ".hidden", "b_test.go", "x.unknown", "page.tsx", "style.min.js", "LICENSE", "m.rs", "CMakeLists.txt")


def identities(spark: SparkSession, at: str) -> DataFrame:
    """(id, name, email, commits, ins, del, first, last): each customer with the totals of its orders; names and addresses
    are shared, some addresses are missing."""
    moved = changes(spark, at).groupBy("hash").agg(F.sum("ins").alias("ins"), F.sum("del").alias("del"))
    totals = commits(spark, at).join(moved, "hash", "left").groupBy("who").agg(F.count("*").alias("commits"), F.coalesce(F.sum("ins"), F.lit(0)).alias("ins"), F.coalesce(F.sum("del"), F.lit(0)).alias("del"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    names = table(spark, at, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    number = F.col("c_custkey")
    said = F.concat(F.when(number % 2 == 0, "u").otherwise("U"), (number % 60).cast("string"), F.lit("@x"))
    people = table(spark, at, "customer").join(names, "c_nationkey").select(number.alias("id"), "name", F.when(number % 7 != 0, said).otherwise("").alias("email"))
    return people.join(totals, people.id == totals.who).drop("who")


MODULE_ENDS = (".ts", ".tsx", "/index.ts")


def code(spark: SparkSession, at: str) -> DataFrame:
    """(path, text): a module for each part in its brand's folder. It imports the parts with the four next keys from that
    folder, relatively, by an alias, by a workspace package and by a script's name, and two packages."""
    key, brand = F.col("p_partkey"), F.col("p_brand")
    end = F.element_at(F.array(*map(F.lit, MODULE_ENDS)), (key % 3 + 1).cast("int"))
    number = lambda n: (key + n).cast("string")
    text = F.concat(
        F.when(key % 2 == 0, "export function f() {}\n").otherwise(""), F.lit("import a from './m"), number(1), F.lit("'\nexport { b } from '@/"), brand, F.lit("/m"), number(2), F.lit("'\nimport '@org/"), brand, F.lit("/m"), number(3),
        F.lit("'\nimport c from '../"), brand, F.lit("/m"), number(4), F.lit(".js'\nrequire('react/jsx')\nimport e from '@org/none/x'\n"),
    )
    return dealt(table(spark, at, "part").select("p_partkey", "p_brand"), "p_partkey").select(F.concat(F.lit("src/"), brand, F.lit("/m"), key.cast("string"), end).alias("path"), text.alias("text"))


def projects(spark: SparkSession, at: str) -> DataFrame:
    """(path, text): a module for each part in a folder of its brand and size, beside the folder's main file, and the compiler
    configurations that say what their imports mean.

    Every part has a configuration at the root that inherits from the next part's, but each sixth; some lead in a circle,
    some are broken, some have comments and trailing commas. A folder's own configuration inherits from that of its
    least part; folders of every third size have none and look to their brand's.
    """
    part = dealt(table(spark, at, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select(F.col("p_partkey").alias("key"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("where"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    key, where, text = F.col("key"), F.col("where"), lambda n: n.cast("string")
    said = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    up = F.when(key % 6 == 0, "").when(key % 24 == 5, said('"extends": "./c', text(key - 4), '.json",')).otherwise(said('"extends": "./c', text(key + 1), '",'))
    paths = said('"paths": {"@k', text(key % 3), '/*": ["', where, '/*", "src/', where, '/*",], /* one */ "~all": ["x', text(key), '"],}, // both\n')
    options = F.concat(F.when(key % 5 == 0, '"baseUrl": "src",').otherwise(""), F.when(key % 4 != 0, paths).otherwise(""))
    own = F.when(key % 17 == 0, "{ broken").otherwise(said("{", up, '"compilerOptions": {', options, "},}"))
    roots = part.select(said("c", text(key), ".json").alias("path"), own.alias("text"))
    folders = part.groupBy("where", "brand", "size").agg(F.min("key").alias("key"))
    place = said("src/", where, "/")
    theirs = folders.where("size % 3 <> 0").select(said(place, "tsconfig.json").alias("path"), said('{"extends": "../../../c', text(key), '"}').alias("text"))
    brands = folders.groupBy("brand").agg(F.min("size").alias("size")).select(said("src/", F.col("brand"), "/jsconfig.json").alias("path"), said('{"compilerOptions": {"paths": {"@k0/*": ["./', text(F.col("size")), '/*"]}}}').alias("text"))
    mains = folders.select(said(place, "main.ts").alias("path"), F.lit("").alias("text"))
    asks = said("import a from '@k0/main'\nimport b from '@k1/main.js'\nimport c from '@k2/main'\nimport d from '~all'\nimport e from '", where, "/main'\nimport './main'\n")
    modules = part.select(said(place, "m", text(key), ".ts").alias("path"), asks.alias("text"))
    return roots.unionByName(theirs).unionByName(brands).unionByName(mains).unionByName(modules)


def _text(*parts) -> Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


def _dealt(rows: DataFrame, key: Column, texts: dict[int, tuple[Column, Column]], of: int) -> DataFrame:
    """(path, text) of the remainder of each row's key by `of`, for the remainders that have one."""
    path, text = (F.coalesce(*(F.when(key % of == n, one[i]) for n, one in texts.items())) for i in (0, 1))
    return rows.where((key % of).isin(*texts)).select(path.alias("path"), text.alias("text"))


def api_files(spark: SparkSession, at: str) -> DataFrame:
    """(path, text): a document for each page that says what its address serves: OpenAPI in JSON and in YAML, with a server or
    a basePath, serverless templates, protobuf services, and some that are broken."""
    key, lead = F.col("page_id"), F.regexp_extract("url", r"^https?://[^/]+(/[^/?#]+)", 1)
    route, server = _text(lead, "/{code}/", key), _text("https://h", key % 3, ".example.org:8080/api/")
    at_ = lambda name: _text("p", key, "/", name)
    json = _text('{ // made\n "openapi": "3.0.1", "servers": [{"url": "', server, '"}],\n "paths": {"', route, '": {"get": {}, "parameters": [],}, /* all */ "/all": {"post": {"x": {"delete": 1}}},},}')
    paths = _text('paths:\n  # said\n  "', route, '":\n    get:\n      summary: one\n\n    parameters: []\n  /all:\n    post:\n      x:\n        delete: 1\ncomponents:\n  /none:\n    get: 1\n')
    yaml, based = _text("openapi: 3.0.1\nservers:\n  - url: ", server, "\n", paths), _text("swagger: '2.0'\nhost: own.example.org:90\nbasePath: /v1\n", paths)
    cloud = _text("functions:\n  f:\n    events:\n      - http:\n          path: ", route, "\n          cors: true\n          method: get\n  g:\n    events:\n      - http:\n          method: post\n          path: /late\n          a: 1\n          b: 2\n          c: 3\n          d: 4\n          method: put\n")
    proto = _text("syntax = \"proto3\";\npackage a.b", key, ";\nservice Cart { rpc Add (X) returns (Y);\n  rpc Drop (X) returns (Y); }\n")
    return _dealt(table(spark, at, "pages"), key, {0: (at_("openapi.json"), json), 1: (at_("openapi.yaml"), yaml), 2: (at_("swagger.yml"), based), 3: (at_("serverless.yml"), cloud), 4: (at_("shop.proto"), proto), 5: (at_("openapi.json"), F.lit('{"openapi": "3.0.1", '))}, 6)


def collection_files(spark: SparkSession, at: str) -> DataFrame:
    """(path, text): a collection of requests for each page: Postman with up to three levels of folders and three ways to
    write an address, request files, Bruno's with and without GraphQL, and broken ones."""
    key, url = F.col("page_id"), F.col("url")
    at_ = lambda name: _text("p", key, "/", name)
    said = (key / 4).cast("long")
    address = F.when(said % 3 == 0, _text('"{{base}}/x/', key, '?y=1"')).when(said % 3 == 1, _text('{"raw": "', url, '"}')).otherwise('{"path": ["x", ":id"]}')
    request = _text('{"name": "r", "request": {"method": "put", "url": ', address, "}}")
    folder = lambda name, inner: _text('{"name": "', name, '", "item": [', inner, ', {"name": "none"}]}')
    two = folder("outer", folder("inner", request))
    item = F.when(key % 3 == 0, request).when(key % 3 == 1, folder("only", request)).otherwise(_text('{"name": "top", "item": ', two, ', "request": {"url": "/top"}}'))
    postman = _text('{"info": {}, /* said */ "item": [', item, ",]}")
    rest = _text("### one\nGET ", url, "\n\nPOST /b/", key, "\n")
    bruno = F.when(said % 2 == 0, _text("post {\n  url: {{host}}/g/", key, "\n  body: json\n}\n")).otherwise("meta {\n  name: Ask it\n}\npost {\n  url: {{host}}\n  body: graphql\n}\nbody:graphql {\n  query Pets { a }\n}\n")
    return _dealt(table(spark, at, "pages"), key, {0: (at_("a.postman_collection.json"), postman), 1: (at_("calls.http"), rest), 2: (at_("ask.bru"), bruno), 3: (at_("b.postman_collection.json"), F.lit('{"item": [1, 2'))}, 4)


def report_files(spark: SparkSession, at: str) -> DataFrame:
    """(path, text): a coverage report for each document, its numbers taken from the document's length, of each kind that is
    read; each fifth is broken, and a folder of two documents may have two."""
    key, n = F.col("doc_id"), F.coalesce("n_chars", F.lit(0))
    at_ = lambda name: _text("d", (key / 2).cast("long"), "/", name)
    share = lambda by: _text('{"total": ', n, ', "pct": ', n % by, ".5}")
    summary = _text('{"total": {"lines": ', share(7), ', "branches": ', share(11), ', // "statements": 1\n "functions": ', share(13), ",}}")
    python = _text('{"meta": {"note": "a // b, ]"}, "totals": {"percent_covered": ', n % 97, ".25}}")
    lcov = _text("TN:\nSF:a\nLF:", n + 3, "\nLH:", n, "\nBRF:8\nBRH:1\nend_of_record\nSF:b\nLF:1\nLH:1\nend_of_record\n")
    return _dealt(table(spark, at, "documents"), key, {0: (at_("coverage/coverage-summary.json"), summary), 1: (at_("coverage.json"), python), 2: (at_("coverage/lcov.info"), lcov), 3: (at_("coverage.lcov"), lcov), 4: (at_("coverage/coverage-summary.json"), F.lit('{"total": {"lines"'))}, 5)


def stack_files(spark: SparkSession, at: str) -> DataFrame:
    """(repo, path, text): each document as a file of its source's repository that leaves a mark or none, with its length as
    port or version."""
    key, n = F.col("doc_id"), F.coalesce("n_chars", F.lit(0))
    at_ = lambda name, folder="a": _text(folder, "/", key, "/", name)
    port = n % 50_000 + 10
    texts = {
        0: (at_("Dockerfile.prod"), _text("FROM x\nEXPOSE ", port, "\n  expose ", port + 1, "\n")), 1: (at_("docker-compose.yml"), _text('ports:\n  - "', port, ':80"\n')), 2: (at_(".nvmrc"), _text("v", n % 4 + 18, "\n")), 3: (at_("tsconfig.json"), F.when(key % 2 == 0, '{"compilerOptions": {"strict": true}}').otherwise('{"compilerOptions": {}}')),
        4: (_text(".github/workflows/c", key, ".yml"), F.when(key % 4 == 0, "uses: aws-actions/x").otherwise("run: y")), 5: (at_("main.tf", "infra"), F.lit("fly.io")), 6: (at_("vite.config.ts"), F.lit("")), 7: (at_("Dockerfile", "vendor"), F.lit("EXPOSE 1")), 8: (at_("Dockerfile", "tests"), F.lit("EXPOSE 2")),
        9: (at_(".env.local"), F.lit(None).cast("string")), 10: (at_("Info.plist", "ios"), F.lit("")), 11: (at_("plain.py"), F.lit("aws-actions/")),
    }
    named = table(spark, at, "documents").select("source", "doc_id", "n_chars")
    path, text = (F.coalesce(*(F.when(key % 12 == m, one[i]) for m, one in texts.items())) for i in (0, 1))
    return named.select(F.coalesce("source", F.lit("")).alias("repo"), path.alias("path"), text.alias("text"))


LITERAL_FOLDERS = ("src", "tests", "vendor", "app")


def literal_files(spark: SparkSession, at: str) -> DataFrame:
    """(path, text): a script for each document that says each of its lines in quotes, a path, a class list and an import."""
    key = F.col("doc_id")
    folder = F.get(F.array(*map(F.lit, LITERAL_FOLDERS)), (key % 4).cast("int"))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.concat(F.lit("say('"), F.translate(x, "'\\", ""), F.lit("')\n")))
    look = F.when(key % 3 == 0, 'look("flex items-center px-4 md:hover:text-xs")\n').when(key % 3 == 1, "look(`flex p-4 m-2 text-center`)\n").otherwise("import 'one package with a very long name'\nsay('one package with a very long name')\nsay('./some/path/that/names/itself')\n")
    return table(spark, at, "documents").select(_text(folder, "/d", key, ".tsx").alias("path"), F.concat(F.array_join(lines, ""), look).alias("text"))


def talks(spark: SparkSession, at: str) -> DataFrame:
    """(talk, seq, chunk): each conversation as JSON lines, cut into chunks of 100 characters wherever these end.

    What the user says has failed in every third turn, else it is silence; the assistant speaks in two pieces, and in some
    turns uses a tool between them. A result closes each turn and costs an eighth.
    """
    turn, text = F.col("turn"), F.coalesce("text", F.lit(""))
    part = lambda **kind: F.struct(*(c.alias(n) for n, c in kind.items()))
    json = lambda kind, *parts: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(F.array(*parts).alias("content")).alias("message")))
    none = F.lit(None)
    mine = lambda kind, text=none, name=none, path=none: part(type=F.lit(kind), text=text.cast("string"), name=name.cast("string"), input=F.when(path.isNotNull(), F.struct(path.cast("string").alias("path"))))
    said = F.when(turn % 4 == 1, json("assistant", mine("text", text), mine("tool_use", name=F.lit("Read"), path=_text("p/", turn)), mine("text", F.lit("then")))).otherwise(json("assistant", mine("text", text), mine("text", F.lit("then"))))
    failed = json("user", part(type=F.lit("tool_result"), is_error=turn % 3 == 0, content=text))
    line = F.concat(F.when(F.col("role") == "assistant", said).otherwise(failed), F.lit('\n{"type": "result", "total_cost_usd": 0.125}\n'))
    whole = table(spark, at, "conversations").groupBy(F.col("conv_id").cast("string").alias("talk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "").alias("all"))
    cuts = F.sequence(F.lit(0), F.floor((F.length("all") - 1) / 100).cast("int"))
    return whole.select("talk", F.posexplode(F.transform(cuts, lambda i: F.substring("all", i * 100 + 1, F.lit(100)))).alias("seq", "chunk"))


def follows(spark: SparkSession, at: str) -> DataFrame:
    """(src, dst, type): from the part of each order's first line to that of its second, where the first is closed at under
    0.08 off; those of each fifth order only carry a type."""
    rows = table(spark, at, "lineitem")
    first = rows.where("l_linenumber = 1 and l_returnflag <> 'N' and l_discount < 0.08").select("l_orderkey", F.col("l_partkey").alias("src"), (F.col("l_orderkey") % 5 == 0).alias("type"))
    second = rows.where("l_linenumber = 2").select("l_orderkey", F.col("l_partkey").alias("dst"))
    return first.join(second, "l_orderkey").where("src <> dst").select("src", "dst", "type")


def manifest_files(spark: SparkSession, at: str) -> DataFrame:
    """(path, text): a manifest for each part, of each kind that is read, which asks for packages named by the part's size."""
    key, n = F.col("p_partkey"), F.col("p_size")
    at_ = lambda name: _text("m", key, "/", name)
    texts = {
        0: (at_("package.json"), _text('{"dependencies": {"n', n, '": "^', n % 9, '.0"}, "devDependencies": {"vite": "5"}}')), 1: (at_("Cargo.toml"), _text('[package]\nname = "x"\n[dependencies]\ns', n, ' = { version = "1.', n, '", features = ["a"] } # said\nown = { path = "../own" }\n[dev-dependencies.t', n, ']\nversion = "1"\nfull = true')),
        2: (at_("requirements-dev.txt"), _text("p", n, ">=7 ; python_version > '3'\n# no\n-r other.txt\nrequests[socks] == 2.", n)), 3: (at_("build.gradle"), _text("dependencies {\n  implementation 'g:a", n, ":1.2'\n  testImplementation(\"h:b\")\n}")), 4: (at_("pom.xml"), _text("<dependency>\n<groupId>g</groupId><artifactId>z", n, "</artifactId><scope>test</scope></dependency>")),
        5: (at_("go.mod"), _text("module x\nrequire (\n\tgithub.com/a/b", n, " v1.2.3\n)")), 6: (at_("pubspec.yaml"), _text("name: x\ndependencies:\n  flutter:\n    sdk: flutter\n  h", n, ": ^1.0 # said\ndev_dependencies:\n    lints: '2.0'\n")), 7: (at_("pyproject.toml"), _text('[project]\ndependencies = [\n  "q', n, '>=1",\n]\n[project.optional-dependencies]\ndev = ["pytest"]\n')),
        8: (at_("package.json"), F.lit("not json")),
    }
    return _dealt(table(spark, at, "part"), key, texts, 9)


def mounts(spark: SparkSession, at: str) -> DataFrame:
    """(src, dst, prefix): parts mount the two of twice their number, some under two prefixes, and some mount what mounts
    them."""
    key, name = F.col("p_partkey"), lambda n: _text("f", n)
    part = table(spark, at, "part")
    down = part.where("p_partkey > 0").select(name((key / 2).cast("long")).alias("src"), name(key).alias("dst"), _text("/p", F.col("p_size"), "/").alias("prefix"))
    old = part.where("p_partkey > 0 and p_partkey % 11 = 0").select(name((key / 2).cast("long")).alias("src"), name(key).alias("dst"), F.lit("old").alias("prefix"))
    up = part.where("p_partkey >= 20 and p_partkey % 5 = 0").select(name(key).alias("src"), name((key / 4).cast("long")).alias("dst"), F.lit("/up").alias("prefix"))
    return down.unionByName(old).unionByName(up)


def renames(spark: SparkSession, at: str) -> DataFrame:
    """(seq, raw_path): orders from the newest on, each ten of them a file that is renamed twice."""
    key = F.col("o_orderkey")
    ten = (key / 10).cast("long")
    r = key % 10
    raw = F.when(r == 9, _text("g", ten, "/a0")).when(r == 8, _text("g", ten, "/a0 => g", ten, "/a1")).when(r == 7, _text("g", ten, "/a1")).when(r == 6, _text("g", ten, "/{a1 => a2}")).when(r == 4, _text("other", ten)).otherwise(_text("g", ten, "/a2"))
    return table(spark, at, "orders").select(key.alias("seq"), raw.alias("raw_path"))
