"""Registered queries over configurations, reports, documents and collections that the tables' rows are written as."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import compare, configs, coverage, documents, graph, history, imports, literals, manifests, paths, ranks, stack, units
from tessera.plans.catalog import FILES, LINES, ORACLE_SQL, query
from tessera.sources import formats
from tessera.sources.tables import LITERAL_FOLDERS, activity, api_files, collection_files, files, follows, fresh_path, literal_files, manifest_files, mounts, projects, renames, report_files, stack_files, table, talks
from tessera.streaming import transcripts

CHAINS = """WITH RECURSIVE p AS MATERIALIZED (SELECT p_partkey AS k, p_brand AS b, p_size AS s, p_brand || '/' || p_size AS w FROM part), n AS (SELECT k, CASE WHEN k % 6 = 0 THEN NULL WHEN k % 24 = 5 THEN k - 4 ELSE k + 1 END AS u FROM p),
  c AS (SELECT k, 0 AS step, k AS a, [k] AS seen FROM p WHERE k % 17 <> 0 UNION ALL SELECT c.k, c.step + 1, n.u, list_append(c.seen, n.u) FROM c JOIN n ON n.k = c.a WHERE n.u % 17 <> 0 AND n.u IN (SELECT k FROM p) AND NOT list_contains(c.seen, n.u)),
  e AS (SELECT c.k, c.step, unnest([0, 1]) AS place, unnest(['@k' || a % 3 || '/*', '~all']) AS pattern, unnest([w || '/*|src/' || w || '/*', 'x' || a]) AS targets, unnest([w, '']) AS home FROM c JOIN p ON p.k = a WHERE a % 4 <> 0),
  o AS (SELECT k, pattern, arg_min(targets, step) AS targets, arg_min(home, step) AS home, min((-step, place)) AS first FROM e GROUP BY k, pattern),
  m AS MATERIALIZED (SELECT k, (SELECT 'src' FROM c WHERE c.k = r.k AND c.a % 5 = 0 LIMIT 1) AS base_url, coalesce((SELECT string_agg(pattern || '=' || targets, ';' ORDER BY first) FROM o WHERE o.k = r.k), '') AS aliases FROM p r WHERE k % 17 <> 0),
  f AS MATERIALIZED (SELECT w, b, s, min(k) AS k FROM p GROUP BY ALL), j AS (SELECT b, min(s) AS s FROM f GROUP BY b)"""


@query(CHAINS + """ SELECT 'c' || k || '.json' AS path, '' AS folder, base_url, aliases FROM m UNION ALL SELECT 'src/' || w || '/tsconfig.json', CASE WHEN f.k % 17 = 0 THEN 'src/' || w ELSE '' END, base_url, coalesce(aliases, '') FROM f LEFT JOIN m USING (k) WHERE s % 3 <> 0
  UNION ALL SELECT 'src/' || b || '/jsconfig.json', 'src/' || b, NULL, '@k0/*=./' || s || '/*' FROM j""")
def config_settings(spark, at):
    told = F.array_join(F.transform("aliases", lambda a: F.concat(a["pattern"], F.lit("="), F.array_join(a["targets"], "|"))), ";")
    return configs.merged(configs.read(projects(spark, at))).select("path", "folder", "base_url", told.alias("aliases"))


CONFIGURED = CHAINS + """, t AS (SELECT f.w, CASE WHEN f.s % 3 <> 0 THEN m.base_url END AS base_url FROM f LEFT JOIN m USING (k)), h AS (SELECT f.w, o.pattern, o.home FROM f JOIN o ON o.k = f.k WHERE f.s % 3 <> 0 UNION ALL SELECT f.w, '@k0/*', f.b || '/' || j.s FROM f JOIN j ON j.b = f.b WHERE f.s % 3 = 0),
  a AS (SELECT k, w, b, unnest(['./main', '@k0/main', '@k1/main.js', '@k2/main', '~all', w || '/main']) AS specifier, unnest([NULL, '@k0/*', '@k1/*', '@k2/*', '~all', NULL]) AS pattern, unnest([NULL, '@k0/main', '@k1/main.js', '@k2/main', '~all', b]) AS package FROM p),
  i AS (SELECT 'src/' || a.w || '/m' || a.k || '.ts' AS src, specifier, CASE WHEN specifier = './main' OR (a.pattern IS NULL AND t.base_url = 'src') THEN 'src/' || a.w || '/main.ts' WHEN h.home <> '' THEN 'src/' || h.home || '/main.ts' END AS dst, h.home, package FROM a JOIN t USING (w) LEFT JOIN h ON h.w = a.w AND h.pattern = a.pattern),
  g AS (SELECT src, specifier, CASE WHEN dst IS NOT NULL THEN 'file' WHEN home IS NOT NULL THEN 'missing' ELSE 'package' END AS kind, dst, CASE WHEN dst IS NULL AND home IS NULL THEN package END AS package FROM i)"""


def configured(spark, at):
    files = projects(spark, at)
    return imports.resolved(files.where("path like '%.ts'"), settings=configs.settings(files))


@query(CONFIGURED + " SELECT * FROM g")
def configured_imports(spark, at):
    return configured(spark, at)


API = """WITH p AS (SELECT page_id AS k, regexp_extract(url, '^https?://[^/]+(/[^/?#]+)', 1) AS lead FROM pages), d AS (SELECT k, lead, 'p' || k || '/' || list_extract(['openapi.json', 'openapi.yaml', 'swagger.yml', 'serverless.yml', 'shop.proto'], (k % 6 + 1)::INT) AS path, k % 6 AS m FROM p WHERE k % 6 < 5)"""


@query(API + """ SELECT path, 'openapi' AS framework, 'GET' AS method, CASE WHEN m = 2 THEN '/v1' ELSE '/api' END || lead || '/*/' || k AS route, lead || '/{code}/' || k AS raw FROM d WHERE m < 3 UNION ALL SELECT path, 'openapi', 'POST', CASE WHEN m = 2 THEN '/v1/all' ELSE '/api/all' END, '/all' FROM d WHERE m < 3
  UNION ALL SELECT path, 'serverless', 'GET', lead || '/*/' || k, lead || '/{code}/' || k FROM d WHERE m = 3 UNION ALL SELECT path, 'grpc', 'POST', '/a.b' || k || '.Cart/' || rpc, '/a.b' || k || '.Cart/' || rpc FROM d, (VALUES ('Add'), ('Drop')) r(rpc) WHERE m = 4""")
def documented_endpoints(spark, at):
    return documents.served(api_files(spark, at))


@query("SELECT DISTINCT CASE WHEN page_id % 6 = 2 THEN 'own.example.org' ELSE 'h' || page_id % 3 || '.example.org' END AS host FROM pages WHERE page_id % 6 < 3")
def documented_hosts(spark, at):
    return documents.hosts(api_files(spark, at))


COLLECTED = """WITH p AS (SELECT page_id AS k, url, page_id // 4 AS s, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h, regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '(.)/$', '\\1') AS r FROM pages),
  a AS (SELECT *, 'p' || k || '/a.postman_collection.json' AS path, list_extract(['{{base}}/x/' || k || '?y=1', url, 'x/:id'], (s % 3 + 1)::INT) AS raw, list_extract(['/x/' || k, r, '/x/*'], (s % 3 + 1)::INT) AS route, list_extract(['*base', h, ''], (s % 3 + 1)::INT) AS host FROM p WHERE k % 4 = 0)"""


@query(COLLECTED + """ SELECT path, 'postman' AS framework, 'PUT' AS method, route, host, '' AS name, raw FROM a UNION ALL SELECT path, 'postman', 'ANY', '/top', '', '', '/top' FROM a WHERE k % 3 = 2
  UNION ALL SELECT 'p' || k || '/calls.http', 'rest', 'GET', r, h, '', url FROM p WHERE k % 4 = 1 UNION ALL SELECT 'p' || k || '/calls.http', 'rest', 'POST', '/b/' || k, '', '', '/b/' || k FROM p WHERE k % 4 = 1
  UNION ALL SELECT 'p' || k || '/ask.bru', CASE WHEN s % 2 = 0 THEN 'bruno' ELSE 'graphql' END, 'POST', CASE WHEN s % 2 = 0 THEN '/g/' || k ELSE '/' END, '*host', CASE WHEN s % 2 = 0 THEN '' ELSE 'query Pets' END, '{{host}}' || CASE WHEN s % 2 = 0 THEN '/g/' || k ELSE '' END FROM p WHERE k % 4 = 2""")
def collection_requests(spark, at):
    return documents.requests(collection_files(spark, at))


@query(COLLECTED + """ SELECT path, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'only' ELSE 'top/outer/inner' END AS folder, 'r' AS name, 'put' AS method, raw AS url FROM a UNION ALL SELECT path, '', 'top', 'any', '/top' FROM a WHERE k % 3 = 2""")
def collection_folders(spark, at):
    told = documents.collected(documents._told(collection_files(spark, at)))
    return told.select("path", F.array_join("folders", "/").alias("folder"), "name", "method", "url")


@query("""WITH d AS (SELECT doc_id AS k, 'd' || doc_id // 2 AS folder, coalesce(n_chars, 0) AS n, doc_id % 5 AS m FROM documents WHERE doc_id % 5 < 4),
  r AS (SELECT folder, folder || '/' || list_extract(['coverage/coverage-summary.json', 'coverage.json', 'coverage/lcov.info', 'coverage.lcov'], (m + 1)::INT) AS source, list_extract(['istanbul', 'coverage.py', 'lcov', 'lcov'], (m + 1)::INT) AS kind, m,
    CASE m WHEN 0 THEN n % 7 + .5 WHEN 1 THEN n % 97 + .25 ELSE floor((n + 1) / (n + 4) * 1000 + .5) / 10 END::DOUBLE AS lines, CASE m WHEN 0 THEN 0 WHEN 1 THEN n % 97 + .25 ELSE floor((n + 1) / (n + 4) * 1000 + .5) / 10 END::DOUBLE AS statements,
    CASE m WHEN 0 THEN n % 11 + .5 WHEN 1 THEN 0 ELSE 12.5 END::DOUBLE AS branches, CASE m WHEN 0 THEN n % 13 + .5 ELSE 0 END::DOUBLE AS functions FROM d)
  SELECT folder, source, kind, lines, statements, branches, functions FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY m) AS i FROM r) WHERE i = 1""")
def coverage_reports(spark, at):
    return coverage.reports(report_files(spark, at))


#: (facet, label, on, key, path_like, says, pick, once) in their order.
RULES = (
    ("dockerfiles", "Docker", "stem", "Dockerfile", None, None, None, None), ("compose", "Compose", "stem", "docker-compose", r"\.ya?ml$", None, None, None), ("terraform", "Terraform", "ending", ".tf", None, None, None, None), ("build", None, "stem", "vite.config", None, None, None, None),
    ("strict", "on", "stem", "tsconfig", r"\.json$", r'"strict"\s*:\s*true', None, "strict"), ("strict", "off", "stem", "tsconfig", r"\.json$", '"compilerOptions"', None, "strict"), ("node", None, "name", ".nvmrc", None, None, r"^\s*(\S+)", None), ("env", None, "stem", ".env", None, None, None, None),
    ("ports", None, "stem", "Dockerfile", None, None, r"(?im)^\s*EXPOSE\s+(\d+)", None), ("ports", None, "stem", "docker-compose", None, None, r"""["']?(\d{2,5}):\d{2,5}["']?""", None), ("hosts", "AWS", "below", ".github/workflows", r"\.ya?ml$", "aws-actions/", None, None), ("hosts", "Fly", "ending", ".tf", None, r"fly\.io", None, None), ("apps", "iOS", "folder", "ios", None, None, None, None),
)
MARKS = """(WITH d AS (SELECT coalesce(source, '') AS repo, doc_id AS k, coalesce(n_chars, 0) AS n, doc_id % 12 AS m FROM documents), t AS (SELECT repo, 'dockerfiles' AS facet, 'Docker' AS label, 0 AS place, 'a/' || k || '/Dockerfile.prod' AS path FROM d WHERE m = 0 UNION ALL SELECT repo, 'compose', 'Compose', 1, 'a/' || k || '/docker-compose.yml' FROM d WHERE m = 1
  UNION ALL SELECT repo, 'terraform', 'Terraform', 2, 'infra/' || k || '/main.tf' FROM d WHERE m = 5 UNION ALL SELECT repo, 'build', 'vite.config.ts', 3, 'a/' || k || '/vite.config.ts' FROM d WHERE m = 6 UNION ALL SELECT repo, 'strict', CASE WHEN k % 2 = 0 THEN 'on' ELSE 'off' END, 4, 'a/' || k || '/tsconfig.json' FROM d WHERE m = 3
  UNION ALL SELECT repo, 'node', 'v' || (n % 4 + 18), 6, 'a/' || k || '/.nvmrc' FROM d WHERE m = 2 UNION ALL SELECT repo, 'env', '.env.local', 7, 'a/' || k || '/.env.local' FROM d WHERE m = 9 UNION ALL SELECT repo, 'ports', (n % 50000 + 10 + x)::VARCHAR, 8, 'a/' || k || '/Dockerfile.prod' FROM d, (VALUES (0), (1)) v(x) WHERE m = 0
  UNION ALL SELECT repo, 'ports', (n % 50000 + 10)::VARCHAR, 9, 'a/' || k || '/docker-compose.yml' FROM d WHERE m = 1 UNION ALL SELECT repo, 'hosts', 'AWS', 10, '.github/workflows/c' || k || '.yml' FROM d WHERE m = 4 AND k % 4 = 0 UNION ALL SELECT repo, 'hosts', 'Fly', 11, 'infra/' || k || '/main.tf' FROM d WHERE m = 5 UNION ALL SELECT repo, 'apps', 'iOS', 12, 'ios/' || k || '/Info.plist' FROM d WHERE m = 10)
  SELECT repo, facet, label, count(DISTINCT path)::BIGINT AS files, arg_min(path, (place, path)) AS first FROM t GROUP BY ALL)"""


def _marks(spark, at):
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], stack.RULE)
    return stack.marks(stack_files(spark, at), rules)


@query(f"SELECT * FROM {MARKS}")
def stack_marks(spark, at):
    return _marks(spark, at)


ASKED = "(SELECT 'src' || p_partkey % 20 AS repo, p_partkey AS place, CASE p_partkey % 3 WHEN 0 THEN 'g' || p_size || ':lib' || p_size % 9 WHEN 1 THEN 'lib' || p_size % 9 ELSE '@scope' || p_size % 5 || '/x' || p_size END AS name, CASE p_partkey % 3 WHEN 0 THEN 'Maven' WHEN 1 THEN 'npm' ELSE 'PyPI' END AS ecosystem FROM part)"
LABELS = (("frameworks", "lib1", "React"), ("frameworks", "lib2", "Express"), ("connects", "lib3", "Postgres"), ("frameworks", "@scope1/", "Vue"), ("frameworks", "@scope1/x6", "Koa"), ("ui", "@scope2/", "Kit"), ("bins", "lib4", "parser"), ("ui", "lib1", "Look"))
PACKAGED = f"""(WITH a AS (SELECT *, list_extract(string_split(name, ':'), -1) AS tail FROM {ASKED}), l AS (SELECT * FROM (VALUES {', '.join(map(str, LABELS))}) v(facet, key, label)), h AS (SELECT repo, name, ecosystem, place, facet, label, row_number() OVER (PARTITION BY place, facet ORDER BY key = tail DESC, length(key) DESC) AS i FROM a JOIN l ON key = tail OR (ends_with(key, '/') AND starts_with(tail, key)))
  SELECT repo, facet, label, arg_min(name, (place, name)) AS package, arg_min(ecosystem, (place, name)) AS ecosystem FROM h WHERE i = 1 GROUP BY repo, facet, label)"""


def _packaged(spark, at):
    size, key = F.col("p_size"), F.col("p_partkey")
    said = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in c))
    turn = lambda *c: F.get(F.array(*c), (key % 3).cast("int"))
    asked = table(spark, at, "part").select(said("src", key % 20).alias("repo"), key.alias("place"), turn(said("g", size, ":lib", size % 9), said("lib", size % 9), said("@scope", size % 5, "/x", size)).alias("name"), turn(*map(F.lit, ("Maven", "npm", "PyPI"))).alias("ecosystem"))
    return stack.packaged(asked, spark.createDataFrame(LABELS, "facet string, key string, label string"))


@query(f"SELECT * FROM {PACKAGED}")
def package_facets(spark, at):
    return _packaged(spark, at)


@query(f"""WITH f AS (SELECT repo, facet, label FROM {MARKS} UNION ALL SELECT repo, facet, label FROM {PACKAGED}), m AS (SELECT 'src' || p_partkey % 20 AS repo, p_size % 3 AS packages, p_size % 7 = 0 AS workspaces, p_size % 11 = 0 AS bin FROM part WHERE p_size % 10 = 0), r AS (SELECT repo FROM f UNION SELECT repo FROM m),
  w AS (SELECT repo, [CASE WHEN EXISTS (FROM f WHERE f.repo = r.repo AND facet = 'frameworks' AND label IN ('React', 'Vue')) THEN 'frontend' END, CASE WHEN EXISTS (FROM f WHERE f.repo = r.repo AND (facet = 'connects' OR facet = 'frameworks' AND label IN ('Express', 'Koa'))) THEN 'backend' END, CASE WHEN EXISTS (FROM m WHERE m.repo = r.repo AND workspaces AND packages = 0) THEN 'monorepo root' END,
    CASE WHEN EXISTS (FROM m WHERE m.repo = r.repo AND workspaces) THEN 'monorepo' END, CASE WHEN EXISTS (FROM m WHERE m.repo = r.repo AND bin) OR EXISTS (FROM f WHERE f.repo = r.repo AND facet = 'bins') THEN 'cli' END, CASE WHEN EXISTS (FROM f WHERE f.repo = r.repo AND facet = 'apps') THEN 'ios' END, CASE WHEN EXISTS (FROM f WHERE f.repo = r.repo AND facet IN ('dockerfiles', 'compose', 'terraform')) THEN 'infra' END] AS l FROM r),
  x AS (SELECT repo, list_filter(l, lambda p: p IS NOT NULL) AS l FROM w) SELECT repo, unnest(range(len(l)))::INT AS place, unnest(l) AS part FROM x""")
def stack_parts(spark, at):
    facets = _marks(spark, at).select("repo", "facet", "label").unionByName(_packaged(spark, at).select("repo", "facet", "label"))
    size = F.col("p_size")
    manifests = table(spark, at, "part").where(size % 10 == 0).select(F.concat(F.lit("src"), (F.col("p_partkey") % 20).cast("string")).alias("repo"), (size % 3).alias("packages"), (size % 7 == 0).alias("workspaces"), (size % 11 == 0).alias("bin"))
    return stack.parts(facets, manifests)


SIGNS = r"[\d\s.,;:%#|/+_-]"
SAID = rf"""(WITH t AS (SELECT DISTINCT doc_id, replace(replace(raw, chr(39), ''), '\', '') AS said FROM (SELECT doc_id, raw FROM {LINES})), u AS (SELECT doc_id, said FROM t WHERE length(said) >= 24 AND NOT regexp_matches(said, '^[./~@]|^https?:|^node:') AND NOT regexp_matches(said, '^(?i)(?:[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}|[0-9a-f]{{16,}}|[A-Za-z0-9+/]{{24,}}={{0,2}})$')
    AND NOT regexp_matches(said, '^[MmLlHhVvCcSsQqTtAaZz][\d\s.,-]') AND NOT (len(regexp_extract_all(said, '{SIGNS}')) / length(said) > 0.6 AND NOT regexp_matches(said, '\s\w+\s\w+\s')) UNION ALL SELECT doc_id, 'flex items-center px-4 md:hover:text-xs' FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'flex p-4 m-2 text-center' FROM documents WHERE doc_id % 3 = 1)
  SELECT doc_id, list_extract({list(LITERAL_FOLDERS)}, (doc_id % 4 + 1)::INT) || '/d' || doc_id || '.tsx' AS path, said FROM u WHERE doc_id % 4 <> 2)"""
REPEATED = f"(SELECT said, count(*)::BIGINT AS files, starts_with(said, 'flex ') AS styled, min(path) AS first, (count(*) * length(said))::BIGINT AS weight FROM {SAID} GROUP BY said HAVING count(*) >= CASE WHEN starts_with(said, 'flex ') THEN 5 ELSE 3 END AND bool_or(doc_id % 4 <> 1))"


@query(f"SELECT * FROM {REPEATED}")
def repeated_literals(spark, at):
    return literals.repeated(literals.literals(literal_files(spark, at)))


@query(f"SELECT 'text:' || said AS id, 'text' AS kind, files AS reach, greatest(2, least(45, floor(2 + 1.5 * files + 0.5)))::BIGINT AS minutes FROM {REPEATED} WHERE NOT styled")
def literal_tasks(spark, at):
    return literals.tasks(literals.repeated(literals.literals(literal_files(spark, at))))


@query("""WITH p AS (SELECT k, o || '/' || p_type AS a, o || '/' || p_type || '/' || p_size AS b FROM (SELECT p_partkey AS k, replace(p_brand, '#', '') AS o, p_type, p_size FROM part)), h AS (SELECT DISTINCT a || '/*' AS c, a AS bare FROM p WHERE k % 5 = 0 UNION SELECT DISTINCT b, b FROM p WHERE k % 3 = 0), w AS (SELECT b AS path FROM p UNION SELECT a FROM p UNION SELECT split_part(a, '/', 1) FROM p UNION SELECT b || '/x.ts' FROM p WHERE k % 2 = 0),
  m AS (SELECT w.path, h.c, h.bare, CASE WHEN h.c = w.path THEN 0 WHEN h.bare = w.path OR starts_with(w.path, h.bare || '/') THEN 1 ELSE 2 END AS r FROM w JOIN h ON h.bare = w.path OR starts_with(w.path, h.bare || '/') OR starts_with(h.bare, w.path || '/')),
  o AS (SELECT path, c, r, row_number() OVER (PARTITION BY path ORDER BY r, CASE WHEN r = 1 THEN -length(bare) ELSE length(bare) END, c) AS i FROM m) SELECT path, c AS container, list_extract(['same', 'over', 'under'], r + 1) AS how FROM w LEFT JOIN (SELECT * FROM o WHERE i = 1) USING (path)""")
def nearest_containers(spark, at):
    part = table(spark, at, "part")
    # a hash sign would mark a part of a path
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    key, a = F.col("p_partkey"), F.concat_ws("/", brand, "p_type")
    b = F.concat_ws("/", a, F.col("p_size").cast("string"))
    held = part.where(key % 5 == 0).select(F.concat(a, F.lit("/*")).alias("path")).union(part.where(key % 3 == 0).select(b))
    picked = part.select(b.alias("path")).union(part.select(a)).union(part.select(brand)).union(part.where(key % 2 == 0).select(F.concat(b, F.lit("/x.ts"))))
    return paths.nearest_container(picked, held)


NODES = f"(WITH f AS (SELECT path, weight AS w FROM {FILES}), u AS (SELECT '' AS path, w FROM f UNION ALL SELECT split_part(path, '/', 1), w FROM f UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), w FROM f UNION ALL SELECT path, w FROM f) SELECT path, sum(w)::BIGINT AS weight FROM u GROUP BY path)"


@query(f"""WITH RECURSIVE n AS MATERIALIZED (SELECT *, CASE WHEN path = '' THEN NULL WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM {NODES}), s AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY weight DESC, path) AS i FROM n),
  t AS (SELECT path, 0 AS depth, [0::BIGINT] AS trail FROM s WHERE path = '' UNION ALL SELECT s.path, t.depth + 1, list_append(t.trail, s.i) FROM t JOIN s ON s.parent = t.path) SELECT path, depth, row_number() OVER (ORDER BY trail)::BIGINT AS place FROM t""")
def tree_places(spark, at):
    rolled = history.tree_rollup(files(spark, at), "path", ["weight"])
    return paths.preorder(rolled, "weight")


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS brand, p_size AS size, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(left(p_name, 1)) || substr(p_name, 2) END AS name FROM part), r AS (SELECT *, lower(name) AS l, name <> lower(name) AS u FROM p)
  SELECT k, row_number() OVER (PARTITION BY brand ORDER BY l DESC, u DESC, k) AS name_down, row_number() OVER (PARTITION BY brand ORDER BY l, u, k) AS name_up, row_number() OVER (PARTITION BY brand ORDER BY size DESC, k) AS size_down, row_number() OVER (PARTITION BY brand ORDER BY k) AS unsorted FROM r""")
def sorted_columns(spark, at):
    # the three states of two columns, as places within each brand
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.upper(F.left("p_name", F.lit(1))), F.substring("p_name", 2, 1000)))
    rows = table(spark, at, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), name.alias("name"))
    sort, out = None, rows
    for key in ("name", "name", "name", "size"):
        sort = compare.cycled(sort, key)
        label = "unsorted" if sort is None else f"{key}_{'up' if sort[1] else 'down'}"
        out = ranks.ranked_within(out, ["brand"], compare.order_of(rows, sort, "k"), name=label)
    return out.select("k", "name_down", "name_up", "size_down", "unsorted")


@query("""WITH s AS (SELECT user_id AS key, min(ts)::DATE AS first, max(ts)::DATE AS last, list_extract(['hour', 'day', 'week', 'month', 'year'], (user_id % 5 + 1)::INT) AS wanted, user_id % 5 AS w FROM events GROUP BY user_id), d AS (SELECT *, (last - first)::INT AS days FROM s),
  o AS (SELECT key, g, i, abs(i - w) AS away FROM d, (VALUES ('hour', 0, 0, 31), ('day', 1, 0, NULL), ('week', 2, 7, NULL), ('month', 3, 31, NULL), ('year', 4, 365, NULL)) v(g, i, low, high) WHERE days >= low AND (high IS NULL OR days <= high))
  SELECT key, days, (SELECT string_agg(g, ',' ORDER BY i) FROM o WHERE o.key = d.key) AS offered, wanted, (SELECT arg_min(g, (away, i)) FROM o WHERE o.key = d.key) AS nearest FROM d""")
def offered_grains(spark, at):
    names = F.array(*(F.lit(g) for g, _, _ in history.GRAINS))
    spans = activity(spark, at).groupBy(F.col("who").alias("key")).agg(F.to_date(F.min("ts")).alias("first"), F.to_date(F.max("ts")).alias("last"))
    return history.grains(spans.withColumn("wanted", F.get(names, (F.col("key") % 5).cast("int"))))


@query("""WITH b AS (SELECT date_trunc('week', ts)::TIMESTAMP AS starts, count(*)::BIGINT AS n FROM events GROUP BY 1), z AS (SELECT max(ts) - INTERVAL 20 DAY AS a, max(ts) - INTERVAL 10 DAY AS b FROM events) SELECT starts, n FROM b, z WHERE starts <= z.b AND starts + INTERVAL 7 DAY - INTERVAL 1 MICROSECOND >= z.a""")
def zoomed_weeks(spark, at):
    rows = activity(spark, at)
    weeks = rows.groupBy(F.date_trunc("week", "ts").alias("starts")).agg(F.count("*").alias("n")).withColumn("ends", F.expr("starts + interval 7 days - interval 1 microsecond"))
    last = rows.agg(F.max("ts").alias("last"))  # one row
    shown = history.zoomed(weeks.join(F.broadcast(last)), "starts", "ends", F.expr("last - interval 20 days"), F.expr("last - interval 10 days"))
    return shown.select("starts", "n")


@query("""WITH e AS (SELECT conv_id, turn, unnest(CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN [1, 2, 3] WHEN role = 'assistant' THEN [1, 3] WHEN turn % 3 = 0 THEN [0] ELSE [] END) AS sub, coalesce(text, '') AS text FROM conversations),
  s AS (SELECT conv_id, turn, sub, CASE sub WHEN 0 THEN 'note' WHEN 2 THEN 'tool' ELSE 'agent' END AS who, CASE sub WHEN 0 THEN 'that failed: ' || left(text, 200) WHEN 1 THEN text WHEN 2 THEN 'p/' || turn ELSE 'then' END AS text FROM e WHERE sub <> 1 OR trim(text) <> ''),
  m AS (SELECT *, CASE WHEN who = 'agent' AND lag(who) OVER w = 'agent' THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn, sub)), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, sub) AS place FROM m)
  SELECT conv_id::VARCHAR AS talk, place::BIGINT AS place, any_value(who) AS who, CASE WHEN any_value(who) = 'tool' THEN 'Read' END AS tool, string_agg(text, '' ORDER BY turn, sub) AS text FROM r GROUP BY conv_id, place""")
def transcript_turns(spark, at):
    return transcripts.turns(talks(spark, at))


@query("SELECT conv_id::VARCHAR AS talk, count(*) / 8 AS cost, count(*)::BIGINT AS results FROM conversations GROUP BY conv_id")
def transcript_costs(spark, at):
    return transcripts.costs(talks(spark, at))


@query("SELECT p_partkey::VARCHAR AS key, p_name AS name, p_size::VARCHAR AS size FROM part")
def markdown_rows(spark, at):
    # written as tables and read back
    formats.register(spark)
    path = fresh_path(spark)
    table(spark, at, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_size").alias("size")).write.format("tessera_table").option("as", "markdown").option("name", "parts").mode("append").save(path)
    cells = F.split(F.col("value"), r"\s*\|\s*")
    rows = spark.read.text(path).where("value like '| %' and not value like '| key %' and not value like '| ---%'")
    return rows.select(*(F.trim(F.get(cells, F.lit(i + 1))).alias(n) for i, n in enumerate(("key", "name", "size"))))


FOLLOWS = "(SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst, a.l_orderkey % 5 = 0 AS type FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_linenumber = 1 AND a.l_returnflag <> 'N' AND a.l_discount < 0.08 AND b.l_linenumber = 2 AND a.l_partkey <> b.l_partkey)"
CLOSED = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT src, dst FROM {FOLLOWS}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), n AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e),
  m AS MATERIALIZED (SELECT x.a AS node, min(x.b) AS ring FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), g AS MATERIALIZED (SELECT node, coalesce(ring, node) AS ring FROM n LEFT JOIN m USING (node))"""


def _edges(spark, at):
    return follows(spark, at).distinct()


@query(CLOSED + " SELECT * FROM g")
def part_rings(spark, at):
    return graph.components(_edges(spark, at).select("src", "dst"))


@query(CLOSED + """, o AS MATERIALIZED (SELECT DISTINCT a.ring AS ra, b.ring AS rb FROM e JOIN g a ON src = a.node JOIN g b ON dst = b.node WHERE a.ring <> b.ring), w AS (SELECT DISTINCT ring AS r0, 0 AS level FROM g UNION SELECT o.ra, w.level + 1 FROM w JOIN o ON o.rb = w.r0) SELECT node, max(level)::BIGINT AS level FROM g JOIN w ON ring = r0 GROUP BY node""")
def part_levels(spark, at):
    return graph.levels(_edges(spark, at).select("src", "dst"))


@query(CLOSED + ", s AS (SELECT DISTINCT src AS node FROM e WHERE src % 40 = 0) SELECT node FROM s UNION SELECT b FROM r JOIN s ON a = node")
def part_reach(spark, at):
    rows = _edges(spark, at)
    return graph.reached(rows, rows.where("src % 40 = 0").select(F.col("src").alias("node")))


#: Parts of a brand and size are one unit.
UNITED = f"""WITH RECURSIVE u AS MATERIALIZED (SELECT p_partkey AS node, p_brand || '/' || p_size AS unit FROM part), f AS MATERIALIZED (SELECT * FROM {FOLLOWS}), t AS MATERIALIZED (SELECT a.unit AS src, b.unit AS dst, count(*) AS n, count(*) FILTER (type) AS types FROM f JOIN u a ON src = a.node JOIN u b ON dst = b.node WHERE a.unit <> b.unit GROUP BY ALL),
  ra AS (SELECT src AS a, dst AS b FROM t UNION SELECT ra.a, t.dst FROM ra JOIN t ON ra.b = t.src), ga AS MATERIALIZED (SELECT x.a AS unit, min(x.b) AS tangle FROM ra x JOIN ra y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1), tr AS MATERIALIZED (SELECT * FROM t WHERE n > types), rr AS (SELECT src AS a, dst AS b FROM tr UNION SELECT rr.a, tr.dst FROM rr JOIN tr ON rr.b = tr.src), gr AS (SELECT DISTINCT x.a AS unit FROM rr x JOIN rr y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b),
  fe AS MATERIALIZED (SELECT DISTINCT src, dst FROM f WHERE NOT type), rf AS (SELECT src AS a, dst AS b FROM fe UNION SELECT rf.a, fe.dst FROM rf JOIN fe ON rf.b = fe.src), gf AS MATERIALIZED (SELECT x.a AS node, min(x.b) AS ring FROM rf x JOIN rf y ON x.a = y.b AND x.b = y.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1), sp AS MATERIALIZED (SELECT DISTINCT ring, unit FROM gf JOIN u USING (node))"""


def _units(spark, at):
    return table(spark, at, "part").select(F.col("p_partkey").alias("node"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("unit"))


@query(UNITED + """ SELECT tangle, count(*)::BIGINT AS size, (SELECT count(*) FROM t JOIN ga x ON t.src = x.unit JOIN ga y ON t.dst = y.unit WHERE x.tangle = g.tangle AND y.tangle = g.tangle)::BIGINT AS edges, EXISTS (FROM ga x JOIN gr USING (unit) WHERE x.tangle = g.tangle) AS runtime,
  EXISTS (SELECT ring FROM sp JOIN ga x USING (unit) WHERE x.tangle = g.tangle GROUP BY ring HAVING count(*) > 1) AS deep FROM ga g GROUP BY tangle""")
def part_tangles(spark, at):
    return units.flagged_tangles(_edges(spark, at), _units(spark, at))


@query(UNITED + " SELECT a.unit AS src, b.unit AS dst, count(*)::BIGINT AS n FROM f JOIN gf x ON f.src = x.node JOIN gf y ON f.dst = y.node AND x.ring = y.ring JOIN u a ON f.src = a.node JOIN u b ON f.dst = b.node WHERE NOT type AND a.unit <> b.unit GROUP BY ALL")
def part_ring_edges(spark, at):
    return units.ring_edges(_edges(spark, at), _units(spark, at))


LICENCES = (("MIT", "permissive"), ("Apache-2.0 OR GPL-3.0", "permissive"), ("(MIT AND LGPL-2.1)", "weak"), ("GPL-2.0-only", "strong"), ("UNLICENSED", "closed"), ("The ISC License", "permissive"), ("", "unknown"), ("Strange", "unknown"), ("CC-BY-NC-4.0", "strong"), ("CC-BY-4.0", "permissive"))


@query(f"SELECT p_partkey AS key, said, family FROM part JOIN (VALUES {', '.join(str((i, *x)) for i, x in enumerate(LICENCES))}) v(i, said, family) ON i = p_partkey % 10")
def licence_families(spark, at):
    said = F.get(F.array(*(F.lit(x) for x, _ in LICENCES)), (F.col("p_partkey") % 10).cast("int"))
    return table(spark, at, "part").select(F.col("p_partkey").alias("key"), said.alias("said")).withColumn("family", S.licence_family(F.col("said")))


@query(f"""WITH r AS (SELECT page_id, host, regexp_extract(path, '^/[^/]*') AS lead FROM ({ORACLE_SQL['route_normal']})) SELECT page_id AS client, 'e:' || lead AS endpoint, 4::BIGINT AS score, 'exact' AS how FROM r WHERE host IN (SELECT host FROM r WHERE page_id % 2 = 0)""")
def route_links(spark, at):
    # the hosts of every other page are known
    pages = table(spark, at, "pages").select("page_id", S.route_host(F.col("url")).alias("host"), S.route_path(F.col("url")).alias("path"))
    lead = F.regexp_extract("path", "^/[^/]*", 0)
    ends = pages.select(F.concat(F.lit("e:"), lead).alias("id"), F.lit("GET").alias("method"), F.concat(lead, F.lit("/*")).alias("path")).distinct()
    return graph.route_links(pages.select(F.col("page_id").alias("id"), F.lit("GET").alias("method"), "path", "host"), ends, pages.where("page_id % 2 = 0").select("host"))


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS n FROM part), a AS (SELECT k, n, v.* FROM p, (VALUES (0, 'package.json', 'n', '^', false, 'npm'), (0, 'package.json', 'vite', '5', true, 'npm'), (1, 'Cargo.toml', 's', '1.', false, 'crates.io'), (1, 'Cargo.toml', 'own', '', false, 'crates.io'), (1, 'Cargo.toml', 't', '1', true, 'crates.io'), (2, 'requirements-dev.txt', 'p', '>=7', true, 'PyPI'), (2, 'requirements-dev.txt', 'requests', '== 2.', true, 'PyPI'),
    (3, 'build.gradle', 'g:a', '1.2', false, 'Maven'), (3, 'build.gradle', 'h:b', '', true, 'Maven'), (4, 'pom.xml', 'g:z', '', true, 'Maven'), (5, 'go.mod', 'github.com/a/b', 'v1.2.3', false, 'Go'), (6, 'pubspec.yaml', 'flutter', '', false, 'Pub'), (6, 'pubspec.yaml', 'h', '^1.0', false, 'Pub'), (6, 'pubspec.yaml', 'lints', '2.0', true, 'Pub'), (7, 'pyproject.toml', 'q', '>=1', false, 'PyPI'), (7, 'pyproject.toml', 'pytest', '', true, 'PyPI')) v(m, file, name, range, dev, ecosystem) WHERE m = k % 9)
  SELECT 'm' || k || '/' || file AS path, name || CASE WHEN name IN ('n', 's', 't', 'p', 'g:a', 'g:z', 'github.com/a/b', 'h', 'q') THEN n::VARCHAR ELSE '' END AS name, CASE range WHEN '^' THEN '^' || n % 9 || '.0' WHEN '1.' THEN '1.' || n WHEN '== 2.' THEN '== 2.' || n ELSE range END AS range, dev, ecosystem FROM a""")
def manifest_requests(spark, at):
    return manifests.asked(manifest_files(spark, at))


@query(f"SELECT path, framework AS kind, method, route FROM ({ORACLE_SQL['documented_endpoints']}) UNION ALL SELECT path, framework, method, route FROM ({ORACLE_SQL['collection_requests']})")
def api_documents(spark, at):
    told = [rows.select("path", F.col("framework").alias("kind"), "method", "route") for rows in (documents.served(api_files(spark, at)), documents.requests(collection_files(spark, at)))]
    return told[0].unionByName(told[1])


@query("SELECT 'd' || doc_id // 2 || '/' || CASE WHEN doc_id % 5 = 2 THEN 'coverage/lcov.info' ELSE 'coverage.lcov' END AS path, floor((coalesce(n_chars, 0) + 1) / (coalesce(n_chars, 0) + 4) * 1000 + .5) / 10 AS lines, 12.5::DOUBLE AS branches, 0.0::DOUBLE AS functions FROM documents WHERE doc_id % 5 IN (2, 3)")
def lcov_coverage(spark, at):
    return manifests.lcov_coverage(report_files(spark, at).where("path like '%lcov%'"))


@query("""WITH p AS (SELECT p_partkey AS k, p_name AS name, p_brand AS a, p_type AS b FROM part), u AS (SELECT name, a, b, a || '/' || b || '/x' || k || '.ts' AS src FROM p WHERE k % 3 = 0), d AS (SELECT name, a, b, a || '/' || b || '/d' || k || '.ts' AS dst FROM p WHERE k % 7 = 1),
  m AS (SELECT u.name, src, dst, CASE WHEN u.a <> d.a THEN 0 WHEN u.b <> d.b THEN 1 ELSE 2 END AS n FROM u JOIN d USING (name)), b AS (SELECT name, src, max(n) AS n FROM m GROUP BY ALL) SELECT name, src, CASE WHEN count(DISTINCT dst) = 1 THEN min(dst) END AS dst FROM m JOIN b USING (name, src, n) GROUP BY name, src""")
def nearest_declaring(spark, at):
    key = F.col("p_partkey")
    rows = lambda of, mark: table(spark, at, "part").where(of).select(F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type", F.concat(F.lit(mark), key.cast("string"), F.lit(".ts"))).alias("file"))
    return units.nearest_declaring(rows(key % 3 == 0, "x"), rows(key % 7 == 1, "d"))


@query("WITH s AS (SELECT p_brand AS b, max(p_size) AS m FROM part GROUP BY 1) SELECT DISTINCT '@' || p_brand || '/' || p_type AS name, CASE WHEN p_type = 'PROMO' THEN 'Promo' WHEN m > 45 THEN p_brand END AS label FROM part JOIN s ON b = p_brand")
def package_labels(spark, at):
    part = table(spark, at, "part")
    scope = F.concat(F.lit("@"), "p_brand", F.lit("/"))
    wide = part.groupBy("p_brand").agg(F.max("p_size").alias("m")).where("m > 45").select(scope.alias("key"), F.col("p_brand").alias("label"))
    own = part.where("p_type = 'PROMO'").select(F.concat(scope, "p_type").alias("key"), F.lit("Promo").alias("label")).distinct()
    return units.labelled(part.select(F.concat(scope, "p_type").alias("name")), wide.unionByName(own))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k, p_size AS n FROM part), m AS MATERIALIZED (SELECT k // 2 AS src, k AS dst, 'p' || n AS prefix FROM p WHERE k > 0 UNION ALL SELECT k // 2, k, 'old' FROM p WHERE k > 0 AND k % 11 = 0 UNION ALL SELECT k, k // 4, 'up' FROM p WHERE k >= 20 AND k % 5 = 0),
  w AS (SELECT 0::BIGINT AS file, '' AS prefix, [0::BIGINT] AS seen UNION ALL SELECT m.dst, w.prefix || '/' || m.prefix, list_append(w.seen, m.dst) FROM w JOIN m ON m.src = w.file WHERE NOT list_contains(w.seen, m.dst)) SELECT DISTINCT 'f' || file AS file, prefix FROM w""")
def mounted_prefixes(spark, at):
    return graph.mounted(mounts(spark, at), table(spark, at, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file")))


@query("WITH o AS (SELECT o_orderkey AS seq, o_orderkey // 10 AS g, o_orderkey % 10 AS r FROM orders) SELECT seq, CASE r WHEN 9 THEN 'g' || g || '/a0' WHEN 8 THEN 'g' || g || '/a0 => g' || g || '/a1' WHEN 7 THEN 'g' || g || '/a1' WHEN 6 THEN 'g' || g || '/{a1 => a2}' WHEN 4 THEN 'other' || g ELSE 'g' || g || '/a2' END AS raw_path, CASE r WHEN 4 THEN 'other' || g ELSE 'g' || g || '/a2' END AS path FROM o")
def renames_followed(spark, at):
    return history.followed(renames(spark, at))


@query("WITH t AS (SELECT c_custkey AS k, 'helper' AS tool FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey % 3 = 0 UNION SELECT c_custkey, 'mender' FROM customer WHERE c_custkey % 4 = 0) SELECT tool, count(*)::BIGINT AS commits FROM t GROUP BY tool")
def signed_commits(spark, at):
    # a segment's customers are a bot's, others signed in a trailer by their number
    key = F.col("c_custkey")
    said = F.concat(F.lit("by hand, no helper\n"), F.when(key % 3 == 0, "Co-authored-by: Helper <h@x>\nco-authored-by: helper <h@x>\n").otherwise(""), F.when(key % 4 == 0, "assisted-by: mender:one").otherwise(""))
    rows = table(spark, at, "customer").select(key.cast("string").alias("hash"), F.when(F.col("c_mktsegment") == "BUILDING", "helper[bot] <1@x>").otherwise("Helper <h@x>").alias("author"), said.alias("body"))
    return history.signed(rows, [("(?i)helper", "helper"), ("(?i)mender", "mender")])


@query(f"SELECT path, framework, method, route FROM ({ORACLE_SQL['documented_endpoints']}) WHERE framework = 'openapi' AND NOT (method = 'GET' AND regexp_extract(route, '([0-9]+)$', 1)::BIGINT % 4 = 0)")
def documents_only(spark, at):
    # each fourth page's address is served by code as well
    said = documents.served(api_files(spark, at)).where("framework = 'openapi'").withColumnRenamed("route", "at").withColumnRenamed("path", "file").withColumnRenamed("at", "path")
    served = said.where("method = 'GET'").where(F.regexp_extract("path", "([0-9]+)$", 1).cast("long") % 4 == 0)
    return compare.answered(said, served.select("method", "path")).select(F.col("file").alias("path"), "framework", "method", F.col("path").alias("route"))
