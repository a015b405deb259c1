"""Registered queries over imports, endpoints, findings and several repositories."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import api, compare, fleet, history, imports, ranks, tasks, units
from tessera.plans.catalog import CHANGES, COMMITS, FILES, ORACLE_SQL, query
from tessera.sources.tables import MODULE_ENDS, activity, changes, code, commits, files, table

MODULES = f"(SELECT p_partkey AS k, p_brand AS b, 'src/' || p_brand || '/m' || p_partkey || list_extract({list(MODULE_ENDS)}, (p_partkey % 3 + 1)::INT) AS path FROM part)"
FOUND = f"""WITH p AS MATERIALIZED (SELECT * FROM {MODULES}), s AS (SELECT path AS src, b, './m' || (k + 1) AS specifier, CASE WHEN k % 3 <> 2 THEN k + 1 END AS t, 'missing' AS other, NULL AS pack FROM p
  UNION ALL SELECT path, b, '@/' || b || '/m' || (k + 2), k + 2, 'missing', NULL FROM p UNION ALL SELECT path, b, '@org/' || b || '/m' || (k + 3), CASE WHEN EXISTS (FROM p x WHERE x.k = p.k + 3 AND x.b = p.b) THEN k + 3 ELSE 0 END, 'package', '@org/' || b FROM p
  UNION ALL SELECT path, b, '../' || b || '/m' || (k + 4) || '.js', CASE WHEN k % 3 <> 2 AND (k + 4) % 3 <> 2 THEN k + 4 END, 'missing', NULL FROM p UNION ALL SELECT path, b, 'react/jsx', NULL, 'package', 'react' FROM p UNION ALL SELECT path, b, '@org/none/x', NULL, 'package', '@org/none' FROM p),
  f AS MATERIALIZED (SELECT src, specifier, CASE WHEN d.path IS NULL THEN other ELSE 'file' END AS kind, d.path AS dst, CASE WHEN d.path IS NULL THEN pack END AS package FROM s LEFT JOIN p d ON d.k = s.t AND d.b = s.b)"""
TOTALS = FOUND + """, c AS (SELECT regexp_extract(src, '^[^/]+/[^/]+') AS part, count(DISTINCT src)::BIGINT AS files, count(*) FILTER (kind = 'file')::BIGINT AS edges, count(*) FILTER (kind = 'package')::BIGINT AS external, count(*) FILTER (kind = 'missing')::BIGINT AS missing, count(*)::BIGINT AS seen FROM f GROUP BY 1)"""


def _found(spark, at):
    homes = table(spark, at, "part").select(F.concat(F.lit("@org/"), "p_brand").alias("name"), F.concat(F.lit("src/"), "p_brand").alias("folder"), F.lit("m0").alias("entry")).distinct()
    return imports.resolved(code(spark, at), [("@/*", ("alt/*", "src/*"))], homes)


def _parts(spark, at):
    return imports.totals(_found(spark, at), code(spark, at), lambda c: F.substring_index(c, "/", 2))


@query(FOUND + " SELECT * FROM f")
def imports_resolved(spark, at):
    return _found(spark, at)


@query(TOTALS + " SELECT *, round((seen - missing) / seen, 6) AS coverage FROM c")
def import_totals(spark, at):
    return _parts(spark, at)


@query(TOTALS + " SELECT sum(files)::BIGINT AS files, sum(edges)::BIGINT AS edges, sum(external)::BIGINT AS external, sum(missing)::BIGINT AS missing, sum(seen)::BIGINT AS seen, round((sum(seen) - sum(missing)) / sum(seen), 6) AS coverage FROM c")
def imports_summed(spark, at):
    return imports.summed(_parts(spark, at))


@query(FOUND + " SELECT path, k % 2 = 1 AND EXISTS (FROM f WHERE src = path AND kind = 'file') AS barrel FROM p")
def forwarding_files(spark, at):
    return imports.forwarding(_found(spark, at), imports.symbols(code(spark, at)))


@query(f"SELECT path, (CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS exports, (k % 2 = 0)::BIGINT AS declares, (k % 2 = 0)::BIGINT AS functions, 0::BIGINT AS classes, true AS forwards FROM {MODULES}")
def symbol_counts(spark, at):
    return imports.symbols(code(spark, at))


@query(f"WITH p AS (SELECT *, array_to_string(list_slice(string_split(path, '/'), 1, -2), '/') AS folder FROM {MODULES}), a AS (SELECT min(path) AS src, folder FROM p WHERE k % 3 <> 2 GROUP BY folder) SELECT src, path AS dst FROM a JOIN p USING (folder) WHERE src <> path")
def folder_imports(spark, at):
    # the first module of each folder that holds several imports the whole folder
    modules = code(spark, at)
    asked = modules.where(~F.endswith("path", F.lit("/index.ts"))).groupBy(imports.folder_of(F.col("path")).alias("folder")).agg(F.min("path").alias("src"))
    return imports.into_folders(asked.select("src", "folder"), modules)


@query(f"WITH p AS (SELECT * FROM {MODULES} WHERE k % 3 <> 2) SELECT x.path AS src, y.path AS dst FROM p x JOIN p y ON x.b = y.b AND y.k BETWEEN x.k + 2 AND x.k + 4")
def sibling_words(spark, at):
    # what is imported relatively has an edge already
    near = _found(spark, at).where("kind = 'file' and specifier like './%'")
    return imports.siblings(code(spark, at), near)


ROUTES = f"""WITH r AS MATERIALIZED (SELECT page_id, path, regexp_extract(path, '^/[^/]*') AS lead, starts_with(url, 'https') AS safe FROM ({ORACLE_SQL['route_normal']}) JOIN pages USING (page_id)), e AS MATERIALIZED (SELECT DISTINCT 'c:' || lead AS id, 'GET' AS method, lead || '/*' AS path, 'web' AS framework FROM r WHERE safe
  UNION ALL SELECT DISTINCT 'd:' || lead, 'GET', lead || '/*', 'openapi' FROM r UNION ALL SELECT DISTINCT 'd:' || path, 'ANY', path, 'openapi' FROM r WHERE NOT safe), h AS MATERIALIZED (SELECT * FROM e WHERE framework <> 'openapi' OR NOT EXISTS (FROM e c WHERE c.framework <> 'openapi' AND c.method = e.method AND c.path = e.path)),
  l AS MATERIALIZED (SELECT page_id AS client, coalesce(x.id, w.id) AS endpoint, CASE WHEN x.id IS NOT NULL THEN 7 ELSE 4 END::BIGINT AS score, 'exact' AS how FROM r LEFT JOIN h x ON x.method = 'ANY' AND x.path = r.path LEFT JOIN h w ON w.method = 'GET' AND w.path = lead || '/*')"""


def _routes(spark, at):
    pages = table(spark, at, "pages").select("page_id", S.route_path(F.col("url")).alias("path"), F.startswith("url", F.lit("https")).alias("safe"))
    lead = F.regexp_extract("path", "^/[^/]*", 0)
    end = lambda rows, mark, key, method, path, framework: rows.select(F.concat(F.lit(mark), key).alias("id"), F.lit(method).alias("method"), path.alias("path"), F.lit(framework).alias("framework")).distinct()
    wide = F.concat(lead, F.lit("/*"))
    ends = end(pages.where("safe"), "c:", lead, "GET", wide, "web").unionByName(end(pages, "d:", lead, "GET", wide, "openapi")).unionByName(end(pages.where("not safe"), "d:", F.col("path"), "ANY", F.col("path"), "openapi"))
    clients = pages.select(F.col("page_id").alias("id"), F.lit("GET").alias("method"), "path", F.lit("").alias("host"), F.lit("fetch").alias("framework"))
    return ends, clients


@query(ROUTES + " SELECT * FROM l")
def page_route_links(spark, at):
    return api.joined(*_routes(spark, at))[0]


@query(ROUTES + " SELECT (SELECT count(*) FROM h) AS endpoints, (SELECT count(*) FROM e) - (SELECT count(*) FROM h) AS described, (SELECT count(*) FROM r) AS clients, count(DISTINCT client) AS linked, (SELECT count(*) FROM r) - count(DISTINCT client) AS outside, (SELECT string_agg(framework, ',' ORDER BY framework) FROM (SELECT framework FROM h UNION SELECT 'fetch')) AS frameworks FROM l")
def page_api_totals(spark, at):
    return api.joined(*_routes(spark, at))[1]


@query(ROUTES + " SELECT h.*, count(client)::BIGINT AS calls FROM h LEFT JOIN l ON endpoint = id GROUP BY ALL ORDER BY calls DESC, path, id")
def page_endpoint_calls(spark, at):
    ends, clients = _routes(spark, at)
    return api.by_calls(api.held(ends), api.joined(ends, clients)[0])


OPEN = f"""(WITH n AS (SELECT path, weight FROM {FILES} WHERE file NOT IN (SELECT file FROM {CHANGES} JOIN {COMMITS} USING (hash) WHERE ts >= '2001-06-01')), g AS (SELECT regexp_extract(path, '^[^/]+/[^/]+') AS f, count(*) AS n, sum(weight) AS w FROM n GROUP BY 1) SELECT 'open:surface' AS id, 'dead' AS kind, arg_min(f, (-n, f)) AS place, sum(n)::BIGINT AS reach, sum(w)::BIGINT AS lines, least(45, floor(2 + 1.5 * least(sum(n), 12) + .5))::BIGINT AS minutes FROM g HAVING sum(n) >= 3)"""
DEPS = "(SELECT 'pkg' || p_partkey AS name, p_size % 2 = 0 AS direct, p_size % 3 = 0 AS dev, CASE WHEN p_size % 7 = 0 THEN '' ELSE '1.' || p_size % 4 END AS version, list_extract(['MIT', 'GPL-3.0', 'UNLICENSED', '', 'LGPL-2.1'], (p_size % 5 + 1)::INT) AS licence FROM part)"
WARNED = "(SELECT 'pkg' || l_partkey AS name, '1.' || l_linenumber % 4 AS version, list_extract(['Critical', 'high', 'moderate', 'low', 'odd'], ((l_linenumber - 1) % 5 + 1)::INT) AS severity FROM lineitem WHERE l_returnflag = 'R')"
DEP_TASKS = f"(SELECT 'advisory:' || name AS id, 'security' AS kind, sum(CASE severity WHEN 'Critical' THEN 4 WHEN 'high' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END)::BIGINT AS reach, 4::BIGINT AS minutes FROM {DEPS} JOIN {WARNED} USING (name) GROUP BY name UNION ALL SELECT 'licence:' || name, 'licence', 1, 6 FROM {DEPS} d WHERE direct AND NOT dev AND d.version <> '' AND licence IN ('GPL-3.0', 'UNLICENSED', ''))"
WIDE = "(SELECT 'spread:' || p_type AS id, 'shape' AS kind, count(DISTINCT p_partkey)::BIGINT AS reach, least(45, floor(2 + .75 * count(DISTINCT p_partkey) + .5))::BIGINT AS minutes FROM part GROUP BY p_type HAVING count(DISTINCT p_partkey) >= 26)"


def _open(spark, at):
    late = commits(spark, at).where("ts >= '2001-06-01'").select("hash")
    called = changes(spark, at).join(late, "hash", "left_semi").select(F.col("file").alias("node"))
    return tasks.open_exports(files(spark, at).select(F.col("file").alias("node"), F.substring_index("path", "/", 2).alias("file"), F.col("weight").alias("lines")), called)


def _deps(spark, at):
    turn = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    size, line = F.col("p_size"), F.col("l_linenumber")
    deps = table(spark, at, "part").select(F.concat(F.lit("pkg"), "p_partkey").alias("name"), (size % 2 == 0).alias("direct"), (size % 3 == 0).alias("dev"), F.when(size % 7 == 0, "").otherwise(F.concat(F.lit("1."), (size % 4).cast("string"))).alias("version"), turn(("MIT", "GPL-3.0", "UNLICENSED", "", "LGPL-2.1"), size).alias("licence"))
    warned = table(spark, at, "lineitem").where("l_returnflag = 'R'").select(F.concat(F.lit("pkg"), "l_partkey").alias("name"), F.concat(F.lit("1."), (line % 4).cast("string")).alias("version"), turn(("Critical", "high", "moderate", "low", "odd"), line - 1).alias("severity"))
    return deps, warned


def _wide(spark, at):
    units = ranks.spread(table(spark, at, "part").select(F.concat_ws("/", "p_type", "p_partkey").alias("path")), "path")
    return tasks.wide_folders(units.withColumn("role", S.role_of(F.col("unit"))))


@query(f"SELECT * FROM {OPEN}")
def open_exports(spark, at):
    return _open(spark, at)


@query(FOUND + " SELECT 'missing:' || src || ':' || specifier AS id, 'broken' AS kind, 1::BIGINT AS reach, 4::BIGINT AS minutes FROM f WHERE kind = 'missing'")
def missing_imports(spark, at):
    return tasks.missing_imports(_found(spark, at))


@query(f"SELECT * FROM {DEP_TASKS}")
def dependency_tasks(spark, at):
    return tasks.dependencies(*_deps(spark, at))


@query(f"SELECT * FROM {WIDE}")
def wide_folders(spark, at):
    return _wide(spark, at)


EVERY = f"(SELECT id, kind, reach, minutes, round(reach / greatest(minutes, 1), 6) AS weight FROM (SELECT id, kind, reach, minutes FROM {OPEN} UNION ALL FROM {DEP_TASKS} UNION ALL FROM {WIDE}))"


def _every(spark, at):
    return compare.ranked_tasks([_open(spark, at).select("id", "kind", "reach", "minutes"), tasks.dependencies(*_deps(spark, at)), _wide(spark, at)])


@query(f"SELECT * FROM {EVERY} WHERE kind = 'security' ORDER BY weight DESC, reach DESC, id LIMIT 40")
def security_tasks(spark, at):
    return tasks.asked(_every(spark, at), "security", 40)


@query(f"SELECT kind, count(*)::BIGINT AS tasks, sum(reach)::BIGINT AS reach, sum(minutes)::BIGINT AS minutes FROM {EVERY} GROUP BY kind")
def task_totals(spark, at):
    return tasks.totals(_every(spark, at))


@query(f"SELECT d.*, (SELECT count(*) FROM {WARNED} w WHERE w.name = d.name AND w.version = d.version)::BIGINT AS advisories, (SELECT max(version) FROM {WARNED} w WHERE w.name = d.name) AS newest FROM {DEPS} d")
def installed_packages(spark, at):
    deps, warned = _deps(spark, at)
    return tasks.installed(deps, warned, warned.select("name", F.col("version").alias("newest")))


@query(f"SELECT \"at\", sum(carried_size)::BIGINT AS size, count(carried_size)::BIGINT AS repos FROM ({ORACLE_SQL['size_carry_forward']}) GROUP BY \"at\"")
def fleet_sizes(spark, at):
    # each person's last event as the size of a repository
    return fleet.sizes(activity(spark, at), "who", "ts", "event_id")


@query("""WITH b AS (SELECT p_type AS t, p_brand AS b, p_partkey AS k, p_size AS w FROM part), u AS (SELECT '' AS path, w FROM b UNION ALL SELECT t, w FROM b UNION ALL SELECT t || '/' || b, w FROM b UNION ALL SELECT t || '/' || b || '/' || k, w FROM b) SELECT path, count(*)::BIGINT AS files, sum(w)::BIGINT AS weight FROM u GROUP BY path""")
def fleet_tree(spark, at):
    # types as repositories, brands as their folders
    leaves = table(spark, at, "part").select(F.col("p_type").alias("repo"), F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").cast("long").alias("weight"))
    return history.tree_rollup(fleet.rooted(leaves, "repo", ["path"]), "path", ["weight"])


@query(ROUTES + " SELECT id, method, path, framework FROM e WHERE framework = 'openapi' AND (method, path) NOT IN (SELECT (method, path) FROM e WHERE framework = 'web')")
def page_documents_only(spark, at):
    ends, _ = _routes(spark, at)
    return compare.answered(ends.where("framework = 'openapi'"), ends.where("framework = 'web'")).select("id", "method", "path", "framework")


@query("""WITH o AS (SELECT o_orderkey AS h, CASE WHEN o_orderpriority = '1-URGENT' THEN 'helper' END AS author, CASE o_orderstatus WHEN 'F' THEN 'helper' WHEN 'O' THEN 'mender' END AS trailer FROM orders), t AS (SELECT h, author AS tool FROM o WHERE author IS NOT NULL UNION SELECT h, trailer FROM o WHERE trailer IS NOT NULL) SELECT tool, count(*)::BIGINT AS commits FROM t GROUP BY tool""")
def signed_orders(spark, at):
    # urgent orders by a bot, the others signed in a trailer by their state
    state = F.col("o_orderstatus")
    body = F.concat(F.lit("said\n"), F.when(state == "F", "Co-authored-by: Helper <h@x>\nco-authored-by: helper <h@x>").when(state == "O", "assisted-by: mender:one").otherwise("by hand, no helper"))
    rows = table(spark, at, "orders").select(F.col("o_orderkey").cast("string").alias("hash"), F.when(F.col("o_orderpriority") == "1-URGENT", "helper[bot] <1@x>").otherwise("Helper <h@x>").alias("author"), body.alias("body"))
    return history.signed(rows, [("(?i)helper", "helper"), ("(?i)mender", "mender")])


@query("WITH n AS (SELECT DISTINCT '@' || p_brand || '/' || p_type || '/' || p_name AS name, p_brand AS b, p_type AS t, p_name AS p FROM part), s AS (SELECT p_brand AS b, p_type AS t, max(p_size) AS m FROM part GROUP BY ALL) SELECT name, CASE WHEN m > 45 THEN t ELSE b END AS label FROM n JOIN s USING (b, t)")
def labelled_parts(spark, at):
    # each brand is a label, and so is a type of a brand that has a large part
    part = table(spark, at, "part")
    scope = F.concat(F.lit("@"), "p_brand", F.lit("/"))
    keys = part.select(scope.alias("key"), F.col("p_brand").alias("label")).distinct()
    own = part.groupBy("p_brand", "p_type").agg(F.max("p_size").alias("m")).where("m > 45").select(F.concat(scope, "p_type", F.lit("/")).alias("key"), F.col("p_type").alias("label"))
    return units.labelled(part.select(F.concat(scope, "p_type", F.lit("/"), "p_name").alias("name")), keys.unionByName(own))
