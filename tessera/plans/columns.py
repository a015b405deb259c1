"""Registered queries over column functions and small row sets: groups of paths, pins, remotes, guarded cells, envelopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import files as P
from tessera.functions import scalars as S
from tessera.operators import compare, exports, fleet, graph, text
from tessera.plans.catalog import FILES, FOLD, LINES, _fold, query
from tessera.sources.tables import activity, changes, commits, files, table, tree

TREE = "(SELECT doc_id, text, list_extract(['index.ts', 'test_a.py', 'Makefile', 'run', 'photo.PNG', '.hidden', 'b_test.go', 'x.unknown', 'page.tsx', 'style.min.js', 'LICENSE', 'm.rs', 'CMakeLists.txt'], (doc_id % 13 + 1)::INT) AS name FROM documents)"


@query(f"SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS unit, count(*)::BIGINT AS files, sum(weight)::BIGINT AS weight FROM {FILES} GROUP BY 1 UNION ALL SELECT split_part(path, '/', 1), count(*), sum(weight) FROM {FILES} GROUP BY 1")
def path_units(spark, at):
    rows = files(spark, at)
    two, one = (rows.groupBy(S.unit_of(F.col("path"), n).alias("unit")).agg(F.count("*").alias("files"), F.sum("weight").alias("weight")) for n in (2, 1))
    return two.unionByName(one)


@query(f"""WITH t AS (SELECT *, left(text, 4096) AS head FROM {TREE}), l AS (SELECT *, length(head) - length(replace(head, chr(10), '')) + 1 AS n FROM t) SELECT doc_id, name FROM l WHERE name IN ('index.ts', 'test_a.py', 'b_test.go', 'page.tsx', 'm.rs') AND NOT (n > 1 AND length(head) / n > 300) AND text IS NOT NULL""")
def source_files(spark, at):
    rows = tree(spark, at).where("text is not null")
    return rows.where(P.readable_source(F.col("path"), F.col("text")) & (P.language_of(F.col("path"), F.col("text")) != "CMake")).select("doc_id", F.substring_index("path", "/", -1).alias("name"))


@query("SELECT doc_id, source FROM documents WHERE source IN ('src1', 'src7', 'src13')")
def chosen_sources(spark, at):
    return fleet.chosen(table(spark, at, "documents").select("doc_id", "source"), "source", ["src1", "src7", "src13"])


PINS = (("workspace:*", "linked"), ("^1.2", "caret"), ("~2.0.1", "tilde"), ("3.4.5-beta", "exact"), (">=1 <3", "range"), ("file:../x", "linked"), ("1.2", "range"))


@query(f"SELECT pin, count(*)::BIGINT AS parts, sum(p_size)::BIGINT AS size FROM part JOIN (VALUES {', '.join(str((i, p)) for i, (_, p) in enumerate(PINS))}) v(i, pin) ON i = p_size % 7 GROUP BY pin")
def pin_totals(spark, at):
    wanted = F.get(F.array(*(F.lit(w) for w, _ in PINS)), (F.col("p_size") % 7).cast("int"))
    return table(spark, at, "part").groupBy(S.pin(wanted).alias("pin")).agg(F.count("*").alias("parts"), F.sum("p_size").alias("size"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages) SELECT page_id, CASE page_id % 4 WHEN 3 THEN '' ELSE 'https://' || CASE page_id % 4 WHEN 0 THEN 'github.' WHEN 1 THEN 'gitlab.' ELSE '' END || h || '/a/b' END AS url, CASE page_id % 4 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'git' END AS host FROM p""")
def remotes(spark, at):
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    said = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    forms = F.get(F.array(said("git@github.", host, ":a/b.git"), said("ssh://git@gitlab.", host, "/a/b.git"), said("git://", host, "/a/b"), said("/local/", host)), (F.col("page_id") % 4).cast("int"))
    url = P.browsable(forms)
    return table(spark, at, "pages").select("page_id", url.alias("url"), P.remote_host(url).alias("host"))


@query("""WITH r AS (SELECT user_id AS who, event_type = 'view' AS generic, event_id, event_type AS kind FROM events) SELECT who, kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY generic, event_id) AS i FROM r) WHERE i = 1""")
def first_specific(spark, at):
    rows = activity(spark, at).select("who", (F.col("kind") == "view").alias("generic"), "event_id", "kind")
    return compare.first_named(rows, "who", "generic", "event_id").select("who", "kind", "event_id")


NAMED = "CASE WHEN {i} = 0 AND {o} = 0 OR {o} = 0 THEN 'Module' WHEN {i} / ({i} + {o}) >= .8 THEN 'Module*' WHEN {n} / ({n} + {o}) >= .55 THEN 'Shared' WHEN {i} / ({i} + {o}) >= .5 AND needs <= 1 THEN 'Module*' WHEN {n} = 0 THEN 'Entrypoint' WHEN {n} / ({n} + {o}) < .1 THEN 'Entrypoint*' WHEN {n} / ({n} + {o}) < .45 THEN 'Collection' ELSE 'Shared*' END"
OWN = NAMED.format(i="inside", o="out", n='"into"')
NEAR = [NAMED.format(i=f"greatest(inside + {a}, 0)", o=f"greatest(out + {b}, 0)", n=f'greatest("into" + {c}, 0)') for a, b, c in ((1, -1, 0), (-1, 1, 0), (0, 1, -1), (0, -1, 1))]


@query(FOLD + f" SELECT unit, {OWN} IN ('Module', 'Entrypoint') OR ({' AND '.join(f'{x} = {OWN}' for x in NEAR)}) AS sure FROM x WHERE inside + out + \"into\" > 0")
def sure_shapes(spark, at):
    return _fold(spark, at).select("unit", S.sure(F.col("inside"), F.col("out"), F.col("into"), F.col("needs")).alias("sure"))


@query(f"""WITH d AS (SELECT doc_id, sum(length(regexp_replace(trim(raw), '\\s+$', ''))) AS said, length(replace(any_value(text), chr(10), '')) AS chars, count(*) AS n FROM {LINES} JOIN documents USING (doc_id) GROUP BY doc_id) SELECT doc_id FROM d WHERE chars + 3 * n >= 8000 AND doc_id % 2 = 0""")
def talky_documents(spark, at):
    # every other document has all of its lines commented
    rows = table(spark, at, "documents").where("text <> ''")
    closed = F.regexp_replace("text", r"\n$", "")
    said = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("// "), F.regexp_replace(closed, "\n", "\n// "))).otherwise(F.col("text"))
    return text.talky(rows.select("doc_id", said.alias("text")), share=0.9).select("doc_id")


@query("SELECT '{\"version\":\"2\",\"kind\":\"people\",\"data\":{\"id\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\"}}' AS value FROM customer")
def enveloped_people(spark, at):
    return exports.wrapped(table(spark, at, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), "people", "2")


CELLS = ("=sum(A1)", "-12.5", "+a", "@x", "plain", "-1e5", "\ttab")


@query(f"SELECT p_partkey AS key, CASE WHEN i IN (0, 2, 3, 5, 6) THEN chr(39) || cell ELSE cell END AS cell, CASE WHEN i = 1 THEN -12.5 END::DOUBLE AS number FROM part JOIN (SELECT unnest(range(7)) AS i, unnest({list(CELLS)}) AS cell) v ON i = p_partkey % 7".replace("'\\ttab'", "chr(9) || 'tab'"))
def guarded_cells(spark, at):
    cell = F.get(F.array(*map(F.lit, CELLS)), (F.col("p_partkey") % 7).cast("int"))
    return table(spark, at, "part").select(F.col("p_partkey").alias("key"), exports.guarded(cell).alias("cell"), exports.typed_number(cell).alias("number"))


@query("SELECT s_suppkey AS id, '' AS email, 0 AS also FROM supplier")
def hidden_people(spark, at):
    rows = table(spark, at, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("a@"), "s_suppkey").alias("email"), F.array(F.lit("b")).alias("also"))
    return exports.hidden(rows).select("id", "email", F.size("also").alias("also"))


@query("""WITH RECURSIVE d AS (SELECT p_partkey AS k, p_size AS n FROM part), r AS (SELECT k FROM d WHERE n % 10 = 0 AND n % 20 <> 0), e AS (SELECT k AS src, k + n + 1 AS dst FROM d WHERE k + n + 1 IN (SELECT k FROM d) UNION ALL SELECT k, k // 2 FROM d WHERE n % 3 = 0), c AS (SELECT k FROM r UNION SELECT e.dst FROM c JOIN e ON e.src = c.k) SELECT k AS name, k IN (SELECT k FROM r) AS direct FROM c""")
def shipped_packages(spark, at):
    # each part depends on the one its size further on, some on that of half their number; only what ships is a root
    key, n = F.col("p_partkey"), F.col("p_size")
    part = table(spark, at, "part")
    there = part.select(key.alias("dst"))
    edges = part.select(key.alias("src"), (key + n + 1).alias("dst")).join(there, "dst", "left_semi").select("src", "dst").unionByName(part.where(n % 3 == 0).select(key.alias("src"), (key / 2).cast("long").alias("dst")))
    roots = part.where((n % 10 == 0) & (n % 20 != 0)).select(key.alias("node"))
    direct = roots.withColumn("direct", F.lit(True))
    return graph.reached(edges, roots).join(direct, "node", "left").select(F.col("node").alias("name"), F.coalesce("direct", F.lit(False)).alias("direct"))


@query("""WITH a AS (SELECT l_partkey AS file, count(DISTINCT o_custkey) AS people FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT CASE WHEN people >= 32 THEN 32 WHEN people >= 16 THEN 16 WHEN people >= 8 THEN 8 WHEN people >= 4 THEN 4 ELSE people END::BIGINT AS reach, count(*)::BIGINT AS files FROM a GROUP BY 1""")
def reach_histogram(spark, at):
    # how many files so many people have touched, by 1, 2, 3 and then by doublings
    by = changes(spark, at).join(commits(spark, at).select("hash", "who"), "hash").groupBy("file").agg(F.countDistinct("who").alias("people"))
    band = F.when(F.col("people") < 4, F.col("people")).otherwise(F.least(F.lit(32), F.pow(F.lit(2), F.floor(F.log2("people"))).cast("long")))
    return by.groupBy(band.cast("long").alias("reach")).agg(F.count("*").alias("files"))
