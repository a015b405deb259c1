"""The registered queries and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import scalars as S
from tessera.operators import compare, exports, graph, history, markup, text, units
from tessera.sources.tables import activity, apart, changes, commits, files, partners, table, trade
from tessera.streaming.activity import believable, sessions, windowed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


CHANGES = "(SELECT l_orderkey AS hash, l_linenumber AS line_no, l_partkey AS file, l_quantity::BIGINT AS ins, CASE WHEN l_returnflag = 'R' THEN l_quantity::BIGINT ELSE 0 END AS del FROM lineitem)"
COMMITS = "(SELECT o_orderkey AS hash, o_custkey AS who, o_orderdate AS ts, o_orderstatus AS refs FROM orders)"
FILES = "(SELECT p_partkey AS file, p_brand || '/' || p_type || '/' || p_partkey AS path, p_size::BIGINT AS weight FROM part)"
LINES = "(SELECT doc_id, lang, unnest(CASE WHEN text = '' OR text IS NULL THEN [] WHEN text LIKE '%' || chr(10) THEN list_slice(string_split(text, chr(10)), 1, -2) ELSE string_split(text, chr(10)) END) AS raw, unnest(range(CASE WHEN text = '' OR text IS NULL THEN 0 WHEN text LIKE '%' || chr(10) THEN len(string_split(text, chr(10))) - 1 ELSE len(string_split(text, chr(10))) END)) AS \"at\" FROM documents)"
SEATS = f"(SELECT doc_id, \"at\", regexp_replace(trim(raw), '\\s+', ' ', 'g') AS line FROM {LINES})"
TRADE = "(SELECT c_nationkey AS src, s_nationkey AS dst, count(*)::BIGINT AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
PARTNERS = f"(SELECT src::BIGINT AS src, dst::BIGINT AS dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM {TRADE} WHERE src <> dst) WHERE n = 1)"
REACH = f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {PARTNERS}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)"


@query(f"""WITH l AS (SELECT lang, trim(raw) AS t, raw FROM {LINES}), c AS (SELECT lang,
  count(*) FILTER (t <> '' AND NOT starts_with(t, '//') AND NOT starts_with(t, '/*'))::BIGINT AS code, count(*) FILTER (starts_with(t, '//') OR starts_with(t, '/*'))::BIGINT AS comment,
  count(*) FILTER (t = '')::BIGINT AS blank, coalesce(sum((length(regexp_extract(raw, '^[ \\t]*')) + length(regexp_replace(regexp_extract(raw, '^[ \\t]*'), '[^\\t]', '', 'g'))) // 2) FILTER (t <> ''), 0)::BIGINT AS indent FROM l GROUP BY lang),
  d AS (SELECT lang, count(*)::BIGINT AS files, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang)
  SELECT lang, files, code, comment, blank, indent, chars, floor(chars / 4 + 0.5)::BIGINT AS tokens, round(code / sum(code) OVER (), 6) AS share FROM d JOIN c USING (lang)""")
def language_report(spark, at):
    return text.language_report(table(spark, at, "documents"))


@query(f"""WITH b AS (SELECT path, weight, coalesce(i, 0) AS ins FROM {FILES} f LEFT JOIN (SELECT file, sum(ins) AS i FROM {CHANGES} GROUP BY file) USING (file)),
  u AS (SELECT '' AS path, weight, ins FROM b UNION ALL SELECT split_part(path, '/', 1), weight, ins FROM b UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), weight, ins FROM b UNION ALL SELECT path, weight, ins FROM b)
  SELECT path, count(*)::BIGINT AS files, sum(weight)::BIGINT AS weight, sum(ins)::BIGINT AS ins FROM u GROUP BY path""")
def tree_rollup(spark, at):
    moved = changes(spark, at).groupBy("file").agg(F.sum("ins").alias("ins"))
    leaves = files(spark, at).join(moved, "file", "left").na.fill(0, ["ins"])
    return history.tree_rollup(leaves, "path", ["weight", "ins"])


@query(f"""SELECT path, count(hash)::BIGINT AS touches, coalesce(sum(ins), 0)::BIGINT AS ins, coalesce(sum(del), 0)::BIGINT AS del, max(ts) AS last
  FROM {FILES} f LEFT JOIN (SELECT * FROM {CHANGES} JOIN {COMMITS} USING (hash)) USING (file) GROUP BY file, path""")
def path_churn(spark, at):
    return history.path_churn(files(spark, at), changes(spark, at), commits(spark, at))


@query(f"""WITH m AS (SELECT hash, sum(ins) AS ins, sum(del) AS del FROM {CHANGES} GROUP BY hash), t AS (SELECT who, count(*)::BIGINT AS commits, coalesce(sum(ins), 0)::BIGINT AS ins, coalesce(sum(del), 0)::BIGINT AS del, min(ts) AS first, max(ts) AS last FROM {COMMITS} LEFT JOIN m USING (hash) GROUP BY who),
  f AS (SELECT who, count(DISTINCT file)::BIGINT AS files FROM {CHANGES} JOIN {COMMITS} USING (hash) GROUP BY who) SELECT who, commits, ins, del, coalesce(files, 0) AS files, first, last FROM t LEFT JOIN f USING (who)""")
def contributor_totals(spark, at):
    return history.contributor_totals(commits(spark, at), changes(spark, at))


@query(f"""WITH t AS (SELECT path, who FROM {CHANGES} JOIN {COMMITS} USING (hash) JOIN {FILES} USING (file)), u AS (SELECT split_part(path, '/', 1) AS folder, who FROM t UNION ALL SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2), who FROM t UNION ALL SELECT path, who FROM t),
  n AS (SELECT folder, who, count(*)::BIGINT AS touches FROM u GROUP BY ALL) SELECT folder, who, touches, people FROM (SELECT *, count(*) OVER (PARTITION BY folder) AS people, row_number() OVER (PARTITION BY folder ORDER BY touches DESC, who) AS k FROM n) WHERE k = 1""")
def folder_owners(spark, at):
    return history.folder_owners(files(spark, at), changes(spark, at), commits(spark, at))


DAILY = f"""WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS \"at\", count(*)::BIGINT AS lines, sum(ins)::BIGINT AS ins, sum(del)::BIGINT AS del FROM {CHANGES} JOIN {COMMITS} USING (hash) GROUP BY 1),
  a AS (SELECT unnest(generate_series(min(\"at\"), max(\"at\"), INTERVAL 1 DAY)) AS \"at\" FROM d), f AS (SELECT a.\"at\"::TIMESTAMP AS \"at\", coalesce(lines, 0) AS lines, coalesce(ins, 0) AS ins, coalesce(del, 0) AS del FROM a LEFT JOIN d ON a.\"at\" = d.\"at\")"""


def _days(spark, at):
    dated = changes(spark, at).join(commits(spark, at).select("hash", "ts"), "hash")
    return history.calendar(dated, "ts", "day", [F.count("*"), F.sum("ins"), F.sum("del")], ["lines", "ins", "del"])


@query(DAILY + " SELECT * FROM f")
def daily_series(spark, at):
    return _days(spark, at)


@query(DAILY + " SELECT \"at\", (sum(ins - del) OVER (ORDER BY \"at\"))::BIGINT AS net FROM f")
def net_lines(spark, at):
    # one row for each day
    return _days(spark, at).select("at", F.sum(F.col("ins") - F.col("del")).over(Window.orderBy("at")).alias("net"))


@query(DAILY + ", g AS (SELECT max(\"at\") AS top FROM f) SELECT days, (SELECT coalesce(sum(ins + del), 0)::BIGINT FROM f, g WHERE \"at\" > top - to_days(days::INT)) AS moved FROM (VALUES (1::BIGINT), (7), (30), (365)) v(days)")
def trend_windows(spark, at):
    days = _days(spark, at)
    age = F.datediff(F.col("top"), F.col("at"))
    sums = days.join(F.broadcast(days.agg(F.max("at").alias("top")))).agg(*(F.coalesce(F.sum(F.when(age < n, F.col("ins") + F.col("del"))), F.lit(0)).alias(str(n)) for n in (1, 7, 30, 365)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).cast("long").alias("days"), F.col(f"`{n}`").alias("moved")) for n in (1, 7, 30, 365)))).alias("x")).select("x.*")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS \"at\", count(*)::BIGINT AS commits, count(DISTINCT user_id)::BIGINT AS people FROM events GROUP BY 1")
def timeline_daily(spark, at):
    return activity(spark, at).groupBy(F.date_trunc("day", "ts").alias("at")).agg(F.count("*").alias("commits"), F.countDistinct("who").alias("people"))


@query("""WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS \"at\", count(*)::BIGINT AS events, count(DISTINCT user_id)::BIGINT AS people FROM events GROUP BY 1), a AS (SELECT unnest(generate_series(min(\"at\"), max(\"at\"), INTERVAL 1 HOUR)) AS \"at\" FROM h)
  SELECT a.\"at\"::TIMESTAMP AS \"at\", coalesce(events, 0) AS events, coalesce(people, 0) AS people FROM a LEFT JOIN h ON a.\"at\" = h.at""")
def hourly_activity(spark, at):
    return history.calendar(activity(spark, at), "ts", "hour", [F.count("*"), F.countDistinct("who")], ["events", "people"])


def _bucket(grain: str) -> None:
    def run(spark, at):
        return history.bucketed(activity(spark, at), "ts", grain, "who")

    run.__name__ = f"bucket_{grain}"
    query(f"SELECT date_trunc('{grain}', ts)::TIMESTAMP AS bucket, count(*)::BIGINT AS events, count(DISTINCT user_id)::BIGINT AS people FROM events GROUP BY 1")(run)


for _grain in ("week", "month", "year"):
    _bucket(_grain)


@query("""WITH v AS (SELECT user_id AS kind, date_trunc('day', ts)::TIMESTAMP AS \"at\", max(event_id) AS size FROM events GROUP BY ALL), a AS (SELECT kind, unnest(generate_series((SELECT min(\"at\") FROM v), (SELECT max(\"at\") FROM v), INTERVAL 1 DAY))::TIMESTAMP AS \"at\" FROM (SELECT DISTINCT kind FROM v))
  SELECT kind, \"at\", size, last_value(size IGNORE NULLS) OVER (PARTITION BY kind ORDER BY \"at\" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried_size FROM a LEFT JOIN v USING (kind, \"at\")""")
def size_carry_forward(spark, at):
    # of each person, whose days have gaps
    return history.carried_days(activity(spark, at).drop("kind").withColumnRenamed("who", "kind"), "kind", "ts", "event_id", "size")


@query("""WITH v AS (SELECT event_type AS kind, date_trunc('day', ts)::TIMESTAMP AS \"at\", max(event_id) AS size FROM events GROUP BY ALL), a AS (SELECT kind, unnest(generate_series((SELECT min(\"at\") FROM v), (SELECT max(\"at\") FROM v), INTERVAL 1 DAY))::TIMESTAMP AS \"at\" FROM (SELECT DISTINCT kind FROM v))
  SELECT kind, \"at\", size, last_value(size IGNORE NULLS) OVER (PARTITION BY kind ORDER BY \"at\" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried_size FROM a LEFT JOIN v USING (kind, \"at\")""")
def size_carry_whole(spark, at):
    # of each kind of event
    return history.carried_days(activity(spark, at), "kind", "ts", "event_id", "size")


ORDINALS = f"SELECT hash, who, ts, row_number() OVER (ORDER BY ts, hash) AS ordinal FROM {COMMITS}"


@query(ORDINALS)
def commit_ordinal(spark, at):
    return history.ordinals(commits(spark, at))


@query(f"WITH o AS ({ORDINALS}), n AS (SELECT count(*) AS total FROM o) SELECT hash, who, ts, ordinal FROM o, n WHERE (ordinal - 1) % greatest(1, total // 80) = 0 OR ordinal = total")
def sampled_points(spark, at):
    return history.sampled(history.ordinals(commits(spark, at)), 80)


@query(f"SELECT hash, who, ts, coalesce(c_name, '') AS name FROM {COMMITS} LEFT JOIN customer ON who = c_custkey ORDER BY ts DESC, hash DESC LIMIT 50 OFFSET 100")
def commit_page(spark, at):
    page = commits(spark, at).orderBy(F.desc("ts"), F.desc("hash")).offset(100).limit(50)
    names = table(spark, at, "customer").select(F.col("c_custkey").alias("who"), F.col("c_name").alias("name"))
    return page.join(names, "who", "left").select("hash", "who", "ts", F.coalesce("name", F.lit("")).alias("name"))


@query(f"SELECT file, who, count(*)::BIGINT AS touches, sum(ins)::BIGINT AS ins, sum(del)::BIGINT AS del FROM {CHANGES} JOIN {COMMITS} USING (hash) WHERE ts >= '1996-01-01' AND ts < '1996-07-01' GROUP BY ALL")
def moved_window(spark, at):
    within = commits(spark, at).where("ts >= '1996-01-01' and ts < '1996-07-01'").select("hash", "who")
    return changes(spark, at).join(within, "hash").groupBy("file", "who").agg(F.count("*").alias("touches"), F.sum("ins").alias("ins"), F.sum("del").alias("del"))


@query("SELECT o_orderpriority AS label, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def share_of_total(spark, at):
    by = table(spark, at, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # over the few labels


@query("""WITH m AS (SELECT o_orderstatus AS status, date_trunc('month', o_orderdate)::TIMESTAMP AS \"at\", count(*)::BIGINT AS n FROM orders GROUP BY ALL) SELECT status, \"at\", n, round(100 * n / max(n) OVER (PARTITION BY status), 6) AS scaled FROM m""")
def peak_scaled(spark, at):
    by = table(spark, at, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.date_trunc("month", "o_orderdate").alias("at")).agg(F.count("*").alias("n"))
    return by.withColumn("scaled", F.round(100 * F.col("n") / F.max("n").over(Window.partitionBy("status")), 6))


@query(f"SELECT line, count(*)::BIGINT AS files FROM (SELECT DISTINCT doc_id, line FROM {SEATS} WHERE length(line) >= 24) GROUP BY line HAVING count(*) >= 3")
def repeated_lines(spark, at):
    return text.repeated_lines(table(spark, at, "documents"))


@query(f"""WITH l AS MATERIALIZED (SELECT doc_id, "at", CASE WHEN length(line) >= 12 AND NOT regexp_matches(line, '^(//|[*]|/[*]|import |export )') AND NOT regexp_matches(line, '^[)\\]}}>,;]+$') THEN line END AS line FROM {SEATS}),
  s AS MATERIALIZED (SELECT * FROM l WHERE line IS NOT NULL), k AS (SELECT line FROM s GROUP BY line HAVING count(*) BETWEEN 2 AND 60), h AS (SELECT s.* FROM s JOIN k USING (line)),
  f AS (SELECT line, doc_id, min("at") AS first_at FROM h GROUP BY ALL), o AS (SELECT line, doc_id, lead(doc_id) OVER w AS two, lead(first_at) OVER w AS two_at FROM f WINDOW w AS (PARTITION BY line ORDER BY doc_id)),
  p AS (SELECT h.doc_id AS one, h."at" AS one_at, two, two_at FROM h JOIN o ON h.line = o.line AND h.doc_id = o.doc_id WHERE two IS NOT NULL),
  b AS (SELECT p.* FROM p LEFT JOIN s x ON x.doc_id = one AND x."at" = one_at - 1 LEFT JOIN s y ON y.doc_id = two AND y."at" = two_at - 1 WHERE x.line IS NULL OR y.line IS NULL OR x.line <> y.line),
  g AS (SELECT one, one_at, two, two_at, x."at" - one_at AS step, row_number() OVER (PARTITION BY one, one_at, two, two_at ORDER BY x."at") - 1 AS n FROM b JOIN s x ON x.doc_id = one AND x."at" >= one_at JOIN s y ON y.doc_id = two AND y."at" = x."at" - one_at + two_at AND x.line = y.line)
  SELECT one, (one_at + 1)::BIGINT AS one_at, two, (two_at + 1)::BIGINT AS two_at, count(*)::BIGINT AS lines FROM g WHERE step = n GROUP BY ALL HAVING count(*) >= 5""")
def copied_runs(spark, at):
    return text.copied_runs(table(spark, at, "documents"))


@query(f"SELECT doc_id, \"at\"::BIGINT AS \"at\", line FROM {SEATS} WHERE regexp_matches(line, '(?i)licen[cs]e')")
def license_mentions(spark, at):
    return text.seats(table(spark, at, "documents")).where(F.col("line").rlike("(?i)licen[cs]e")).select("doc_id", F.col("at").cast("long").alias("at"), "line")


@query("""SELECT page_id, coalesce(regexp_extract(url, '^(?:https?:)?//([^/?#]+)', 1), '') AS host, CASE WHEN regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '(.)/$', '\\1') END AS path FROM pages""")
def route_normal(spark, at):
    return table(spark, at, "pages").select("page_id", S.route_host(F.col("url")).alias("host"), S.route_path(F.col("url")).alias("path"))


@query("SELECT regexp_extract(url, '^(?:https?:)?//([^/?#]+)', 1) AS host, count(*)::BIGINT AS pages FROM pages GROUP BY 1")
def host_counts(spark, at):
    return table(spark, at, "pages").groupBy(S.route_host(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query("""WITH l AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT href, count(*)::BIGINT AS links FROM l GROUP BY href""")
def markup_links(spark, at):
    return markup.page_links(table(spark, at, "pages")).groupBy("href").agg(F.count("*").alias("links"))


FOLD = f"""WITH u AS (SELECT n_nationkey AS node, r_name AS unit FROM nation JOIN region ON n_regionkey = r_regionkey), p AS (SELECT a.unit AS ua, b.unit AS ub, sum(weight)::BIGINT AS w FROM {TRADE} JOIN u a ON src = a.node JOIN u b ON dst = b.node GROUP BY ALL), x AS (SELECT unit,
  coalesce((SELECT sum(w) FROM p WHERE ua = unit AND ub = unit), 0)::BIGINT AS inside, coalesce((SELECT sum(w) FROM p WHERE ua = unit AND ub <> unit), 0)::BIGINT AS out, coalesce((SELECT sum(w) FROM p WHERE ub = unit AND ua <> unit), 0)::BIGINT AS \"into\",
  (SELECT count(*) FROM p WHERE ua = unit AND ub <> unit)::BIGINT AS needs, (SELECT count(*) FROM p WHERE ub = unit AND ua <> unit)::BIGINT AS needed_by FROM (SELECT DISTINCT unit FROM u))"""


def _fold(spark, at):
    units = table(spark, at, "nation").join(table(spark, at, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("unit"))
    return graph.unit_fold(trade(spark, at), units)


@query(FOLD + " SELECT *, CASE WHEN needs + needed_by > 0 THEN needs / (needs + needed_by) ELSE 0.0::DOUBLE END AS instability FROM x WHERE inside + out + \"into\" > 0")
def unit_fold(spark, at):
    return _fold(spark, at)


@query(FOLD + """ SELECT unit, CASE WHEN inside = 0 AND out = 0 OR out = 0 THEN 'Module' WHEN inside / (inside + out) >= .8 THEN 'Module*' WHEN \"into\" / (\"into\" + out) >= .55 THEN 'Shared' WHEN inside / (inside + out) >= .5 AND needs <= 1 THEN 'Module*'
  WHEN \"into\" = 0 THEN 'Entrypoint' WHEN \"into\" / (\"into\" + out) < .1 THEN 'Entrypoint*' WHEN \"into\" / (\"into\" + out) < .45 THEN 'Collection' ELSE 'Shared*' END AS label FROM x WHERE inside + out + \"into\" > 0""")
def unit_shape(spark, at):
    return _fold(spark, at).select("unit", S.shape(F.col("inside"), F.col("out"), F.col("into"), F.col("needs")).alias("label"))


@query(REACH + ", m AS (SELECT x.a AS node, min(x.b) AS ring FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT ring, count(*)::BIGINT AS size, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM m GROUP BY ring HAVING count(*) > 1")
def scc_cycles(spark, at):
    return graph.rings(partners(spark, at))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {PARTNERS}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
  g AS (SELECT node, coalesce((SELECT min(x.b) FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a = node), node) AS ring FROM n), o AS (SELECT DISTINCT a.ring AS ra, b.ring AS rb FROM e JOIN g a ON src = a.node JOIN g b ON dst = b.node WHERE a.ring <> b.ring),
  w AS (SELECT ring AS r0, 0 AS level FROM g UNION SELECT o.ra, w.level + 1 FROM w JOIN o ON o.rb = w.r0) SELECT node, max(level)::BIGINT AS level FROM g JOIN w ON ring = r0 GROUP BY node""")
def levels(spark, at):
    return graph.levels(partners(spark, at))


@query(REACH + ", n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, CASE WHEN node = 3 THEN 'runs' WHEN node IN (SELECT b FROM r WHERE a = 3) THEN 'called' ELSE 'dead' END AS state FROM n")
def reach_states(spark, at):
    edges = partners(spark, at)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    live = graph.reached(edges, spark.range(3, 4).select(F.col("id").alias("node"))).withColumn("live", F.lit(True))
    return nodes.join(live, "node", "left").select("node", F.when(F.col("node") == 3, "runs").when(F.col("live"), "called").otherwise("dead").alias("state"))


@query("""WITH RECURSIVE p AS (SELECT s_suppkey AS id, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), m AS (SELECT name, min(id) AS lo FROM p GROUP BY name),
  e AS (SELECT a.name AS x, b.name AS y FROM m a JOIN m b ON length(a.name) >= 5 AND length(b.name) >= 5 AND (starts_with(a.name, b.name) OR starts_with(b.name, a.name))), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
  SELECT p.id, CASE WHEN length(p.name) < 5 THEN p.id ELSE (SELECT min(lo) FROM r JOIN m ON r.y = m.name WHERE r.x = p.name) END AS person FROM p""")
def identity_merge(spark, at):
    names = table(spark, at, "supplier").join(table(spark, at, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("name"))
    return graph.same_people(names)


@query("""SELECT p.event_id AS id, p.user_id AS who, p.ts, f.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type <> 'purchase' GROUP BY ALL) f ON p.user_id = f.user_id AND p.ts >= f.ts""")
def asof_prefix(spark, at):
    rows = activity(spark, at)
    facts = rows.where("kind <> 'purchase'").groupBy("who", "ts").agg(F.max("event_id").alias("before"))
    return history.as_of(rows.where("kind = 'purchase'").select(F.col("event_id").alias("id"), "who", "ts"), facts, "who", "ts", "before").select("id", "who", "ts", "before")


@query("""WITH b AS (SELECT o_custkey AS who, count(*) AS was FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1), h AS (SELECT o_custkey AS who, count(*) AS now FROM orders GROUP BY 1)
  SELECT who, coalesce(was, 0)::BIGINT AS was, coalesce(now, 0)::BIGINT AS now, was IS NULL AS added FROM b FULL JOIN h USING (who)""")
def snapshot_diff(spark, at):
    head = commits(spark, at).withColumn("one", F.lit(1).cast("long"))
    return compare.snapshot_diff(head.where("ts < '1998-01-01'"), head, "who", "one")


@query("""SELECT 'thing' AS row, 'nation' AS kind, n_name AS id, NULL::VARCHAR AS "from", NULL::VARCHAR AS "to", NULL::BIGINT AS weight FROM nation UNION ALL SELECT 'thing', 'region', r_name, NULL, NULL, NULL FROM region
  UNION ALL SELECT 'link', 'supplies', NULL, n_name, r_name, count(*)::BIGINT FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""")
def knowledge_rows(spark, at):
    nation, region = table(spark, at, "nation"), table(spark, at, "region")
    things = nation.select(F.lit("nation").alias("kind"), F.col("n_name").alias("id")).unionByName(region.select(F.lit("region").alias("kind"), F.col("r_name").alias("id")))
    links = table(spark, at, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("n_name").alias("from"), F.col("r_name").alias("to")).agg(F.count("*").alias("weight")).withColumn("kind", F.lit("supplies"))
    return exports.flat(things, links).select("row", "kind", "id", "from", "to", "weight")


@query("""WITH d AS (SELECT event_type AS kind, date_trunc('day', ts)::TIMESTAMP AS \"at\", count(*) AS n FROM events GROUP BY ALL), a AS (SELECT DISTINCT kind, \"at\" FROM (SELECT DISTINCT kind FROM d), (SELECT DISTINCT \"at\" FROM d)) SELECT kind, \"at\", coalesce(n, 0)::BIGINT AS n FROM a LEFT JOIN d USING (kind, \"at\")""")
def fleet_align(spark, at):
    by = activity(spark, at).groupBy("kind", F.date_trunc("day", "ts").alias("at")).agg(F.count("*").alias("n"))
    # every kind on the calendar from the first day to the last, and of it the days that anything has
    ends = by.agg(F.min("at").alias("a"), F.max("at").alias("b"))  # one row
    axis = by.select("kind").distinct().join(F.broadcast(ends)).select("kind", F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("at")).join(by.select("at").distinct(), "at", "left_semi")
    return axis.join(by, ["kind", "at"], "left").select("kind", "at", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH r AS (SELECT line, count(*) AS files FROM (SELECT DISTINCT doc_id, line FROM {SEATS} WHERE length(line) >= 24) GROUP BY line HAVING count(*) >= 3), t AS (SELECT 'text:' || line AS id, 'text' AS kind, files::BIGINT AS reach, greatest(2, least(45, floor(2 + 1.5 * files + 0.5)))::BIGINT AS minutes FROM r
  UNION ALL SELECT 'idle:' || p_partkey, 'idle', p_size::BIGINT, 4::BIGINT FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) SELECT id, kind, reach, minutes, round(reach / greatest(minutes, 1), 6) AS weight FROM t""")
def tasks_union(spark, at):
    said = text.repeated_lines(table(spark, at, "documents")).select(F.concat(F.lit("text:"), "line").alias("id"), F.lit("text").alias("kind"), F.col("files").alias("reach"), S.minutes(F.col("files"), F.lit(0)).alias("minutes"))
    idle = files(spark, at).join(apart(changes(spark, at).select("file").distinct()), "file", "left_anti").select(F.concat(F.lit("idle:"), F.col("file").cast("string")).alias("id"), F.lit("idle").alias("kind"), F.col("weight").alias("reach"), F.lit(4).cast("long").alias("minutes"))
    return compare.ranked_tasks([said, idle])


@query("""WITH m AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) OR lag(role) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 1 ELSE 0 END AS new FROM conversations), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
  SELECT conv_id, run::BIGINT AS run, role, min(turn) AS first, max(turn) AS last, count(*)::BIGINT AS turns, sum(length(text))::BIGINT AS chars FROM r GROUP BY conv_id, run, role""")
def transcript_runs(spark, at):
    return text.runs(table(spark, at, "conversations"))


@query("SELECT p_name AS name, count(DISTINCT p_brand)::BIGINT AS brands FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def names_in_several(spark, at):
    return table(spark, at, "part").groupBy(F.col("p_name").alias("name")).agg(F.countDistinct("p_brand").alias("brands")).where("brands > 1")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE lower(c_custkey::VARCHAR) LIKE '%build%' OR lower(c_name) LIKE '%build%' OR lower(c_mktsegment) LIKE '%build%'")
def text_search(spark, at):
    return compare.matching(table(spark, at, "customer").select("c_custkey", "c_name", "c_mktsegment"), "build")


@query(f"SELECT src, dst, weight, round(weight / sum(weight) OVER (PARTITION BY src), 6) AS share FROM {TRADE}")
def trade_matrix(spark, at):
    return trade(spark, at).withColumn("share", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("src")), 6))


@query("SELECT l_partkey AS file, count(*)::BIGINT AS touches FROM lineitem GROUP BY 1 ORDER BY touches DESC, file LIMIT 20")
def most_touched(spark, at):
    return changes(spark, at).groupBy("file").agg(F.count("*").alias("touches")).orderBy(F.desc("touches"), "file").limit(20)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS \"at\", event_type AS kind, count(*)::BIGINT AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def activity_windows(spark, at):
    return windowed(activity(spark, at)).withColumn("value", F.round("value", 2))


@query("""WITH g AS (SELECT user_id AS who, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY who ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT who, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*)::BIGINT AS n FROM s GROUP BY who, k""")
def activity_sessions(spark, at):
    return sessions(activity(spark, at))


UNITS = "u AS (SELECT n_nationkey AS node, r_name AS unit FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("WITH n AS (SELECT user_id AS who, event_type AS kind, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL) SELECT who, kind FROM (SELECT *, row_number() OVER (PARTITION BY who ORDER BY n DESC, f) AS k FROM n) WHERE k = 1")
def usual_kind(spark, at):
    return units.usual(activity(spark, at), "who", "kind", "event_id")


@query(REACH + ", m AS (SELECT x.a AS node, min(x.b) AS ring FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a) SELECT a.ring, count(DISTINCT a.node) AS size, count(*)::BIGINT AS edges FROM e JOIN m a ON src = a.node JOIN m b ON dst = b.node WHERE a.ring = b.ring GROUP BY a.ring HAVING count(DISTINCT a.node) > 1")
def tangles(spark, at):
    return units.tangles(partners(spark, at))


@query(f"WITH {UNITS}, i AS (SELECT b.unit, dst AS node, sum(weight)::BIGINT AS w FROM {TRADE} JOIN u a ON src = a.node JOIN u b ON dst = b.node WHERE a.unit <> b.unit GROUP BY ALL) SELECT unit, node, w AS arriving, (t - w)::BIGINT AS rest FROM (SELECT *, sum(w) OVER (PARTITION BY unit) AS t, row_number() OVER (PARTITION BY unit ORDER BY w DESC, node) AS k FROM i) WHERE k = 1")
def loudest_member(spark, at):
    of = table(spark, at, "nation").join(table(spark, at, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("unit"))
    return units.loudest(trade(spark, at), of)


@query("WITH f AS (SELECT DISTINCT p_brand AS b, p_type AS t FROM part) SELECT b || '/' || t AS path, CASE WHEN count(*) OVER (PARTITION BY t) = 1 THEN t ELSE b || '/' || t END AS name FROM f UNION ALL SELECT DISTINCT b, b FROM f")
def names_told_apart(spark, at):
    part = table(spark, at, "part")
    return units.told_apart(part.select(F.concat_ws("/", "p_brand", "p_type").alias("path")).union(part.select("p_brand")))


@query(f"SELECT weight AS size, CASE WHEN count(DISTINCT b) > 1 THEN '.' WHEN count(DISTINCT t) > 1 THEN any_value(b) ELSE any_value(b || '/' || t) END AS folder FROM (SELECT weight, split_part(path, '/', 1) AS b, split_part(path, '/', 2) AS t FROM {FILES}) GROUP BY weight")
def shared_folder(spark, at):
    return units.shared_folder(files(spark, at).select(F.col("weight").alias("size"), "path"), "size")


@query(f"WITH b AS (SELECT src AS node, 0 AS s, weight AS a FROM {TRADE} WHERE src <> dst UNION ALL SELECT dst, weight, 0 FROM {TRADE} WHERE src <> dst) SELECT node, round((sum(s) - sum(a)) / (sum(s) + sum(a)), 6) AS facing FROM b GROUP BY node")
def facing(spark, at):
    return units.facing(trade(spark, at))


@query("SELECT p_name AS name, count(*)::BIGINT AS n, array_to_string(list_slice(list(p_partkey ORDER BY p_partkey), 1, 4), ',') AS samples FROM part GROUP BY p_name")
def name_samples(spark, at):
    return units.samples(table(spark, at, "part").select(F.col("p_name").alias("name"), "p_partkey"), "name", "p_partkey")


@query("SELECT l_suppkey AS package, bool_or(l_returnflag = 'R') AS direct, bool_and(l_linestatus = 'F') AS dev FROM lineitem GROUP BY 1")
def fleet_packages(spark, at):
    return table(spark, at, "lineitem").groupBy(F.col("l_suppkey").alias("package")).agg(F.bool_or(F.col("l_returnflag") == "R").alias("direct"), F.bool_and(F.col("l_linestatus") == "F").alias("dev"))


@query("SELECT kind, bucket, value AS last FROM (SELECT event_type AS kind, date_trunc('week', ts)::TIMESTAMP AS bucket, value, row_number() OVER (PARTITION BY event_type, date_trunc('week', ts) ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def bucket_last(spark, at):
    return activity(spark, at).groupBy("kind", F.date_trunc("week", "ts").alias("bucket")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query(f"SELECT count(*)::BIGINT AS commits, min(ts) FILTER (ts >= '1996-01-01') AS first, max(ts) FILTER (ts >= '1996-01-01') AS last FROM {COMMITS}")
def believable_range(spark, at):
    sane = believable("ts", "1996-01-01")
    return commits(spark, at).agg(F.count("*").alias("commits"), F.min(F.when(sane, F.col("ts"))).alias("first"), F.max(F.when(sane, F.col("ts"))).alias("last"))


@query(f"WITH w AS (SELECT src, dst, weight, 'calls' AS kind FROM {TRADE} UNION ALL SELECT src, dst, 1, 'imports' FROM {PARTNERS}) SELECT src::BIGINT AS src, dst::BIGINT AS dst, sum(weight)::BIGINT AS weight, count(DISTINCT kind)::BIGINT AS kinds FROM w GROUP BY ALL")
def wires(spark, at):
    calls = trade(spark, at).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight", F.lit("calls").alias("kind"))
    both = calls.unionByName(partners(spark, at).select("src", "dst", F.lit(1).cast("long").alias("weight"), F.lit("imports").alias("kind")))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.countDistinct("kind").alias("kinds"))


LEVELS = ORACLE_SQL["levels"]


@query(f"SELECT level, count(*)::BIGINT AS nodes FROM ({LEVELS}) GROUP BY level")
def level_summary(spark, at):
    return graph.levels(partners(spark, at)).groupBy("level").agg(F.count("*").alias("nodes"))


@query(f"WITH d AS (SELECT src AS node, dst AS other, weight FROM {TRADE} WHERE src <> dst UNION ALL SELECT dst, src, weight FROM {TRADE} WHERE src <> dst) SELECT node, count(*)::BIGINT AS degree, sum(weight)::BIGINT AS weight FROM d GROUP BY node ORDER BY degree DESC, weight DESC, node LIMIT 10")
def busiest_nodes(spark, at):
    out = trade(spark, at).where("src <> dst")
    both = out.select(F.col("src").alias("node"), "weight").union(out.select("dst", "weight"))
    return both.groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weight")).orderBy(F.desc("degree"), F.desc("weight"), "node").limit(10)
