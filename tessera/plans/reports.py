"""Further registered queries: ranks, caps, gaps, bundles and shares over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import ranks
from tessera.plans.catalog import CHANGES, COMMITS, FILES, TRADE, query
from tessera.sources.tables import activity, changes, commits, files, table, trade

REGIONS = "(SELECT n_nationkey AS node, r_name AS unit FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _regions(spark, at):
    return table(spark, at, "nation").join(table(spark, at, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("unit"))


@query(f"SELECT path, parent, weight, row_number() OVER (PARTITION BY parent ORDER BY weight DESC, path)::INTEGER AS place FROM (SELECT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS parent, weight FROM {FILES})")
def ranked_siblings(spark, at):
    rows = files(spark, at).select("path", F.substring_index("path", "/", 2).alias("parent"), "weight")
    return ranks.ranked_within(rows, ["parent"], [F.desc("weight"), F.asc("path")])


@query("""WITH d AS (SELECT min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) / 2.0 AS mid FROM events), b AS (SELECT event_type AS kind, user_id AS who, count(*) AS before FROM events, d WHERE epoch_us(ts) < mid GROUP BY ALL), n AS (SELECT event_type AS kind, user_id AS who, count(*) AS now FROM events, d WHERE epoch_us(ts) >= mid GROUP BY ALL)
  SELECT kind, who, now::BIGINT AS now, coalesce(before, 0)::BIGINT AS before FROM n LEFT JOIN b USING (kind, who) WHERE now > coalesce(before, 0) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY now - coalesce(before, 0) DESC, who) <= 20""")
def new_findings(spark, at):
    rows = activity(spark, at)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    mid = rows.agg((F.min(micros) + (F.max(micros) - F.min(micros)) / 2).alias("mid"))  # one row
    told = rows.join(F.broadcast(mid)).withColumn("late", micros >= F.col("mid"))
    return ranks.new_findings(told.where("not late"), told.where("late"), "kind", "who")


@query(f"SELECT path, count(hash)::BIGINT AS calls FROM {FILES} f LEFT JOIN {CHANGES} c USING (file) GROUP BY file, path")
def endpoint_calls(spark, at):
    return ranks.called(files(spark, at).select("file", "path"), changes(spark, at), "file").select("path", "calls")


@query(f"WITH c AS (SELECT path, count(hash) AS calls FROM {FILES} f LEFT JOIN {CHANGES} c USING (file) GROUP BY file, path) SELECT count(*)::BIGINT AS endpoints, count(*) FILTER (calls > 0)::BIGINT AS linked, sum(calls)::BIGINT AS clients, max(calls)::BIGINT AS most FROM c")
def api_totals(spark, at):
    found = ranks.called(files(spark, at).select("file"), changes(spark, at), "file")
    return found.agg(F.count("*").alias("endpoints"), F.count_if(F.col("calls") > 0).alias("linked"), F.sum("calls").alias("clients"), F.max("calls").alias("most"))


@query("""WITH v AS (SELECT user_id AS kind, date_trunc('day', ts)::TIMESTAMP AS "at", count(*) AS n FROM events GROUP BY ALL), s AS (SELECT kind, min("at") AS a, max("at") AS b FROM v GROUP BY kind),
  x AS (SELECT kind, a, b, unnest(generate_series((SELECT min("at") FROM v), (SELECT max("at") FROM v), INTERVAL 1 DAY))::TIMESTAMP AS "at" FROM s)
  SELECT x.kind, x."at", CASE WHEN x."at" BETWEEN a AND b THEN coalesce(n, 0)::BIGINT END AS n FROM x LEFT JOIN v ON x.kind = v.kind AND x."at" = v."at" """)
def window_gaps(spark, at):
    return ranks.windowed_gaps(activity(spark, at), "who", "ts")


@query(f"""SELECT CASE WHEN a.unit = b.unit THEN a.unit || '/' || src ELSE a.unit END AS src, CASE WHEN a.unit = b.unit THEN b.unit || '/' || dst ELSE b.unit END AS dst, sum(weight)::BIGINT AS weight FROM {TRADE} t JOIN {REGIONS} a ON a.node = src JOIN {REGIONS} b ON b.node = dst GROUP BY 1, 2""")
def wire_bundles(spark, at):
    return ranks.bundled(trade(spark, at), _regions(spark, at))


@query(f"""WITH w AS (SELECT a.unit, sum(CASE WHEN a.unit = b.unit THEN weight ELSE 0 END)::BIGINT AS inside, sum(weight)::BIGINT AS total FROM {TRADE} t JOIN {REGIONS} a ON a.node = src JOIN {REGIONS} b ON b.node = dst GROUP BY 1)
  SELECT unit, inside, total, (CASE WHEN inside = total THEN 100 ELSE least(99, floor(inside * 100.0 / total + 0.5)) END)::BIGINT AS share FROM w""")
def inside_shares(spark, at):
    return ranks.inside_share(trade(spark, at), _regions(spark, at))


@query(f"SELECT src, dst, weight FROM {TRADE} WHERE src IN (SELECT node FROM {REGIONS} WHERE unit = 'EUROPE') AND dst IN (SELECT node FROM {REGIONS} WHERE unit = 'EUROPE')")
def graph_within(spark, at):
    return ranks.within(trade(spark, at), _regions(spark, at).where("unit = 'EUROPE'")).select("src", "dst", "weight")


@query("SELECT o_custkey AS who, string_agg(o_orderpriority, ',' ORDER BY first_at, o_orderpriority) AS labels FROM (SELECT o_custkey, o_orderpriority, min(o_orderdate) AS first_at FROM orders GROUP BY ALL) GROUP BY o_custkey")
def label_union(spark, at):
    rows = table(spark, at, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("ts"))
    return ranks.ordered_union(rows, "who", "label", "ts")


@query(f"""WITH p AS (SELECT DISTINCT split_part(path, '/', 1) AS unit, split_part(path, '/', 2) AS entry FROM {FILES}) SELECT unit, count(*)::BIGINT AS entries, count(*)::BIGINT AS folders FROM p GROUP BY unit""")
def entry_spread(spark, at):
    return ranks.spread(files(spark, at), "path")


@query(f"SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*)::BIGINT AS commits FROM {COMMITS} GROUP BY 1 ORDER BY commits DESC, day LIMIT 10")
def busiest_days(spark, at):
    return commits(spark, at).groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "day").limit(10)


@query(f"""WITH t AS (SELECT who, count(DISTINCT hash) AS n, sum(ins) AS ins, sum(del) AS del FROM {CHANGES} JOIN {COMMITS} USING (hash) GROUP BY who)
  SELECT count(*)::BIGINT AS people, sum(n)::BIGINT AS commits, max(n)::BIGINT AS most_commits, sum(ins)::BIGINT AS ins, max(ins)::BIGINT AS most_ins, sum(del)::BIGINT AS del, max(del)::BIGINT AS most_del FROM t""")
def column_peaks(spark, at):
    # changes first by commit, so that the join moves one row for each
    by = changes(spark, at).groupBy("hash").agg(F.sum("ins").alias("ins"), F.sum("del").alias("del")).join(commits(spark, at), "hash").groupBy("who").agg(F.count("*").alias("n"), F.sum("ins").alias("ins"), F.sum("del").alias("del"))
    return by.agg(F.count("*").alias("people"), F.sum("n").alias("commits"), F.max("n").alias("most_commits"), F.sum("ins").alias("ins"), F.max("ins").alias("most_ins"), F.sum("del").alias("del"), F.max("del").alias("most_del"))


@query("""SELECT source, lang, n::BIGINT AS n FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1""")
def majority_language(spark, at):
    by = table(spark, at, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return ranks.ranked_within(by, ["source"], [F.desc("n"), F.asc("lang")], 1).drop("place")
