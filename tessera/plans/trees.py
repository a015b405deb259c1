"""Registered queries over file trees and people."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import files as P
from tessera.operators import people, scan, text
from tessera.plans.catalog import CHANGES, COMMITS, FILES, LINES, query
from tessera.sources.tables import FOLDERS, LEAVES, changes, commits, files, identities, table, tree

GLOBS = ("gen/  # made", "", "/docs/**/x.*", "d?7/")
TREE = f"(SELECT doc_id, list_extract({list(FOLDERS)}, (doc_id % 12 + 1)::INT) || '/' || source || '/d' || doc_id || '/' || list_extract({list(LEAVES)}, (doc_id % 13 + 1)::INT) AS path, text FROM documents)"
TONGUE = "CASE list_extract(string_split(path, '/'), -1) WHEN 'index.ts' THEN 'TypeScript' WHEN 'test_a.py' THEN 'Python' WHEN 'Makefile' THEN 'Make' WHEN 'photo.PNG' THEN 'Image' WHEN 'b_test.go' THEN 'Go' WHEN 'x.unknown' THEN 'unknown' WHEN 'page.tsx' THEN 'TypeScript' WHEN 'style.min.js' THEN 'JavaScript' WHEN 'm.rs' THEN 'Rust' WHEN 'CMakeLists.txt' THEN 'CMake' ELSE '' END"
OTHERS = "(starts_with(path, 'node_modules/') OR starts_with(path, 'vendor/') OR starts_with(path, 'theme/static/lib/') OR starts_with(path, 'a/dist/'))"
STATES = f"(SELECT *, CASE WHEN {OTHERS} OR starts_with(path, 'gen/') OR regexp_matches(path, '^docs/(.*/)?x\\.[^/]*$') OR regexp_matches(path, '/d[0-9]7/') THEN 'skipped' WHEN lang = 'Image' THEN 'document' WHEN text IS NULL THEN 'unknown' WHEN contains(left(text, 8192), chr(0)) THEN 'binary' WHEN lang = '' THEN 'unknown' ELSE 'read' END AS state FROM (SELECT *, {TONGUE} AS lang FROM {TREE}))"
SCAN = f"""WITH k AS MATERIALIZED (SELECT * FROM {STATES} WHERE state IN ('read', 'document')), l AS (SELECT path, k.lang, trim(raw) AS t, raw, CASE WHEN k.lang IN ('Python', 'Make') THEN starts_with(trim(raw), '#') ELSE starts_with(trim(raw), '//') OR starts_with(trim(raw), '/*') END AS said FROM k JOIN {LINES} x USING (doc_id) WHERE state = 'read'),
  c AS (SELECT path, count(*) FILTER (t <> '' AND NOT said) AS code, count(*) FILTER (said) AS comment, count(*) FILTER (t = '') AS blank, sum((length(regexp_extract(raw, '^[ \\t]*')) + length(regexp_replace(regexp_extract(raw, '^[ \\t]*'), '[^\\t]', '', 'g'))) // 2) FILTER (t <> '' AND NOT said) AS indent FROM l GROUP BY path),
  s AS (SELECT path, lang, coalesce(code, 0)::BIGINT AS code, coalesce(comment, 0)::BIGINT AS comment, coalesce(blank, 0)::BIGINT AS blank, coalesce(indent, 0)::BIGINT AS indent, CASE WHEN state = 'read' THEN length(text) ELSE 0 END::BIGINT AS chars FROM k LEFT JOIN c USING (path))"""


def _scan(spark, at):
    return scan.scanned(tree(spark, at), GLOBS)


@query(f"SELECT path, lang, state FROM {STATES}")
def file_states(spark, at):
    return scan.judged(tree(spark, at), GLOBS).select("path", "lang", "state")


@query(SCAN + " SELECT * FROM s")
def scanned_files(spark, at):
    return _scan(spark, at)


@query(SCAN + f", h AS (SELECT t.path, count(*) AS touches, max(ts) AS last FROM {TREE} t JOIN {CHANGES} ON file = doc_id JOIN {COMMITS} USING (hash) GROUP BY 1) SELECT lang, count(*)::BIGINT AS files, sum(code)::BIGINT AS code, coalesce(sum(touches), 0)::BIGINT AS touches, max(last) AS last FROM s LEFT JOIN h USING (path) GROUP BY lang")
def language_churn(spark, at):
    moved = changes(spark, at).join(commits(spark, at).select("hash", "ts"), "hash").groupBy("file").agg(F.count("*").alias("touches"), F.max("ts").alias("last"))
    named = tree(spark, at).select(F.col("doc_id").alias("file"), "path").join(moved, "file")
    return scan.by_language(_scan(spark, at), named.select("path", "touches", "last"))


@query(SCAN + " SELECT lower(regexp_extract(path, '\\.([A-Za-z]+)$', 1)) AS ending, count(*)::BIGINT AS files FROM s WHERE regexp_matches(path, '[^/]\\.([A-Za-z]+)$') GROUP BY 1")
def ending_tally(spark, at):
    return scan.endings(_scan(spark, at))


@query(SCAN + " SELECT lang, sum(code)::BIGINT AS code FROM s WHERE lang IN ('TypeScript', 'Python', 'Go', 'JavaScript', 'Rust') GROUP BY lang ORDER BY code DESC, lang LIMIT 1")
def primary_language(spark, at):
    return scan.primary_language(_scan(spark, at))


CASES = ". \ndef test_a(\nfunc TestA(\n#[test]\ntest("


@query(f"WITH n AS (SELECT path, (length(text) - length(replace(text, '. ', ''))) // 2 AS n FROM {TREE} WHERE NOT {OTHERS}), r AS (SELECT CASE WHEN ends_with(path, 'test_a.py') THEN 'pytest' WHEN ends_with(path, 'b_test.go') THEN 'go test' WHEN ends_with(path, '.rs') AND n > 0 THEN 'cargo test' WHEN starts_with(path, 'tests/') AND regexp_matches(path, '\\.(ts|tsx|js)$') THEN 'javascript' END AS runner, n FROM n) SELECT runner, count(*)::BIGINT AS files, coalesce(sum(n), 0)::BIGINT AS cases FROM r WHERE runner IS NOT NULL GROUP BY runner")
def test_suites(spark, at):
    return scan.suites(tree(spark, at).withColumn("text", F.replace("text", F.lit(". "), F.lit(CASES))))


@query(f"""WITH p AS (SELECT list_slice(string_split(path, '/'), 1, -2) AS own FROM {TREE}), a AS (SELECT own, unnest(range(0, len(own) + 1)) AS n FROM p)
  SELECT array_to_string(list_slice(own, 1, n), '/') AS folder, count(*) FILTER (n = len(own))::BIGINT AS leaves, count(*)::BIGINT AS below FROM a GROUP BY 1""")
def folder_counts(spark, at):
    return scan.folders(tree(spark, at))


@query(SCAN + ", b AS (SELECT split_part(path, '/', 1) AS folder, lang, sum(code)::BIGINT AS code FROM s GROUP BY ALL) SELECT *, CASE WHEN sum(code) OVER (PARTITION BY folder) > 0 THEN round(code / sum(code) OVER (PARTITION BY folder), 6) ELSE 0 END AS share FROM b")
def folder_languages(spark, at):
    return scan.folder_languages(_scan(spark, at))


@query("""WITH f AS (SELECT lang <> 'en' AS deep, left(coalesce(text, ''), 400) AS t FROM documents) SELECT CASE WHEN deep THEN NULL WHEN contains(lower(t), 'mit license') THEN 'MIT' WHEN contains(lower(t), 'apache license') THEN 'Apache-2.0' WHEN contains(lower(t), 'gnu affero') THEN 'AGPL-3.0' WHEN contains(lower(t), 'gnu general public') THEN 'GPL'
  WHEN contains(lower(t), 'gnu lesser') THEN 'LGPL' WHEN contains(lower(t), 'bsd') THEN 'BSD' WHEN contains(lower(t), 'mozilla public license') THEN 'MPL-2.0' WHEN contains(lower(t), 'unlicense') OR contains(lower(t), 'public domain') THEN 'Unlicense' ELSE 'unknown' END AS licence, count(*)::BIGINT AS files, count(*) FILTER (deep)::BIGINT AS nested FROM f GROUP BY 1""")
def licence_files(spark, at):
    # documents in English as licence files at the root, the others further down
    docs = table(spark, at, "documents").select(F.when(F.col("lang") == "en", "LICENSE.txt").otherwise("x/COPYING").alias("path"), "text")
    return scan.licence_files(docs)


@query(f"WITH l AS (SELECT raw AS said FROM {LINES} WHERE length(raw) >= 24) SELECT regexp_matches(said, '(?i)^[0-9a-f]{{16,}}$|^[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}$|^[a-z0-9+/]{{24,}}={{0,2}}$') OR regexp_matches(said, '^[MmLlHhVvCcSsQqTtAaZz][0-9\\s.,-]') OR (length(regexp_replace(said, '[^0-9\\s.,;:%#|/+_-]', '', 'g')) / length(said) > .6 AND NOT regexp_matches(said, '\\s\\w+\\s\\w+\\s')) AS machine, count(*)::BIGINT AS lines FROM l GROUP BY 1")
def machine_lines(spark, at):
    rows = table(spark, at, "documents").select(F.explode(text.lines_of(F.col("text"))).alias("said")).where(F.length("said") >= 24)
    return rows.groupBy(P.machine_made(F.col("said")).alias("machine")).agg(F.count("*").alias("lines"))


@query("SELECT page_id, length(url) <= 300 AND NOT regexp_matches(url, '[\\s\\\\]') AND NOT regexp_matches(url, '\\.html?$') AS strict, length(url) < 300 AND NOT regexp_matches(url, '[\\s\\\\]') AND NOT regexp_matches(url, '\\.html?$') AS soft FROM pages")
def route_likeness(spark, at):
    return table(spark, at, "pages").select("page_id", P.route_like(F.col("url")).alias("strict"), P.route_like(F.col("url"), named=True).alias("soft"))


IDENTITIES = f"""(WITH m AS (SELECT hash, sum(ins) AS ins, sum(del) AS del FROM {CHANGES} GROUP BY hash), t AS (SELECT who, count(*)::BIGINT AS commits, coalesce(sum(ins), 0)::BIGINT AS ins, coalesce(sum(del), 0)::BIGINT AS del, min(ts) AS first, max(ts) AS last FROM {COMMITS} LEFT JOIN m USING (hash) GROUP BY who)
  SELECT c_custkey AS id, n_name AS name, CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'u' || c_custkey % 60 || '@x' ELSE 'U' || c_custkey % 60 || '@x' END AS email, commits, ins, del, first, last FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN t ON who = c_custkey)"""
PEOPLE = f"""WITH RECURSIVE i AS MATERIALIZED (SELECT *, lower(CASE WHEN email = '' THEN name ELSE email END) AS address FROM {IDENTITIES}), h AS MATERIALIZED (SELECT address, min(id) AS id, regexp_replace(lower(arg_min(name, id)), '[^a-z0-9]', '', 'g') AS name FROM i GROUP BY address), m AS (SELECT name, min(id) AS lo FROM h GROUP BY name),
  e AS (SELECT a.name AS x, b.name AS y FROM m a JOIN m b ON length(a.name) >= 5 AND length(b.name) >= 5 AND (starts_with(a.name, b.name) OR starts_with(b.name, a.name))), r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x), p AS MATERIALIZED (SELECT i.*, CASE WHEN length(h.name) < 5 THEN h.id ELSE (SELECT min(lo) FROM r JOIN m ON r.y = m.name WHERE r.x = h.name) END AS person FROM i JOIN h USING (address))"""


@query(f"SELECT lower(CASE WHEN email = '' THEN name ELSE email END) AS address, sum(commits)::BIGINT AS commits, sum(ins)::BIGINT AS ins, sum(del)::BIGINT AS del, min(first) AS first, max(last) AS last FROM {IDENTITIES} GROUP BY 1")
def addresses_summed(spark, at):
    return people.addresses(identities(spark, at))


@query(PEOPLE + " SELECT id, person FROM p")
def matched_people(spark, at):
    return people.matched(identities(spark, at))


@query(PEOPLE + """, n AS (SELECT person, name, sum(commits) AS c FROM p GROUP BY ALL), b AS (SELECT person, name FROM n QUALIFY row_number() OVER (PARTITION BY person ORDER BY c DESC, name) = 1), l AS (SELECT person, email FROM p QUALIFY row_number() OVER (PARTITION BY person ORDER BY commits DESC, id) = 1)
  SELECT person, b.name, l.email, sum(commits)::BIGINT AS commits, sum(ins)::BIGINT AS ins, sum(del)::BIGINT AS del, min(first) AS first, max(last) AS last, coalesce(string_agg(DISTINCT p.email, ',' ORDER BY p.email) FILTER (p.email <> '' AND p.email <> l.email), '') AS also, CASE WHEN starts_with(b.name, 'UNITED') THEN 'helper' ELSE '' END AS tool FROM p JOIN b USING (person) JOIN l USING (person) GROUP BY person, b.name, l.email""")
def merged_people(spark, at):
    told = identities(spark, at)
    return people.merged(told, people.matched(told), [("(?i)^united", "helper")])


@query(f"WITH t AS (SELECT who::VARCHAR AS who, count(*)::BIGINT AS commits FROM {COMMITS} GROUP BY 1), f AS (SELECT * FROM t ORDER BY commits DESC, who LIMIT 12) SELECT * FROM f UNION ALL SELECT (count(*) - 12) || ' more', (sum(commits) - (SELECT sum(commits) FROM f))::BIGINT FROM t")
def leading_people(spark, at):
    return people.leading(commits(spark, at).groupBy("who").agg(F.count("*").alias("commits")), "commits", "who", 12)


@query(f"""WITH t AS (SELECT path, who FROM {CHANGES} JOIN {COMMITS} USING (hash) JOIN {FILES} USING (file) WHERE ts >= '2001-06-01'), n AS (SELECT path AS folder, who, count(*) AS c FROM t GROUP BY ALL UNION ALL SELECT split_part(path, '/', 1), who, count(*) FROM t GROUP BY ALL), o AS (SELECT folder, who FROM n QUALIFY row_number() OVER (PARTITION BY folder ORDER BY c DESC, who) = 1)
  SELECT f.path, coalesce(a.folder, b.folder) AS folder, coalesce(a.who, b.who) AS who FROM {FILES} f LEFT JOIN o a ON a.folder = f.path LEFT JOIN o b ON b.folder = split_part(f.path, '/', 1)""")
def nearest_owners(spark, at):
    # owners of files and of first folders in the last weeks of the log
    late = commits(spark, at).where("ts >= '2001-06-01'").select("hash", "who")
    touched = changes(spark, at).join(late, "hash").join(files(spark, at).select("file", "path"), "file")
    held = touched.select("who", F.explode(F.array("path", F.substring_index("path", "/", 1))).alias("folder")).groupBy("folder", "who").agg(F.count("*").alias("n"))
    owners = held.groupBy("folder").agg(F.max_by("who", F.struct("n", (-F.col("who")).alias("w"))).alias("who"))
    return people.nearest_owner(files(spark, at), owners)
