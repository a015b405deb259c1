"""Rules for files and people on rows told by hand."""

from pyspark.sql import functions as F

from tessera.functions import files as P
from tessera.operators import people, scan

FILES = [
    ("a.py", "x = 1\n# said\n\n"), ("deep/node_modules/a.py", "x"), ("a/b/build/c.ts", "x"), ("a/b/c/build/d.ts", "x"), ("CMakeLists.txt", "y"), ("bin/run", "#!/usr/bin/env python3\n"), ("bin/none", "text"),
    ("img.PNG", "\0"), ("raw.dat", "ab\0c"), (".hidden", "x"), ("link.py", None), (None, "x"), ("gen/a.py", "x"), ("docs/x/y/z.md", "x"), ("notes.a.xyz", "x"),
]


def told(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


def test_judged(spark):
    rows = scan.judged(spark.createDataFrame(FILES, "path string, text string"), ["gen/", "/docs/**/z.*  # all", ""])
    assert told(rows, "path", "lang", "state") == {
        ("a.py", "Python", "read"), ("deep/node_modules/a.py", "Python", "skipped"), ("a/b/build/c.ts", "TypeScript", "skipped"), ("a/b/c/build/d.ts", "TypeScript", "read"), ("CMakeLists.txt", "CMake", "read"),
        ("bin/run", "Python", "read"), ("bin/none", "", "unknown"), ("img.PNG", "Image", "document"), ("raw.dat", "dat", "binary"), (".hidden", "", "unknown"), ("link.py", "Python", "unknown"), (None, "", "unknown"),
        ("gen/a.py", "Python", "skipped"), ("docs/x/y/z.md", "Markdown", "skipped"), ("notes.a.xyz", "xyz", "read"),
    }


def test_scanned(spark):
    rows = scan.scanned(spark.createDataFrame(FILES[:1] + FILES[7:8], "path string, text string"))
    assert told(rows, "path", "code", "comment", "blank", "chars") == {("a.py", 1, 1, 1, 14), ("img.PNG", 0, 0, 0, 0)}
    assert scan.scanned(spark.createDataFrame([], "path string, text string")).count() == 0


def test_globs(spark):
    cases = [("/a/", "a/x", True), ("/a/", "b/a/x", False), ("*.min.js", "q/x.min.js", True), ("*.min.js", "x.minijs", False), ("a?c", "abc/d", True), ("a?c", "a/c", False), ("a**z", "a/b/z", True), ("(x", "(x", True)]
    for glob, path, hit in cases:
        assert spark.range(1).select(P.ignored(F.lit(path), [glob]).alias("x")).first().x == hit, glob
    assert P.glob_pattern(["", " # only said"]) == ""


def test_rules(spark):
    rows = spark.createDataFrame([(1,)], "n int")
    one = lambda c: rows.select(c.alias("x")).first().x
    assert [one(P.route_like(F.lit(s))) for s in ("/a/b", "", "a", "./a/b", "text/html", "https://x.org", "/a b", "/a.png", "~/a")] == [True, False, False, False, False, True, False, False, False]
    assert [one(P.route_like(F.lit(s), named=True)) for s in ("a", "", "a.b", "/a.b")] == [True, True, False, True]
    assert [one(P.machine_made(F.lit(s))) for s in ("0123456789abcdef", "M 10,20 30", "12:30:11, 4%", "the plain sentence of words")] == [True, True, True, False]
    assert [one(P.browsable(F.lit(s))) for s in ("git@h.org:o/r.git", "ssh://git@h.org/o/r", "git://h/r.git", "/local/r")] == ["https://h.org/o/r", "https://h.org/o/r", "https://h/r", ""]
    assert one(P.remote_host(F.lit("https://gitlab.com/a"))) == "gitlab" and one(P.remote_host(F.lit("https://x.org/a"))) == "git"
    assert [one(P.licence_said(F.lit(s))) for s in ("The mit license", "GNU LESSER", "x" * 400 + "BSD", "")] == ["MIT", "LGPL", "unknown", "unknown"]
    assert [one(P.short_bytes(F.lit(n))) for n in (999, 1500, 2_000_000, 3_400_000_000)] == ["999 B", "1.5 kB", "2.0 MB", "3.4 GB"]
    assert [one(P.loaded_by_name(F.lit(s))) for s in ("a/page.tsx", "lib/index.ts", "api/x.py", "lib/x.ts")] == [True, True, True, False]
    assert [one(P.in_suite(F.lit(s))) for s in ("a/tests/x.py", "a.spec.ts", "a.ts")] == [True, True, False]
    assert one(P.readable_source(F.lit("a.ts"), F.lit("let a = 1"))) and not one(P.readable_source(F.lit("a.d.ts"), F.lit(""))) and not one(P.readable_source(F.lit("a.js"), F.lit("x" * 900 + "\n")))


IDS = "id long, name string, email string, commits long, ins long, del long, first date, last date"


def test_people(spark):
    rows = spark.createDataFrame([(1, "Ann Lee", "a@x", 2, 1, 1, None, None), (2, "ann", "A@x", 5, 1, None, None, None), (3, "annlee jr", "b@x", 1, 0, 0, None, None), (4, "Bo", "", 1, 0, 0, None, None), (5, "bo", None, 1, 0, 0, None, None), (6, None, None, 1, 0, 0, None, None)], IDS)
    assert told(people.matched(rows), "id", "person") == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
    assert told(people.addresses(rows), "address", "commits", "del") == {("a@x", 7, 1), ("b@x", 1, 0), ("bo", 2, 0), (None, 1, 0)}
    out = people.merged(rows, people.matched(rows), [("(?i)^bo$", "helper")])
    assert told(out, "person", "name", "email", "commits", "also", "tool") == {(1, "ann", "A@x", 8, "a@x,b@x", ""), (4, "Bo", "", 2, "", "helper"), (6, None, None, 1, "", "")}


def test_leading_and_owners(spark):
    rows = spark.createDataFrame([("a", 3), ("b", 3), ("c", 1)], "who string, n long")
    assert told(people.leading(rows, "n", "who", 1), "who", "n") == {("a", 3), ("2 more", 4)}
    assert told(people.leading(rows, "n", "who", 3), "who", "n") == {("a", 3), ("b", 3), ("c", 1)}
    owners = spark.createDataFrame([("", 9), ("a/b", 1)], "folder string, who long")
    asked = spark.createDataFrame([("a/b/c",), ("a/x",), ("a/b",)], "path string")
    assert told(people.nearest_owner(asked, owners), "path", "folder", "who") == {("a/b/c", "a/b", 1), ("a/x", "", 9), ("a/b", "a/b", 1)}
    assert told(people.nearest_owner(asked, owners.where("who = 1")), "path", "who") == {("a/b/c", 1), ("a/x", None), ("a/b", 1)}
