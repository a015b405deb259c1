"""What a specifier stands for: a file, a package or nothing; totals, forwarding files, siblings and folder imports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.markup import package_of, specifiers
from tessera.sources.tables import MOST, apart, dealt, written

# The endings tried in order, and what may stand for a written script ending.
TRIED = (".ts", ".tsx", ".mts", ".cts", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".json")
REWRITTEN = {".js": (".ts", ".tsx", ".d.ts", ".js"), ".jsx": (".tsx", ".jsx"), ".mjs": (".mts", ".d.mts", ".mjs"), ".cjs": (".cts", ".d.cts", ".cjs")}


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def walked(start: Column, said: Column) -> Column:
    """said taken from the folder start, . and .. resolved; null where it leaves the root."""
    # most have no more than one .. after a folder, which needs no walk; both columns are made once
    short = F.regexp_replace(F.regexp_replace(F.concat(F.lit("/"), start, F.lit("/"), said), r"(/\.?)+(?=/|\z)", ""), r"/(?!\.\.(?:/|\z))[^/]+/\.\.(?=/|\z)", "")
    return F.get(F.transform(F.array(short), lambda c: F.when(~c.rlike(r"/\.\.(/|\z)"), F.substring(c, 2, 1 << 30)).otherwise(_stepped(c))), F.lit(0))


def _stepped(path: Column) -> Column:
    up = F.aggregate(F.filter(F.split(path, "/"), lambda p: p != ""), F.array().cast("array<string>"), lambda acc, p: F.when((p != "..") | F.coalesce(F.try_element_at(acc, F.lit(-1)) == "..", F.size(acc) == 0), F.concat(acc, F.array(p))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))))
    return F.get(F.transform(F.array(up), lambda steps: F.when(~F.array_contains(steps, ".."), F.array_join(steps, "/"))), F.lit(0))


ENDS = tuple(dict.fromkeys((*TRIED, *(e for instead in REWRITTEN.values() for e in instead))))


def _told_by(files: DataFrame) -> DataFrame:
    """(key, form, end, dst): what a base may be for which each file of files (path) is tried: its whole path, that without
    an ending, the folder that it is the index of."""
    path = F.col("path")
    told = lambda end, form, cut: F.when(F.endswith(path, F.lit(cut)), F.struct(F.left(path, F.length(path) - len(cut)).alias("key"), F.lit(form).alias("form"), F.lit(end).alias("end")))
    ended = [told(e, "ended", e) for e in ENDS]
    index = [F.coalesce(told(e, "index", f"/index{e}"), F.when(path == f"index{e}", F.struct(F.lit("").alias("key"), F.lit("index").alias("form"), F.lit(e).alias("end")))) for e in ENDS]
    whole = F.struct(path.alias("key"), F.lit("whole").alias("form"), F.lit("").alias("end"))
    return files.select(path.alias("dst"), F.explode(F.array_compact(F.array(whole, *ended, *index))).alias("x")).select("x.*", "dst")


def _keys_of(base: Column) -> Column:
    """(key, swapped) of the files that a base may be: itself and, where it ends in a script's ending, what stands before
    that."""
    stem = F.lit(None).cast("string")
    written_as = F.lit(None).cast("string")
    for end in REWRITTEN:
        stem = F.when(F.endswith(base, F.lit(end)), F.left(base, F.length(base) - len(end))).otherwise(stem)
        written_as = F.when(F.endswith(base, F.lit(end)), F.lit(end)).otherwise(written_as)
    own = F.struct(base.alias("key"), F.lit("").alias("swapped"))
    return F.when(stem.isNotNull(), F.array(F.struct(stem.alias("key"), written_as.alias("swapped")), own)).otherwise(F.array(own))


def _order() -> Column:
    """The place of a file's (swapped, form, end) among those tried for a base; null for what is not tried."""
    places = {("", "whole", ""): 100}
    places |= {(said, "ended", e): i for said, instead in REWRITTEN.items() for i, e in enumerate(instead)}
    places |= {("", form, e): first + i for form, first in (("ended", 200), ("index", 300)) for i, e in enumerate(TRIED)}
    entries = [x for (swapped, form, end), i in places.items() for x in (F.lit(f"{swapped} {form} {end}"), F.lit(i))]
    return F.try_element_at(F.create_map(*entries), F.concat_ws(" ", "swapped", "form", "end"))


def _filled(target: Column, middle: Column) -> Column:
    """target with the first * replaced."""
    hole = F.instr(target, "*")
    return F.when(hole > 0, F.concat(F.left(target, hole - 1), middle, F.substring(target, hole + 1, F.length(target)))).otherwise(target)


def imports_of(files: DataFrame) -> DataFrame:
    """(src, specifier): the different imports of each file (path, text)."""
    return _said_by(files).distinct()


def _said_by(files: DataFrame) -> DataFrame:
    return files.select(F.col("path").alias("src"), F.explode(F.array_distinct(specifiers(F.col("text")))).alias("specifier"))


def resolved(files: DataFrame, aliases: Sequence[tuple[str, Sequence[str]]] = (), packages: DataFrame | None = None, base: str | None = None, settings: DataFrame | None = None) -> DataFrame:
    """(src, specifier, kind, dst, package): kind is file, package or missing.

    A relative specifier is tried from its own folder; others by the aliases (pattern with at most one *, targets) in
    order, then in the folder of a workspace package (name, folder, entry), then below `base`. settings (folder, root,
    base_url, aliases) give each folder's files aliases and a base of their own, tried before the common ones. The first
    candidate that is a file counts. Relative ones, absolute ones and those that an alias takes are missing without a
    file; the rest are packages. Bases meet the files in one join on the path without its ending.
    """
    # an import that a file makes twice, and a file that is given twice, meet in the last grouping
    rows = written(_said_by(files))
    n = rows.count()
    said = F.col("specifier")
    near = F.startswith(said, F.lit("."))
    outside = said.rlike(r"^/|^[A-Za-z]:[\\/]")
    bare = ~near & ~outside
    bases, taken = [F.array(F.when(near, walked(folder_of(F.col("src")), said)))], F.lit(False)

    def hits(pattern: Column) -> Column:
        hole = F.instr(pattern, "*")
        tail = F.substring(pattern, hole + 1, F.length(pattern))
        return F.when(hole == 0, said == pattern).otherwise(F.startswith(said, F.left(pattern, hole - 1)) & F.endswith(said, tail) & (F.length(said) >= F.length(pattern) - 1))

    def middle(pattern: Column) -> Column:
        hole = F.instr(pattern, "*")
        return F.when(hole == 0, "").otherwise(F.substring(said, hole, F.length(said) - F.length(pattern) + 1))

    if settings is not None:
        told = settings.select(F.col("folder").alias("_folder"), F.col("root").alias("_root"), F.col("base_url").alias("_base"), F.col("aliases").alias("_aliases"))
        rows = written(rows.join(told, folder_of(F.col("src")) == F.col("_folder"), "left").drop("_folder"))
        hit = F.filter("_aliases", lambda a: bare & hits(a["pattern"]))
        within = lambda a: F.transform(a["targets"], lambda t: walked(F.col("_root"), F.concat(F.coalesce("_base", F.lit(".")), F.lit("/"), _filled(t, middle(a["pattern"])))))
        bases.append(F.coalesce(F.flatten(F.transform(hit, within)), F.array().cast("array<string>")))
        taken = taken | F.coalesce(F.size(hit) > 0, F.lit(False))
    for pattern, targets in aliases:
        hit = bare & hits(F.lit(pattern))
        taken = taken | hit
        bases.append(F.array(*(F.when(hit, walked(F.lit(""), _filled(F.lit(t), middle(F.lit(pattern))))) for t in targets)))
    asked = rows.withColumn("near", near).withColumn("taken", taken | outside).withColumn("package", F.when(~outside, package_of(said)))
    if packages is not None:
        asked = asked.join(packages.select(F.col("name").alias("package"), F.col("folder").alias("_home"), F.col("entry").alias("_entry")), "package", "left")
        rest = F.substring(said, F.length("package") + 1, F.length(said))
        bases.append(F.array(F.when(~near, walked(F.col("_home"), rest)), F.when(~near & F.col("_entry").isNotNull(), walked(F.col("_home"), F.col("_entry")))))
    if settings is not None:
        bases.append(F.array(F.when(bare & (F.col("_base") != ""), walked(F.col("_root"), F.concat(F.col("_base"), F.lit("/"), said)))))
    if base is not None:
        bases.append(F.array(F.when(bare, walked(F.lit(base), said))))
    tried = asked.select("src", "specifier", F.posexplode(F.array_compact(F.concat(*bases))).alias("place", "base")).select("src", "specifier", "place", F.explode(_keys_of(F.col("base"))).alias("x")).select("src", "specifier", "place", "x.*")
    # both are dealt by their rows: few bytes hold many of them, and a task sorts all that it is given
    met = dealt(tried, "key", n=2 * n, most=MOST).join(apart(_told_by(files)), "key").withColumn("order", _order()).where("order is not null")
    every = asked.select("src", "specifier", "near", "taken").unionByName(met.select("src", "specifier", "dst", "place", "order"), allowMissingColumns=True)
    best = F.min_by("dst", F.when(F.col("order").isNotNull(), F.struct("place", "order")))
    out = dealt(every, "src", "specifier", n=2 * n, most=MOST).groupBy("src", "specifier").agg(best.alias("dst"), F.bool_or("near").alias("near"), F.bool_or("taken").alias("taken"))
    kind = F.when(F.col("dst").isNotNull(), "file").when(F.col("near") | F.col("taken"), "missing").otherwise("package")
    return out.select("src", "specifier", kind.alias("kind"), "dst", F.when(kind == "package", package_of(said)).alias("package"))


def totals(found: DataFrame, files: DataFrame, by: Callable[[Column], Column] | None = None) -> DataFrame:
    """(part, files, edges, external, missing, seen, coverage): imports by kind for each part that `by` makes of the paths, coverage
    being the share that is not missing, 1 where nothing is imported. Without `by` all is one part, ''."""
    part = by or (lambda _: F.lit(""))
    told = found.groupBy(part(F.col("src")).alias("part")).agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in (("file", "edges"), ("package", "external"), ("missing", "missing"))), F.count("*").alias("seen"))
    held = files.groupBy(part(F.col("path")).alias("part")).agg(F.count("*").alias("files"))
    out = held.join(told, "part", "left").na.fill(0, ["edges", "external", "missing", "seen"])
    return out.withColumn("coverage", covered(F.col("seen"), F.col("missing")))


def covered(seen: Column, missing: Column) -> Column:
    return F.when(seen > 0, F.round((seen - missing) / seen, 6)).otherwise(F.lit(1.0))


def summed(stats: DataFrame) -> DataFrame:
    """Totals of several parts as one row: sums, and the coverage from the sums."""
    names = ("files", "edges", "external", "missing", "seen")
    return stats.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).withColumn("coverage", covered(F.col("seen"), F.col("missing")))


def symbols(files: DataFrame) -> DataFrame:
    """(path, exports, declares, functions, classes, forwards): counts of declarations at the beginning of lines, and
    whether an export names another file."""
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    kinds = r"(?m)^\s*(?:export\s+(?:default\s+)?)?(?:abstract\s+|async\s+)*"
    return files.select(
        "path", n(r"(?m)^\s*export\s").alias("exports"), n(kinds + r"(?:function|class|const|let|var|interface|type|enum)\b").alias("declares"), n(kinds + r"function\b").alias("functions"), n(kinds + r"class\b").alias("classes"),
        F.col("text").rlike(r"(?m)^\s*export\s[^'\"()]*?\bfrom\s*['\"]").alias("forwards"),
    )


def forwarding(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(path, barrel): files that import a file, declare nothing and hand something on."""
    led = found.where("kind = 'file'").select(F.col("src").alias("path")).distinct().withColumn("led", F.lit(True))
    rows = counts.join(apart(led), "path", "left")
    return rows.select("path", (F.coalesce("led", F.lit(False)) & (F.col("declares") == 0) & ((F.col("exports") > 0) | F.coalesce("forwards", F.lit(False)))).alias("barrel"))


def into_folders(asked: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): imports (src, folder) of a whole folder, to each file directly in it but the importer."""
    held = files.select(F.col("path").alias("dst"), folder_of(F.col("path")).alias("folder"))
    return asked.distinct().join(apart(held), "folder").where("src <> dst").select("src", "dst")


def siblings(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): files of one folder of which one says the other's name as a word, without those in edges (src, dst).

    Words meet names on (folder, word), so files of a folder are not compared with each other.
    """
    words = files.select(F.col("path").alias("src"), folder_of(F.col("path")).alias("folder"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))).alias("word"))
    names = files.select(F.col("path").alias("dst"), folder_of(F.col("path")).alias("folder"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.\w+$", "").alias("word"))
    met = words.join(apart(names), ["folder", "word"]).where("src <> dst").select("src", "dst").distinct()
    return met.join(apart(edges.select("src", "dst")), ["src", "dst"], "left_anti")
