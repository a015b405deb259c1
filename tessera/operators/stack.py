"""What a repository is made of: marks that its files leave, labels of the packages that it asks for, and its parts.

Rules are tables. A file meets the rules in one join on what its path offers as keys, however many rules there are; texts
are only fetched for the rules that look into them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.files import base_name, vendored
from tessera.functions.scalars import ancestors, role_of
from tessera.operators.imports import folder_of

RULE = "place int, facet string, label string, `on` string, key string, path_like string, says string, pick string, once string"

# Labels that make a front end, and those that make a back end.
CLIENT = ("React", "Vue", "Svelte", "Angular", "Solid", "Preact", "Astro", "Next.js", "Nuxt", "Flutter")
SERVER = ("Express", "Fastify", "NestJS", "Koa", "Hono", "hapi", "Next.js", "Nuxt", "SvelteKit")
BOXES = ("dockerfiles", "compose", "kubernetes", "terraform")


def path_keys(path: Column) -> Column:
    """Array of (on, key): the file's name, its beginnings up to a dot (stem), its endings from a dot on, the names of the
    folders that it is in, and their paths (below)."""
    name = base_name(path)
    bits = F.split(name, r"\.")
    cut = lambda low, n: F.array_join(F.slice(bits, low, n), ".")
    places = F.sequence(F.lit(1), F.size(bits))
    one = lambda kind: lambda k: F.struct(F.lit(kind).alias("on"), k.alias("key"))
    stems = F.filter(F.transform(places, lambda i: cut(F.lit(1), i)), lambda k: k != "")
    ends = F.transform(F.filter(places, lambda i: i > 1), lambda i: F.concat(F.lit("."), cut(i, F.size(bits))))
    folder = folder_of(path)
    within = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(folder, "/")))
    below = F.filter(ancestors(folder), lambda k: k != "")
    return F.concat(F.array(one("name")(name)), F.transform(stems, one("stem")), F.transform(ends, one("ending")), F.transform(within, one("folder")), F.transform(F.array_distinct(below), one("below")))


def marks(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, facet, label, files, first): what the rules tell from files (repo, path, text), on how many files, and the first
    of these by rule and path. Copies of others' code and tests tell nothing.

    A rule holds where its key (see path_keys) is one of the file's, path_like matches the path and says the text, if they
    are set. Of rules with the same `once` only a file's first one counts. The label is the rule's; where that is null,
    every first group of `pick` in the text, or without pick the file's name. A null text says nothing.
    """
    kept = files.where(~vendored(F.col("path")) & (role_of(F.col("path")) != "test"))
    met = kept.select("repo", "path", F.explode(path_keys(F.col("path"))).alias("k")).select("repo", "path", "k.*").join(rules, ["on", "key"])
    met = met.where(F.col("path_like").isNull() | F.regexp_like("path", F.col("path_like"))).drop("on", "key", "path_like").distinct()
    plain, deep = met.where("says is null and pick is null"), met.where("says is not null or pick is not null")
    read = deep.join(kept.where("text is not null").select("repo", "path", "text"), ["repo", "path"]).where(F.col("says").isNull() | F.regexp_like("text", F.col("says")))
    picked = F.when(F.col("label").isNull() & F.col("pick").isNotNull(), F.regexp_extract_all("text", F.col("pick"), F.lit(1))).otherwise(F.array(F.coalesce("label", base_name(F.col("path")))))
    every = plain.withColumn("labels", F.array(F.coalesce("label", base_name(F.col("path"))))).unionByName(read.withColumn("labels", picked).drop("text"))
    first = F.min("place").over(Window.partitionBy("repo", "path", "once"))
    every = every.withColumn("least", F.when(F.col("once").isNotNull(), first)).where("least is null or place = least")
    told = every.select("repo", "path", "facet", "place", F.explode("labels").alias("label")).where("label <> ''")
    return told.groupBy("repo", "facet", "label").agg(F.countDistinct("path").alias("files"), F.min_by("path", F.struct("place", "path")).alias("first"))


def coordinate(name: Column) -> Column:
    """The last segment of a package's name: group:artifact goes by its artifact."""
    return F.substring_index(name, ":", -1)


def packaged(asked: DataFrame, labels: DataFrame) -> DataFrame:
    """(repo, facet, label, package, ecosystem): labels (facet, key, label) of the packages that asked (repo, name,
    ecosystem, place) holds, each with the first package that implied it.

    A package goes by its coordinate's last segment: by the key that equals it, else the longest key ending in / that
    begins it, in each facet.
    """
    rows = asked.withColumn("tail", coordinate(F.col("name")))
    heads = F.transform(F.filter(F.sequence(F.lit(1), F.length("tail")), lambda i: F.substring(F.col("tail"), i, F.lit(1)) == "/"), lambda i: F.left(F.col("tail"), i))
    tails = rows.where("tail <> ''").select("tail").distinct().select("tail", F.explode(F.array_distinct(F.concat(F.array("tail"), heads))).alias("key"))
    best = tails.join(labels, "key").groupBy("tail", "facet").agg(F.max_by("label", F.struct((F.col("key") == F.col("tail")).alias("own"), F.length("key").alias("n"))).alias("label"))
    return rows.join(best, "tail").groupBy("repo", "facet", "label").agg(F.min_by(F.struct("name", "ecosystem"), F.struct("place", "name")).alias("f")).select("repo", "facet", "label", F.col("f.name").alias("package"), F.col("f.ecosystem").alias("ecosystem"))


def parts(facets: DataFrame, manifests: DataFrame) -> DataFrame:
    """(repo, place, part): what each repository ships, in order, from facets (repo, facet, label) of its marks and packages
    and its manifests (repo, packages, workspaces, bin); a repository without either has no rows."""
    has = lambda facet, labels=None: F.coalesce(F.bool_or((F.col("facet") == facet) & (F.col("label").isin(*labels) if labels else F.lit(True))), F.lit(False))
    told = facets.groupBy("repo").agg(
        has("frameworks", CLIENT).alias("client"), (has("frameworks", SERVER) | has("connects")).alias("server"), has("apps").alias("native"), F.array_sort(F.collect_set(F.when(F.col("facet") == "apps", F.lower("label")))).alias("apps"),
        F.coalesce(F.bool_or(F.col("facet").isin(*BOXES)), F.lit(False)).alias("boxed"), has("bins").alias("binned"), has("workspaces").alias("spaced"),
    )
    own = manifests.groupBy("repo").agg(F.bool_or(F.col("workspaces") & (F.col("packages") == 0)).alias("root"), F.bool_or("workspaces").alias("many"), F.bool_or("bin").alias("bin"))
    rows = told.join(own, "repo", "full").na.fill(False)
    yes = lambda c, part: F.when(c, F.array(F.lit(part))).otherwise(F.array().cast("array<string>"))
    col = F.col
    listed = F.concat(yes(col("client"), "frontend"), yes(col("server"), "backend"), yes(col("root"), "monorepo root"), yes(col("many") | col("spaced"), "monorepo"), yes(col("bin") | col("binned"), "cli"), F.coalesce("apps", F.array().cast("array<string>")), yes(col("boxed"), "infra"))
    return rows.select("repo", F.posexplode(listed).alias("place", "part"))
