"""Compiler configurations: what each inherits along its chain of `extends`, and the nearest one of each folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import ancestors
from tessera.functions.tolerant import document, plain_json
from tessera.operators.imports import folder_of, walked
from tessera.sources.tables import apart, written

# The names of the configurations that are looked for, the first before the second.
NAMES = ("tsconfig.json", "jsconfig.json")
FORM = "extends string, compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>"


def read(files: DataFrame) -> DataFrame:
    """(path, folder, up, base_url, paths): the files (path, text) that are configurations, which any JSON object may be.

    up is the path that `extends` names: taken from the file's folder if it begins with a dot, .json added, else below
    node_modules there. Comments and trailing commas are skipped; a text that is no object is no configuration.
    """
    # a VARIANT tells whether the text is an object; a map keeps the order of its patterns, which a VARIANT does not
    told = files.where(F.col("path").endswith(".json")).select("path", F.schema_of_variant(document(F.col("text"))).startswith("OBJECT").alias("ok"), F.from_json(plain_json(F.col("text")), FORM).alias("j"))
    said, folder = F.col("j.extends"), folder_of(F.col("path"))
    near = F.startswith(said, F.lit("."))
    up = F.when(near, walked(folder, F.when(F.endswith(said, F.lit(".json")), said).otherwise(F.concat(said, F.lit(".json"))))).otherwise(walked(folder, F.concat(F.lit("node_modules/"), said)))
    return told.where("ok").select("path", folder.alias("folder"), F.when(said != "", up).alias("up"), F.col("j.compilerOptions.baseUrl").alias("base_url"), F.col("j.compilerOptions.paths").alias("paths"))


def chains(links: DataFrame) -> DataFrame:
    """(path, step, at): what each path of links (path, up) leads to, itself at step 0, to the end or to the first that
    the chain has already.

    Pointers double, so a chain of n takes log2(n) rounds. A step that leads back into its own chain ends it.
    """
    every = links.select("path").distinct()
    held = written(links.select("path", "up").distinct().join(apart(every.select(F.col("path").alias("up"))), "up", "left_semi").where("path <> up"))
    chain = written(every.select("path", F.lit(0).alias("step"), F.col("path").alias("at")))
    jump, span = held.select("path", F.col("up").alias("next")), 1
    while not jump.isEmpty():
        more = jump.join(apart(chain.select(F.col("path").alias("next"), "step", "at")), "next").select("path", (F.col("step") + span).alias("step"), "at")
        # of what a chain visits twice the first visit counts, and what lies beyond it is gone over again
        chain = written(chain.unionByName(more).groupBy("path", "at").agg(F.min("step").alias("step")).select("path", "step", "at"))
        far = jump.join(apart(jump.select(F.col("path").alias("next"), F.col("next").alias("further"))), "next").select("path", F.col("further").alias("next"))
        jump = written(far.join(apart(chain.select("path", F.col("at").alias("next"))), ["path", "next"], "left_anti"))
        span *= 2
    return chain


def merged(configs: DataFrame) -> DataFrame:
    """(path, folder, base_url, aliases): each configuration with what it inherits.

    The nearest base_url of its chain counts, and of each pattern the nearest targets; patterns stand in the order in
    which they were first written, from the far end of the chain on. folder is that of the nearest configuration that
    has paths or a base_url, else of the chain's last one. aliases: array of (pattern, targets).
    """
    chain = written(chains(configs).join(apart(configs.select(F.col("path").alias("at"), "folder", "base_url", "paths")), "at"))
    own = (F.col("paths").isNotNull() | (F.coalesce("base_url", F.lit("")) != "")).alias("own")
    nearest = F.min_by("folder", F.when(own, F.col("step")))
    told = chain.groupBy("path").agg(F.coalesce(nearest, F.max_by("folder", "step")).alias("folder"), F.min_by("base_url", F.when(F.col("base_url").isNotNull(), F.col("step"))).alias("base_url"))
    each = chain.where("paths is not null").select("path", "step", F.posexplode(F.map_entries("paths")).alias("place", "entry")).select("path", "step", "place", F.col("entry.key").alias("pattern"), F.col("entry.value").alias("targets"))
    one = each.groupBy("path", "pattern").agg(F.min_by("targets", "step").alias("targets"), F.min(F.struct((-F.col("step")).alias("s"), "place")).alias("first"))
    # as many as the chain's own files hold
    lists = one.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("first", "pattern", "targets"))).alias("l"))
    aliases = F.transform("l", lambda a: F.struct(a["pattern"].alias("pattern"), a["targets"].alias("targets")))
    return told.join(apart(lists.select("path", aliases.alias("aliases"))), "path", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<struct<pattern: string, targets: array<string>>>")))


def nearest(files: DataFrame, configs: DataFrame) -> DataFrame:
    """(folder, path): for each folder of files (path) the configuration of the nearest folder above, or in, it that has
    one in force. In one folder the first of NAMES that is a file counts, and none if that one is not readable."""
    name = F.substring_index("path", "/", -1)
    here = files.where(name.isin(*NAMES)).select("path", folder_of(F.col("path")).alias("at"), (name != NAMES[0]).alias("second"))
    first = here.groupBy("at").agg(F.min_by("path", "second").alias("path")).join(apart(configs.select("path")), "path", "left_semi")
    folders = files.select(folder_of(F.col("path")).alias("folder")).distinct()
    above = folders.select("folder", F.explode(F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(ancestors(F.col("folder")))).alias("at"))
    return above.join(first, "at").groupBy("folder").agg(F.max_by("path", F.length("at")).alias("path"))


def settings(files: DataFrame) -> DataFrame:
    """(folder, root, base_url, aliases) in force in each folder of files (path, text) that has any."""
    configs = written(read(files))
    return nearest(files, configs).join(apart(merged(configs).withColumnRenamed("folder", "root")), "path").select("folder", "root", "base_url", "aliases")
