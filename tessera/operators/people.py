"""Identities of people: addresses summed, people matched over repositories, merged rows, nearest owners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import files as P
from tessera.functions.scalars import ancestors
from tessera.operators.graph import same_people
from tessera.sources.tables import written

SUMS = ("commits", "ins", "del")


def _key():
    return F.lower(F.when(F.coalesce("email", F.lit("")) != "", F.col("email")).otherwise(F.col("name")))


def addresses(identities: DataFrame) -> DataFrame:
    """(address, commits, ins, del, first, last): identities (id, name, email, ...) summed by address in either case; the
    name stands for a missing one. Nulls in sums count as zero."""
    by = identities.withColumn("address", _key()).groupBy("address")
    return by.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS), F.min("first").alias("first"), F.max("last").alias("last"))


def matched(identities: DataFrame) -> DataFrame:
    """(id, person): identities (id, name, email) of one address are one person, and so are those whose first identities'
    names begin one another; the person is the least id."""
    told = written(identities.select("id", "name", _key().alias("address")))
    heads = told.groupBy("address").agg(F.min(F.struct("id", "name")).alias("m")).select("address", "m.id", "m.name")
    people = same_people(heads.select("id", "name")).join(heads.select("id", "address"), "id").select("address", "person")
    return told.join(people, "address", "left").select("id", F.coalesce("person", "id").alias("person"))


def merged(identities: DataFrame, people: DataFrame, signers: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(person, name, email, commits, ins, del, first, last, also, tool): one row for each person (id, person).

    The identity with most commits lends its address, ties to the smaller id; the name with most commits in all is the
    name, ties to the smaller; `also` has the other addresses in order, comma-joined, which is as long as a person has
    addresses and not commits. tool is the signer that name or address shows.
    """
    rows = written(identities.join(people, "id"))
    by = rows.groupBy("person").agg(
        F.max_by("email", F.struct(F.col("commits"), (-F.col("id")).alias("i"))).alias("email"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in SUMS), F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_sort(F.collect_set(F.when(F.col("email") != "", F.col("email")))).alias("held"),
    )
    names = rows.groupBy("person", "name").agg(F.sum("commits").alias("n")).groupBy("person").agg(F.min(F.struct((-F.col("n")).alias("n"), "name")).alias("m")).select("person", "m.name")
    out = by.join(names, "person").withColumn("also", F.array_join(F.filter("held", lambda e: ~e.eqNullSafe(F.col("email"))), ",")).drop("held")
    return out.withColumn("tool", P.tool_of(F.col("name"), F.coalesce("email", F.lit("")), signers))


def leading(people: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """(key, by): the `most` rows with the greatest numbers, ties to the smaller key, and one row 'n more' with the sum of the rest.

    The first ones come from a bounded sort in each task; the rest is told from totals, so nothing is ordered as a whole.
    """
    first = people.select(F.col(key).cast("string").alias(key), F.col(by).alias(by)).orderBy(F.desc(by), F.col(key)).limit(most)
    first = written(first)
    total = people.agg(F.count("*").alias("n"), F.coalesce(F.sum(by), F.lit(0)).alias("s"))
    held = first.agg(F.count("*").alias("k"), F.coalesce(F.sum(by), F.lit(0)).alias("t"))  # one row
    rest = total.join(F.broadcast(held)).where("n > k").select(F.concat((F.col("n") - F.col("k")).cast("string"), F.lit(" more")).alias(key), (F.col("s") - F.col("t")).alias(by))
    return first.unionByName(rest)


def nearest_owner(asked: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, folder, who): for each asked path the owner (folder, who) of itself or of the nearest folder above that has
    one; null where none has."""
    up = asked.select("path").distinct().select("path", F.posexplode(ancestors(F.col("path"))).alias("depth", "folder"))
    best = up.join(owners.select("folder", "who"), "folder").groupBy("path").agg(F.max_by(F.struct("folder", "who"), "depth").alias("m"))
    return asked.select("path").distinct().join(best, "path", "left").select("path", "m.folder", "m.who")
