"""Corpus preparation: each stage reads what the one before it has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import fresh, materialize, table
from tessera.llm.packing import pack_documents, text_cluster
from tessera.llm.pii import disclosing_terms, find_pii, sanitised
from tessera.llm.simhash import few, near_duplicate_groups, text_key
from tessera.llm.toxicity import fit, judged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a model of the labelled ones tells as toxic.

    A null text counts as empty and stays, as all do where labels of both kinds are missing. Repeated rows are told
    alike. Columns of any name pass unchanged; an empty table stays empty.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs if model is None else docs.where(~judged(model, F.col("text"))["toxic"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of near-duplicates (five-word shingles, similarity 0.8 or more).

    Documents with a null doc_id stay. A null text counts as empty, so of those without words one stays. Rows equal in
    doc_id and text are one document, of which one row stays (that of the least hash, should other columns differ);
    rows of one doc_id with different texts are documents of their own. Columns of any name pass unchanged.
    """
    groups = materialize(near_duplicate_groups(docs).where("not first or copies > 1"))
    key = text_key(F.col("text").cast("string"))
    gone, repeated = (few(materialize(groups.where(c).select("id", F.col("text_key").alias("key")))) for c in ("not first", "first"))
    kept = docs.join(gone, (docs["doc_id"].cast("long") == gone["id"]) & (key == gone["key"]), "left_anti")
    if repeated.isEmpty():
        return kept
    named, row = fresh(docs, "text_key"), fresh(docs, "row")
    same = (kept["doc_id"].cast("long") == repeated["id"]) & (key == repeated["key"])
    each = Window.partitionBy("doc_id", named).orderBy(F.xxhash64(*docs.columns))
    one = kept.join(repeated, same, "left_semi").withColumn(named, key).withColumn(row, F.row_number().over(each)).where(F.col(row) == 1)
    return kept.join(repeated, same, "left_anti").unionByName(one.select(*docs.columns))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and disclosing terms in the texts; n_chars follows.

    A null text stays null, with n_chars 0, an empty one empty. All rows stay, repeated ones and null ids too, and
    columns of any name pass unchanged.
    """
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    found = find_pii(given, materialize(disclosing_terms(given)))
    text = F.when(F.col("text").isNotNull(), sanitised(F.col("_text"), F.col("_spans")))
    changed = {"text": text, "n_chars": F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return found.select(*((changed[c] if c in changed else F.col("row")[c]).alias(c) for c in docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' bytes into bins of 16,384; at most two of a source and one of a cluster in a bin.

    A null or empty text has the one byte that ends it. Null sources conflict with nothing; null ids and repeated rows
    get a place each. Other columns are not read; an empty table gives no rows.
    """
    length = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    return pack_documents(docs, length, 16_384, F.col("source"), text_cluster(F.col("text")), per_source=2)


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
