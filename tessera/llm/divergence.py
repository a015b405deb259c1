"""Source divergence audit: how far each source's term shares lie from other sources' and from its language's.

A sum over all kept terms is taken apart by supports. Terms that only one of two sources has are priced from that
source's histogram of counts, since the other's share of a missing term is one number; the joined postings of the two
correct the terms that both have; terms that neither has share one constant. So no source is held against the whole
vocabulary. All arithmetic is in whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.simhash import few

#: Terms in UTF-8: letters of ASCII and whatever is beyond it.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Documents of its language that a term must be in to be kept.
LEAST_DOCS = 3
#: Shares are counted in these parts of one.
PARTS = 1_000_000_000
#: Ranks of terms that are returned of each source.
TOP = 200

#: Counts that a task holds before it hands them on, and bytes from which a text's terms are taken one by one.
ENTRIES, LONG = 400_000, 1 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts of docs (lang, source, text), summed within each task.

    Every lang and source that occurs has a row of the empty term with counts of 0.
    """

    def handed(n: dict, df: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), counts in n.items():
            terms = [b"", *counts]
            told = (pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()).cast(pa.string()))
            within = df[lang, source]
            yield pa.RecordBatch.from_arrays([*told, pa.array([0, *counts.values()], pa.int64()), pa.array([0, *(within[t] for t in counts)], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df, held = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw, key = text.as_buffer().to_pybytes().lower(), (lang, source)
                before = len(n[key])
                if len(raw) < LONG:
                    found = TERM.findall(raw)
                    n[key].update(found)
                    df[key].update(set(found))
                else:
                    own = Counter(m[0] for m in TERM.finditer(raw))
                    n[key].update(own)
                    df[key].update(own.keys())
                held += len(n[key]) - before
                if held > ENTRIES:
                    yield from handed(n, df)
                    n, df, held = defaultdict(Counter), defaultdict(Counter), 0
        yield from handed(n, df)

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(PARTS * (count + 1) / (total + kept)); products are decimals, so that they hold any count."""
    whole = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * whole(count + 1), whole(total + kept))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of each source of each language.

    part 'pair': the divergence from each other source of the language, over all kept terms. part 'term': the `top`
    kept terms whose share exceeds the language's. Greatest value first, ties to the lesser item by UTF-8.

    Null lang, source or text count as empty strings; an empty lang or source is one of its own. Every row is a
    document, repeated ones too. A source without kept terms has pairs (of value 0 where its language keeps none) and
    no terms. A text of any length is read whole. Other columns are not read; an empty table gives none.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(said(lang_col).alias("lang"), said(source_col).alias("source"), said(text_col).alias("text"))
    counts = materialize(term_counts(given).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    vocabulary = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    kept = counts.drop("docs").join(vocabulary, ["lang", "term"])
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all").alias("of_lang"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "kept", "of_lang"])
    # where a language keeps no term its sources' shares are never used
    zero = F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.greatest("kept", F.lit(1)))).otherwise(1)
    groups = few(materialize(groups.withColumn("zero", zero)))
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("all"), F.col("of_lang"), F.col("kept"))
    postings = materialize(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", p.alias("p"), q.alias("q"), "zero"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = postings.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    pairs = pair_values(postings, groups).withColumn("rank", F.row_number().over(by_value))
    names = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*names).unionByName(terms.withColumn("part", F.lit("term")).select(*names))


def pair_values(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): each source of a language against each other one, named by item.

    postings: (lang, source, term, n, p, zero) of the kept terms that a source has; groups: (lang, source, held, kept,
    zero), zero being the share of a term that the source has not.
    """
    zeros = few(materialize(groups.select("lang", F.col("zero").alias("against")).distinct()))
    histogram = postings.groupBy("lang", "source", "n", "p").agg(F.count("*").alias("h"))
    priced = histogram.join(zeros, "lang").groupBy("lang", "source", "against").agg(
        F.sum(F.col("h") * divergence(F.col("p"), F.col("against"))).alias("mine"), F.sum(F.col("h") * divergence(F.col("against"), F.col("p"))).alias("theirs")
    )
    priced = few(materialize(priced))

    def side(of: str) -> DataFrame:
        return postings.select("lang", "term", *(F.col(c).alias(f"{c}_{of}") for c in ("source", "p", "zero")))

    def corrected(a: str, b: str) -> Column:
        pa_, za, pb, zb = (F.col(f"{c}_{x}") for x in (a, b) for c in ("p", "zero"))
        return F.sum(divergence(pa_, pb) - divergence(pa_, zb) - divergence(za, pb) + divergence(za, zb))

    met = side("a").join(side("b"), ["lang", "term"]).where("source_a < source_b")
    both = materialize(met.groupBy("lang", "source_a", "source_b").agg(corrected("a", "b").alias("ab"), corrected("b", "a").alias("ba")))
    overlap = both.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), F.col("ab").alias("both"))
    overlap = overlap.unionByName(both.select("lang", F.col("source_b").alias("source"), F.col("source_a").alias("item"), F.col("ba").alias("both")))
    other = groups.select("lang", F.col("source").alias("item"), F.col("held").alias("held_b"), F.col("zero").alias("zero_b"))
    pairs = groups.join(few(materialize(other)), "lang").where("source <> item")
    pairs = pairs.join(priced.select("lang", "source", F.col("against").alias("zero_b"), "mine"), ["lang", "source", "zero_b"], "left")
    pairs = pairs.join(priced.select("lang", F.col("source").alias("item"), F.col("against").alias("zero"), "theirs"), ["lang", "item", "zero"], "left")
    pairs = pairs.join(overlap, ["lang", "source", "item"], "left").na.fill(0, ["mine", "theirs", "both"])
    neither = (F.col("kept") - F.col("held") - F.col("held_b")) * divergence(F.col("zero"), F.col("zero_b"))
    return pairs.select("lang", "source", "item", (F.col("mine") + F.col("theirs") + F.col("both") + neither).alias("value"))
