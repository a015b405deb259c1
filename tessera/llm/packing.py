"""Best-fit packing of documents into training sequences under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Documents of a packing group, on average. Each group is packed by one task.
GROUP_ROWS = 4096

#: Stands for a null doc_id while packing.
NO_ID = -(1 << 63)


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int, per_source: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, given in packing order; no item is longer than the capacity.

    Open bins stand in the order of their residual. An item goes to the first bin from its own length on that it does
    not conflict with: one that holds neither its duplicate cluster nor per_source items of its source. A bin carries
    these as bitmaps: one of clusters, and per_source of sources, of which the k-th has the sources with k items or
    more. Cluster -1 conflicts with nothing. Of bins with equal residual the earliest comes first.
    """
    order: list[tuple[int, int]] = []
    held: list[list[int]] = []
    bins, offsets = [], []
    for length, source, cluster in zip(lengths, sources, clusters, strict=True):
        source_bit, cluster_bit = 1 << source, 1 << cluster if cluster >= 0 else 0
        at = bisect_left(order, (length, -1))
        while at < len(order):
            maps = held[order[at][1]]
            if not (maps[0] & cluster_bit or maps[per_source] & source_bit):
                break
            at += 1
        if at < len(order):
            residual, which = order.pop(at)
        else:
            residual, which = capacity, len(held)
            held.append([0] * (1 + per_source))
        maps = held[which]
        maps[0] |= cluster_bit
        for k in range(per_source, 1, -1):
            maps[k] |= maps[k - 1] & source_bit
        maps[1] |= source_bit
        bins.append(which)
        offsets.append(capacity - residual)
        if residual > length:
            insort(order, (residual - length, which))
    return bins, offsets


def pack_documents(docs: DataFrame, length: Column, capacity: int, source: Column | None = None, cluster: Column | None = None, per_source: int = 2, id_col: str = "doc_id", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, piece, bin_id, bin_offset, length, group): where each piece of each document lies.

    A document longer than the capacity fills whole bins of its own, and its last piece is packed like a document.
    Longest pieces go first, ties by doc_id. No bin holds two pieces of one cluster, or more than per_source of one
    source. Documents are dealt by a hash into groups of about group_rows, packed by themselves, so bins never mix
    groups; the number of groups follows the number of documents. Null lengths count as 0 and get a place; a null
    source or cluster conflicts with nothing. Repeated rows are packed each; give them a cluster to keep them apart.
    Rows with a null id, and equal rows beyond a group's number, are dealt by the place that they are read from.
    """
    rows = docs.select(
        # pandas would turn ids beside a null into floats
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"),
        F.coalesce(length.cast("long"), F.lit(0)).alias("length"),
        (source if source is not None else F.lit(None)).cast("string").alias("source"),
        (cluster if cluster is not None else F.lit(None)).cast("string").alias("cluster"),
        F.monotonically_increasing_id().alias("seat"),
    )
    rows = materialize(rows)
    groups = max(1, -(-rows.count() // group_rows))
    key = ["doc_id", "length", "source", "cluster"]
    many = materialize(rows.where(F.col("doc_id") != NO_ID).groupBy(*key).count().where(F.col("count") > group_rows).select(F.xxhash64(*key).alias("key")))
    by_seat = F.col("doc_id") == NO_ID
    dealt = rows.withColumn("key", F.xxhash64(*key))
    if not many.isEmpty():
        dealt = dealt.join(many.distinct().withColumn("often", F.lit(True)), "key", "left")
        by_seat = by_seat | F.coalesce("often", F.lit(False))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("key", F.when(by_seat, F.col("seat")), F.lit("pack")), F.lit(groups)))
    dealt = dealt.select(*key, "group")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["group"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id"], ascending=[False, True], kind="stable")
        full = pdf["length"] // capacity
        rest = pdf["length"] - full * capacity
        # a document that fills its bins has no rest to pack; an empty one still gets its place
        packed = pdf.assign(rest=rest, piece=full)[(rest > 0) | (full == 0)].sort_values(["rest", "doc_id"], ascending=[False, True], kind="stable")
        repeated = packed["cluster"].where(packed["cluster"].duplicated(keep=False))
        clusters = pd.factorize(repeated)[0].tolist()
        sources, names = pd.factorize(packed["source"])
        # unknown sources conflict with nothing, so each has a bit of its own
        unknown = iter(range(len(names), len(names) + int((sources < 0).sum())))
        bits = [int(s) if s >= 0 else next(unknown) for s in sources]
        bins, offsets = best_fit(packed["rest"].tolist(), bits, clusters, capacity, per_source)
        out = pd.DataFrame({"doc_id": packed["doc_id"], "piece": packed["piece"], "bin": bins, "bin_offset": offsets, "length": packed["rest"]})
        long = pdf[full > 0]
        whole = long.loc[long.index.repeat(full[full > 0])][["doc_id"]]
        whole["piece"] = whole.groupby(level=0).cumcount()
        first = max(bins, default=-1) + 1
        whole = whole.assign(bin=range(first, first + len(whole)), bin_offset=0, length=capacity)
        both = pd.concat([out, whole]) if len(whole) else out
        both["bin_id"] = group * (1 << 32) + both["bin"]
        both["group"] = group
        return both[["doc_id", "piece", "bin_id", "bin_offset", "length", "group"]]

    out = dealt.groupBy("group").applyInPandas(pack, "doc_id long, piece long, bin_id long, bin_offset long, length long, group long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def text_cluster(text: Column) -> Column:
    """Name of a text's exact-duplicate cluster: equal for texts that differ in case and white space only."""
    return F.md5(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")))
