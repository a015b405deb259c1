"""Nearest neighbours by multiprobe p-stable hashing, reranked by exact inner products.

Largest inner products become smallest distances by one further component that brings all vectors to one length. In
each table a vector's bucket is floor((a.x + b) / w) for a row of Gaussian a. A query visits its own bucket and then
perturbed ones in the order of their estimated success. Buckets are dealt to cells; each cell compares its queries
with the vectors of the buckets that they probe and hands on the best of each query.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Rows from which the width and the number of probes are fitted, and the queries among them.
FIT_ROWS, FIT_QUERIES = 4096, 128
#: Recall that the number of probes is fitted for, and the numbers that are tried.
AIM, PROBES = 0.95, (4, 8, 16, 32, 64, 128, 256, 512)
#: Vectors of a cell, on average; cells beyond twice that are split.
CELL_ROWS = 1 << 16
#: Split cells up to which their list is broadcast.
BROADCAST_CELLS = 10_000
#: Queries compared at a time.
BLOCK = 128


@dataclass(frozen=True)
class Index:
    """tables of `hashes` functions each, of width `width` on vectors brought to the length `bound`."""

    dim: int
    bound: float
    width: float
    hashes: int
    probes: int
    tables: int
    cells: int
    seed: int = 7


@functools.lru_cache(maxsize=64)
def _functions(index: Index, table: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([index.seed, table])
    return rng.standard_normal((index.dim + 1, index.hashes)), rng.uniform(0, index.width, index.hashes)


@functools.lru_cache(maxsize=8)
def probe_order(hashes: int, probes: int) -> np.ndarray:
    """(probes, 2 * hashes) of 0/1: sets of boundaries to cross, boundary j being the j-th nearest, by rising expected
    squared distance when the distances are uniform. No set crosses both boundaries of a function."""
    last = 2 * hashes
    j = np.arange(1, last + 1)
    near = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    far = last + 1 - j
    cost = np.where(j <= hashes, near, 1 - far / (hashes + 1) + far * (far + 1) / (4 * (hashes + 1) * (hashes + 2)))
    found, heap = [()], [(cost[0], (0,))]
    while heap and len(found) < probes:
        total, chosen = heapq.heappop(heap)
        if not any(last - 1 - c in chosen for c in chosen):
            found.append(chosen)
        top = chosen[-1]
        if top + 1 < last:
            heapq.heappush(heap, (total - cost[top] + cost[top + 1], (*chosen[:-1], top + 1)))
            heapq.heappush(heap, (total + cost[top + 1], (*chosen, top + 1)))
    out = np.zeros((len(found), last), dtype=np.int64)
    for row, chosen in enumerate(found):
        out[row, list(chosen)] = 1
    return out


def augmented(x: np.ndarray, bound: float, query: bool) -> np.ndarray:
    """Vectors with the component that makes inner products fall as distances rise; queries get 0."""
    more = np.zeros(len(x)) if query else np.sqrt(np.maximum(bound**2 - (x * x).sum(axis=1), 0))
    return np.concatenate([x, more[:, None]], axis=1)


def _name(cells: np.ndarray, index: Index, table: int) -> np.ndarray:
    """One number for each row of bucket coordinates."""
    weights = np.random.default_rng([index.seed, table, 1]).integers(-(1 << 62), 1 << 62, index.hashes) | 1
    with np.errstate(over="ignore"):
        return cells @ weights


def buckets(x: np.ndarray, index: Index, table: int) -> np.ndarray:
    a, b = _functions(index, table)
    return _name(np.floor((augmented(x, index.bound, False) @ a + b) / index.width).astype(np.int64), index, table)


def probed(x: np.ndarray, index: Index, table: int) -> np.ndarray:
    """(queries, probes): the buckets that each query visits, in order."""
    a, b = _functions(index, table)
    at = (augmented(x, index.bound, True) @ a + b) / index.width
    own = np.floor(at)
    below = at - own
    distance = np.concatenate([below, 1 - below], axis=1)
    order = np.argsort(distance, axis=1, kind="stable")
    sets = probe_order(index.hashes, index.probes)
    weights = np.random.default_rng([index.seed, table, 1]).integers(-(1 << 62), 1 << 62, index.hashes) | 1
    with np.errstate(over="ignore"):
        step = np.concatenate([-weights, weights])[order]
        return _name(own.astype(np.int64), index, table)[:, None] + step @ sets.T


def fit(sample: np.ndarray, bound: float, rows: int, tables: int, k: int, seed: int = 7) -> Index:
    """The index for `rows` vectors, fitted on a bounded sample of them.

    The number of functions follows log2(rows), so that buckets stay small. The width follows the usual distance of
    the k-th neighbour within the sample, which is greater than that in the whole; the number of probes is the least
    that finds AIM of the sample's neighbours. Where none does, there are fewer functions, and with the fewest wider
    buckets, until one does.
    """
    x = augmented(sample, bound, False)
    q = augmented(sample[:FIT_QUERIES], bound, True)
    inner = q @ x.T
    inner[np.arange(len(q)), np.arange(len(q))] = -np.inf
    near = np.argsort(-inner, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    apart = np.sqrt(((q[:, None, :] - x[near]) ** 2).sum(axis=2)) if near.size else np.ones((1, 1))
    radius = float(np.median(apart)) or 1.0
    hashes = int(np.clip(round(np.log2(max(rows, 2))), 4, 32))
    cells = max(1, -(-rows // CELL_ROWS))
    index = Index(sample.shape[1], bound, 2.75 * radius, hashes, PROBES[-1], tables, cells, seed)
    if not near.size:
        return index
    while True:
        reached = _reached(sample, near, index)
        enough = next((p for p in PROBES if (reached < p).mean() >= AIM), None)
        if enough:
            return replace(index, probes=enough)
        # buckets as wide as the data hold everything, so this ends
        index = replace(index, hashes=index.hashes - 1) if index.hashes > 4 else replace(index, width=2 * index.width)


def _reached(sample: np.ndarray, near: np.ndarray, index: Index) -> np.ndarray:
    """For each of the first rows and each of its `near` rows, the first probe that finds it in any table."""
    reached = np.full(near.shape, PROBES[-1])
    for table in range(index.tables):
        visits = probed(sample[: len(near)], index, table)
        goal = buckets(sample, index, table)[near]
        for row in range(len(near)):
            hit = visits[row][:, None] == goal[row][None, :]
            reached[row] = np.minimum(reached[row], np.where(hit.any(axis=0), hit.argmax(axis=0), PROBES[-1]))
    return reached


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


ROW = "cell long, salt int, kind int, bucket long, id long, vector {kind}, probes array<long>"


def _batch(cell, salt, kind, bucket, ids, vectors, probes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(salt, pa.int32()), pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), ids, vectors, probes], names=["cell", "salt", "kind", "bucket", "id", "vector", "probes"])


def indexed(nodes: DataFrame, index: Index) -> DataFrame:
    """A row for each vector and table, with its bucket and cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, n = _matrix(batch.column(1)), len(batch)
            none = pa.nulls(n, pa.list_(pa.int64()))
            for table in range(index.tables):
                names = buckets(x, index, table)
                yield _batch(table * index.cells + names % index.cells, np.zeros(n), np.zeros(n), names, batch.column(0), batch.column(1), none)

    return nodes.select("id", "vector").mapInArrow(run, ROW.format(kind=nodes.schema["vector"].dataType.simpleString()))


def probing(queries: DataFrame, index: Index) -> DataFrame:
    """A row for each query and cell that it visits, with the buckets that it visits there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch.column(1))
            for table in range(index.tables):
                visits = probed(x, index, table)
                cell = visits % index.cells
                row = np.repeat(np.arange(len(x)), visits.shape[1])
                order = np.lexsort((cell.ravel(), row))
                row, flat, cells = row[order], visits.ravel()[order], cell.ravel()[order]
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (cells[1:] != cells[:-1])])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(row)].astype(np.int32)), pa.array(flat))
                who = pa.array(row[starts])
                n = len(starts)
                yield _batch(table * index.cells + cells[starts], np.zeros(n), np.ones(n), np.zeros(n), batch.column(0).take(who), batch.column(1).take(who), lists)

    return queries.select("id", "vector").mapInArrow(run, ROW.format(kind=queries.schema["vector"].dataType.simpleString()))


def _best(scores: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the `most` greatest scores of each row, ties to the smaller id; -inf is no score."""
    n, width = scores.shape
    bar = np.full(n, -np.inf)
    if width > 4 * most:
        # the most-th greatest of the maxima of disjoint parts is no greater than the most-th greatest score
        parts = min(width // 2, max(128, 2 * most))
        tops = np.maximum.reduceat(scores, np.arange(parts) * width // parts, axis=1)
        bar = -np.partition(-tops, most - 1, axis=1)[:, most - 1]
    rows, columns = np.nonzero((scores >= bar[:, None]) & (scores > -np.inf))
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    return rows[rank < most], columns[rank < most]


def compared(most: int, everything: bool = False):
    """mapInArrow function over rows (cell, salt, kind, ...) sorted so, vectors first: the best of each query there."""

    def search(ids, x, names, who, q, probes):
        order = np.argsort(names, kind="stable")
        ids, x, names = ids[order], x[order], names[order]
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        known, ends = names[first], np.r_[first[1:], len(names)]
        for at in range(0, len(who), BLOCK):
            some = q[at : at + BLOCK]
            if everything:
                scores = some @ x.T
            else:
                scores = np.full((len(some), len(x)), -np.inf)
                visits = probes[at : at + BLOCK]
                row = np.repeat(np.arange(len(some)), [len(v) for v in visits])
                flat = np.concatenate(visits)
                place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                real = known[place] == flat
                row, place = row[real], place[real]
                order = np.argsort(place, kind="stable")
                row, place = row[order], place[order]
                cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else []
                for a, b in zip(cuts, np.r_[cuts[1:], len(place)] if len(place) else [], strict=True):
                    rows, span = row[a:b], slice(first[place[a]], ends[place[a]])
                    scores[rows, span] = some[rows] @ x[span].T
            rows, columns = _best(scores, ids, most)
            yield pa.RecordBatch.from_arrays([pa.array(who[at + rows]), pa.array(ids[columns]), pa.array(scores[rows, columns])], names=["query_id", "node", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, ready = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.int64)
            change = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for a, b in zip(change, np.r_[change[1:], len(keys)], strict=True):
                part, (c, s, kind) = batch.slice(a, b - a), keys[a]
                if (c, s) != cell:
                    cell, held, ready = (c, s), [], None
                ids, x = part.column(4).to_numpy(zero_copy_only=False), _matrix(part.column(5))
                if kind == 0:
                    held.append((ids, x, part.column(3).to_numpy(zero_copy_only=False)))
                elif held:
                    if ready is None:
                        ready = tuple(np.concatenate(v) for v in zip(*held, strict=True))
                    probes = None if everything else [v.values.to_numpy() for v in part.column(6)]
                    yield from search(*ready, ids, x, probes)

    return run


def _met(rows: DataFrame, most: int, everything: bool = False) -> DataFrame:
    dealt = rows.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    return dealt.mapInArrow(compared(most, everything), "query_id long, node long, score double")


def _salted(vectors: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """Both sides; the vectors of an oversized cell are dealt over parts of it, and its queries visit all of them."""
    crowded = materialize(vectors.groupBy("cell").count().where(F.col("count") > 2 * CELL_ROWS).select("cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("parts")))
    n = crowded.count()
    if n == 0:
        return vectors.unionByName(queries)
    if n <= BROADCAST_CELLS:
        crowded = F.broadcast(crowded)
    names = vectors.columns
    parts = F.coalesce("parts", F.lit(1))
    dealt = vectors.join(crowded, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("id"), parts).cast("int")).select(*names)
    told = queries.join(crowded, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).select(*names)
    return dealt.unionByName(told)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of greatest inner product with each query that the index finds.

    Every row is indexed; queries are the rows where is_query holds. Nearest first, ties to the smaller id; a query's
    own id is no candidate. Ids or vectors that are null, zero vectors and those with null or non-finite components
    take no part. Vectors of a length that fewer rows have take no part either (ties to the longer). Repeated rows
    count once. An id with several vectors is one row whose score is that of its nearest pair of vectors, as a candidate
    and as a query. Equal vectors are searched for as one, of which the k + 1 least ids matter. Queries for which fewer
    than k rows are found are compared with all vectors, in blocks. Extra columns are not read; an empty table gives
    none.
    """
    vector = F.col(vector_col)
    clean = vectors.where(F.col(id_col).isNotNull() & vector.isNotNull()).select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), is_query.alias("q"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    clean = clean.where(finite & F.exists("vector", lambda v: v != 0))
    kind = clean.schema["vector"].dataType.simpleString()
    size = clean.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    result = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return vectors.sparkSession.createDataFrame([], result)
    clean = clean.where(F.size("vector") == size["d"]).groupBy("id", "vector").agg(F.max("q").alias("q"))
    clean = materialize(clean)
    # a row beyond the k + 1 least ids of equal vectors is never among the k nearest
    few = clean.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    least = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("least"), "vector", "ids")
    nodes = materialize(least.withColumn("j", F.row_number().over(Window.partitionBy("least").orderBy("vector")) - 1))
    # nodes are named in the order of their least ids, so that ties among them go to the smaller one
    several = nodes.agg(F.coalesce(F.max("j") + 1, F.lit(1))).first()[0]
    nodes = nodes.select((F.col("least") * several + F.col("j")).alias("id"), "vector", "ids")
    most = (k + 1) * several
    queries = clean.where("q").select("id", "vector")
    told = nodes.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))).alias("most")).first()
    sample = nodes.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector")
    index = fit(np.array([r["vector"] for r in sample.collect()], dtype=np.float64), float(np.sqrt(told["most"])), told["n"], tables, k)
    rows = _salted(indexed(nodes, index), probing(queries, index), index)
    found = materialize(_met(rows, most).groupBy("query_id", "node").agg(F.max("score").alias("score")))

    def ranked(pairs: DataFrame) -> DataFrame:
        each = pairs.join(nodes.select(F.col("id").alias("node"), "ids"), "node").select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id")
        if several > 1:
            each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    best = ranked(_top(found, most))
    best = materialize(best)
    counted = best.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = materialize(queries.join(counted, "id", "left_anti"))
    if short.isEmpty():
        return best
    blocks = max(1, -(-told["n"] // CELL_ROWS))
    none = F.lit(None).cast("array<long>")
    one = nodes.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("cell"), F.lit(0).alias("salt"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("bucket"), "id", F.col("vector").cast(kind).alias("vector"), none.alias("probes"))
    other = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("cell"), F.lit(0).alias("salt"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("bucket"), "id", F.col("vector").cast(kind).alias("vector"), none.alias("probes"))
    exact = ranked(_top(_met(one.unionByName(other), most, everything=True).groupBy("query_id", "node").agg(F.max("score").alias("score")), most))
    return best.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(exact)


def _top(pairs: DataFrame, most: int) -> DataFrame:
    """The best `most` nodes of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return pairs.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")
