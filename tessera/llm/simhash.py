"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints are cut into fewer segments than a plain block index needs, so few that in two near fingerprints some
segment differs by at most one bit. Each segment is indexed once for each of its bits with that bit blanked (a
one-wildcard variant); equal variants meet in one group and are verified on the whole fingerprint. Groups hand on a
spanning forest and not all their pairs, so that what leaves a group is never more than what came in.

Where the texts decide and the bits only screen (near_duplicate_groups), the forests' trees are families, within which
every pair that is not joined yet is counted on the sets of shingles; only verified links leave a family, again as a
forest.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
_UPPER = re.compile("[A-Z]+")

#: Odd multipliers that turn one 64-bit hash into further ones (powers of the golden-ratio constant of splitmix64).
GOLDEN = 0x9E3779B97F4A7C15

#: Shingles hashed at a time, so that a very long text needs no more memory than a usual one.
CHUNK = 1 << 15


def words(text: str) -> list[str]:
    """Words of the text with A-Z lowered; all other characters stay as they are."""
    text = text.lower() if text.isascii() else _UPPER.sub(lambda m: m[0].lower(), text)
    return WORD.findall(text)


def shingles(found: Sequence[str], n: int) -> Iterator[str]:
    """The n-word shingles, repeats included; the whole sequence where it has fewer words."""
    if len(found) < n:
        return iter([" ".join(found)] if found else [])
    return map(" ".join, zip(*(found[i:] for i in range(n)), strict=False))


def hashes(text: str, n: int) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, 42) for s in shingles(words(text), n)), dtype=np.uint64)


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 without hashes."""
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), CHUNK):
        part = np.ascontiguousarray(h[at : at + CHUNK])
        count += np.add.reduce(np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(GOLDEN * k % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, planes: int = 1, distinct: bool = False) -> DataFrame:
    """(id, text_key, words array<long>, node, n_hashes): `planes` 64-bit SimHash fingerprints of each text's shingles.

    A null text counts as empty; a text without words has fingerprint 0. Long texts are hashed whole. With
    `distinct`, repeats of a shingle count once, text_key is a hash of the text, node one of its set of shingles (64
    bits of an MD5) and n_hashes the set's size; else these are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, nodes, sizes = [], [], []
            for value in batch.column(1):
                h = hashes(value.as_py() or "", ngram)
                if distinct:
                    h = np.unique(h)
                    nodes.append(int.from_bytes(hashlib.md5(h.tobytes()).digest()[:8], "little", signed=True))
                    sizes.append(len(h))
                prints.append([majority(remixed(h, k)) for k in range(planes)])
            flat = np.array(prints, dtype=np.uint64).reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1, dtype=np.int32) * planes), pa.array(flat))
            more = [pa.array(x, pa.int64()) if distinct else pa.nulls(len(batch), pa.int64()) for x in (nodes, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists, *more], names=["id", "text_key", "words", "node", "n_hashes"])

    text = F.col(text_col).cast("string")
    key = text_key(text) if distinct else F.lit(None).cast("long")
    out = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), key.alias("text_key"))
    return out.mapInArrow(run, "id long, text_key long, words array<long>, node long, n_hashes long")


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart; a null one is named like an empty one."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def variants(word_col: Column, layout: Sequence[tuple[int, int, int]]) -> Column:
    """Array of one-wildcard keys. layout: (which word, shift, bits up to 32) of each segment.

    A key holds the number of its segment and blanked bit above the 32 bits of the masked segment.
    """
    keys, number = [], 0
    for which, shift, bits in layout:
        segment = F.shiftrightunsigned(word_col[which], shift)
        for bit in range(bits):
            mask = ((1 << bits) - 1) & ~(1 << bit)
            keys.append(segment.bitwiseAND(F.lit(mask)).bitwiseOR(F.lit(number << 32)))
            number += 1
    return F.array(*keys)


def _spanning(check: np.ndarray, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the rows whose check words differ by at most `most` bits."""
    left, a, b = np.arange(len(node)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            found = []
            for at in range(0, len(front), 64):
                some = front[at : at + 64]
                near = np.bitwise_count(check[left][None, :] ^ check[some][:, None]) <= most
                hit = near.any(axis=0)
                if hit.any():
                    a.append(node[some[near.argmax(axis=0)[hit]]])
                    b.append(node[left[hit]])
                    found.append(left[hit])
                    left = left[~hit]
                if not len(left):
                    break
            front = np.concatenate(found) if found else front[:0]
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def group_links(most: int, limit: int | None, small: int = 12):
    """mapInArrow function over rows (key, node, check) sorted by key: (a, b, kind) with a < b.

    kind 0: an edge. Groups of up to `small` rows give all verified pairs, larger ones a spanning forest; either way
    all that is connected within a group stays connected, since what is verified here is what decides.
    kind 1: a member (b: check) of a group beyond `limit`, for another pass.
    """

    def edges(key, node, check):
        a, b, over_node, over_check = [], [], [], []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        big = np.repeat(sizes > small, sizes)
        for step in range(1, small):
            if step >= len(key):
                break
            at = np.flatnonzero((key[step:] == key[:-step]) & ~big[step:])
            if not len(at):
                break
            at = at[np.bitwise_count(check[at] ^ check[at + step]) <= most]
            a.append(node[at])
            b.append(node[at + step])
        for at in np.flatnonzero(sizes > small):
            rows = slice(starts[at], starts[at] + sizes[at])
            if limit is not None and sizes[at] > limit:
                over_node.append(node[rows])
                over_check.append(check[rows])
                continue
            x, y = _spanning(check[rows], node[rows], most)
            a.append(x)
            b.append(y)
        return a, b, over_node, over_check

    def batch_of(a, b, over_node, over_check):
        pairs = np.zeros((0, 2), dtype=np.int64)
        if a:
            x, y = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        members = np.zeros((0, 2), dtype=np.int64)
        if over_node:
            members = np.unique(np.stack([np.concatenate(over_node), np.concatenate(over_check).view(np.int64)], axis=1), axis=0)
        both = np.concatenate([pairs, members])
        kind = np.repeat(np.arange(2, dtype=np.int32), [len(pairs), len(members)])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1])), pa.array(kind)], names=["a", "b", "kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        key = node = check = none
        over = None  # the key whose group is already known to be beyond the limit
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            key, node, check = (np.concatenate(x) for x in zip((key, node, check), new, strict=True))
            if not len(key):
                continue
            if over is not None:
                end = np.searchsorted(key, over, side="right")
                if end:
                    yield batch_of([], [], [node[:end]], [check[:end].view(np.uint64)])
                    key, node, check = key[end:], node[end:], check[end:]
                if len(key):
                    over = None
                else:
                    continue
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                yield batch_of(*edges(key[:cut], node[:cut], check[:cut].view(np.uint64)))
                key, node, check = key[cut:], node[cut:], check[cut:]
            if limit is not None and len(key) > limit:
                over = key[0]
                yield batch_of([], [], [node], [check.view(np.uint64)])
                key = node = check = none
        if len(key):
            yield batch_of(*edges(key, node, check.view(np.uint64)))

    return run


def _met(keyed: DataFrame, most: int, limit: int | None) -> DataFrame:
    """Rows (key, node, check) brought together by key and linked within each group."""
    dealt = keyed.select("key", "node", "check").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(group_links(most, limit), "a long, b long, kind int")


def near_links(prints: DataFrame, layout: Sequence[tuple[int, int, int]], most: int, limit: int = 1 << 14) -> DataFrame:
    """Edges (a, b) that connect what is connected by steps of at most `most` (up to 3) differing bits in `check`.

    prints: (node, words array<long>, check long), one row for each distinct fingerprint. Groups of more than `limit`
    rows under one key are handled by a second, finer pass: for up to 2 bits by keys with both bits blanked, under
    which at most four fingerprints meet; beyond that by one-wildcard variants of eighths of `check`.
    """
    keyed = prints.select(F.explode(variants(F.col("words"), layout)).alias("key"), "node", "check")
    found = materialize(_met(keyed, most, limit))
    edges = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select(F.col("a").alias("node"), F.col("b").alias("check")).distinct()
    if most <= 2:
        masks = [(1 << i) | (1 << j) for i in range(64) for j in range(i + 1)] if most == 2 else [1 << i for i in range(64)] if most == 1 else [0]
        signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
        finer = hot.select("node", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: F.struct(m.alias("mask"), F.col("check").bitwiseAND(F.bitwise_not(m)).alias("rest")))).alias("key"))
        star = finer.groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("all")).where(F.size("all") > 1)
        more = star.select(F.element_at("all", 1).alias("a"), F.explode(F.slice("all", 2, 4)).alias("b"))
    else:
        eighths = [(0, 8 * i, 8) for i in range(8)]
        # bit 48 keeps these keys apart from the first pass's
        keys = F.transform(variants(F.array("check"), eighths), lambda k: k.bitwiseOR(F.lit(1 << 48)))
        finer = hot.select(F.explode(keys).alias("key"), "node", "check")
        more = _met(finer, most, None).select("a", "b")
    # without oversized groups the finer pass would only add empty jobs
    return edges if hot.isEmpty() else edges.unionByName(more)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, most: int = 2, limit: int = 1 << 14) -> DataFrame:
    """(doc_id, fingerprint hex, component_id): components of the documents under `most` differing bits.

    Repeated ids keep their rows; rows with equal texts share everything. component_id is the least id that is
    reachable. Rows with a null id take part in no component and keep a null one. A null text counts as empty, texts of
    any length are hashed whole. Extra columns are not read; an empty table gives none.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments of 32 bits find up to 3 differing bits")
    prints = materialize(fingerprints(docs, id_col, text_col, ngram).select("id", F.col("words")[0].alias("fp")))
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("node")).where("node is not null"))
    given = nodes.select("node", F.array("fp").alias("words"), F.col("fp").alias("check"))
    joined = materialize(components(near_links(given, [(0, 0, 32), (0, 32, 32)], most, limit)))
    named = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = prints.join(materialize(named), "fp", "left")
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"),
    )


#: Probability that a pair just at the similarity asked for meets under some variant; sets the number of planes.
MEET = 0.975
#: Differing bits in two further planes up to which a pair that met is of one family. A pair at similarity 0.8 is
#: expected to differ in 19 and is within with probability 0.995.
SCREEN = 30
#: Rows of a family that are compared with each other in one task, and hashes in their sets.
PART_ROWS, PART_HASHES = 2048, 1 << 22


def share_of_bits(similarity: float) -> float:
    """Share of differing SimHash bits to expect of two equally large sets with this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def segment_layout(rows: int, similarity: float) -> list[tuple[int, int, int]]:
    """Segments of so many planes that a pair at `similarity` meets under some variant with probability MEET.

    A plane is cut into 4, 3 or 2 segments, so wide that of `rows` random fingerprints about a thousand share a
    variant.
    """
    cuts = next(c for c in (4, 3, 2) if c == 2 or rows <= 1 << (64 // c + 9))
    bits, p = 64 // cuts, share_of_bits(similarity)
    one = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    planes = max(1, math.ceil(math.log(1 - MEET) / math.log(1 - one) / cuts)) if one < 1 else 1
    return [(plane, bits * i, bits) for plane in range(planes) for i in range(cuts)]


def segment_keys(word_col: Column, layout: Sequence[tuple[int, int, int]]) -> Column:
    """Array of the whole segments as keys, the segment's number above its bits."""
    return F.array(*(F.shiftrightunsigned(word_col[which], shift).bitwiseAND(F.lit((1 << bits) - 1)).bitwiseOR(F.lit(i << 32)) for i, (which, shift, bits) in enumerate(layout)))


class Forest:
    """Which groups are joined already, among those that this task has handed on edges of."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def joins(self, a: int, b: int) -> bool:
        """Joins a and b; false if they were."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Entries of a task's Forest; beyond it a new one is begun, which may hand on an edge again.
FOREST = 1 << 20


#: Rows under one key that one task compares; those of a key beyond it are dealt over tasks by pairs of parts.
HOT_ROWS = 1 << 14

SCREENED = "a long, b long, one long, two long, kind int"


def screened(most: int, limit: int | None, small: int = 32):
    """mapInArrow function over rows (key, known, one, two) sorted by key: SCREENED.

    kind 0: an edge (a, b) between `known`. Rows of one key whose check words one and two differ in at most `most` bits
    are of one family. The edges join all families of each key; edges that this task's earlier ones imply are left out.
    kind 1: a row (a: key, b: known, one, two) of a key with more than `limit` rows, for another pass.
    """

    def near(one, two, a, b):
        return np.bitwise_count(one[a] ^ one[b]) + np.bitwise_count(two[a] ^ two[b]) <= most

    def large(known, one, two):
        """(known, known) of a forest of one group, in blocks."""
        _, of = np.unique(known, return_inverse=True)
        for at in range(0, len(known), 64):
            block = slice(at, at + 64)
            ok = (of[block, None] != of[None, :]) & (np.arange(at, at + len(of[block]))[:, None] < np.arange(len(of))[None, :])
            if not ok.any():
                continue
            ok &= np.bitwise_count(one[block, None] ^ one[None, :]) + np.bitwise_count(two[block, None] ^ two[None, :]) <= most
            for row in np.flatnonzero(ok.any(axis=1)):
                others = np.flatnonzero(ok[row])
                others = others[of[others] != of[at + row]]
                for label, first in zip(*np.unique(of[others], return_index=True), strict=True):
                    yield known[at + row], known[others[first]]
                    of[of == label] = of[at + row]

    def edges(key, known, one, two, forest):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        big = np.repeat(sizes > small, sizes)
        pairs = []
        for step in range(1, small):
            if step >= len(key):
                break
            at = np.flatnonzero((key[step:] == key[:-step]) & ~big[step:])
            if not len(at):
                break
            at = at[known[at] != known[at + step]]
            at = at[near(one, two, at, at + step)]
            pairs.extend(zip(known[at].tolist(), known[at + step].tolist(), strict=True))
        for at in np.flatnonzero(sizes > small):
            rows = slice(starts[at], starts[at] + sizes[at])
            if (known[rows] != known[starts[at]]).any():
                pairs.extend((int(x), int(y)) for x, y in large(known[rows], one[rows], two[rows]))
        new = np.array([p for p in pairs if forest.joins(*p)], dtype=np.int64).reshape(-1, 2)
        none = pa.nulls(len(new), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(new[:, i])) for i in range(2)), none, none, pa.array(np.zeros(len(new), dtype=np.int32))], names=["a", "b", "one", "two", "kind"])

    def rest(rows):
        return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(np.ones(len(rows[0]), dtype=np.int32))], names=["a", "b", "one", "two", "kind"])

    def told(rows, forest):
        """The edges within whole groups, and the rows of those beyond the limit."""
        key = rows[0]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        over = np.repeat(sizes > (len(key) if limit is None else limit), sizes)
        if over.any():
            yield rest([x[over] for x in rows])
            rows = [x[~over] for x in rows]
        if len(rows[0]):
            key, known, one, two = rows
            yield edges(key, known, one.view(np.uint64), two.view(np.uint64), forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, n, over = Forest(), [], 0, None  # over: a key that is known to be beyond the limit
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "known", "one", "two")]
            if over is not None and len(batch):
                end = int(np.searchsorted(rows[0], over, side="right"))
                if end:
                    yield rest([x[:end] for x in rows])
                    rows = [x[end:] for x in rows]
            if not len(rows[0]):
                continue
            over = None
            if held and held[-1][0][-1] != rows[0][-1] or not held and rows[0][0] != rows[0][-1]:
                # what was held ends within this batch
                whole = [np.concatenate(x) for x in zip(*held, rows, strict=True)]
                cut = int(np.searchsorted(whole[0], whole[0][-1], side="left"))
                yield from told([x[:cut] for x in whole], forest)
                held, n = [[x[cut:] for x in whole]], len(whole[0]) - cut
            else:
                held.append(rows)
                n += len(rows[0])
            if limit is not None and n > limit and held[0][0][0] == held[-1][0][-1]:
                over = held[-1][0][-1]
                for part in held:
                    yield rest(part)
                held, n = [], 0
            if len(forest.up) > FOREST:
                forest = Forest()
        if held:
            yield from told([np.concatenate(x) for x in zip(*held, strict=True)], forest)

    return run


def _screened(dealt: DataFrame, most: int, limit: int) -> DataFrame:
    """Edges (a, b) of dealt (key, known, one, two). The rows of a key beyond the limit are dealt to parts of that size at
    most, on average, and every pair of parts meets in a cell of its own."""

    def met(rows: DataFrame, most_rows: int | None) -> DataFrame:
        return rows.select("key", "known", "one", "two").repartition("key").sortWithinPartitions("key", "known").mapInArrow(screened(most, most_rows), SCREENED)

    found = materialize(met(dealt, limit))
    edges = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("known"), "one", "two")
    if hot.isEmpty():
        return edges
    # rows of one family have nothing to find
    parts = materialize(hot.groupBy("key").agg(F.ceil(F.count("*") / limit).cast("int").alias("parts"), F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi").select("key", "parts"))
    placed = hot.join(few(parts), "key").withColumn("part", F.pmod(F.xxhash64("known", "one", "two"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = placed.withColumn("other", other).select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "known", "one", "two")
    return edges.unionByName(materialize(met(cells, None)).select("a", "b"))


def verified(similarity: float):
    """mapInArrow function over rows (family, i, j, part, node, known, hashes) sorted by family, i, j: edges (a, b)
    between `known` whose sets of shingles have the Jaccard similarity or more.

    A cell's rows are the parts i and j of a family. Every pair of different parts, or of the one part if i = j, is
    counted exactly unless what was found before joins it already, so the edges are a forest that loses no link.
    """

    def linked(cross, part, known, sets):
        size = np.array([len(s) for s in sets])
        starts = np.r_[0, np.cumsum(size)]
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        _, of = np.unique(known, return_inverse=True)
        mine = np.zeros(int(column.max(initial=-1)) + 1, dtype=np.uint8)
        for i in range(len(sets) - 1):
            after = np.flatnonzero((of[i + 1 :] != of[i]) & (size[i + 1 :] >= similarity * size[i]) & (size[i] >= similarity * size[i + 1 :])) + i + 1
            if cross:
                after = after[part[after] != part[i]]
            if not len(after) or not size[i]:
                continue
            mine[column[starts[i] : starts[i + 1]]] = 1
            for at in range(0, len(after), 256):
                some = after[at : at + 256]
                some = some[of[some] != of[i]]
                if not len(some):
                    continue
                ends = np.cumsum(size[some])
                places = np.arange(ends[-1]) + np.repeat(starts[some] - ends + size[some], size[some])
                both = np.add.reduceat(mine[column[places]], ends - size[some], dtype=np.int64)
                ok = some[both >= similarity * (size[i] + size[some] - both)]
                for label, first in zip(*np.unique(of[ok], return_index=True), strict=True):
                    yield known[i], known[ok[first]]
                    of[of == label] = of[i]
            mine[column[starts[i] : starts[i + 1]]] = 0

    def cell(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        i, j, part, known = (whole.column(c).to_numpy() for c in ("i", "j", "part", "known"))
        sets = [np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in whole.column("hashes")]
        found = np.array([(int(a), int(b)) for a, b in linked(i[0] != j[0], part, known, sets)], dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, c])) for c in range(2)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not len(batch):
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("family", "i", "j")], axis=1)
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for a, b in zip(starts, np.r_[starts[1:], len(keys)], strict=True):
                if held and tuple(keys[a]) != now:
                    yield cell(held)
                    held = []
                now = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield cell(held)

    return run


def _joined(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """nodes with the column `name` replaced by its component under edges (a, b) between its values."""
    found = materialize(components(edges).select(F.col("node").alias(name), F.col("component").alias("_to")))
    return nodes.join(few(found), name, "left").withColumn(name, F.coalesce("_to", name)).drop("_to")


def families(prints: DataFrame, layout: Sequence[tuple[int, int, int]]) -> DataFrame:
    """(node, family) for prints (node, words), whose last two words check what the layout's segments bring together.

    First whole segments meet, then one-wildcard variants, between the families of the first only.
    """
    last = max(which for which, _, _ in layout)
    named = prints.select("node", "words", F.col("node").alias("family"))
    for keys in (segment_keys, variants):
        dealt = named.select(F.explode(keys(F.col("words"), layout)).alias("key"), "node", F.col("family").alias("known"), F.col("words")[last + 1].alias("one"), F.col("words")[last + 2].alias("two"))
        named = materialize(_joined(named, _screened(dealt, SCREEN, HOT_ROWS), "family"))
    return named.select("node", "family")


#: Rows of two numbers up to which the documents' side of a join stays where it is and these are broadcast.
BROADCAST_ROWS = 2_000_000


def few(rows: DataFrame) -> DataFrame:
    """The written table, to be broadcast if its size is within the bound."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _sets(members: DataFrame, source: DataFrame, ngram: int) -> DataFrame:
    """members (node, family, parts, id, text_key) with hashes, the sorted shingle hashes as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(hashes(t.as_py() or "", ngram)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "family", "parts")), pa.array(sets, pa.binary())], names=["node", "family", "parts", "hashes"])

    texts = source.withColumn("text_key", text_key(F.col("text"))).join(few(members), ["id", "text_key"])
    return texts.select("node", "family", "parts", "text").mapInArrow(run, "node long, family long, parts int, hashes binary")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, text_key, copies, group, first): documents that reach each other by steps of Jaccard similarity
    `similarity` or more have one group; of each, the least id (of equal ids the least text_key) has `first`.

    A row for each id and text that differ: `copies` repeated rows are one document, an id with two texts is two.
    Texts with equal sets of shingles are one node from the start, named by 64 bits of their hash. Families are found
    by the bits, links within them by exact counts on the whole texts' sets, whatever a family's size: first in each
    part of a family, then between parts that are not one yet. A pair at the similarity itself is in one family with
    probability MEET times 0.995, nearer ones with more. Rows with a null id are in no group; a null text is an empty
    one, texts of any length are read whole. Extra columns are not read; an empty table gives none.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    layout = segment_layout(source.count(), similarity)
    planes = layout[-1][0] + 3
    prints = materialize(fingerprints(source, "id", "text", ngram, planes, distinct=True))
    nodes = materialize(prints.groupBy("node").agg(F.min(F.struct("id", "text_key")).alias("m"), F.first("words").alias("words"), F.first("n_hashes").alias("n_hashes")).select("node", "m.id", "m.text_key", "n_hashes", "words"))
    found = families(nodes, layout)
    named = materialize(found.join(nodes.select("node", "id", "text_key", "n_hashes"), "node"))
    whole = named.groupBy("family").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / PART_ROWS), F.ceil(F.sum("n_hashes") / PART_HASHES)).cast("int").alias("parts")).where("n > 1").drop("n")
    members = materialize(named.join(whole, "family").select("node", "family", "parts", "id", "text_key"))
    # rows that repeat give equal sets
    sets = materialize(_sets(members, source, ngram))
    dealt = sets.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))

    def links(rows: DataFrame) -> DataFrame:
        met = rows.select("family", "i", "j", "part", "known", "hashes").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "part", "known")
        return materialize(met.mapInArrow(verified(similarity), "a long, b long"))

    known = members.select("node", "family", "parts", F.col("node").alias("group"))
    known = materialize(_joined(known, links(dealt.select("*", F.col("part").alias("i"), F.col("part").alias("j"), F.col("node").alias("known"))), "group"))
    apart = materialize(known.where("parts > 1").groupBy("family").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("family"))
    if not apart.isEmpty():
        others = F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != F.col("part")), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
        wide = dealt.join(few(apart), "family").join(few(materialize(known.where("parts > 1").select("node", F.col("group").alias("known")))), "node").withColumn("c", F.explode(others))
        known = materialize(_joined(known, links(wide.select("*", "c.i", "c.j")), "group"))
    joined = few(materialize(known.where("node <> group").select("node", "group")))
    rows = prints.groupBy("id", "text_key", "node").agg(F.count("*").alias("copies"))
    told = materialize(rows.join(joined, "node", "left").select("id", "text_key", "copies", F.coalesce("group", "node").alias("group")))
    first = told.groupBy("group").agg(F.min(F.struct("id", "text_key")).alias("m"))
    return told.join(first, "group").select("id", "text_key", "copies", "group", (F.struct("id", "text_key") == F.col("m")).alias("first"))
