"""Spelling variants: each word's near words (one code point apart) by a trie self-join with active-node sets.

Two words one edit apart share what stands before the edit and what stands after it. So the vocabulary's trie is dealt
by beginnings: words with the same first half meet, and those with the same last half, whichever half the edit is in.
A part that holds too many words is cut again within the half in question, until the edit's place is known. In each
part a task builds the trie of what its words do not share and walks down it; every node carries its active nodes,
those whose strings are one edit from its own, which follow from its parent's. Where a word ends, the words that end at
its active nodes are near.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Fixed by the task: code points and occurrences of a word at least, the divisor, and how much more frequent a form is.
LEAST, OCCURS, EVERY, TIMES = 5, 3, 97, 2
#: Whole runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, from LEAST bytes on (fewer make no word).
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf]){5,}")

#: Counts that a task holds before it hands them on, and bytes from which a text's runs are taken one by one.
ENTRIES, LONG = 400_000, 1 << 20
#: Words of a part beyond which it is cut again.
PART_WORDS = 50_000


def misspelt(doc: bytes, runs: Counter) -> Counter:
    """The runs of one document, lowered, with the code point deleted that the task's rule names in one of 97."""
    start, crc32 = zlib.crc32(doc + b":"), zlib.crc32
    changed = [(run, h) for run in runs if not (h := crc32(run, start)) % EVERY]
    moved = [(run.decode(), h, runs.pop(run)) for run, h in changed]
    for word, h, n in moved:
        at = h % len(word)
        runs[(word[:at] + word[at + 1 :]).encode()] += n
    return runs


def run_counts(docs: DataFrame) -> DataFrame:
    """(word, n): counts of docs (id, text), summed within each task."""

    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes().lower()
                found = RUN.findall(raw) if len(raw) < LONG else (m[0] for m in RUN.finditer(raw))
                counts.update(misspelt(doc.encode(), Counter(found)))
                if len(counts) > ENTRIES:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    return docs.mapInArrow(run, "word string, n long")


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    given = docs.select(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = run_counts(given).where(F.length("word") >= LEAST).groupBy("word").agg(F.sum("n").alias("n"))
    return words.where(F.col("n") >= OCCURS)


class Trie:
    """Distinct strings by their code points. A node with one string below it is not opened: a position in it is told by
    how much of the string is read."""

    def __init__(self, strings: list[str]):
        """strings: sorted by code points."""
        self.strings = strings
        self.kids: list[dict[str, int] | None] = []
        self.ends: list[int] = []
        self.only: list[int] = []
        todo = [(0, len(strings), 0, None, "")]
        while todo:
            low, high, depth, up, char = todo.pop()
            node = len(self.kids)
            if up is not None:
                up[char] = node
            if high - low == 1:
                self.kids.append(None)
                self.ends.append(-1)
                self.only.append(low)
                continue
            kids: dict[str, int] = {}
            first = low + (len(strings[low]) == depth)
            self.kids.append(kids)
            self.ends.append(low if first > low else -1)
            self.only.append(-1)
            while first < high:
                char, last = strings[first][depth], first + 1
                while last < high and strings[last][depth] == char:
                    last += 1
                todo.append((first, last, depth + 1, kids, char))
                first = last

    def below(self, node: int, depth: int) -> list[tuple[int, int]]:
        kids = self.kids[node]
        if kids is None:
            return [(node, depth + 1)] if depth < len(self.strings[self.only[node]]) else []
        return [(k, depth + 1) for k in kids.values()]

    def step(self, node: int, depth: int, char: str) -> tuple[int, int] | None:
        kids = self.kids[node]
        if kids is None:
            return (node, depth + 1) if self.strings[self.only[node]][depth : depth + 1] == char else None
        to = kids.get(char)
        return None if to is None else (to, depth + 1)

    def end(self, node: int, depth: int) -> int:
        """The string that ends at this position, or -1."""
        if self.kids[node] is None:
            own = self.only[node]
            return own if len(self.strings[own]) == depth else -1
        return self.ends[node]

    def read(self, node: int, depth: int, rest: str) -> int:
        """The string that ends after `rest` from this position on, or -1."""
        for at, char in enumerate(rest):
            kids = self.kids[node]
            if kids is None:
                own = self.only[node]
                return own if self.strings[own][depth + at :] == rest[at:] else -1
            node = kids.get(char, -1)
            if node < 0:
                return -1
        return self.end(node, depth + len(rest))

    def near(self) -> Iterator[tuple[int, list[int]]]:
        """(string, the strings one edit from it), for those that have any."""
        if self.kids[0] is None:
            return
        todo: list[tuple[int, int, set]] = [(0, 0, set())]
        if self.ends[0] >= 0:
            found = [e for k in self.below(0, 0) if (e := self.end(*k)) >= 0]
            if found:
                yield self.ends[0], found
        while todo:
            node, depth, active = todo.pop()
            kids = self.kids[node]
            for char, kid in kids.items():
                now = {(node, depth)}  # the last code point deleted
                for v in active:
                    if (to := self.step(*v, char)) is not None:
                        now.add(to)
                for other, sister in kids.items():
                    if other != char:
                        now.add((sister, depth + 1))  # replaced
                        if (to := self.step(sister, depth + 1, char)) is not None:
                            now.add(to)  # one inserted before it
                own = self.only[kid]
                if own >= 0:
                    rest = self.strings[own][depth + 1 :]
                    found = [e for v in now if (e := self.read(*v, rest)) >= 0]
                    if found:
                        yield own, list(set(found))
                    continue
                now.update(self.below(kid, depth + 1))  # one inserted after it
                own = self.ends[kid]
                if own >= 0:
                    found = [e for v in now if (e := self.end(*v)) >= 0]
                    if found:
                        yield own, found
                todo.append((kid, depth + 1, now))


def near_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function over rows (key, word, n) sorted by key and word: (word, n_near, form, form_n) of each part, the
    form being the part's most frequent near word of the word.

    A part's key tells the length m of a pair's shorter word and the places from low to high that the edit is in. Where
    an insertion has several places, the last one counts, so a pair is counted in one part only.
    """
    told: list[list] = [[] for _ in range(4)]

    def rows(batch):
        return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)

    def every():
        for batch in batches:
            yield from rows(batch)

    def handed():
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(told, kinds, strict=True)], names=["word", "n_near", "form", "form_n"])
        for v in told:
            v.clear()
        return out

    for key, part in groupby(every(), itemgetter(0)):
        part = list(part)
        if len(part) < 2:
            continue
        m, low, high = map(int, key.split(" ", 3)[:3])
        words, counts = [r[1] for r in part], [r[2] for r in part]
        tail = m - high
        middles = [w[low : len(w) - tail] for w in words]
        order = sorted(range(len(middles)), key=middles.__getitem__)
        for i, others in Trie([middles[i] for i in order]).near():
            word = words[order[i]]
            real = []
            for j in others:
                j = order[j]
                other = words[j]
                if len(word) == len(other):
                    if len(word) == m:
                        real.append(j)
                elif high == m or word[:high] != other[:high]:
                    real.append(j)
            if real:
                best = min(real, key=lambda j: (-counts[j], words[j]))
                for column, v in zip(told, (word, len(real), words[best], counts[best]), strict=True):
                    column.append(v)
        if len(told[0]) > 10_000:
            yield handed()
    yield handed()


def _keyed(rows: DataFrame, places: Column) -> DataFrame:
    """rows (word, n) with a row for each place (m, low, high): key, m, low, high."""
    each = rows.select("word", "n", F.explode(places).alias("at")).select("word", "n", "at.*")
    tail = F.expr("right(word, m - high)")
    return each.withColumn("key", F.concat_ws(" ", "m", "low", "high", F.expr("left(word, low)"), tail))


def _place(m: Column, low: Column, high: Column) -> Column:
    return F.struct(m.cast("int").alias("m"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def parts(words: DataFrame, most: int) -> DataFrame:
    """(key, word, n): the parts that the words meet in, of up to `most` words unless the edit has one place only."""
    length, none = F.length("word"), F.lit(0)

    def halves(m: Column) -> list[Column]:
        return [_place(m, none, F.floor(m / 2)), _place(m, F.floor(m / 2), m)]

    # a word is the shorter one of a pair, or one longer than that
    places = F.when(length > LEAST, F.array(*halves(length), *halves(length - 1))).otherwise(F.array(*halves(length)))
    rows, settled = _keyed(words, places), None
    while True:
        crowded = rows.groupBy("key", "m", "low", "high").count().where((F.col("count") > most) & (F.col("high") - F.col("low") > 1))
        crowded = materialize(crowded.select("key"))
        if crowded.isEmpty():
            return rows.select("key", "word", "n") if settled is None else settled.unionByName(rows.select("key", "word", "n"))
        calm = rows.join(crowded, "key", "left_anti").select("key", "word", "n")
        settled = materialize(calm if settled is None else settled.unionByName(calm))
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        again = rows.join(crowded, "key", "left_semi").select("word", "n", F.array(_place(F.col("m"), F.col("low"), middle), _place(F.col("m"), middle, F.col("high"))).alias("places"))
        rows = _keyed(materialize(again), F.col("places"))


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the last word that the forms lead to. A form is more frequent than its word, so
    they end; each round doubles the steps."""
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = further.drop("moved")
        if further.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = PART_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word that occurs often enough.

    form is the most frequent near word (of equals the first by code points) if it occurs at least twice as often, else
    null; root is where the forms lead, the word itself without one. n_near counts all near words.

    A null text has no words; a null id counts as an empty one. Repeated rows count again, texts and words of any
    length are read whole. Other columns are not read; an empty table gives none.
    """
    words = materialize(vocabulary(docs, id_col, text_col))
    dealt = parts(words, most).repartition("key").sortWithinPartitions("key", "word")
    met = dealt.mapInArrow(near_counts, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("form")))
    near = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    often = -F.col("best.m") >= TIMES * F.col("n")
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n"))
    told = materialize(told)
    roots = followed(told.where("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
