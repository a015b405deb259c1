"""Language-model scores of whole documents: a unigram base, and a recurrent network trained on the corpus by rounds.

Words are counted over all training documents. In each round every task trains its share of the documents from the
common parameters, and the tasks' parameters are averaged by the words that they have read; each training document is
read in one round. Scoring carries the state through all of a document. What travels to every task has a fixed bound:
the network and the counts of the most frequent words. Counts of the others are joined.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_dir
from tessera.llm.recurrent import Network, Trainer, scored

#: Words in UTF-8, and the token that ends a document (no word holds white space).
WORD, END = re.compile(rb"[^\x20\x09-\x0d]+"), b"\n"
#: Words with an output of their own, and words whose counts every task holds; those seen once are never among them.
HEAD, KNOWN = 4096, 1 << 18
#: Rounds of training, words of a task's stretch, parameters in a row of the averaging.
ROUNDS, STRETCH, BLOCK = 4, 1 << 22, 2048
#: Words that a task counts before it hands them on, and bytes from which a text's words are taken one by one.
ENTRIES, LONG = 400_000, 1 << 20


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def words(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text with A-Z lowered, in lists of bounded length."""
    raw = raw.lower()
    if len(raw) < LONG:
        yield WORD.findall(raw)
        return
    some = []
    for m in WORD.finditer(raw):
        some.append(m[0])
        if len(some) >= LONG:
            yield some
            some = []
    yield some


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n): counts of docs (text), with one END a document, summed within each task."""

    def handed(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                for some in words(text.as_buffer().to_pybytes()):
                    counts.update(some)
                if len(counts) > ENTRIES:
                    yield handed(counts)
                    counts = Counter()
            counts[END] += len(batch)
        yield handed(counts)

    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


@dataclass
class Vocabulary:
    """total training tokens, kinds of them; known: words with their counts, falling, of which the first `head` have
    outputs; seldom, rare: tokens of the other known words and of all further ones; rare_kinds: how many those are."""

    total: int
    kinds: int
    known: list[bytes]
    counts: np.ndarray
    head: int

    def __post_init__(self):
        self.end = self.known.index(END)
        self.seldom = int(self.counts[self.head :].sum())
        self.rare = self.total - int(self.counts.sum())
        self.rare_kinds = self.kinds - int((self.counts > 0).sum())


def counted(counts: DataFrame, head: int = HEAD, known: int = KNOWN) -> Vocabulary:
    """The vocabulary of counts (word, n). Known are the words from such a count on that they are at most `known`; END always
    has an output. A histogram of counts, of some hundred rows, decides before any word reaches the driver."""
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    band = F.floor(F.log2("n") * 8)
    told = counts.where("n >= 2").groupBy(band.alias("band")).agg(F.count("*").alias("words")).collect()
    least, held = math.inf, 0
    for r in sorted(told, key=lambda r: -r["band"]):
        held += r["words"]
        if held > known:
            break
        least = r["band"]
    top = counts.where((band >= F.lit(float(least))) | (F.col("word") == F.lit(END))).where((F.col("n") >= 2) | (F.col("word") == F.lit(END))).collect()
    rows = sorted(((bytes(r["word"]), r["n"]) for r in top), key=lambda r: (r[0] != END, -r[1], r[0]))
    if not rows or rows[0][0] != END:
        rows.insert(0, (END, 0))
    first = sorted(rows[:head], key=lambda r: (-r[1], r[0])) + rows[head:]
    return Vocabulary(total, kinds, [w for w, _ in first], np.array([n for _, n in first], dtype=np.int64), min(head, len(first)))


ENCODED = "row long, doc_id long, held_out boolean, turn int, n_tokens long, n_known long, base double, beyond double, ids binary, rare array<binary>"


def encoded(docs: DataFrame, id_col: str, text_col: str, vocabulary: Vocabulary) -> DataFrame:
    """Each document's ids (16 bits), with the sums of what the known words' counts decide: base of log10(count + 1) and
    beyond of the log10 shares of words within the classes beyond the head. rare: words that are not known."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(vocabulary)
    state: dict = {}

    def tables():
        if not state:
            v = held.value
            plain = np.log10(v.counts + 1.0)
            within = np.zeros(len(v.counts))
            if v.seldom:
                within[v.head :] = np.log10(v.counts[v.head :] / v.seldom)
            state.update(ids={w: i for i, w in enumerate(v.known)}, plain=np.r_[plain, 0.0], within=np.r_[within, -np.log10(v.rare + v.rare_kinds + 1.0)], some=np.r_[v.counts > 0, False], head=v.head, none=len(v.known), end=v.end)
        return state

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        get, none, head = t["ids"].get, t["none"], t["head"]
        short = np.minimum(np.arange(none + 1), head).astype(np.uint16)
        short[none] = head + 1
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                rows: list[list] = [[] for _ in range(6)]
                for text in part.column(4):
                    ids, rare = [], []
                    for some in words(text.as_buffer().to_pybytes()):
                        own = np.array([get(w, none) for w in some], dtype=np.int32)
                        rare += [some[i] for i in np.flatnonzero(own == none)]
                        ids.append(own)
                    own = np.concatenate([*ids, np.array([t["end"]], dtype=np.int32)])
                    told = (len(own), int(t["some"][own].sum()), float(t["plain"][own].sum()), float(t["within"][own].sum()), short[own].tobytes(), rare)
                    for column, v in zip(rows, told, strict=True):
                        column.append(v)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], names=[c.split()[0] for c in ENCODED.split(", ")])

    doc = F.col(id_col).cast("long")
    named = docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc_id"), held_out(doc).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turn = F.when(F.col("held_out"), ROUNDS).otherwise(F.pmod(F.xxhash64("row"), F.lit(ROUNDS))).cast("int")
    return named.select("row", "doc_id", "held_out", turn.alias("turn"), "text").mapInArrow(run, ENCODED)


def by_turn(rows: DataFrame) -> DataFrame:
    """rows written to the shared folder, a folder for each turn, and read back."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    rows.write.partitionBy("turn").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def stretches(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches, cut so that they hold about `most` words (or one document), with the ids of their documents."""
    rows, docs, n = [], [], 0
    for batch in batches:
        ids = [np.frombuffer(v.as_buffer(), dtype=np.uint16) for v in batch.column(column)]
        low = 0
        for i, own in enumerate(ids):
            n += len(own)
            if n >= most:
                yield [*rows, batch.slice(low, i + 1 - low)], docs + ids[low : i + 1]
                rows, docs, n, low = [], [], 0, i + 1
        if low < len(ids):
            rows.append(batch.slice(low))
            docs += ids[low:]
    if docs:
        yield rows, docs


def trained(rows: DataFrame, net: Network, end: int) -> Network:
    """The network after one round over the documents of rows (ids): the mean of what the tasks have learned, weighted by
    their words. The parameters travel in blocks."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, n = Trainer(held.value.filled(held.value.flat()), end), 0
        for _, docs in stretches(batches, 0, STRETCH):
            stream = np.concatenate(docs)
            trainer.learn(stream)
            n += len(stream)
        if n:
            flat = trainer.net.flat().astype(np.float64) * n
            cuts = range(0, len(flat), BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts), dtype=np.int32)), pa.array(np.full(len(cuts), n, dtype=np.int64)), pa.array([flat[c : c + BLOCK].tobytes() for c in cuts], pa.binary())], names=["block", "n", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, n, some in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = sums.setdefault(block, [0, 0.0])
                own[0] += n
                own[1] = own[1] + np.frombuffer(some)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([x.tobytes() for _, x in sums.values()], pa.binary())], names=["block", "n", "sums"])

    kind = "block int, n long, sums binary"
    # as many rows as the network has blocks
    told = rows.select("ids").mapInArrow(learn, kind).repartition("block").mapInArrow(summed, kind).collect()
    if not told:
        return net
    return net.filled(np.concatenate([np.frombuffer(r["sums"]) / r["n"] for r in sorted(told, key=lambda r: r["block"])]))


def begun(vocabulary: Vocabulary) -> Network:
    return Network.begun(vocabulary.counts[: vocabulary.head], [vocabulary.seldom, vocabulary.rare])


def document_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, known: int = KNOWN) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    Null texts count as empty ones, which have one token, the end; a null id counts as an empty one and is trained on.
    Repeated rows are documents of their own. Texts of any length are scored whole. Without training documents the
    base gives every token probability 1, and the network is an untrained one. Other columns are not read; an empty
    table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    counts = materialize(word_counts(docs.where(~held_out(F.col(id_col).cast("long"))).select(text.alias("text"))))
    vocabulary = counted(counts, head, known)
    rows = by_turn(encoded(docs, id_col, text_col, vocabulary))
    net = begun(vocabulary)
    for turn in range(ROUNDS):
        net = trained(rows.where(F.col("turn") == turn), net, vocabulary.end)
    held, end = docs.sparkSession.sparkContext.broadcast(net), vocabulary.end
    passed = ("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "beyond")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, docs in stretches(batches, len(passed), STRETCH):
            logs, at = scored(held.value, docs, end) / np.log(10), 0
            for batch in some:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(passed))), pa.array(logs[at : at + len(batch)])], names=[*passed, "network"])
                at += len(batch)

    told = rows.select(*passed, "ids").mapInArrow(score, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, beyond double, network double")
    met = rows.select("row", F.explode("rare").alias("word")).join(counts, "word")
    rare = met.groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("logs"))
    every = told.join(rare, "row", "left").na.fill(0, ["more", "logs"])
    share = float(np.log10(vocabulary.total + vocabulary.kinds + 1))
    return every.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("more")).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("logs") - F.col("n_tokens") * F.lit(share)).alias("base_score"), (F.col("network") + F.col("beyond") + F.col("logs")).alias("score"),
    )
