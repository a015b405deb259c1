"""Token ids as word-aligned Simple-8b blocks in Parquet: each 64-bit word packs as many ids as its selector tells.

A row of the table is a block: the ids of consecutive documents in ascending doc_id order. Its header columns give
where each document's ids start and which words are escapes, so that a block is decoded without a loop over words.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Fixed by the format: bits and count of the ids in a word, by selector (the top four bits). Selector 0 is an escape:
#: the word after it is one value of up to 64 bits.
BITS = (0, 60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNT = (0, 1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)

#: The narrowest field for values of so many bits; 64 for those that only an escape holds.
FIELD = np.array([min((b for b in BITS[1:] if b >= n), default=64) for n in range(66)], dtype=np.uint8)

#: Ids and documents after which a block ends.
BLOCK_IDS = 1 << 18
BLOCK_DOCS = 512


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, positions of escape words) of the values. Each word takes as many of the next values as fit."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
    # the narrowest field that holds each value; 64 marks an escape
    need = most = FIELD[np.frexp(ids.astype(np.float64))[1]]
    best = np.where(most > 60, 0, 15).astype(np.int8)
    reach = 1
    # values that fit a selector fit all that pack fewer, so the window only widens and ends with the first misfit
    for selector in range(14, 1, -1):
        count = COUNT[selector]
        if n < count:
            break
        while reach < count:
            most = np.maximum(most[:-1], need[reach:])
            reach += 1
        fit = most <= BITS[selector]
        if not fit.any():
            break
        best[: len(fit)][fit] = selector
    step = (np.array(COUNT)[best] + (best == 0)).tolist()
    at, firsts = 0, []
    while at < n:
        firsts.append(at)
        at += step[at]
    firsts = np.array(firsts, dtype=np.int64)
    chosen = best[firsts].astype(np.int64)
    place = np.cumsum(1 + (chosen == 0)) - 1 - (chosen == 0)
    words = np.zeros(int(place[-1]) + 1 + int(chosen[-1] == 0), dtype=np.uint64)
    words[place] = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        mine = chosen == selector
        rows, at = firsts[mine], place[mine]
        if selector == 0:
            words[at + 1] = ids[rows]
            continue
        filled = words[at]
        for k in range(COUNT[selector]):
            filled |= ids[rows + k] << np.uint64(k * BITS[selector])
        words[at] = filled
    return words, place[chosen == 0].astype(np.int32)


def unpack(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The values of the words, all selectors at once."""
    raw = np.zeros(len(words), dtype=bool)
    raw[np.asarray(escapes, dtype=np.int64) + 1] = True
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(raw, 1, np.array(COUNT)[selector])
    offset = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    out[offset[raw]] = words[raw]
    for s in np.unique(selector[~raw]):
        if s:
            at = np.flatnonzero(~raw & (selector == s))
            shifts = np.arange(COUNT[s], dtype=np.uint64) * np.uint64(BITS[s])
            values = (words[at][:, None] >> shifts) & np.uint64((1 << BITS[s]) - 1)
            out[offset[at][:, None] + np.arange(COUNT[s])] = values
    return out


#: Words and parts of words that a worker keeps, and the longest of them.
MEMO = 400_000
MEMO_LENGTH = 40

#: Words of these characters need none of the library's normalizer but lower case; all others go to it whole.
PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Fixed by the vocabulary file: its pre-tokenizer's pattern, for lower-case words of those characters.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: bytes that print stand for
    themselves, the others for the characters from 256 on."""
    printing = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in printing]
    letter = {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letter[b] for b in range(256)]


class WordEncoder:
    """Encodes whole texts with the tokenizers library, each distinct word once.

    The vocabulary drops white space and joins nothing over it, so a text's ids are those of its words in a row. Texts
    are cut at spaces and line ends. Words of plain letters go straight to the library's BPE model part by part, all
    others, and those that hold an added token's string, through its whole chain.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # their strings become their ids in any text, as the library has it
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(c.isspace() for t in self.added for c in t):
            raise ValueError("texts are cut at white space, which an added token of this vocabulary holds")
        self.model = self.library.model
        self.letters = byte_letters()
        self.memo: dict[str, bytes] = {}
        self.part_memo: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        if (found := self.part_memo.get(part)) is None:
            spelled = "".join([self.letters[b] for b in part.encode()])
            found = np.array([t.id for t in self.model.tokenize(spelled)], dtype="<u4").tobytes()
            if len(part) <= MEMO_LENGTH:
                self.part_memo[part] = found
        return found

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and not any(t in word for t in self.added):
            return b"".join(map(self._part, PARTS.findall(word.lower())))
        return np.array(self.library.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        memo, out = self.memo, []
        for word in text.replace("\n", " ").split(" "):
            if (found := memo.get(word)) is None:
                found = self._word(word)
                if len(word) <= MEMO_LENGTH:
                    memo[word] = found
            out.append(found)
        if len(memo) > MEMO or len(self.part_memo) > MEMO:
            memo.clear()
            self.part_memo.clear()
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


BLOCK_SCHEMA = "part int, block int, n_ids long, doc_ids array<long>, offsets array<long>, escapes array<int>, payload binary"


def write_blocks(docs: DataFrame, path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, ends it with end_id and writes the ids as blocks in ascending doc_id order; returns
    the written table. Null texts count as empty and still get the end id. Null doc_ids come first; rows of equal
    doc_id are ordered by their text's hash. Documents are dealt by ranges of doc_id, so parts follow one another. Texts
    of any length are encoded whole; other columns, of whatever name, are not read. An empty table gives no blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, end = TaskContext.get().partitionId(), word_encoder(path), np.array([end_id], dtype="<u4").tobytes()
        ids, held, size, block = [], [], 0, 0

        def packed():
            flat = np.frombuffer(b"".join(held), dtype="<u4")
            words, escapes = pack(flat)
            offsets = np.r_[0, np.cumsum([len(h) // 4 for h in held])]
            row = [[part], [block], [len(flat)], [ids], [offsets.tolist()], [escapes.tolist()], [words.astype("<u8").tobytes()]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=re.findall(r"(\w+) [^,]+", BLOCK_SCHEMA))

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                held.append(encoder.ids(text.as_py() or "") + end)
                size += len(held[-1]) // 4
                if size >= BLOCK_IDS or len(held) >= BLOCK_DOCS:
                    yield packed()
                    ids, held, size, block = [], [], 0, block + 1
        if held:
            yield packed()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ids and texts that repeat, nulls among them, are dealt by the place that they are read from
    keyed = source.withColumns({"text_hash": F.xxhash64("text"), "seat": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(parts, "doc_id", "text_hash", "seat").sortWithinPartitions("doc_id", "text_hash", "seat")
    return materialize(ordered.select("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA))


def read_blocks(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """(part, block, seq, doc_id, before, n_tokens, ids_crc32[, ids]) of each document, decoded from the blocks.

    before: ids of the block's earlier documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block, _, doc_ids, offsets, escapes, payload in zip(*batch.columns, strict=True):
                offsets = np.array(offsets.as_py(), dtype=np.int64)
                flat = unpack(np.frombuffer(payload.as_py(), dtype="<u8"), np.array(escapes.as_py(), dtype=np.int64)).astype("<u4")
                n = len(offsets) - 1
                out = [
                    pa.array(np.full(n, part.as_py(), dtype=np.int32)),
                    pa.array(np.full(n, block.as_py(), dtype=np.int32)),
                    pa.array(np.arange(n, dtype=np.int32)),
                    pa.array(doc_ids.as_py(), pa.int64()),
                    pa.array(offsets[:-1]),
                    pa.array(np.diff(offsets)),
                    pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64()),
                ]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(out, names=["part", "block", "seq", "doc_id", "before", "n_tokens", "ids_crc32", "ids"][: len(out)])

    columns = [c.strip().split()[0] for c in BLOCK_SCHEMA.split(", ")]
    return blocks.select(*columns).mapInArrow(run, "part int, block int, seq int, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, block, block_start): ids before each block. Sums within parts, then over the few parts."""
    each = materialize(blocks.select("part", "block", "n_ids"))
    # one row for each part
    parts = each.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inner = each.select("part", "block", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("inner_start"))
    return inner.join(parts, "part").select("part", "block", (F.col("inner_start") + F.col("part_start")).alias("block_start"))


def stored_documents(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the written blocks."""
    told = read_blocks(blocks).join(block_starts(blocks), ["part", "block"])
    return told.select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
