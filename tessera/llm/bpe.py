"""Byte-level BPE with the tiktoken library: encoding, raw-byte decoding and token counts by section."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as the pattern has it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: A text is cut here only. A run of white space begins a match whatever follows it, and nothing before it looks
#: further; so does an ideograph or a kana after an ideographic stop or comma. So the pieces' tokens are the whole
#: text's tokens.
SAFE = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])|(?<=[\u3001\u3002\uff0c\uff01\uff1f])(?=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff])")

#: Characters after which a long text is cut at the next safe place.
PIECE = 1 << 16

#: Characters from which a run of white space is told apart by hand: the library's matcher goes back over such runs and
#: runs out of stack on the longest.
RUN = 1 << 14


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The encoding of a local rank file, once for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: A pattern that takes a whole piece as one match.
WHOLE = "(?s).+"


@functools.lru_cache(maxsize=4)
def _long_run(least: int) -> re.Pattern[str]:
    return re.compile(f"(?<![{WHITE}])[{WHITE}]{{{least},}}")


def pieces(text: str, size: int = PIECE, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """The text in pieces of `size` characters or somewhat more, cut at safe places only, and whether a piece is one
    match of the pattern: a run of white space but for its last character, which goes with what follows."""

    def cut(part: str) -> Iterator[tuple[str, bool]]:
        at = 0
        while len(part) - at > size and (found := SAFE.search(part, at + size)):
            yield part[at : found.start()], False
            at = found.start()
        if at < len(part):
            yield part[at:] if at else part, False

    at = 0
    if len(text) >= run:
        for m in _long_run(run).finditer(text):
            yield from cut(text[at : m.start()])
            at = m.end() - (m.end() < len(text))
            if at > m.start():
                yield text[m.start() : at], True
    yield from cut(text[at:] if at else text)


def encoded(text: str, path: str, pattern: str) -> Iterator[list[int]]:
    """The ids of the whole text, piece by piece."""
    enc = encoding(path, pattern)
    for piece, single in pieces(text):
        yield (encoding(path, WHOLE) if single else enc).encode_ordinary(piece)


@functools.lru_cache(maxsize=4)
def _decimals(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of each whole text.

    Null texts count as empty: no tokens, and the digests of nothing. Rows are independent: repeated rows and null
    ids stay as they are, other columns are not read. decoded_sha256 is taken from the bytes that the ids decode to.
    Texts of any length are encoded whole, piece by piece; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        name = _decimals(enc.n_vocab).__getitem__
        for batch in batches:
            counts, digests, decoded, kept = [], [], [], []
            for value in batch.column(1):
                n, text_sha, byte_sha, all_ids = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in encoded(value.as_py() or "", path, pattern):
                    if ids:
                        text_sha.update(("," * bool(n) + ",".join(map(name, ids))).encode())
                        byte_sha.update(enc.decode_bytes(ids))
                        n += len(ids)
                        if with_ids:
                            all_ids += ids
                counts.append(n)
                digests.append(text_sha.hexdigest())
                decoded.append(byte_sha.hexdigest())
                kept.append(all_ids)
            out = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                out.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


@functools.lru_cache(maxsize=4)
def _byte_lengths(path: str, pattern: str) -> np.ndarray:
    enc = encoding(path, pattern)
    return np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], dtype=np.int64)


def token_spans(text: str, path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end character of each token of the whole text; part of a character counts as the character."""
    lengths = _byte_lengths(path, pattern)
    ids = [np.zeros(0, dtype=np.int64), *(np.array(found, dtype=np.int64) for found in encoded(text, path, pattern))]
    ends = np.cumsum(lengths[np.concatenate(ids)])
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


#: To which section a token goes that lies over several: that of its first or last character, or that which holds
#: most of its characters (of equals the first).
RULES = ("first", "last", "most")


def attributed(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Interval join of token spans with sections, given by their ascending starts: the section of each token, and
    whether the token crosses a boundary. Both sides are sorted, so the join is a merge by binary search."""
    first = np.searchsorted(sections, starts, side="right") - 1
    last = np.searchsorted(sections, ends - 1, side="right") - 1
    crossing = first != last
    if rule == "last":
        return last, crossing
    if rule == "most":
        first = first.copy()
        for t in np.flatnonzero(crossing):
            edges = np.r_[starts[t], sections[first[t] + 1 : last[t] + 1], ends[t]]
            first[t] += int(np.argmax(np.diff(edges)))
    return first, crossing


def _counted(docs: DataFrame, cut, path: str, pattern: str, rule: str, columns: Sequence[str]) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for row, values in enumerate(zip(*(batch.column(i + 1) for i in range(len(columns))), strict=True)):
                text, sections = cut([v.as_py() or "" for v in values])
                starts, ends = token_spans(text, path, pattern)
                to, crossing = attributed(starts, ends, sections, rule)
                n = len(sections)
                for x, v in zip(out, (np.full(n, row), np.arange(n), sections, np.r_[sections[1:], len(text)], np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)), strict=True):
                    x.append(v)
            rows = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0])), *(pa.array(x.astype(np.int64)) for x in rows[1:])], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return docs.mapInArrow(run, "doc_id long, section long, start long, end long, n_tokens long, n_crossing long")


def section_token_counts(docs: DataFrame, path: str, pattern: str, boundary: str = "\n", rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing): tokens of each section of each text, encoded whole.

    A section runs from the end of one match of the regex `boundary` to the end of the next. Every token goes to
    exactly one section, so the counts of a document add up to its tokens; n_crossing tells how many of a section's
    tokens lie over a boundary. An empty or null text has one empty section. Repeated rows give repeated sections, a
    null id gives sections without an id. Other columns are not read; an empty table gives no rows.
    """
    pattern_of = re.compile(boundary)

    def cut(values: list[str]) -> tuple[str, np.ndarray]:
        text = values[0]
        found = sorted({0, *(m.end() for m in pattern_of.finditer(text) if m.end() < len(text))})
        return text, np.array(found, dtype=np.int64)

    return _counted(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), cut, path, pattern, rule, ["text"])


def field_token_counts(docs: DataFrame, fields: Sequence[str], path: str, pattern: str, rule: str = "first", id_col: str = "doc_id") -> DataFrame:
    """As section_token_counts, the sections being the fields' texts, concatenated and encoded as one document.

    Null and empty fields are empty sections, which get no tokens.
    """

    def cut(values: list[str]) -> tuple[str, np.ndarray]:
        return "".join(values), np.r_[0, np.cumsum([len(v) for v in values[:-1]])].astype(np.int64)

    given = [F.col(f).cast("string").alias(f"field{i}") for i, f in enumerate(fields)]
    return _counted(docs.select(F.col(id_col).cast("long").alias("doc_id"), *given), cut, path, pattern, rule, list(fields))
