"""op6, op8 and op9 against the libraries on whole texts."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm.bpe import WHOLE, encode_documents, field_token_counts, pieces, section_token_counts
from tessera.llm.simple8b import pack, stored_documents, unpack, word_encoder, write_blocks

BYTES = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def whole():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def test_bpe_whole_texts(odd, empty, whole):
    got = encode_documents(odd, BYTES, P.PATTERN).collect()
    expected = sorted((str(r["doc_id"]), len(ids := whole.encode_ordinary(r["text"] or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((str(r[0]), *r[1:]) for r in got) == expected
    assert encode_documents(empty, BYTES, P.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text("ab 1'\n\t\u3000\x1c.é日。か", max_size=200), st.integers(1, 20), st.integers(2, 9))
def test_pieces_are_safe(text, size, run):
    if not _kept:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
        _kept.extend(tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (P.PATTERN, WHOLE))
    assert [i for p, single in pieces(text, size, run) for i in _kept[single].encode_ordinary(p)] == _kept[0].encode_ordinary(text)


_kept: list = []


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_sections_add_up(odd, empty, whole, rule):
    got = section_token_counts(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), BYTES, P.PATTERN, rule=rule).groupBy("doc_id").sum("n_tokens").collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect()}
    assert {r[0]: r[1] for r in got} == {i: len(whole.encode_ordinary(t)) for i, t in texts.items() if i is not None}
    assert section_token_counts(empty, BYTES, P.PATTERN).count() == 0


def test_very_long_texts(spark, whole):
    """White space that the library itself has no stack for, and long texts of all scripts."""
    texts = ["a" + " " * 2_000_000 + "b", "\n" * 1_500_000, "привет мир " * 60_000, "日本語。" * 60_000, "x" * 400_000]
    got = {r["doc_id"]: r for r in encode_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, P.PATTERN).collect()}
    assert all(got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(texts))
    assert [got[i]["n_tokens"] for i in (2, 3, 4)] == [len(whole.encode_ordinary(t)) for t in texts[2:]]
    counts = section_token_counts(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), BYTES, P.PATTERN).collect()
    assert [r["n_tokens"] for r in counts] == [got[0]["n_tokens"]]
    assert len(list(pieces(texts[2]))) > 5 and len(list(pieces(texts[3]))) > 2


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_sections_by_brute_force(spark, whole, rule):
    import random

    rng = random.Random(4)
    texts = ["".join(rng.choices(["one", " two", "\n", "\n\n", "  ", "日本", "é", "\t\n", "x1!"], k=40)) for _ in range(60)]
    got = {(r["doc_id"], r["section"]): (r["n_tokens"], r["n_crossing"]) for r in section_token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), BYTES, P.PATTERN, rule=rule).collect()}
    for d, text in enumerate(texts):
        of_byte, section = [], 0
        for i, c in enumerate(text):
            of_byte += [(section, i)] * len(c.encode())
            section += c == "\n" and i + 1 < len(text)
        told, at = {k: [0, 0] for k in range(section + 1)}, 0
        for token in whole.encode_ordinary(text):
            n = len(whole.decode_single_token_bytes(token))
            held = [s for s, _ in dict.fromkeys(of_byte[at : at + n])]
            at += n
            to = {"first": held[0], "last": held[-1], "most": max(dict.fromkeys(held), key=held.count)}[rule]
            told[to][0] += 1
            told[to][1] += len(set(held)) > 1
        assert {k: tuple(v) for k, v in told.items()} == {s: v for (i, s), v in got.items() if i == d}


def test_fields(spark, whole):
    docs = spark.createDataFrame([(1, "the cat", " sat", None), (2, None, None, None)], "doc_id long, a string, b string, c string")
    got = {(r["doc_id"], r["section"]): r["n_tokens"] for r in field_token_counts(docs, ["a", "b", "c"], BYTES, P.PATTERN).collect()}
    assert got[1, 0] + got[1, 1] == len(whole.encode_ordinary("the cat sat")) and got[1, 2] == 0
    assert sum(v for (d, _), v in got.items() if d == 2) == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    ids = np.array(values, dtype=np.uint64)
    assert unpack(*pack(ids)).tolist() == ids.tolist()


def test_stored_ids(odd, empty, library):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = sorted(stored_documents(write_blocks(docs, WORDS)).collect())
    start, expected = 0, []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == expected
    assert stored_documents(write_blocks(odd, WORDS)).count() == odd.count()
    assert stored_documents(write_blocks(empty, WORDS)).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endoftext", "|>", "foo", "It's", " ", "\n", "\u00a0", "e\u0301", "\u0301", "42"]), max_size=12).map("".join)))
def test_words_as_the_library(text):
    t = Tokenizer.from_file(WORDS) if not _words else _words[0]
    _words[:] = [t]
    assert np.frombuffer(word_encoder(WORDS).ids(text), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids


_words: list = []
