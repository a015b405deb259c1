"""The operators over whole corpora held against plain recounts."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.divergence import source_divergence
from tessera.llm.recurrent import HIDDEN, Network, Trainer, class_starts, scored
from tessera.llm.scoring import ROUNDS, document_scores
from tessera.llm.spelling import Trie, spelling_variants

SYLLABLES = ("ka", "lo", "mir", "é", "ß", "ton", "ap", "u", "Ren", "Ä")


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    some = [word() for _ in range(150)]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(some[: 20 + i % 130]) + rng.choice(("", "", ".", "!")) for _ in range(rng.randint(0, 40)))
        rows.append((i % 230, text, rng.choice(("en", "en", "de", None)), rng.choice(("a", "a", "a", "b", "c", None, "")), 0, 0, ""))
    rows += [(None, "kalo kalo mirton", "en", "only", 0, 0, ""), (900, None, None, None, None, None, None), (901, "", "xx", "z", 0, 0, ""), (902, "... \x00 ×÷ Kalomir-kalomir", "de", "b", 0, 0, "")]
    rows += [rows[3]] * 5
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, term string"


def plain_divergence(rows, top=200):
    groups, within, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered(r[1]))
        groups[lang, source].update(found)
        within[lang].update(found)
        docs[lang].update(set(found))
    out = set()
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= 3]

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p, q = shares(own), shares(within[lang])
        pairs = [(other[1], sum((p[t] - x[t]) ** 2 // x[t] for t in kept)) for other, counts in groups.items() if other[0] == lang and other[1] != source for x in [shares(counts)]]
        terms = [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if own[t] and p[t] > q[t]]
        for part, values, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(values, key=lambda v: (-v[1], v[0].encode()))[:most]
            out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("top", [200, 3])
def test_divergence_is_that_of_the_definition(spark, corpus, top):
    got = [tuple(r) for r in source_divergence(spark.createDataFrame(corpus, SCHEMA), top=top).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_divergence(corpus, top)


def test_divergence_of_odd_and_of_no_rows(spark, odd, empty):
    rows = [tuple(r) for r in odd.collect()]
    assert {tuple(r) for r in source_divergence(odd).collect()} == plain_divergence(rows)
    assert source_divergence(empty).collect() == []


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def test_trie_join_finds_every_pair_once():
    rng = random.Random(1)
    for _ in range(800):
        strings = sorted({"".join(rng.choice("abé"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 40))})
        near = list(Trie(strings).near())
        got = {i: sorted(others) for i, others in near}
        assert len(got) == len(near)
        want = {i: [j for j, b in enumerate(strings) if one_apart(a, b)] for i, a in enumerate(strings)}
        assert got == {i: v for i, v in want.items() if v}


def plain_variants(rows):
    counts = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    told = {}
    for w, n in words.items():
        near = sorted((x for x in words if one_apart(w, x)), key=lambda x: (-words[x], x))
        told[w] = (near[0] if near and words[near[0]] >= 2 * n else None, len(near))
    out = set()
    for w, (form, near) in told.items():
        root = w
        while told[root][0]:
            root = told[root][0]
        out.add((w, form, root, words[w], near, words[form] if form else None))
    return out


@pytest.mark.parametrize("most", [50_000, 2])
def test_variants_are_those_of_all_pairs(spark, most):
    rng = random.Random(3)
    stems = ["".join(rng.choice(("ka", "lo", "aa", "é", "n")) for _ in range(rng.randint(3, 6))) for _ in range(60)]

    def spelt():
        word = rng.choice(stems[: rng.randint(1, 60)])
        at = rng.randint(0, len(word) - 1)
        return rng.choice((word, word, word, word[:at] + word[at + 1 :], word[:at] + "x" + word[at:], word[:at] + word[at].upper() + word[at:]))

    rows = [(i, " ".join(spelt() for _ in range(60)), "en", "a", 0, 0, "") for i in range(60)] + [(None, "kalokalo " * 4, None, None, None, None, None)] * 2
    got = [tuple(r) for r in spelling_variants(spark.createDataFrame(rows, SCHEMA), most=most).collect()]
    want = plain_variants(rows)
    assert len(got) == len(want) > 100 and set(got) == want
    assert any(form and form != root for _, form, root, *_ in got)


def test_variants_of_odd_long_and_no_rows(spark, odd, empty):
    rows = [tuple(r) for r in odd.collect()]
    assert {tuple(r) for r in spelling_variants(odd).collect()} == plain_variants(rows)
    assert spelling_variants(empty).collect() == []
    long = "a" * 300_000
    rows = [(i, f"{long}b {long}c {long} short, shorts " * 3, "en", "a", 0, 0, "") for i in range(2)]
    assert {tuple(r) for r in spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect()} == plain_variants(rows)


def plain_base(rows):
    train, told = Counter(), []
    for r in rows:
        words = [*re.findall("[^\x20\x09-\x0d]+", lowered(r[1])), "\n"]
        held = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2
        told.append((r[0], held, words))
        if not held:
            train.update(words)
    total = sum(train.values())
    share = math.log10(total + len(train) + 1)
    return sorted(((-1 if i is None else i), held, len(words), sum(train[w] > 0 for w in words), total, round(sum(math.log10(train[w] + 1) - share for w in words), 6)) for i, held, words in told)


def test_base_scores_are_those_of_plain_counts(spark, corpus, odd, empty):
    for rows, head, known in ((corpus, 4096, 1 << 18), (corpus, 5, 20), ([tuple(r) for r in odd.collect()], 4096, 1 << 18)):
        got = document_scores(spark.createDataFrame(rows, SCHEMA), head=head, known=known).collect()
        plain = sorted(((-1 if r[0] is None else r[0]), r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got)
        want = plain_base(rows)
        assert [r[:5] for r in plain] == [r[:5] for r in want]
        assert np.allclose([r[5] for r in plain], [r[5] for r in want], atol=1e-5)
        assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert document_scores(empty).collect() == []


def test_scores_where_nothing_is_trained_on(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = document_scores(spark.createDataFrame([(i, "one two", "en", "a", 0, 0, "") for i in held], SCHEMA)).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got] == [(3, 0, 0, 0.0)] * 3
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def small(words=30, seed=2):
    counts = [1000 // (i + 1) for i in range(words)]
    net = Network.begun(counts, [40, 9], seed)
    rng = np.random.default_rng(seed)
    return net.filled(net.flat() + 0.3 * rng.standard_normal(len(net.flat())))


def plain_logs(net, doc, end):
    """Log probabilities of a document's words, word by word in double precision."""
    h, before, out = np.zeros(HIDDEN), end, []
    of = net.class_of.astype(int)
    for w in doc:
        x, s = net.inputs[before].astype(float), h @ net.state.astype(float)
        z, r = (1 / (1 + np.exp(-(x[a : a + HIDDEN] + s[a : a + HIDDEN]))) for a in (0, HIDDEN))
        new = np.tanh(x[2 * HIDDEN :] + r * s[2 * HIDDEN :])
        h = (1 - z) * new + z * h
        a = h @ net.by_class + net.class_bias
        log = a[of[w]] - np.log(np.exp(a).sum())
        if of[w] < len(net.starts) - 1:
            low, high = net.starts[of[w]], net.starts[of[w] + 1]
            b = net.by_word[low:high] @ h + net.word_bias[low:high]
            log += b[w - low] - np.log(np.exp(b).sum())
        out.append(log)
        before = w
    return out


def test_network_scores_whole_documents():
    net, rng, end = small(), np.random.default_rng(4), 3
    docs = [np.array([*(w if w != end else 4 for w in rng.integers(0, 32, n)), end], dtype=np.uint16) for n in (0, 1, 400, 70, 31, 32, 33, 5)] * 3
    want = [sum(plain_logs(net, d, end)) for d in docs]
    assert np.allclose(scored(net, docs, end), want, rtol=1e-4)
    # all words together have probability 1
    every = [np.exp(plain_logs(net, [1, 2, w], end)[2]) for w in range(32)]
    assert abs(sum(every) - 1) < 1e-6


def test_gradients_are_those_of_differences():
    net, rng, end = small(12), np.random.default_rng(6), 0
    words = rng.integers(0, 14, (6, 3))
    given = np.concatenate([np.full((1, 3), end), words[:-1]])
    h = (0.3 * rng.standard_normal((3, HIDDEN))).astype(np.float32)
    logs, _, grads = net.gradients(given, given == end, words, h)
    flat, at = net.flat().astype(np.float64), 0

    def total(parameters):
        own = net.filled(parameters)
        for n in own.NAMES:
            setattr(own, n, getattr(own, n).astype(np.float64))
        out, _ = own.walked(given, given == end, h, keep=False)
        return float(own.log_p(out.reshape(-1, HIDDEN).astype(np.float64), words.ravel())[0].sum())

    for name in net.NAMES:
        size = getattr(net, name).size
        g = grads[name]
        if name == "inputs":
            full = np.zeros_like(net.inputs)
            full[g[0]] = g[1]
            g = full
        for i in rng.integers(0, size, 12):
            step = np.zeros_like(flat)
            step[at + i] = 1e-2
            assert abs((total(flat + step) - total(flat - step)) / 2e-2 - g.ravel()[i]) < 2e-2, name
        at += size


def test_training_learns_what_follows_what():
    rng, end = np.random.default_rng(8), 0
    # each word is followed by the next one, from a random start
    docs = [np.array([*(1 + (s + np.arange(20)) % 25), end], dtype=np.uint16) for s in rng.integers(0, 25, 3000)]
    net = Network.begun([3000, *[2400] * 25], [0, 0])
    before = scored(net, docs[:100], end).sum()
    trainer = Trainer(net, end)
    for _ in range(4):
        trainer.learn(np.concatenate(docs[100:]))
    assert scored(net, docs[:100], end).sum() > 0.6 * before


def test_classes_hold_all_words():
    for n in (1, 2, 7, 4096):
        starts = class_starts([10 * n // (i + 1) for i in range(n)])
        assert starts[0] == 0 and starts[-1] == n and (np.diff(starts) > 0).all()


def test_held_out_scores_pass_the_base(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        at = rng.randint(0, 39)
        rows.append((i, " ".join(f"w{(at + j) % 40}" for j in range(30)), "en", "a", 0, 0, ""))
    got = [r for r in document_scores(spark.createDataFrame(rows, SCHEMA)).collect() if r["held_out"]]
    assert len(got) > 100 and ROUNDS > 1
    assert sum(r["score"] for r in got) > 0.95 * sum(r["base_score"] for r in got)
