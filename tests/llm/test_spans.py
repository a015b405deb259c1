"""op5 and op7: base spans against the plain patterns, the added ones on built corpora."""

import hashlib
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.llm.pii import disclosing_terms, find_pii, pii_spans
from tessera.llm.secrets import END, SYMBOLS, Ordinary, base_spans, candidates, classes, find_secrets, infer, transitions

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain_pii(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PII.items()) for m in re.finditer(p, text or "", re.ASCII) if holds(kind, m[0])]
    return [f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found)]


TRICKY = [
    "a@b a@b.c.d..e x@y.z@w.v", "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.255", "4111 1111 1111 1111 4111-1111-1111-1111  1",
    "+1 (415) 555-0100 +44 20 7946 0958+1 4155550100 +1", "%@%.% a@-.-", "٣٤٥@x.y 4٣", "0000 0000 0000 00", "\x01a@b.c\x02", "é" * 300 + "a@b.c",
]


def test_pii_base_spans(spark, odd):
    texts = [(i, t) for i, t in enumerate(TRICKY)] + [(r["doc_id"], r["text"]) for r in odd.where("doc_id > 0").distinct().collect() if r["doc_id"]]
    texts = [(i, t) for i, (_, t) in enumerate(texts)]
    got = {r["doc_id"]: r for r in pii_spans(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for i, text in texts:
        expected = plain_pii(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest(), text
        assert set(expected) <= set(got[i]["spans"].split(",")) or not expected
        assert got[i]["n_email"] == sum(x.startswith("email") for x in expected)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("a@.-+1 4(9)%é\x01", max_size=60), min_size=150, max_size=150))
def test_pii_any_text(spark, texts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["base_sha256"] for r in pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i] == hashlib.sha256(",".join(plain_pii(text)).encode()).hexdigest(), text


def test_terms_that_disclose(spark):
    rows = [(i, f"plain words here. Kontakt user{i}@example.org for more words of the same plain kind.") for i in range(30)]
    rows += [(100 + i, "plain words of the same kind, for more and here and of words.") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = disclosing_terms(docs)
    told = {r["term"]: r["kind"] for r in terms.collect()}
    assert told.get("kontakt") == "email" and "words" not in told
    first = find_pii(docs, terms).where("doc_id = 3").first()
    assert [s["start"] for s in first["_spans"]][0] == len("plain words here. ")


def test_terms_of_one_entity_and_long_texts(spark):
    """A name that stands only beside one person's address, in many passages; and 5,000 addresses in one text."""
    rows = [(i, f"Note {'abcdefghij'[i % 10] * 3} by zarko {'klmnopqrst'[i // 10] * 4}, zk@example.org, on plain words here. " + "plain words of the same kind and here, note by on. " * 4) for i in range(40)]
    rows += [(100 + i, "copied text with vexing jumble zed@example.org beside it, plain words of the same kind") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = {r["term"] for r in disclosing_terms(docs).collect()}
    assert "zarko" in told and not told & {"plain", "words", "vexing", "jumble"}
    long = " ".join(f"word user{i}@example.org and" for i in range(5000))
    began = time.time()
    got = pii_spans(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert got["n_email"] == 5000 and time.time() - began < 60
    assert got["base_sha256"] == hashlib.sha256(",".join(plain_pii(long)).encode()).hexdigest()


@pytest.mark.parametrize("run", [pii_spans, find_secrets])
def test_odd_rows(run, odd, empty):
    assert run(odd).count() == odd.count()
    assert run(empty).count() == 0
    null = run(odd).where("doc_id = 2").first()
    assert null["spans"] == "" and null["base_sha256"] == hashlib.sha256(b"").hexdigest()


def plain_secrets(text):
    keys = [(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "assign", lambda m: len(m[2]) >= 12)]
    keys += [(r"AKIA[A-Z0-9]+", "access", lambda m: len(m[0]) >= 18), (r"[0-9a-f]+", "hex", lambda m: len(m[0]) >= 16)]
    return sorted((m.start(), k, m.end()) for k, (p, _, ok) in enumerate(keys) for m in re.finditer(p, text, re.ASCII) if ok(m))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "secret", "Password", "API_key", "apikey", "=", ":", " ", '"', "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "short", "longer-value_1", "ſecret", "é", "."]), max_size=14).map("".join))
def test_secret_base_spans(text):
    assert base_spans(text) == plain_secrets(text)


def test_grammar_tells_formats_apart(spark):
    import random

    rng = random.Random(3)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(200)]
    words = ["-".join("".join(rng.choices("aeiounrst", k=6)) for _ in range(4)) + "2" for _ in range(200)]
    hexes, forms = [classes(h) for h in hexes], [classes(w) for w in words]
    a, b = infer(hexes), infer(forms)
    assert all(a.by_symbol(h) > b.by_symbol(h) for h in hexes) and all(b.by_symbol(w) > a.by_symbol(w) for w in forms)
    assert len(a.steps) < 60
    key = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32))
    rows = [(i, f'token = "{key()}" and the {w} here') for i, w in enumerate(words)] + [(999, f"bare {key()} here")]
    got = {r["doc_id"]: r["n_format"] for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[999] == 1 and sum(got[i] for i in range(200)) < 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token=", "AKIA", "ABCDEFGH1234567", "0123456789abcdef", "sk_live_", "longer-value_1", " ", "é"]), max_size=10).map("".join))
def test_candidates_reach_beyond_base_spans(text):
    base = base_spans(text)
    runs = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9+/_.=-]{12,}", text) if sum(bool(re.search(c, m[0])) for c in ("[a-z]", "[A-Z]", "[0-9]")) > 1]
    assert candidates(text, base) == [(s, e) for s, e in runs if max((b[2] for b in base if b[0] <= s), default=0) < e]


def test_automata_are_distributions():
    """What may follow each state adds up to one, and the forms learned from are all possible."""
    import math
    import random

    rng = random.Random(8)
    forms = [classes("".join(rng.choices("abcxyzABC019_-", k=rng.randint(1, 30)))) for _ in range(300)]
    automaton = infer(forms)
    assert all(abs(sum(map(math.exp, row)) - 1) < 1e-9 and len(row) == END + 1 for row in automaton.log)
    assert all(t < len(automaton.steps) for row in automaton.steps for t in row)
    counts = {}
    for form in forms:
        for t in transitions(form):
            counts[t] = counts.get(t, 0) + 1
    totals = {}
    for (state, _), n in counts.items():
        totals[state] = totals.get(state, 0) + n
    told = Ordinary(counts, totals)
    form = forms[0]
    left = [f for f in forms[1:]]
    expected = 0.0
    for state, symbol in transitions(form):
        seen = sum((state, symbol) == t for f in left for t in transitions(f)) + 0.5
        expected += math.log(seen / (sum(state == t[0] for f in left for t in transitions(f)) + 0.5 * (END + 1)))
    assert abs(told.by_symbol(form) - expected / (len(form) + 1)) < 1e-9


def test_candidates_of_very_long_runs():
    import time

    from tessera.llm.secrets import candidates

    for run in ("a" * 1_000_000, "ACGT" * 250_000, "1" * 1_000_000, "=" * 1_000_000, "a" * 999_999 + "1"):
        began = time.time()
        assert len(candidates(run, [])) == (run[-1] == "1" and run[0] == "a")
        assert time.time() - began < 5


def test_automata_know_how_far_a_key_goes():
    """A key of fixed length has a state for each place; one of another length is told from it."""
    import random

    rng = random.Random(4)
    draw = lambda n: classes("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n)))
    fixed = infer([draw(24) for _ in range(600)])
    assert 25 <= len(fixed.steps) <= 30
    loose = infer([draw(rng.randint(12, 60)) for _ in range(600)])
    assert len(loose.steps) < len(fixed.steps)
    held = [draw(24) for _ in range(200)]
    assert sum(fixed.by_symbol(f) > loose.by_symbol(f) for f in held) >= 190
    assert all(fixed.by_symbol(f) > fixed.by_symbol(f[:-4]) for f in held)


def test_merged_counts_are_those_of_a_plain_recount():
    """Every form is read through the automaton again; its states' frequencies are those of what was read there."""
    import math
    import random

    rng = random.Random(5)
    forms = [classes("".join(rng.choices("abcXYZ019", k=16)) + "-" + "".join(rng.choices("0123456789", k=rng.randint(3, 9)))) for _ in range(400)]
    automaton = infer(forms)
    counts = [[0] * (END + 1) for _ in automaton.steps]
    for form in forms:
        state = 0
        for c in form:
            s = SYMBOLS[c]
            counts[state][s] += 1
            state = automaton.steps[state][s]
            assert state >= 0
        counts[state][END] += 1
    for n, row in zip(counts, automaton.log, strict=True):
        assert all(abs(math.exp(p) - (x + 0.5) / (sum(n) + 0.5 * (END + 1))) < 1e-9 for x, p in zip(n, row, strict=True))
    assert len(automaton.steps) > 1
