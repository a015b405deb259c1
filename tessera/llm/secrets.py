"""Secrets: base spans by pattern, and strings whose format probabilistic automata learned from labelled credentials.

Grammar inference in the manner of ALERGIA: a prefix tree of the labelled credentials of each kind is reduced by
merging states whose outgoing frequencies and remaining lengths agree by Hoeffding's bound. Every other long string is scored by the
likelihood of its format under the automata, against an automaton of all the corpus's long strings, whose states are
the last symbols. Only the classes of characters are learned from, stored and counted, never the strings themselves.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Fixed by the task: kinds in their order, patterns and least lengths.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 12
# with their least lengths; what these skip, the plain patterns match and drop
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

#: Words that every assignment holds one of, lowered; looked for before the pattern.
WORDS = ("passw", "secret", "token", "api_key", "apikey")

#: A candidate is a whole run of these characters, of this length or more, with two of small letters, capitals and
#: digits in it: what has but one of them is a word or a number as far as its form tells.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
KINDS_OF_LETTERS = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))

#: Bounds of the fit: labelled credentials of a kind, and their length (longer ones are not learned from).
FIT_STRINGS, FIT_LENGTH = 1_500, 512
#: Symbols that a state of the automaton of ordinary strings holds.
ORDER = 3
#: Hoeffding's bound holds with probability 1 - ALPHA; a symbol that a state never emitted has SMOOTH occurrences.
ALPHA, SMOOTH = 0.05, 0.5
#: A candidate is a secret if its format is this much likelier by symbol than an ordinary string's, in nats, and no
#: less likely by symbol than all but this share of the labelled credentials of the kind.
MARGIN, SHARE = 0.25, 0.02

_CLASSES = str.maketrans({c: "a" for c in "abcdef"} | {c: "g" for c in "ghijklmnopqrstuvwxyz"} | {c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"} | {c: "0" for c in "123456789"})
SYMBOLS = {c: i for i, c in enumerate("agA0+/_.=-")}
END = len(SYMBOLS)


def classes(value: str) -> str:
    """The value's characters as classes: a to f, other small letters, capitals, digits, and each sign by itself."""
    return value.translate(_CLASSES)


def symbols(form: str) -> list[int]:
    return [SYMBOLS[c] for c in form]


@dataclass
class Automaton:
    """steps[state][symbol]: the next state, -1 for none. log[state][symbol]: log probability, END closing a string."""

    steps: list[list[int]]
    log: list[list[float]]

    def by_symbol(self, form: str) -> float:
        """Mean log probability of a symbol of the form, its end included. Unseen steps go back to the start."""
        steps, log, state, total = self.steps, self.log, 0, 0.0
        for s in symbols(form):
            total += log[state][s]
            state = max(steps[state][s], 0)
        return (total + log[state][END]) / (len(form) + 1)


def transitions(form: str) -> Iterator[tuple[str, str]]:
    """(last ORDER symbols, next symbol) of a form; the start and the end are empty."""
    for i in range(len(form)):
        yield form[max(0, i - ORDER) : i], form[i]
    yield form[max(0, len(form) - ORDER) :], ""


@dataclass
class Ordinary:
    """How often each symbol follows the last ORDER ones in the corpus's different forms. A form is scored without its
    own share of these counts."""

    counts: dict[tuple[str, str], int]
    totals: dict[str, int]

    def by_symbol(self, form: str) -> float:
        own = Counter(transitions(form))
        of_state = Counter()
        for (state, _), n in own.items():
            of_state[state] += n
        total = 0.0
        for (state, symbol), n in own.items():
            seen = max(self.counts.get((state, symbol), 0) - n, 0) + SMOOTH
            total += n * math.log(seen / (max(self.totals.get(state, 0) - of_state[state], 0) + SMOOTH * (END + 1)))
        return total / (len(form) + 1)


def infer(strings: Sequence[str], alpha: float = ALPHA) -> Automaton:
    """The automaton of the forms: prefix-tree states are tried in breadth-first order against the states kept so
    far and merged with the first compatible one, folding what follows them together.

    Two states are compatible if the frequencies of what follows agree, in them and in all states that both lead to, and
    if how far their strings still go does: random letters alone would make one state of a key of fixed length.
    """
    width = END + 1
    steps: list[list[int]] = [[-1] * END]
    counts: list[list[int]] = [[0] * width]
    left: list[Counter] = [Counter()]  # how many of a state's strings go on for so many symbols
    for value in strings:
        state = 0
        for n, s in enumerate(symbols(value)):
            counts[state][s] += 1
            left[state][len(value) - n] += 1
            if steps[state][s] < 0:
                steps.append([-1] * END)
                counts.append([0] * width)
                left.append(Counter())
                steps[state][s] = len(steps) - 1
            state = steps[state][s]
        counts[state][END] += 1
        left[state][0] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def as_far(a: int, b: int) -> bool:
        n, m, x, y = left[a].total(), left[b].total(), 0, 0
        most = bound * (n**-0.5 + m**-0.5)
        for length in sorted(left[a].keys() | left[b].keys()) if most < 1 else ():
            x, y = x + left[a][length], y + left[b][length]
            if abs(x / n - y / m) > most:
                return False
        return True

    def compatible(a: int, b: int) -> bool:
        if not as_far(a, b):
            return False
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = sum(counts[a]), sum(counts[b])
            if not n or not m:
                continue
            most = bound * (n**-0.5 + m**-0.5)
            if most < 1 and any(abs(x / n - y / m) > most for x, y in zip(counts[a], counts[b], strict=True)):
                return False
            pairs += [(x, y) for x, y in zip(steps[a], steps[b], strict=True) if x >= 0 and y >= 0 and x != y]
        return True

    def fold(a: int, b: int) -> None:
        """Adds b and the tree below it to a."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            counts[a] = [x + y for x, y in zip(counts[a], counts[b], strict=True)]
            left[a] += left[b]
            for s in range(END):
                if steps[b][s] < 0:
                    continue
                if steps[a][s] < 0:
                    steps[a][s] = steps[b][s]
                else:
                    pairs.append((steps[a][s], steps[b][s]))

    kept, queue = [0], [(0, s) for s in range(END) if steps[0][s] >= 0]
    settled = {0}
    while queue:
        parent, s = queue.pop(0)
        state = steps[parent][s]
        if state in settled:
            continue
        other = next((k for k in kept if compatible(k, state)), None)
        if other is None:
            kept.append(state)
            settled.add(state)
            queue += [(state, t) for t in range(END) if steps[state][t] >= 0]
        else:
            steps[parent][s] = other
            fold(other, state)
            queue += [(k, t) for k in kept for t in range(END) if steps[k][t] >= 0 and steps[k][t] not in settled]
            queue = list(dict.fromkeys(queue))
    number = {k: i for i, k in enumerate(kept)}
    table = [[number.get(t, -1) for t in steps[k]] for k in kept]
    seen = np.array([counts[k] for k in kept], dtype=np.float64) + SMOOTH
    return Automaton(table, np.log(seen / seen.sum(axis=1, keepdims=True)).tolist())


@dataclass
class Grammar:
    """Automata of the kinds with their least likelihood by symbol, and that of ordinary strings."""

    kinds: list[tuple[str, Automaton, float]]
    ordinary: Ordinary

    def likely(self, form: str) -> bool:
        own = max((x for _, a, least in self.kinds if (x := a.by_symbol(form)) >= least), default=None)
        return own is not None and own - self.ordinary.by_symbol(form) >= MARGIN


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans by start, then kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def credential(text: str, kind: int, start: int, end: int) -> str:
    """What of a base span is the secret itself."""
    return ASSIGN.match(text[start:end])[2] if kind == 0 else text[start:end]


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the mixed whole runs that reach beyond every base span that they touch."""
    out, at = [], 0
    farthest = 0  # end of the base spans that start at or before the run
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] <= m.start():
            farthest = max(farthest, base[at][2])
            at += 1
        if farthest < m.end() and sum(bool(kind.search(text, m.start(), m.end())) for kind in KINDS_OF_LETTERS) > 1:
            out.append((m.start(), m.end()))
    return out


def _lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


SCANNED = "doc_id long, kinds array<int>, starts array<int>, ends array<int>, forms array<string>, more_starts array<int>, more_ends array<int>, more array<string>"


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Base spans and candidates of each whole text, with the forms of the secrets and of the candidates. Offsets are
    code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                more = candidates(text, base)
                told = ([k for _, k, _ in base], [s for s, _, _ in base], [e for _, _, e in base], [classes(credential(text, k, s, e)) for s, k, e in base], [s for s, _ in more], [e for _, e in more], [classes(text[s:e]) for s, e in more])
                for column, v in zip(rows, told, strict=True):
                    column.append(v)
            words = pa.list_(pa.string())
            arrays = [batch.column(0), _lists(rows[0]), _lists(rows[1]), _lists(rows[2]), pa.array(rows[3], words), _lists(rows[4]), _lists(rows[5]), pa.array(rows[6], words)]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCANNED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCANNED)


def _sample(forms: DataFrame, most: int) -> list[str]:
    """At most `most` different forms of up to FIT_LENGTH symbols, chosen by their hash."""
    some = forms.where(F.length("form") <= FIT_LENGTH).distinct()
    return [r["form"] for r in some.orderBy(F.xxhash64("form"), "form").limit(most).collect()]


def _ordinary(forms: DataFrame) -> Ordinary:
    """Transitions of all different forms of the corpus, counted in each task before the shuffle. What reaches the
    driver is bounded by the symbols to the power of ORDER + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for form in batch.column(0).to_pylist():
                found.update(transitions(form))
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], names=["state", "symbol", "n"])

    told = forms.distinct().mapInArrow(run, "state string, symbol string, n long").groupBy("state", "symbol").agg(F.sum("n").alias("n")).collect()
    totals = Counter()
    for r in told:
        totals[r["state"]] += r["n"]
    return Ordinary({(r["state"], r["symbol"]): r["n"] for r in told}, dict(totals))


def learned(found: DataFrame, most: int = FIT_STRINGS) -> Grammar:
    """A grammar from the base spans as labelled credentials and all candidates as ordinary strings.

    At most `most` different forms of each kind, chosen by a hash over all documents, are learned from. Of the
    candidates every different form counts once, so that copies do not make a format ordinary.
    """
    pairs = found.select(F.explode(F.arrays_zip("kinds", "forms")).alias("x"))
    kinds = []
    for number, kind in enumerate(KINDS[:3]):
        forms = _sample(pairs.where(F.col("x.kinds") == number).select(F.col("x.forms").alias("form")), most)
        if forms:
            automaton = infer(forms)
            kinds.append((kind, automaton, float(np.quantile([automaton.by_symbol(s) for s in forms], SHARE))))
    return Grammar(kinds, _ordinary(found.select(F.explode("more").alias("form"))))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format) of each document.

    Null texts count as empty: no spans and the digest of nothing. Rows are independent once the grammar is learned;
    repeated rows and null ids stay. Without labelled credentials no span is added. Texts of any length are read whole, in
    time linear in it. Other columns are not read; an empty table gives none.
    """
    found = materialize(scanned(docs, id_col, text_col))
    grammar = learned(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for kinds, starts, ends, more_starts, more_ends, more in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5, 6, 7)), strict=True):
                base = list(zip(starts, kinds, ends, strict=True))
                extra = []
                for s, e, value in zip(more_starts, more_ends, more, strict=True):
                    if (likely := memo.get(value)) is None:
                        if len(memo) > 100_000:
                            memo.clear()
                        likely = memo[value] = grammar.likely(value)
                    if likely:
                        extra.append((s, len(KINDS) - 1, e))
                told = (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + extra)), len(extra))
                for column, v in zip(rows, told, strict=True):
                    column.append(v)
            whole, words = pa.int64(), pa.string()
            kinds_of = (whole, whole, whole, words, words, whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, k) for v, k in zip(rows, kinds_of, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"])

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")
