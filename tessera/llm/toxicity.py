"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are a text's words and the beginnings and ends of its words, so that inflected and compounded forms of a word
share what it tells.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

WORD = re.compile(r"[^\W\d_]+")

#: Characters of the beginnings and ends that are features of longer words.
AFFIXES = (3, 4, 5, 6)

#: Bounds of the fit: labelled documents, and features.
FIT_DOCS, FIT_FEATURES = 20_000, 2_000
#: Documents of the fit that a feature must be in, and standard deviations by which its toxic ones must differ from what
#: is expected of as many documents.
LEAST_DOCS, LEAST_Z = 5, 3.0
#: Grades beside 0; the toxic documents of the fit are spread over them by the share of their words that are markers.
GRADES = 3
#: One in HELD of the documents of the fit is held out to choose the penalty and the threshold by.
HELD, PENALTIES = 4, (1e-4, 1e-3, 1e-2)
#: Words that a worker keeps the features of, the longest of them, and features that it counts before it hands them on.
MEMO, MEMO_LENGTH, COUNTED = 150_000, 40, 100_000


def features_of(word: str) -> tuple[str, ...]:
    """The word, and its beginnings and ends, marked by the side that is cut off."""
    return (word, *(word[:n] + "-" for n in AFFIXES if n < len(word)), *("-" + word[-n:] for n in AFFIXES if n < len(word)))


def counted_words(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


class Vectorizer:
    """Counts of a text's known features: (columns, counts, words in all)."""

    def __init__(self, index: dict[str, int]):
        self.index = index
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[list[int], list[int], int]:
        memo, index, total, found = self.memo, self.index, 0, Counter()
        for word, n in counted_words(text).items():
            total += n
            if (hits := memo.get(word)) is None:
                hits = tuple(index[f] for f in features_of(word) if f in index)
                if len(word) <= MEMO_LENGTH:
                    memo[word] = hits
            for h in hits:
                found[h] += n
        if len(memo) > MEMO:
            memo.clear()
        columns = sorted(found)
        return columns, [found[c] for c in columns], total


@dataclass
class Model:
    """P(grade > k) = logistic(weights . x - cuts[k]): one set of weights for all thresholds.

    x: log(1 + count) of each feature, and last, where there is any, of all marker features and of the words: with
    these the model can tell a share. Documents without a feature have x = 0. threshold: probability of grade 1 or more from which a document is toxic.
    """

    index: dict[str, int]
    markers: frozenset[int]
    weights: np.ndarray
    cuts: np.ndarray
    threshold: float = 0.5
    vectors: Vectorizer | None = field(default=None, repr=False, compare=False)

    def above(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -50, 50)))

    def score(self, text: str | None) -> float:
        if self.vectors is None:
            self.vectors = Vectorizer(self.index)
        columns, values = scaled(*self.vectors(text), len(self.index), self.markers)
        return float(self.weights[columns] @ values) if columns else 0.0


def scaled(columns: list[int], counts: list[int], total: int, n_features: int, markers: frozenset[int]) -> tuple[list[int], list[float]]:
    """Columns and values of x."""
    if not columns:
        return [], []
    marked = sum(n for c, n in zip(columns, counts, strict=True) if c in markers)
    return [*columns, n_features, n_features + 1], [*np.log1p(counts).tolist(), float(np.log1p(marked)), float(np.log1p(total))]


def fit_cumulative_link(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_columns: int, n_cuts: int, penalty: float = 1e-3, rounds: int = 200, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts of greatest likelihood, with a penalty on the squared weights, by Adam.

    rows, columns, values: the non-zero features. The cuts are a first one and positive steps, so they stay in order.
    """
    n = len(grades)
    share = np.clip([(grades > k).mean() for k in range(n_cuts)], 1e-4, 1 - 1e-4)
    cuts = np.maximum.accumulate(np.log(1 / share - 1) + 1e-2 * np.arange(n_cuts))
    params = np.concatenate([np.zeros(n_columns), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    mean, spread = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, steps = params[:n_columns], np.exp(params[n_columns + 1 :])
        cuts = params[n_columns] + np.r_[0, np.cumsum(steps)]
        eta = np.bincount(rows, weights=values * w[columns], minlength=n)
        upper = 1 / (1 + np.exp(np.clip(eta[:, None] - np.r_[cuts, np.inf], -50, 50)))  # P(grade <= k)
        upper[:, -1] = 1
        lower = np.c_[np.zeros(n), upper[:, :-1]]
        at = np.arange(n), grades
        p = np.maximum(upper[at] - lower[at], 1e-12)
        slope_up, slope_low = upper[at] * (1 - upper[at]) / p, lower[at] * (1 - lower[at]) / p
        d_eta = slope_up - slope_low  # of the negative log-likelihood
        d_cuts = np.zeros(n_cuts)
        np.add.at(d_cuts, grades[grades < n_cuts], -slope_up[grades < n_cuts])
        np.add.at(d_cuts, grades[grades > 0] - 1, slope_low[grades > 0])
        after = d_cuts[::-1].cumsum()[::-1]
        grad = np.concatenate([np.bincount(columns, weights=values * d_eta[rows], minlength=n_columns) / n + penalty * w, after[:1] / n, after[1:] * steps / n])
        mean, spread = 0.9 * mean + 0.1 * grad, 0.99 * spread + 0.01 * grad**2
        params = params - rate * (mean / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-8)
    return params[:n_columns], params[n_columns] + np.r_[0, np.cumsum(np.exp(params[n_columns + 1 :]))]


def marker_features(vocabulary: list[tuple[str, int, int]]) -> set[str]:
    """Of (feature, documents, toxic documents) those of which most documents are toxic, by Wilson's lower bound."""
    found = set()
    for name, n, k in vocabulary:
        p, z = k / n, 3.0
        if (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) > 0.5:
            found.add(name)
    return found


def _document_counts(sample: DataFrame) -> DataFrame:
    """(name, n, k): documents of the sample (text, toxic) with each feature, and toxic ones. Counted in each task
    before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = Counter(), Counter()

        def told():
            names = list(n)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[f] for f in names], pa.int64()), pa.array([k[f] for f in names], pa.int64())], names=["name", "n", "k"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1), strict=True):
                found = {f for word in counted_words(text.as_py()) for f in features_of(word)}
                n.update(found)
                if toxic.as_py():
                    k.update(found)
                if len(n) > COUNTED:
                    yield told()
                    n, k = Counter(), Counter()
        yield told()

    return sample.select("text", "toxic").mapInArrow(run, "name string, n long, k long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def best_threshold(p: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(threshold, caught share + kept share) that is best on held-out documents; of equals the middle one."""
    order = np.argsort(-p, kind="stable")
    caught = np.cumsum(toxic[order]) / max(toxic.sum(), 1)
    kept = 1 - np.cumsum(1 - toxic[order]) / max((1 - toxic).sum(), 1)
    last = np.r_[p[order][1:] != p[order][:-1], True]  # equal probabilities are told alike
    gain = np.where(last, caught + kept, -1)
    best = int(np.argmax(gain))
    here, after = p[order][best], p[order][best + 1] if best + 1 < len(p) else 0.0
    odds = [np.log(max(x, 1e-9) / max(1 - x, 1e-9)) for x in (here, after)]
    return float(min(here, 1 / (1 + np.exp(-np.mean(odds))))), float(gain[best])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS, fit_features: int = FIT_FEATURES) -> Model | None:
    """A model from at most fit_docs labelled documents, chosen by a hash of doc_id; None without both kinds of label.

    Labels say toxic or not. The severity of a toxic document is graded by the share of its words that are markers, in
    GRADES equal parts. Equal texts count once. Features are the fit_features that tell the labels apart best. The
    penalty (of equally good ones the greatest) and the threshold are those that do best on one in HELD of the
    documents, which the model for that is not fitted on; the model itself is then fitted on all. Rows with a null id or label are not used, a null text counts as
    empty, of several labels of an id the greatest counts.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    # at most fit_docs pairs of numbers
    told = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = materialize(told.groupBy(F.xxhash64("text").alias("h"), F.md5("text").alias("m")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("h", "text", "toxic"))
    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    if not 0 < totals["k"] < totals["n"]:
        return None
    rate = totals["k"] / totals["n"]
    z = F.abs(F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate)))
    vocabulary = [(r["name"], r["n"], r["k"]) for r in _document_counts(sample).where((F.col("n") >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(z.desc(), "name").limit(fit_features).collect()]
    index = {w: i for i, (w, _, _) in enumerate(vocabulary)}
    markers = frozenset(index[f] for f in marker_features(vocabulary))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectorizer(index)
        for batch in batches:
            columns, values, shares = [], [], []
            for text in batch.column(1):
                hits, counts, total = vectors(text.as_py())
                told = scaled(hits, counts, total, len(index), markers)
                columns.append(told[0])
                values.append(told[1])
                marked = sum(n for word, n in counted_words(text.as_py()).items() if any(index.get(f) in markers for f in features_of(word)))
                shares.append(marked / max(total, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(shares, pa.float64()), batch.column(2).cast(pa.int32())], names=["h", "columns", "values", "share", "toxic"])

    got = sorted(sample.mapInArrow(features, "h long, columns array<int>, values array<double>, share double, toxic int").collect(), key=lambda r: r["h"])
    toxic = np.array([r["toxic"] for r in got])
    share = np.array([r["share"] for r in got])
    edges = np.quantile(share[toxic == 1], np.arange(1, GRADES) / GRADES)
    grades = np.where(toxic == 1, 1 + np.searchsorted(edges, share, side="left"), 0).astype(np.int64)
    n_columns = len(vocabulary) + 2

    def fitted(which: np.ndarray, penalty: float) -> Model:
        part = [got[i] for i in which]
        rows = np.repeat(np.arange(len(part)), [len(r["columns"]) for r in part])
        columns = np.concatenate([np.array(r["columns"], dtype=np.int64) for r in part])
        values = np.concatenate([np.array(r["values"], dtype=np.float64) for r in part])
        weights, cuts = fit_cumulative_link(rows, columns, values, grades[which], n_columns, GRADES, penalty)
        return Model(index, markers, weights, cuts)

    def p_toxic(model: Model, which: np.ndarray) -> np.ndarray:
        return model.above(np.array([model.weights[got[i]["columns"]] @ np.array(got[i]["values"]) if got[i]["columns"] else 0.0 for i in which]))[:, 0]

    order = np.arange(len(got))
    out = order[order % HELD == 0]
    penalty, threshold = PENALTIES[1], 0.5
    if 0 < toxic[out].sum() < len(out) and 0 < toxic[order % HELD != 0].sum():
        tried = [(best_threshold(p_toxic(fitted(order[order % HELD != 0], p), out), toxic[out]), p) for p in PENALTIES]
        (threshold, _), penalty = max(tried, key=lambda t: (t[0][1], t[1]))
    model = fitted(order, penalty)
    model.threshold = threshold
    return model


def toxicity(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """docs with severity (expected grade, 0 to GRADES), grade (most probable), p_toxic and toxic.

    Null texts count as empty: the grade of a document without features. Without a model nothing is toxic. Without a
    threshold the model's own is taken. Repeated rows are told alike; columns of docs with these names are replaced. Texts
    of any length are read whole; an empty table gives none.
    """
    names = ["severity", "grade", "p_toxic", "toxic"]
    rest = docs.drop(*names)
    if model is None:
        return rest.select("*", F.lit(0.0).alias("severity"), F.lit(0).alias("grade"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))
    return rest.withColumn("_judged", judged(model, F.col(text_col), threshold)).select(*(F.col(c) for c in rest.columns), *(F.col(f"_judged.{n}").alias(n) for n in names))


def judged(model: Model, text: Column, threshold: float | None = None) -> Column:
    """Struct of severity, grade, p_toxic and toxic of a text."""
    least = model.threshold if threshold is None else threshold

    @F.pandas_udf("severity double, grade int, p_toxic double, toxic boolean")
    def told(texts: pd.Series) -> pd.DataFrame:
        above = model.above(np.array([model.score(t) for t in texts]))
        each = np.c_[np.ones(len(above)), above] - np.c_[above, np.zeros(len(above))]
        return pd.DataFrame({"severity": above.sum(axis=1), "grade": each.argmax(axis=1), "p_toxic": above[:, 0], "toxic": above[:, 0] >= least})

    return told(text.cast("string"))
