"""op1 and op10, and the pipeline's near-duplicates, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm.neighbours import buckets, fit, nearest, probed
from tessera.llm.simhash import hashes, near_duplicate_groups, simhash_components


def closed(nodes, linked):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(least[a], least[b])
            if (least[a], least[b]) != (m, m):
                least[a] = least[b] = m
                changed = True
    return least


def plain_fingerprint(text, n=3):
    h = hashes(text or "", n)
    return sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("limit", [1 << 14, 3])
def test_components(spark, odd, limit):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()]
    for i in range(40):
        base = rng.choices(words, k=120)
        rows += [(100 + 10 * i + j, " ".join(base[:j * 3] + ["x"] * (j > 3) + base[j * 3 :])) for j in range(6)]
    got = simhash_components(spark.createDataFrame(rows, "doc_id long, text string"), limit=limit).collect()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    least = closed(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{prints[i]:016x}", least[i]) for i in ids}


def test_components_of_odd_rows(odd, empty):
    got = simhash_components(odd).collect()
    assert len(got) == odd.count() and [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert {r["component_id"] for r in got if r["doc_id"] in (2, 3, 7)} == {2}
    assert simhash_components(empty).count() == 0


def grouped(docs):
    """{id: the least id of its group} of documents whose ids have one text each."""
    rows = near_duplicate_groups(docs).collect()
    first = {r["group"]: r["id"] for r in rows if r["first"]}
    assert len(first) == len({r["group"] for r in rows})
    return {r["id"]: first[r["group"]] for r in rows}


def linked_by_text(rows, n=5, similarity=0.8):
    sets = {i: set(hashes(t or "", n).tolist()) for i, t in rows}
    ids = sorted(sets)
    return [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(both := sets[a] & sets[b]) >= similarity * (len(sets[a]) + len(sets[b]) - len(both))]


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(words)), n):
        out[at] = "".join(rng.choices("abcdefgh", k=6))
    return out


def test_near_duplicates_at_the_threshold(spark):
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows = []
    for i in range(100):
        base = rng.choices(words, k=400)
        other = list(base)
        for at in (40, 110, 180, 250, 290, 330, 370)[: 6 + i % 2]:
            other[at] = "zzz"
        rows += [(i, " ".join(base)), (1000 + i, " ".join(other))]
    links = linked_by_text(rows)
    got = grouped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(links) > 90 and sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert all(got[1000 + i] == 1000 + i for i in range(100) if (i, 1000 + i) not in links)


@pytest.mark.parametrize(("n", "hot"), [(2, 1 << 14), (13, 1 << 14), (50, 1 << 14), (50, 8), (1000, 1 << 14), (1000, 100)])
def test_near_duplicates_in_groups(spark, n, hot, monkeypatch):
    """Families of n texts around a template, whose similarities lie on both sides of the threshold, with and without keys
    that are dealt over tasks."""
    monkeypatch.setattr(simhash, "PART_ROWS", 300)
    monkeypatch.setattr(simhash, "HOT_ROWS", hot)
    rng = random.Random(n)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows = []
    for family in range(max(1, 60 // n)):
        base = rng.choices(words, k=150)
        rows += [(family * n + i, " ".join(changed(rng, base, rng.randint(1, 4)))) for i in range(n)]
    links = linked_by_text(rows)
    least = closed([i for i, _ in rows], links)
    got = grouped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(got[a] == got[b] for a, b in links) >= 0.9 * len(links)
    assert all(least[i] == least[got[i]] for i in got)


def test_near_duplicates_of_one_template(spark, monkeypatch):
    """Fifty pairs over a template that all 101 are near by their bits, but whose text is under the threshold."""
    rng = random.Random(17)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    template = rng.choices(words, k=400)
    rows = [(0, " ".join(template))]
    for i in range(50):
        own = list(template)
        own[40 + i : 120 + i] = rng.choices(words, k=80)
        other = list(own)
        for at in (5, 200, 300, 390):
            other[at] = "zzz"
        rows += [(1 + 2 * i, " ".join(own)), (2 + 2 * i, " ".join(other))]
    least = closed([i for i, _ in rows], linked_by_text(rows))
    assert len(set(least.values())) == 51
    monkeypatch.setattr(simhash, "PART_ROWS", 7)
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string")) == least


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    assert near_duplicate_groups(empty).count() == 0
    got = near_duplicate_groups(odd).collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3, 4, 5, 6, 7, 8]
    group = {r["id"]: r["group"] for r in got}
    assert group[2] == group[3] == group[7] and group[1] == group[8] and group[4] == group[5]
    twice = near_duplicate_groups(spark.createDataFrame([(1, "one two three four five six"), (1, "quite another text of some words"), (1, "one two three four five six")], "doc_id long, text string"))
    assert twice.count() == 2 and twice.where("first").count() == 2


def brute(rows, k):
    at = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            at[i] = np.array(v, dtype=np.float64)
    return {q: sorted(((-float(at[q] @ at[i]), i) for i in at if i != q))[:k] for q in at if q % 20 == 0}


def test_fit_reaches_its_aim():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2048, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = fit(x, 1.0, 1 << 22, 16, 20)
    inner = x[:100] @ x.T
    inner[np.arange(100), np.arange(100)] = -np.inf
    near = np.argsort(-inner, axis=1)[:, :20]
    found = np.zeros(near.shape, dtype=bool)
    for table in range(index.tables):
        goal, visits = buckets(x, index, table), probed(x[:100], index, table)
        found |= np.stack([np.isin(goal[n], v) for n, v in zip(near, visits, strict=True)])
    assert found.mean() >= 0.94


def test_nearest(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1500, 8)).astype(np.float32) * rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)
    x[300:800] = x[7]
    rows = [(int(i), [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [None] * 8), (2060, [float("nan")] * 8), (None, [1.0] * 8), (2080, [1.0, 2.0]), rows[20], rows[5]]
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, id int, cell string")
    got = {}
    for r in nearest(docs, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    expected = brute(rows, 20)
    assert set(got) == set(expected)
    hits = total = 0
    for q, best in expected.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len({i for _, i in best} & {m[1] for m in mine})
        total += len(best)
    assert hits / total >= 0.9


def test_nearest_of_few(spark):
    schema = "vec_id long, embedding array<double>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.1]), (2, [0.5, 0.5])], schema)
    assert [tuple(r)[:3] for r in sorted(nearest(few, F.col("vec_id") % 20 == 0).collect())] == [(0, 1, 2), (0, 2, 1)]
    assert nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_an_id_with_several_vectors(spark):
    """It is one row, as near as its nearest vector, as a candidate and as a query."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, -1.0]), (7, [1.0, 0.2]), (7, [-1.0, 0.3]), (3, [1.0, 0.2]), (3, [0.9, -0.8]), (5, [-1.0, 0.3]), (9, [0.2, 0.1])]
    got = [tuple(r)[:4] for r in sorted(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect())]
    assert [(q, n, v, round(s, 9)) for q, n, v, s in got] == [(0, 1, 3, 1.0), (0, 2, 7, 1.0), (0, 3, 9, 0.2)]


@pytest.mark.parametrize("size", [1, 3, 50, 10_000])
def test_screened_rows_of_crowded_keys(spark, size):
    """Whatever the batches, each key's rows are either linked by a forest or handed on whole."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 6, 400) * 7)
    key[-150:] = 99
    known, one, two = np.arange(400), rng.integers(0, 4, 400), rng.integers(0, 4, 400)
    rows = pa.table({"key": key, "known": known, "one": one, "two": two}).to_batches(max_chunksize=size)
    for limit in (None, 60, 140, 1000):
        out = pa.Table.from_batches(list(simhash.screened(1, limit)(iter(rows)))).to_pydict()
        over = {k for k in set(key.tolist()) if limit is not None and (key == k).sum() > limit}
        assert sorted((a, b) for a, b, kind in zip(out["a"], out["b"], out["kind"], strict=True) if kind) == sorted((int(k), int(n)) for k, n in zip(key, known, strict=True) if int(k) in over)
        links = [(a, b) for a, b, kind in zip(out["a"], out["b"], out["kind"], strict=True) if not kind]
        near = lambda a, b: bin(int(one[a]) ^ int(one[b])).count("1") + bin(int(two[a]) ^ int(two[b])).count("1") <= 1
        assert all(key[a] == key[b] and near(a, b) for a, b in links)
        every = [(a, b) for a in range(400) for b in range(a + 1, 400) if key[a] == key[b] and int(key[a]) not in over and near(a, b)]
        assert closed(range(400), links) == closed(range(400), every)
