"""op2, op3 and op4, and the pipeline."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm.audio import Analysis, audio_features, features, payload_of, resampled, samples_of, segments, wav
from tessera.llm.packing import best_fit, pack_documents, text_cluster
from tessera.llm.toxicity import fit, fit_cumulative_link, toxicity


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 3))
    grade = np.searchsorted([-1.0, 0.5, 2.0], x @ np.array([2.0, -1.0, 0.0]) + rng.logistic(size=3000))
    rows, columns = np.divmod(np.arange(9000), 3)
    weights, cuts = fit_cumulative_link(rows, columns, x.ravel(), grade, 3, 3)
    assert np.all(np.diff(cuts) > 0) and abs(weights[0] - 2) < 0.3 and abs(weights[1] + 1) < 0.2 and abs(weights[2]) < 0.15


def test_toxicity_held_out(spark, odd, empty):
    rng = random.Random(1)
    plain, bad = [f"word{i}" for i in range(80)], ["idiot", "moron", "clown"]
    text = lambda t: " ".join(rng.choices(plain, k=40) + (rng.choices(bad, k=4) if t else []))
    rows = [(i, text(i % 3 == 0), i % 3 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    letters = docs.withColumn("text", F.translate("text", "0123456789", "abcdefghij"))
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows[:400]], "doc_id long, quality int, toxic int")
    model = fit(letters, labels)
    got = {r["doc_id"]: r for r in toxicity(letters, model).collect()}
    assert sum(got[i]["toxic"] == b for i, _, b in rows[400:]) >= 198
    assert all(0 <= r["severity"] <= 3 for r in got.values())
    assert toxicity(odd, model).count() == odd.count() and toxicity(empty, model).count() == 0
    assert fit(empty.select("doc_id", "text"), labels) is None and not toxicity(odd, None).where("toxic").count()


def test_best_fit_by_brute_force():
    rng = random.Random(4)
    for _ in range(50):
        items = sorted(((rng.randint(1, 50), rng.randint(0, 3), rng.choice([-1, -1, 0, 1])) for _ in range(40)), reverse=True)
        lengths, sources, clusters = map(list, zip(*items, strict=True))
        bins, offsets = best_fit(lengths, sources, clusters, 60, 2)
        held = []
        for n, s, c, b, o in zip(lengths, sources, clusters, bins, offsets, strict=True):
            fits = [(60 - sum(x[0] for x in h), i) for i, h in enumerate(held) if 60 - sum(x[0] for x in h) >= n and sum(x[1] == s for x in h) < 2 and not (c >= 0 and any(x[2] == c for x in h))]
            expected = min(fits)[1] if fits else len(held)
            if expected == len(held):
                held.append([])
            assert (b, o) == (expected, sum(x[0] for x in held[expected]))
            held[expected].append((n, s, c))


def test_packed_documents(odd, empty):
    length = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    got = pack_documents(odd, length, 1000, F.col("source"), text_cluster(F.col("text"))).collect()
    by_bin, total = defaultdict(list), defaultdict(int)
    for r in got:
        by_bin[r["bin_id"]].append((r["bin_offset"], r["length"]))
        total[r["doc_id"]] += r["length"]
    for parts in by_bin.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= 1000
    expected = defaultdict(int)
    for r in odd.collect():
        expected[r["doc_id"]] += len((r["text"] or "").encode()) + 1
    assert total == expected
    assert pack_documents(empty, length, 1000).count() == 0


def test_audio_contract(odd, empty):
    got = audio_features(odd, with_media=True, with_tensors=True).collect()
    texts = sorted(r["text"] or "" for r in odd.collect())
    told = sorted((payload_of(t), len(t.encode())) for t in texts)
    assert sorted((r["payload_sha256"], r["tail_crc32"], r["n_bytes"], r["payload_bytes"]) for r in got) == sorted((hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), n, len(p)) for p, n in told)
    for r in got:
        assert r["payload_bytes"] % 192 == 0 and r["payload_bytes"] > 0 and samples_of(bytes(r["media"]))[0] in {p for p, _ in told}
        found = pa.ipc.open_stream(bytes(r["tensors"])).read_all()
        assert len(found) == r["n_tensors"] and str(found.schema.field("mel").type).startswith("extension<arrow.fixed_shape_tensor")
    assert audio_features(empty).count() == 0


def test_resampling_keeps_a_tone():
    t = np.arange(24_000) / 24_000
    y = resampled(np.sin(2 * np.pi * 440 * t).astype(np.float32), 2, 3, 16)
    peak = np.abs(np.fft.rfft(y)).argmax() * 16_000 / len(y)
    assert len(y) == 16_000 and abs(peak - 440) < 2


def test_resampling_by_convolution():
    from tessera.llm.audio import _phases

    x = np.random.default_rng(1).standard_normal(301).astype(np.float32)
    taps, up, down = 16, 2, 3
    low = _phases(up, down, taps)[:, ::-1].T.reshape(-1)
    stuffed = np.zeros(len(x) * up)
    stuffed[::up] = x
    assert np.allclose(resampled(x, up, down, taps), np.convolve(stuffed, low)[: len(stuffed)][::down][: len(x) * up // down], atol=1e-4)


def test_log_mel_by_definition():
    from tessera.llm.audio import bell, log_mel

    a, rate = Analysis(), 16_000.0
    x = np.random.default_rng(2).standard_normal(1000).astype(np.float32)
    mel, level = log_mel(x, rate, a)
    frames = 1 + -(-(len(x) - a.window) // a.hop)
    assert mel.shape == (frames, a.mels)
    padded = np.r_[x, np.zeros(frames * a.hop + a.window)].astype(np.float64)
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = np.linspace(0, to_mel(rate / 2), a.mels + 2)
    for f in range(frames):
        part = padded[f * a.hop : f * a.hop + a.window] * bell(a.window)
        power = [abs(sum(part * np.exp(-2j * np.pi * k * np.arange(a.window) / a.n_fft))) ** 2 for k in range(a.n_fft // 2 + 1)]
        for m in (0, 7, 20, a.mels - 1):
            left, middle, right = 700 * (10 ** (edges[m : m + 3] / 2595) - 1)
            energy = sum(p * max(0.0, min((k * rate / a.n_fft - left) / (middle - left), (right - k * rate / a.n_fft) / (right - middle))) for k, p in enumerate(power))
            assert abs(mel[f, m] - 10 * np.log10(energy + 1e-6)) < 0.02
        assert abs(level[f] - 10 * np.log10((part * part).mean() + 1e-9)) < 0.02


def test_segments_by_hysteresis():
    level = np.array([-60.0] * 30 + [-10.0] * 20 + [-33.0] * 3 + [-10.0] * 10 + [-60.0] * 30)
    assert segments(level, 0.5, -0.25).tolist() == [[30, 63]]
    spans, tensors, n = features(wav(bytes([128] * 4000 + [0, 255] * 6000 + [128] * 4000), 24_000), Analysis())
    assert tensors.shape[1:] == (32, 40) and len(spans) == len(tensors) and n > 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    rows = [(i, " ".join(rng.choices(words, k=60) + ["mail", f"u{i}@example.org"] + (["idiot"] * 5 if i % 5 == 0 else [])), "en", f"s{i % 3}", 400) for i in range(200)]
    rows += [(500 + i, rows[i][1], "en", "s0", 400) for i in range(1, 5)] + [(900, None, None, None, None), (901, "", None, "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = P.toxicity(spark, at, str(tmp_path))
    assert clean.columns == docs.columns and {r[0] for r in clean.select("doc_id").collect()} == {i for i, *_ in rows if i >= 500 or i % 5}
    kept = P.near_dedup(spark, clean, str(tmp_path))
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, *_ in rows if i < 500 and i % 5 or i == 900}
    safe = P.pii(spark, kept, str(tmp_path)).collect()
    assert not any("@" in (r["text"] or "") for r in safe) and all((r["text"] is None) == (r["doc_id"] == 900) for r in safe)
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in safe}


def test_stages_of_odd_tables(spark, tmp_path):
    """Clashing columns pass unchanged, ids that repeat with other texts stay, null ids stay, empty tables stay empty."""
    import corpus_pipeline as P

    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    body = "plain words of a text that goes on for some time and then ends "
    rows = [(i, f"{body * 3} number {chr(97 + i % 26) * 4} " + ("idiot moron " * 3 if i % 2 else "kind people ") + f"mail u{i}@example.org", "en", f"s{i % 3}", 9) for i in range(40)]
    far = "quite another text with none of those in it, mail someone@example.org at once or rather later than that"
    rows += [(2, far, "en", "s", 9), (2, far, "en", "s", 9), (None, body, None, None, None), (None, body, None, None, None), (50, None, "en", None, 0), (51, "", "en", "s", 0), (52, "long " + "word " * 200_000, "en", "s", 9)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(f"own {c}") for c in ("toxic", "severity", "p_toxic", "_text", "_base", "_spans", "_email", "text_key", "row", "key", "id", "words", "group", "copies")}
    docs = plain.withColumns(extra)
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert all(r[c] == f"own {c}" for r in kept for c in extra), name
        assert sum(r["doc_id"] is None for r in kept) == 2, name
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        if name == "toxicity":
            assert {r["doc_id"] for r in kept} >= {*range(0, 40, 2), 50, 51, 52} and not {r["doc_id"] for r in kept} & set(range(1, 40, 2))
        if name == "near_dedup":
            assert sum(r["text"] == far for r in kept) == 1 and {50, 51} & {r["doc_id"] for r in kept} == {50}
        if name == "pii":
            assert not any("@" in (r["text"] or "") for r in kept) and len(kept) == docs.count()
    packed = P.packing(spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert P.packing(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_packing_of_repeated_rows(spark):
    """Null ids and equal rows are dealt over groups; conflicts hold in every bin."""
    rows = [(None, f"t{i % 7}", "s", 5) for i in range(300)] + [(1, "same", "s", 5)] * 300 + [(10 + i, f"u{i % 40}", f"s{i % 5}", 1 + i % 30) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    got = pack_documents(docs, F.col("n"), 60, F.col("source"), F.col("text"), per_source=2, group_rows=100)
    assert got.count() == 900 and got.where("doc_id is null").select("group").distinct().count() > 3 and got.where("doc_id = 1").select("group").distinct().count() > 3
    held = got.where("doc_id >= 10").join(docs, "doc_id").groupBy("bin_id", "source").count().where("count > 2")
    assert held.count() == 0
    assert got.where("doc_id >= 10").join(docs, "doc_id").groupBy("bin_id", "text").count().where("count > 1").count() == 0


def test_toxicity_on_labels_not_fitted_on(spark):
    import os

    at = "/root/testdata/sf0.1"
    if not os.path.exists(f"{at}/labels.parquet"):
        return
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    held = "pmod(xxhash64(doc_id, 'held'), 4) = 0"
    model = fit(docs, labels.where(f"not {held}"))
    got = toxicity(docs, model).select("doc_id", "toxic").join(labels.where(held).select("doc_id", F.col("toxic").alias("label")), "doc_id").collect()
    bad, good = [r["toxic"] for r in got if r["label"]], [r["toxic"] for r in got if not r["label"]]
    assert sum(bad) >= 0.9 * len(bad) and sum(good) <= 0.05 * len(good)
    print(f"caught {sum(bad) / len(bad):.3f}, kept {1 - sum(good) / len(good):.3f}")
