"""Audio columns: 8-bit WAV bytes, and log-mel features of their energetic segments as fixed-shape Arrow tensors."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

#: Bytes to a multiple of which a payload is filled up, and what with.
ALIGN, FILL = 192, b" "

#: Rows of windows or frames worked on at a time, so that a very long recording needs no more memory than a usual one.
CHUNK = 1 << 13


@dataclass(frozen=True)
class Analysis:
    """rate * up / down is the rate after resampling; window and hop are in samples of that rate. `frames` by `mels`
    is the shape of a tensor. A segment begins where a frame's level rises `on` standard deviations over the
    recording's mean level and lasts while it stays over `off`."""

    rate: int = 24_000
    up: int = 2
    down: int = 3
    taps: int = 16
    window: int = 400
    hop: int = 160
    n_fft: int = 512
    mels: int = 40
    frames: int = 32
    on: float = 0.5
    off: float = -0.25


def payload_of(text: str) -> bytes:
    """UTF-8 bytes filled up with spaces to a positive multiple of ALIGN."""
    raw = text.encode()
    return raw + FILL * (-len(raw) % ALIGN if raw else ALIGN)


def wav(samples: bytes, rate: int) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    pad = b"\0" * (len(samples) % 2)
    chunk = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + pad
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WAVE" + chunk


def samples_of(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV file as wav() writes it, its chunks in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, data = 12, 0, b""
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only 8-bit mono PCM is read")
        elif name == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return data, rate


@functools.lru_cache(maxsize=8)
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low pass cut into `up` phases of `taps` coefficients, newest sample last."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    low = np.sinc(t / max(up, down)) * np.hamming(n)
    low *= up / low.sum()
    return low.reshape(taps, up).T[:, ::-1].astype(np.float32).copy()


def resampled(x: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """x at up/down times its rate: each output is one phase of the filter over the newest `taps` inputs."""
    n = len(x) * up // down
    out = np.empty(n, dtype=np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(taps - 1, dtype=np.float32), x.astype(np.float32)]), taps)
    phases = _phases(up, down, taps)
    for first in range(min(up, n)):
        # outputs first, first + up, ... share a phase and lie `down` inputs apart
        rows = windows[first * down // up :: down]
        mine = out[first::up]
        for at in range(0, len(mine), CHUNK):
            mine[at : at + CHUNK] = rows[at : at + CHUNK][: len(mine) - at] @ phases[first * down % up]
    return out


@functools.lru_cache(maxsize=8)
def mel_bank(mels: int, n_fft: int, rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, from 0 to half the rate."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hertz = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    left, middle, right = hertz[:-2, None], hertz[1:-1, None], hertz[2:, None]
    return np.maximum(0, np.minimum((bins - left) / (middle - left), (right - bins) / (right - middle))).T.astype(np.float32).copy()


@functools.lru_cache(maxsize=8)
def bell(n: int) -> np.ndarray:
    return np.hanning(n).astype(np.float32)


def log_mel(x: np.ndarray, rate: float, a: Analysis) -> tuple[np.ndarray, np.ndarray]:
    """(frames x mels) in decibels to two decimals, and each frame's level. The last frame is filled with silence."""
    n = 1 + max(0, -(-(len(x) - a.window) // a.hop))
    x = np.concatenate([x, np.zeros(max(0, (n - 1) * a.hop + a.window - len(x)), dtype=np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, a.window)[:: a.hop]
    shape, bank = bell(a.window), mel_bank(a.mels, a.n_fft, rate)
    mel, level = np.empty((n, a.mels), dtype=np.float32), np.empty(n, dtype=np.float32)
    for at in range(0, n, CHUNK // 8):
        part = frames[at : at + CHUNK // 8] * shape
        spectrum = np.fft.rfft(part, a.n_fft)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[at : at + len(part)] = 10 * np.log10(power @ bank + 1e-6)
        level[at : at + len(part)] = 10 * np.log10((part * part).mean(axis=1) + 1e-9)
    return np.round(mel, 2), np.round(level, 2)


def segments(level: np.ndarray, on: float, off: float) -> np.ndarray:
    """(first, end) frames of each segment by hysteresis around the mean level, in its standard deviations."""
    mean, spread = float(level.mean()), float(level.std())
    said = np.where(level >= mean + on * spread, 1, np.where(level < mean + off * spread, -1, 0))
    # between the thresholds a frame goes on with what was said last
    last = np.maximum.accumulate(np.where(said != 0, np.arange(len(said)), -1))
    active = np.r_[0, (last >= 0) & (said[last] > 0), 0].astype(np.int8)
    change = np.diff(active)
    return np.stack([np.flatnonzero(change == 1), np.flatnonzero(change == -1)], axis=1)


def features(media: bytes, a: Analysis = Analysis()) -> tuple[np.ndarray, np.ndarray, int]:
    """(spans in seconds, tensors of a.frames x a.mels, frames in all) of a recording.

    Each segment is cut into tensors of a.frames frames; the last is filled with the floor level.
    """
    raw, rate = samples_of(media)
    x = (np.frombuffer(raw, dtype=np.uint8).astype(np.float32) - 128) / 128
    to = rate * a.up / a.down
    mel, level = log_mel(resampled(x, a.up, a.down, a.taps), to, a)
    spans, tensors = [], []
    for first, end in segments(level, a.on, a.off):
        for at in range(first, end, a.frames):
            part = mel[at : min(end, at + a.frames)]
            if len(part) < a.frames:
                part = np.concatenate([part, np.full((a.frames - len(part), a.mels), -60, dtype=np.float32)])
            tensors.append(part)
            spans.append((at * a.hop / to, ((min(end, at + a.frames) - 1) * a.hop + a.window) / to))
    return np.array(spans).reshape(-1, 2), np.array(tensors, dtype=np.float32).reshape(-1, a.frames, a.mels), len(mel)


def tensor_table(spans: np.ndarray, tensors: np.ndarray) -> pa.Table:
    """Arrow table of start_s, end_s and a fixed-shape tensor column."""
    return pa.table({"start_s": pa.array(spans[:, 0]), "end_s": pa.array(spans[:, 1]), "mel": pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(tensors))} if len(tensors) else {"start_s": pa.array([], pa.float64()), "end_s": pa.array([], pa.float64()), "mel": pa.array([], pa.fixed_shape_tensor(pa.float32(), tensors.shape[1:]))})


def ipc_bytes(found: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, found.schema) as writer:
        writer.write_table(found)
    return out.getvalue().to_pybytes()


def tensors_of(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(spans, tensors) of a stored tensor table."""
    found = pa.ipc.open_stream(stream).read_all().combine_chunks()
    spans = np.stack([found.column(c).to_numpy() for c in ("start_s", "end_s")], axis=1)
    shape = found.schema.field("mel").type.shape
    chunks = found.column("mel").chunks
    return spans, np.concatenate([c.to_numpy_ndarray() for c in chunks]) if chunks else np.zeros((0, *shape), dtype=np.float32)


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, tensors binary, media binary"
KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(v, KINDS[k]) for v, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


#: Rows of a batch that are worked on and handed on at a time.
ROWS = 512


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            yield batch.slice(at, ROWS)


def stored_media(docs: DataFrame, analysis: Analysis = Analysis(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as an 8-bit WAV file, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield _batch([(d.as_py(), len(t.encode()), wav(payload_of(t), analysis.rate)) for d, t in zip(batch.column(0), texts, strict=True)], MEDIA)

    return materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, MEDIA), "zstd")


def stored_features(media: DataFrame, analysis: Analysis = Analysis(), with_media: bool = False) -> DataFrame:
    """Digests of each stored WAV file, and its tensors with their time spans as an Arrow IPC stream (start_s, end_s and
    mel, a fixed-shape tensor), written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows = []
            for doc_id, n_bytes, held in zip(*batch.columns, strict=True):
                held = held.as_py()
                back = samples_of(held)[0]
                spans, tensors, n_frames = features(held, analysis)
                rows.append((doc_id.as_py(), n_bytes.as_py(), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(held), hashlib.sha256(held).hexdigest(), n_frames, ipc_bytes(tensor_table(spans, tensors)), held if with_media else None))
            yield _batch(rows, FEATURES)

    return materialize(media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES), "zstd")


def audio_features(docs: DataFrame, analysis: Analysis = Analysis(), id_col: str = "doc_id", text_col: str = "text", with_media: bool = False, with_tensors: bool = False) -> DataFrame:
    """Stores each text's bytes as 8-bit audio, reads the stored file back, and stores and reads back its features.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, n_frames, n_tensors,
    feature[, media binary][, tensors binary]). feature holds the numbers of frames and tensors and a digest of spans
    and tensors as read back. Null texts count as empty, whose payload is all filling. Equal texts give equal values;
    repeated rows and null ids stay. Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            counts, told = [], []
            for frames, stream in zip(batch.column("n_frames"), batch.column("tensors"), strict=True):
                spans, tensors = tensors_of(stream.as_py())
                counts.append(len(tensors))
                told.append(f"{frames.as_py()}:{len(tensors)}:{hashlib.md5(np.ascontiguousarray(spans).tobytes() + tensors.tobytes()).hexdigest()}")
            more = {"n_tensors": pa.array(counts, pa.int64()), "feature": pa.array(told, pa.string())}
            yield pa.RecordBatch.from_arrays([more[n] if n in more else batch.column(n) for n in names], names=names)

    kept = stored_features(stored_media(docs, analysis, id_col, text_col), analysis, with_media)
    fields = [c for c in FEATURES.split(", ") if c.split()[1] != "binary"] + ["n_tensors long", "feature string"] + ["media binary"] * with_media + ["tensors binary"] * with_tensors
    names = [c.split()[0] for c in fields]
    return kept.mapInArrow(run, ", ".join(fields))
