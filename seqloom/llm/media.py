"""Media columns: audio features of sample bytes as fixed-shape Arrow tensors with time spans.

A payload of unsigned 8-bit samples is stored losslessly as a mono WAV in a binary column of a
Parquet table. Features are computed from the bytes that are read back: polyphase resampling,
overlapped log-mel frames, and a segmentation of frame energy with hysteresis (a segment opens at
the upper threshold and closes under the lower one). The mel frames of a row are cut into patches of
one fixed shape, the last one padded, and kept as an Arrow IPC stream with the columns
tensor: fixed_shape_tensor<float32>[frames, mels], start_s and end_s.

Each row is computed alone with blocks of fixed sizes, so equal payloads give equal features. A null
text counts as an empty one; an empty payload is padded to 64 zero bytes. Long texts are processed
in blocks. An empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import as_bytes, stored

UNIT = 64
RATE, TARGET_RATE = 16_000, 8_000
FRAME, HOP, MELS, PATCH = 256, 128, 32, 32
BLOCK = 1 << 16


def padded(data: bytes) -> bytes:
    """data with zero bytes up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (UNIT if not data else 0))


def wav(payload: bytes, rate: int = RATE) -> bytes:
    """payload as unsigned 8-bit mono samples in a RIFF file."""
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + bytes(len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + len(data), b"WAVE") + form + data


def unwav(media: bytes) -> tuple[int, bytes]:
    """The sample rate and the samples of such a file, found by walking its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at, rate = 12, None
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            if at + 8 + size > len(media):
                raise ValueError("cut short")
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data")


@functools.cache
def _taps(up: int, down: int) -> np.ndarray:
    """A Hann-windowed sinc low-pass with unit gain after upsampling by `up`."""
    widest = max(up, down)
    half = 8 * widest
    k = np.arange(-half, half + 1)
    h = np.sinc(k / widest) * np.hanning(2 * half + 3)[1:-1]
    return (h * up / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by up/down: each output takes only the taps of its own phase."""
    n_out = -(-len(x) * up // down)
    h = _taps(up, down)
    half = len(h) // 2
    y = np.empty(n_out, np.float32)
    for phase in range(up):  # outputs n = phase, phase + up, ... share (n * down + shift) mod up, hence their taps
        first = phase * down + half
        taps = h[first % up :: up]  # x[first // up - j] meets h[first % up + j * up]
        count = len(range(phase, n_out, up))
        back = taps[::-1].copy()
        lead = len(taps) - 1
        for at in range(0, count, BLOCK):
            m = min(BLOCK, count - at)
            start = first // up + at * down - lead
            stop = start + (m - 1) * down + len(taps)
            cut = np.zeros(stop - start, np.float32)
            a, b = max(0, start), min(len(x), stop)
            if b > a:
                cut[a - start : b - start] = x[a:b]
            rows = np.lib.stride_tricks.as_strided(cut, (m, len(taps)), (cut.strides[0] * down, cut.strides[0]), writeable=False)
            y[phase + at * up : phase + (at + m - 1) * up + 1 : up] = rows @ back
    return y


@functools.cache
def _mel_bank(rate: int) -> np.ndarray:
    """Triangles of equal width on the mel scale, one column per filter."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, MELS + 2) / 2595) - 1)
    hz = np.fft.rfftfreq(FRAME, 1 / rate)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((hz - low) / (mid - low), (high - hz) / (high - mid))).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log10 mel powers, log10 energy of each frame); at least one frame, the last one padded."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    bank, window = _mel_bank(rate), np.hanning(FRAME).astype(np.float32)
    mels, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for at in range(0, n, 2048):
        m = min(2048, n - at)
        cut = np.zeros((m - 1) * HOP + FRAME, np.float32)
        have = x[at * HOP : at * HOP + len(cut)]
        cut[: len(have)] = have
        frames = np.lib.stride_tricks.as_strided(cut, (m, FRAME), (HOP * cut.strides[0], cut.strides[0]), writeable=False) * window
        spectrum = np.fft.rfft(frames)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[at : at + m] = np.log10(power @ bank + np.float32(1e-10))
        energy[at : at + m] = np.log10((frames**2).mean(1) + np.float32(1e-10))
    return mels, energy


def segments(energy: np.ndarray, upper: float = 0.5, lower: float = 0.3) -> list[tuple[int, int]]:
    """Frame ranges [first, last): opened at `upper` of the way from floor to peak energy, closed under `lower` of it."""
    floor, peak = np.percentile(energy, [10, 95])
    if peak - floor < 1e-3:
        return []
    mark = np.where(energy >= floor + upper * (peak - floor), 1, np.where(energy < floor + lower * (peak - floor), 0, -1))
    known = np.where(mark >= 0, np.arange(len(mark)), -1)
    np.maximum.accumulate(known, out=known)
    on = np.where(known >= 0, mark[known], 0) == 1
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensors(mels: np.ndarray, rate: int) -> pa.RecordBatch:
    """Patches of PATCH x MELS as fixed-shape tensors, each with its span in seconds."""
    n = -(-len(mels) // PATCH)
    cut = np.full((n * PATCH, MELS), -10, np.float32)
    cut[: len(mels)] = mels
    starts = np.arange(n) * PATCH * HOP / rate
    ends = (np.minimum((np.arange(n) + 1) * PATCH, len(mels)) - 1) * HOP / rate + FRAME / rate
    shape = pa.FixedShapeTensorArray.from_numpy_ndarray(cut.reshape(n, PATCH, MELS))
    return pa.RecordBatch.from_arrays([shape, pa.array(starts), pa.array(ends)], names=["tensor", "start_s", "end_s"])


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(features: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patches x PATCH x MELS, starts, ends) of one row's features."""
    table = pa.ipc.open_stream(features).read_all().combine_chunks()
    column = table.column("tensor").chunk(0)
    return column.to_numpy_ndarray(), table.column("start_s").to_numpy(), table.column("end_s").to_numpy()


def features(media: bytes) -> tuple[bytes, bytes, list[tuple[float, float]], str]:
    """(payload, tensors as IPC, energy segments in seconds, a short description) of one stored file."""
    rate, payload = unwav(media)
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    common = np.gcd(rate, TARGET_RATE)
    y = resample(x, TARGET_RATE // common, rate // common)
    mels, energy = log_mel(y, TARGET_RATE)
    spans = [(a * HOP / TARGET_RATE, ((b - 1) * HOP + FRAME) / TARGET_RATE) for a, b in segments(energy)]
    batch = tensors(mels, TARGET_RATE)
    said = f"logmel:{batch.num_rows}x{PATCH}x{MELS};frames={len(mels)};mean={float(mels.mean(dtype=np.float64)):.4f};segments={len(spans)};voiced_s={sum(b - a for a, b in spans):.3f}"
    return payload, ipc(batch), spans, said


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a WAV, written to a Parquet table in the shared folder and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data = [x or b"" for x in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([wav(padded(x)) for x in data], pa.binary())], names=["id", "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    made = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary")
    return stored(made, "media").withColumnRenamed("id", id_col)


def audio_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The features of a media table, with digests of what was read back.

    id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature,
    segments array<struct<start_s,end_s>>, features binary (an Arrow IPC stream, see read_tensors).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cols: list[list] = [[] for _ in range(8)]
                for media in part.column(2).to_pylist():
                    payload, packed, spans, said = features(media)
                    row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), said, [{"start_s": a, "end_s": b} for a, b in spans], packed)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), spans_type, pa.binary())
                names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "segments", "features"]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, cols, types)], names=names)

    kind = media.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, segments array<struct<start_s:double,end_s:double>>, features binary"
    return media.select(F.col(id_col).alias("id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", id_col)
