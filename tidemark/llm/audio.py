"""Operator 3: media columns with audio features.

``store_media`` keeps samples losslessly as 8-bit mono WAV in a Parquet binary column;
``read_samples`` takes them out again. ``features`` resamples by a polyphase filter,
takes overlapped log-mel filterbank frames, finds active spans by an energy threshold
with hysteresis, and makes of each medium one Arrow IPC stream: a row a patch of frames, with
its start and end in milliseconds and a fixed-shape tensor ``[patch_frames, n_mels]`` of
16-bit floats. A short last patch is padded with the floor value. ``store_features``
keeps these streams beside the spans in Parquet, and ``tensor_means`` reads the tensors
back.

Defined cases: a null payload is an empty one, whose medium has no samples, no patch and
no span; rows that repeat stay; equal payloads give equal media and features, as each
row is computed by itself; an empty table gives an empty result. Long media are filtered
and framed in blocks, so memory beyond the samples themselves is bounded. Columns of the
input beside the id and the payload are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, new_path

FEATURE_SCHEMA = "n_frames int, patches binary, spans array<struct<start_ms: int, end_ms: int>>"


@dataclass(frozen=True)
class AudioSpec:
    """Rates in Hz, lengths in samples of the resampled signal, thresholds in dB over the medium's mean frame."""

    rate: int = 16_000
    up: int = 3
    down: int = 4
    taps_per_phase: int = 8
    frame: int = 384
    hop: int = 144
    n_mels: int = 40
    patch_frames: int = 16
    on_db: float = 0.5
    off_db: float = 0.1
    least_frames: int = 2
    block: int = 4_096

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down

    @cached_property
    def phases(self) -> np.ndarray:
        """The low-pass filter's taps, a row a phase, oldest sample first."""
        n = self.taps_per_phase * self.up
        at = np.arange(n) - (n - 1) / 2
        cut = 1 / max(self.up, self.down)
        taps = self.up * cut * np.sinc(cut * at) * np.hamming(n)
        return np.ascontiguousarray(taps.reshape(self.taps_per_phase, self.up).T[:, ::-1], np.float32)

    @cached_property
    def mel_bank(self) -> np.ndarray:
        """Triangles evenly spaced on the mel scale, [bins, n_mels]."""
        mel = lambda hz: 2595 * np.log10(1 + hz / 700)
        edges = 700 * (10 ** (np.linspace(0, mel(self.out_rate / 2), self.n_mels + 2) / 2595) - 1)
        bins = np.fft.rfftfreq(self.frame, 1 / self.out_rate)[:, None]
        rise, fall = (bins - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - bins) / np.diff(edges)[1:]
        return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)

    @cached_property
    def window(self) -> np.ndarray:
        return np.hanning(self.frame).astype(np.float32)


def wav(samples: bytes, rate: int) -> bytes:
    """8-bit mono PCM in a RIFF container (sizes wrap for media beyond 4 GB)."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples) & 0xFFFFFFFF)
    body = b"WAVE" + fmt + data
    return struct.pack("<4sI", b"RIFF", (len(body) + len(samples)) & 0xFFFFFFFF) + body + samples


def wav_samples(media: bytes) -> bytes:
    """The samples of what ``wav`` made: the chunk named data, to the end of the medium."""
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 :]


def resample(x: np.ndarray, spec: AudioSpec) -> np.ndarray:
    """``x`` at ``up / down`` of its rate: each phase of the filter makes every up-th sample."""
    n = len(x) * spec.up // spec.down
    t = spec.taps_per_phase
    out = np.empty(n, np.float32)
    padded = np.concatenate([np.zeros(t // 2, np.float32), x, np.zeros(t + spec.down, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, t)
    for phase in range(spec.up):
        count = len(range(phase, n, spec.up))
        first = phase * spec.down // spec.up
        taps = spec.phases[phase * spec.down % spec.up]
        for at in range(0, count, spec.block * 16):
            end = min(count, at + spec.block * 16)
            out[phase + at * spec.up : phase + end * spec.up : spec.up] = views[first + at * spec.down : first + end * spec.down : spec.down] @ taps
    return out


def log_mel(y: np.ndarray, spec: AudioSpec) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames [n, n_mels] and each frame's energy in dB; the last frame is padded, so that frames cover the whole signal."""
    if not len(y):
        return np.empty((0, spec.n_mels), np.float32), np.empty(0, np.float32)
    short = spec.frame - len(y) if len(y) <= spec.frame else -(len(y) - spec.frame) % spec.hop
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(y, (0, short)), spec.frame)[:: spec.hop]
    mels, energy = [], []
    for at in range(0, len(frames), spec.block):
        part = frames[at : at + spec.block]
        power = np.abs(np.fft.rfft(part * spec.window, axis=1)).astype(np.float32) ** 2
        mels.append(np.log(power @ spec.mel_bank + np.float32(1e-6)))
        energy.append(10 * np.log10(np.mean(part * part, axis=1) + 1e-10))
    return np.concatenate(mels), np.concatenate(energy)


def active_spans(energy: np.ndarray, spec: AudioSpec) -> list[tuple[int, int]]:
    """Frame spans that begin at ``on_db``, last while at ``off_db`` or more, and have ``least_frames``."""
    level = energy.mean() if len(energy) else 0.0
    edges = np.diff(np.concatenate([[0], (energy >= level + spec.off_db).astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    loud = np.concatenate([[0], np.cumsum(energy >= level + spec.on_db)])
    on = np.searchsorted(loud, loud[starts] + 1) - 1  # the first loud frame of each run
    return [(int(s), int(e)) for s, e in zip(on, ends) if s < e and e - s >= spec.least_frames]


def _patches(mels: np.ndarray, spec: AudioSpec) -> bytes:
    """An Arrow stream of fixed-shape tensors with time spans."""
    n = -(-len(mels) // spec.patch_frames)
    data = np.full((n * spec.patch_frames, spec.n_mels), np.log(1e-6), np.float16)
    data[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.float16(), [spec.patch_frames, spec.n_mels])
    tensors = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), spec.patch_frames * spec.n_mels))
    first = np.arange(n) * spec.patch_frames
    last = np.minimum(first + spec.patch_frames, len(mels)) - 1
    times = [pa.array((x * 1000 // spec.out_rate).astype(np.int64)) for x in (first * spec.hop, last * spec.hop + spec.frame)]
    batch = pa.RecordBatch.from_arrays([*times, tensors], names=["start_ms", "end_ms", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_patches(stream: bytes) -> pa.Table:
    """start_ms, end_ms and fixed-shape tensors of one medium."""
    return pa.ipc.open_stream(stream).read_all()


def describe(samples: bytes, spec: AudioSpec) -> dict:
    """Features of one medium's 8-bit samples."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(x, spec), spec)
    spans = active_spans(energy, spec)
    ms = lambda n: n * 1000 // spec.out_rate
    return {
        "n_frames": len(mels),
        "patches": _patches(mels, spec),
        "spans": [{"start_ms": ms(s * spec.hop), "end_ms": ms((e - 1) * spec.hop + spec.frame)} for s, e in spans],
    }


def store_media(rows: DataFrame, payload: str = "payload", unit: int = 192, spec: AudioSpec = AudioSpec(), path: str | None = None) -> DataFrame:
    """Write doc_id, n_bytes and ``media``, and read them back.

    The binary ``payload`` is padded with byte 32 to a positive multiple of ``unit``.
    """
    path = path or new_path(rows.sparkSession, "media")

    def make():
        def one(b):
            bodies = [p or b"" for p in b.column(payload).to_pylist()]
            media = [wav(p.ljust(max(1, -(-len(p) // unit)) * unit), spec.rate) for p in bodies]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(p) for p in bodies], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

        return one

    schema = "doc_id long, n_bytes long, media binary"
    arrow_map(rows, ["doc_id", payload], make, schema).write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


def features(media: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media and the features of its samples."""
    import hashlib

    names = ["n_frames", "patches", "spans"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, " + FEATURE_SCHEMA

    def make():
        types = [pa.int32(), pa.binary(), pa.list_(pa.struct([("start_ms", pa.int32()), ("end_ms", pa.int32())]))]

        def one(b):
            media = b.column("media").to_pylist()
            samples = [wav_samples(m) for m in media]
            found = [describe(s, spec) for s in samples]
            own = [
                pa.array([len(s) for s in samples], pa.int64()),
                pa.array([hashlib.sha256(s).hexdigest() for s in samples]),
                pa.array([zlib.crc32(s[-16:]) for s in samples], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media]),
            ]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *own, *(pa.array([f[n] for f in found], t) for n, t in zip(names, types))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", *names])

        return one

    return arrow_map(media, ["doc_id", "n_bytes", "media"], make, schema)


def store_features(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Write what ``features`` makes, tensors and spans, and read it back."""
    path = path or new_path(rows.sparkSession, "features")
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def tensor_means(stored: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """The columns of stored features and ``mel_mean``, from the tensors read back; the padding stays out."""

    def make():
        def mean(stream: bytes, frames: int) -> list[float]:
            tensors = read_patches(stream).column("log_mel").combine_chunks()
            data = tensors.storage.flatten().to_numpy(zero_copy_only=False).reshape(-1, spec.n_mels)[:frames]
            return data.mean(axis=0, dtype=np.float64).tolist() if frames else [0.0] * spec.n_mels

        def one(b):
            found = [mean(s, n) for s, n in zip(b.column("patches").to_pylist(), b.column("n_frames").to_pylist())]
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.float64()))], names=[*b.schema.names, "mel_mean"])

        return one

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema)
    return arrow_map(stored, stored.columns, make, f"{kept}, mel_mean array<double>")


def feature_digest():
    """A short text of stored features: frames, spans, the mean log-mel of the tensors to two decimals, and the SHA-256 of the stored stream."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start_ms"], s["end_ms"])), ",")
    means = F.array_join(F.transform("mel_mean", lambda x: F.round(x, 2).cast("string")), ",")
    return F.concat_ws("|", F.col("n_frames").cast("string"), spans, means, F.sha2("patches", 256))
