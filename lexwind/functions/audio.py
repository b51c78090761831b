"""Audio as arrays of samples: decoding, resampling, silence and mel features, in Arrow functions over numpy.

Put row filters on text in front of these; Spark doesn't reorder them.
"""

from __future__ import annotations

import io
import math
import subprocess
import wave
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexwind.functions.maths import HOP, SAMPLE_RATE


def read_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """(samples, channels) in [-1, 1] and the rate of 8, 16, 24 or 32 bit PCM."""
    with wave.open(io.BytesIO(raw)) as f:
        width, channels, rate, data = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / (1 << (8 * width - 1))
    return x.reshape(-1, channels), rate


def write_wav(samples: np.ndarray, rate: int) -> bytes:
    """16 bit PCM, mono."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def resampled(x: np.ndarray, rate: int, wanted: int, zeros: int = 6, rolloff: float = 0.99) -> np.ndarray:
    """Windowed-sinc resampling as signal libraries define it (Hann window, `zeros` zero crossings), ceil(n * wanted / rate) samples."""
    if rate == wanted or not len(x):
        return x.astype(np.float32)
    g = math.gcd(rate, wanted)
    a, b = rate // g, wanted // g
    cutoff = min(a, b) * rolloff
    width = math.ceil(zeros * a / cutoff)
    offsets = np.arange(-width, width + a)
    t = np.clip((np.arange(0, -b, -1)[:, None] / b + offsets[None, :] / a) * cutoff, -zeros, zeros)
    kernels = np.sinc(t) * np.cos(t * np.pi / zeros / 2) ** 2 * cutoff / a
    wide = np.pad(x.astype(np.float64), (width, width + a))
    blocks = np.lib.stride_tricks.sliding_window_view(wide, kernels.shape[1])[::a]
    return (blocks @ kernels.T).reshape(-1)[: math.ceil(len(x) * wanted / rate)].astype(np.float32)


def decoded(raw: bytes, wanted: int, mix_first: bool = True, first_channel: bool = False) -> np.ndarray | None:
    """Mono samples at the wanted rate; null if the bytes are no WAV. Channels are averaged before or after resampling, or only the first is taken."""
    try:
        x, rate = read_wav(raw)
    except (wave.Error, EOFError, KeyError, ValueError):
        return None
    if first_channel:
        return resampled(x[:, 0], rate, wanted)
    if mix_first:
        return resampled(x.mean(axis=1), rate, wanted)
    return np.stack([resampled(x[:, c], rate, wanted) for c in range(x.shape[1])]).mean(axis=0)


@lru_cache
def mel_filters(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters on the HTK scale by their public definition, (bins, mels)."""
    mel = lambda hz: 2595 * np.log10(1 + hz / 700)
    points = 700 * (10 ** (np.linspace(0, mel(rate / 2), n_mels + 2) / 2595) - 1)
    hz = np.linspace(0, rate // 2, n_fft // 2 + 1)
    slopes = points[None, :] - hz[:, None]
    steps = np.diff(points)
    return np.maximum(0, np.minimum(-slopes[:, :-2] / steps[:-1], slopes[:, 2:] / steps[1:]))


@lru_cache
def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def log_mel(x: np.ndarray, rate: int = SAMPLE_RATE, n_fft: int = 1024, hop: int = HOP, n_mels: int = 100) -> np.ndarray:
    """(mels, 1 + n // hop): magnitudes of centred Hann frames, mel filters, logarithm of at least 1e-5."""
    wide = np.pad(np.asarray(x, dtype=np.float64), n_fft // 2, mode="reflect" if len(x) > n_fft // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(wide, n_fft)[::hop]
    spectrum = np.fft.rfft(frames * hann(n_fft))
    return np.log(np.maximum(np.abs(spectrum) @ mel_filters(rate, n_fft, n_mels), 1e-5)).T


def trimmed_silence(x: np.ndarray, top_db: float = 20.0, frame: int = 2048, hop: int = 512) -> np.ndarray:
    """Between the first and the last frame within `top_db` of the loudest one."""
    if not len(x):
        return x
    wide = np.pad(np.asarray(x, dtype=np.float64), frame // 2)
    power = (np.lib.stride_tricks.sliding_window_view(wide, frame)[::hop] ** 2).mean(axis=1)
    loud = np.flatnonzero(10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(max(power.max(), 1e-10)) > -top_db)
    return x[: 0] if not len(loud) else x[loud[0] * hop : min(len(x), (loud[-1] + 1) * hop)]


def as_column(made: list[np.ndarray | float | bytes | None], kind: str) -> pa.Array:
    """An Arrow column of what a batch's rows were made into; arrays go in as one flat buffer and their shapes."""
    if not kind.startswith("array"):
        return pa.array(made, {"double": pa.float64(), "binary": pa.binary()}[kind])
    missing = pa.array([x is None for x in made])
    held = [x for x in made if x is not None]
    flat = np.concatenate([np.empty(0, dtype=np.float32), *(np.asarray(x, dtype=np.float32).ravel() for x in held)], dtype=np.float32)
    sizes = [0 if x is None else len(x) for x in made]
    values: pa.Array = pa.array(flat)
    if kind == "array<array<float>>":
        inner = np.cumsum([0, *(width for x in held for width in [x.shape[1]] * x.shape[0])])
        values = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), values)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), values, mask=missing)


def rows_of(column: pa.Array) -> list[np.ndarray | bytes | None]:
    """A batch's values: samples as parts of the column's own buffer, bytes as they are."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, at, null = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    return [None if n else flat[a:b] for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), null.tolist(), strict=True)]


def per_row(kind: str, made: Callable, value: Column) -> Column:
    """An Arrow function over flat buffers that maps each value but null."""

    def run(column: pa.Array) -> pa.Array:
        return as_column([None if x is None else made(x) for x in rows_of(column)], kind)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)(value)


def wav_seconds(raw: Column) -> Column:
    """Duration by the header; null if the bytes are no WAV."""

    def probe(b: bytes) -> float | None:
        try:
            with wave.open(io.BytesIO(b)) as f:
                return f.getnframes() / f.getframerate()
        except (wave.Error, EOFError, ZeroDivisionError):
            return None

    return per_row("double", probe, raw)


def decode_audio(raw: Column, rate: int = SAMPLE_RATE, mix_first: bool = True, first_channel: bool = False) -> Column:
    return per_row("array<float>", lambda b: decoded(b, rate, mix_first, first_channel), raw)


def resample(samples: Column, rate: int, wanted: int = SAMPLE_RATE) -> Column:
    return per_row("array<float>", lambda x: resampled(x, rate, wanted), samples)


def mel_spectrogram(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    return per_row("array<array<float>>", lambda x: log_mel(x, rate), samples)


def trim_silence(samples: Column, top_db: float = 20.0) -> Column:
    return per_row("array<float>", lambda x: trimmed_silence(x, top_db), samples)


def encode_wav(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    return per_row("binary", lambda x: write_wav(x, rate), samples)


def decoded_mp3(raw: bytes, wanted: int, ffmpeg: str = "ffmpeg") -> np.ndarray | None:
    """Mono samples through an ffmpeg child process; null if it fails or gives under 100 bytes."""
    try:
        made = subprocess.run([ffmpeg, "-v", "error", "-i", "pipe:0", "-f", "f32le", "-ac", "1", "-ar", str(wanted), "pipe:1"], input=raw, capture_output=True, check=False)
    except OSError:
        return None
    return np.frombuffer(made.stdout, "<f4") if made.returncode == 0 and len(made.stdout) >= 100 else None


def decode_mp3(raw: Column, rate: int = SAMPLE_RATE, ffmpeg: str = "ffmpeg") -> Column:
    return per_row("array<float>", lambda b: decoded_mp3(b, rate, ffmpeg), raw)


def at_full_scale(x: np.ndarray) -> np.ndarray:
    """Divided by the peak and clamped to [-1, 1]; near silence stays as it is."""
    top = float(np.abs(x).max(initial=0.0))
    return x if top < 1e-8 or math.isnan(top) else np.clip(x / (top + 1e-7), -1.0, 1.0).astype(np.float32)


def voice(raw: Column, rate: int = SAMPLE_RATE, read=decoded, model=None, trim: bool = True) -> Column:
    """Bytes to samples in one pass: read, denoised if there is a model, at full scale, without silence at the ends; null if unreadable."""

    def run(b: bytes) -> np.ndarray | None:
        x = read(b, rate)
        if x is None:
            return None
        if model is not None:
            x = denoised(x, model)
        x = at_full_scale(x)
        return trimmed_silence(x) if trim else x

    return per_row("array<float>", run, raw)


def denoised(x: np.ndarray, model) -> np.ndarray:
    """The model's output, or the samples themselves where it fails."""
    try:
        return np.asarray(model(np.asarray(x)), dtype=np.float32)
    except Exception:  # noqa: BLE001  each row fails for itself
        return np.asarray(x, dtype=np.float32)


def denoise(samples: Column, model) -> Column:
    """Apply a pluggable model (samples -> samples); a row on which it fails keeps its samples."""
    return per_row("array<float>", lambda x: denoised(x, model), samples)


def concat_with_pause(waveforms: Column, rate: int = SAMPLE_RATE, pause: float = 0.25) -> Column:
    """One waveform of an array of waveforms; a pause lies between them, unless it is not positive."""
    gap = max(0, int(rate * pause))
    silence = F.array_repeat(F.lit(0.0), gap)
    joined = F.transform(waveforms, lambda w, i: F.when((i > 0) & F.lit(gap > 0), F.concat(silence, w)).otherwise(w))
    return F.flatten(joined)
