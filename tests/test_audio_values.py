"""Values, not lengths, of audio features against their definitions, written out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexwind.functions import audio as A

RATE = 24_000


def signal(n, seed=2):
    draw = np.random.default_rng(seed)
    return (0.2 * np.sin(np.arange(n) / 7) + 0.05 * draw.normal(size=n)).astype(np.float32)


def mel_by_hand(x, frame, n_fft=1024, hop=256, bands=100):
    """One frame of the log-mel: a reflected signal, a Hann window, the transform term by term, triangles on the HTK scale."""
    half = n_fft // 2
    at = lambda i: x[i] if 0 <= i < len(x) else x[-i] if i < 0 else x[2 * (len(x) - 1) - i]
    part = np.array([at(frame * hop - half + k) * (0.5 - 0.5 * math.cos(2 * math.pi * k / n_fft)) for k in range(n_fft)])
    k = np.arange(n_fft)
    power = np.array([abs(np.sum(part * np.exp(-2j * np.pi * f * k / n_fft))) for f in range(half + 1)])
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    edges = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, mel(RATE / 2), bands + 2)]
    out = []
    for b in range(bands):
        low, middle, high = edges[b : b + 3]
        weights = [max(0.0, min((f * RATE / n_fft - low) / (middle - low), (high - f * RATE / n_fft) / (high - middle))) for f in range(half + 1)]
        out.append(math.log(max(1e-5, float(np.dot(weights, power)))))
    return out


def test_mels_through_spark(spark):
    waves = [signal(6000).tolist(), None, signal(3000, 5).tolist(), signal(2600, 6).tolist()]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(waves)], "i long, x array<float>").repartition(2)
    got = {r.i: r.m for r in rows.select("i", A.mel_spectrogram(F.col("x")).alias("m")).collect()}
    assert got[1] is None
    for i, x in enumerate(waves):
        if x is None:
            continue
        m = np.array(got[i])
        assert m.shape == (100, 1 + len(x) // 256)
        for frame in (0, 1, m.shape[1] // 2, m.shape[1] - 1):
            assert m[:, frame] == pytest.approx(mel_by_hand(np.array(x, dtype=np.float64), frame), abs=2e-4)


def trimmed_by_hand(x, top_db=20.0, frame=2048, hop=512):
    wide = np.concatenate((np.zeros(frame // 2), x, np.zeros(frame // 2)))
    power = [max(1e-10, float(np.mean(wide[a : a + frame] ** 2))) for a in range(0, len(wide) - frame + 1, hop)]
    loud = [k for k, p in enumerate(power) if 10 * math.log10(p) > 10 * math.log10(max(power)) - top_db]
    return x[loud[0] * hop : min(len(x), (loud[-1] + 1) * hop)]


def test_silence_at_the_ends_goes(spark):
    x = np.concatenate((np.zeros(9000), signal(8000), np.zeros(7000))).astype(np.float32)
    r = spark.createDataFrame([(x.tolist(),), (None,), ([],)], "x array<float>").select(A.trim_silence(F.col("x")).alias("t")).collect()
    assert r[0].t == pytest.approx(trimmed_by_hand(x).tolist()) and r[1].t is None and r[2].t == []


def test_resampled_tones_are_tones(spark):
    n = np.arange(4000)
    rows = spark.createDataFrame([(np.sin(2 * np.pi * 300 * n / 16_000).tolist(),)], "x array<float>")
    got = np.array(rows.select(A.resample(F.col("x"), 16_000, RATE).alias("y")).first().y)
    assert len(got) == 6000
    assert got[200:-200] == pytest.approx(np.sin(2 * np.pi * 300 * np.arange(6000) / RATE)[200:-200], abs=0.01)


def test_wav_there_and_back(spark):
    x = signal(1000)
    rows = spark.createDataFrame([(x.tolist(),), (None,)], "x array<float>").select(A.encode_wav(F.col("x")).alias("b"))
    back = rows.select(A.decode_audio(F.col("b")).alias("y"), A.wav_seconds(F.col("b")).alias("s")).collect()
    assert back[0].y == pytest.approx((np.round(x * 32767) / 32768).tolist(), abs=1e-6) and back[0].s == pytest.approx(1000 / RATE) and back[1].y is None and back[1].s is None
