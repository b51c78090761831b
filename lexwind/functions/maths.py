"""Durations, schedules and array arithmetic around training and sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_RATE, HOP = 24_000, 256


def frames(seconds: Column, sample_rate: int = SAMPLE_RATE, hop: int = HOP) -> Column:
    """Mel frames of a duration, not rounded."""
    return seconds * sample_rate / hop


def seconds(samples: Column, sample_rate: int = SAMPLE_RATE) -> Column:
    return samples / sample_rate


def target_frames(target_tokens: Column, reference_tokens: Column | None = None, reference_frames: Column | None = None, chars: Column | None = None, duration: Column | None = None, speed: Column | None = None) -> Column:
    """Frames to synthesise: of an explicit duration, else in proportion to a reference, else 13 a character."""
    speed = F.lit(1.0) if speed is None else speed
    made = F.greatest(F.lit(50), F.floor(F.greatest(chars if chars is not None else target_tokens, F.lit(1)) * 13 / speed)).cast("long")
    if reference_frames is not None and reference_tokens is not None:
        from_reference = F.greatest(F.lit(50), F.floor(reference_frames * target_tokens / F.greatest(reference_tokens, F.lit(1)) / speed)).cast("long")
        made = F.when(reference_frames.isNotNull(), from_reference).otherwise(made)
    if duration is not None:
        made = F.when(duration.isNotNull(), F.greatest(F.lit(1), F.floor(frames(duration))).cast("long")).otherwise(made)
    return made


def chunk_weight(text: Column) -> Column:
    """Characters other than spaces, 1 at least."""
    return F.greatest(F.lit(1), F.length(F.replace(text, F.lit(" "), F.lit(""))))


def learning_rate(step: Column, peak: float, warmup: int, total: int, floor: float = 1e-6, start: float = 1e-4) -> Column:
    """Linear from start * peak to peak over the warm-up, then cosine down to the floor."""
    rising = F.lit(peak) * (F.lit(start) + (F.lit(1.0 - start)) * step / max(warmup, 1))
    past = (step - warmup) / max(total - warmup, 1)
    falling = F.lit(floor) + F.lit(peak - floor) * (1 + F.cos(past * math.pi)) / 2
    return F.when(step < warmup, rising).otherwise(falling)


def sway_steps(n: int, sway: float = -1.0) -> Column:
    """Times 0 to 1 in n steps, bent by the sway coefficient."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: (i / n) + F.lit(sway) * (F.cos(i / n * (math.pi / 2)) - 1 + i / n))


def interpolate(noise: Column, data: Column, t: Column) -> Column:
    """(1 - t) * noise + t * data."""
    return F.zip_with(noise, data, lambda a, b: (1 - t) * a + t * b)


def flow(noise: Column, data: Column) -> Column:
    return F.zip_with(noise, data, lambda a, b: b - a)


def euler_step(x: Column, velocity: Column, dt: Column) -> Column:
    return F.zip_with(x, velocity, lambda a, v: a + v * dt)


def guided(conditioned: Column, free: Column, strength: Column) -> Column:
    """Classifier-free guidance: p + (p - p0) * strength."""
    return F.zip_with(conditioned, free, lambda p, q: p + (p - q) * strength)


def safe_log(values: Column, least: float = 1e-5) -> Column:
    return F.transform(values, lambda x: F.log(F.greatest(x, F.lit(least))))


def peak(values: Column) -> Column:
    return F.array_max(F.transform(values, lambda x: F.abs(x)))


def peak_normalized(values: Column) -> Column:
    """Divided by the peak and clamped to [-1, 1]; near silence stays as it is."""
    p = peak(values)
    return F.when((p < 1e-8) | p.isNull(), values).otherwise(F.transform(values, lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x / (p + 1e-7)))))


def min_max_normalized(values: Column) -> Column:
    low, high = F.array_min(values), F.array_max(values)
    return F.transform(values, lambda x: (x - low) / F.greatest(high - low, F.lit(1e-8)))


def masked_mean_square(made: Column, wanted: Column, mask: Column) -> Column:
    """Mean of squared differences where the mask holds; null if it nowhere does."""
    errors = F.zip_with(mask, F.zip_with(made, wanted, lambda a, b: (a - b) * (a - b)), lambda m, e: F.when(m, e))
    held = F.filter(errors, lambda e: e.isNotNull())
    return F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda s, e: s + e) / F.size(held))


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def steps_per_epoch(batches: Column, accumulation: int) -> Column:
    return F.greatest(F.lit(1), F.floor(batches / accumulation)).cast("long")


def sine(seconds_: float = 2.0, hz: float = 220.0, amplitude: float = 0.3, sample_rate: int = SAMPLE_RATE) -> Column:
    """A test tone as an array of samples."""
    n = int(seconds_ * sample_rate)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.sin(i * (2 * math.pi * hz / sample_rate)) * amplitude)
