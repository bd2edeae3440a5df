"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for nulls, different lengths and vanishing vectors."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (scale > 1e-9)
    return F.when(usable, dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_norm(a: Column) -> Column:
    length = F.sqrt(F.greatest(dot(a, a), F.lit(1e-12)))
    return F.transform(a.cast("array<double>"), lambda x: x / length)


def squared_distance(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def centroid_of(centroids: Column, speaker: Column) -> Column:
    """A speaker's vector out of a map with lower-case keys; null if there is none."""
    return F.try_element_at(centroids, F.lower(speaker))


def mix(a: Column, b: Column, gain_a: float = 1.0, gain_b: float = 1.0) -> Column:
    """Sum of two signals with a soft limit beyond 0.9."""

    def limited(x: Column) -> Column:
        soft = F.signum(x) * (0.90 + 0.10 * F.tanh((F.abs(x) - 0.90) / 0.10))
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(F.abs(x) > 0.90, soft).otherwise(x)))

    zero = F.lit(0.0)
    return F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: limited(F.coalesce(x, zero) * gain_a + F.coalesce(y, zero) * gain_b))


def downmix(frames: Column) -> Column:
    """Mean over the channels of each frame."""
    return F.transform(frames, lambda c: F.aggregate(c.cast("array<double>"), F.lit(0.0), lambda s, x: s + x) / F.size(c))


def resample(samples: Column, source_rate: int, target_rate: int) -> Column:
    """Linear interpolation to floor(n / ratio) samples."""
    ratio = source_rate / target_rate
    n = F.size(samples)
    count = F.floor(n / ratio).cast("int")

    def value(i: Column) -> Column:
        at = i * ratio
        low = F.floor(at).cast("int")
        a = F.get(samples, low).cast("double")
        b = F.coalesce(F.get(samples, F.least(low + 1, n - 1)).cast("double"), a)
        return a + (b - a) * (at - low)

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), value)).otherwise(F.array().cast("array<double>"))


def pcm16(samples: Column) -> Column:
    """Clamped and truncated 16-bit values."""
    return F.transform(samples.cast("array<double>"), lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("int"))


def rms(samples: Column) -> Column:
    x = samples.cast("array<double>")
    return F.coalesce(F.least(F.lit(1.0), F.sqrt(F.try_divide(dot(x, x), F.size(x)))), F.lit(0.0))


def peak(samples: Column) -> Column:
    return F.coalesce(F.least(F.lit(1.0), F.array_max(F.transform(samples.cast("array<double>"), lambda x: F.abs(x)))), F.lit(0.0))
