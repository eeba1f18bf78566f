"""Vectors as arrays of doubles: norms, clipping, cosine, and Gaussian noise for differential privacy."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DELTA = 1e-5


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once: inside a lambda over a vector it would be worked out for each component."""
    return F.transform(F.array(value), use)[0]


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays."""
    return _once(F.nullif(norm(v), F.lit(0.0)), lambda n: F.transform(v, lambda x: x / F.coalesce(n, F.lit(1.0))))


def scaled(v: Column, by: Column) -> Column:
    return _once(by, lambda b: F.transform(v, lambda x: x * b))


def clip_scale(length: Column, max_norm: float) -> Column:
    """The factor that brings a vector of ``length`` to ``max_norm`` at most."""
    return F.when(length > max_norm, F.lit(float(max_norm)) / length).otherwise(1.0)


def cosine_of(product: Column, a: Column, b: Column) -> Column:
    """Cosine from a dot product and two norms; a zero denominator counts as 1."""
    return product / F.when(a * b == 0, 1.0).otherwise(a * b)


def cosine(a: Column, b: Column) -> Column:
    return cosine_of(dot(a, b), norm(a), norm(b))


def gaussian_sigma(epsilon: float, delta: float = DELTA, sensitivity: float = 1.0) -> float:
    """Noise of the Gaussian mechanism. Its classic proof takes epsilon under 1 and, for replaced rows, twice the clip norm."""
    if epsilon <= 0 or not 0 < delta < 1:
        raise ValueError("epsilon must be positive and delta between 0 and 1")
    return math.sqrt(2 * math.log(1.25 / delta)) * sensitivity / epsilon


def sigma_column(epsilon: Column, delta: float = DELTA, sensitivity: float = 1.0) -> Column:
    return F.lit(math.sqrt(2 * math.log(1.25 / delta)) * sensitivity) / epsilon


def keyed_normal(*key: Column) -> Column:
    """A standard normal number that depends on ``key`` alone: repeatable anywhere, private only while the key is secret."""
    h = F.md5(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary"))
    u1 = (F.conv(F.substring(h, 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    u2 = F.conv(F.substring(h, 9, 8), 16, 10).cast("double") / 4294967296.0
    return F.sqrt(-2 * F.ln(u1)) * F.cos(2 * math.pi * u2)


def keyed_noise(size: Column, *key: Column) -> Column:
    """``size`` independent keyed normal numbers, one a dimension."""
    return F.transform(F.sequence(F.lit(0), size - 1), lambda i: keyed_normal(*key, i))


def with_noise(v: Column, noise: Column, sigma: Column) -> Column:
    return _once(sigma, lambda s: F.zip_with(v, noise, lambda x, z: x + s * z))


def random_noise(size: int) -> Column:
    """Fresh normal numbers for production use, where nothing may be predicted."""
    return F.array(*(F.randn() for _ in range(size)))


def private_vector(v: Column, noise: Column, sigma: Column, clip: float = 1.0, normalize: bool = True) -> Column:
    """Clip to ``clip``, add noise, and bring to unit length again if asked."""
    noisy = with_noise(scaled(v, clip_scale(norm(v), clip)), noise, sigma)
    return l2_normalize(noisy) if normalize else noisy
