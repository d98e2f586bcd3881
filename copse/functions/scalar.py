"""Scalar column expressions: links, intervals, impurities and the portable hash draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Clamping bounds and normal quantiles by significance level.
CLAMP = 1e-5
Z_TABLE = [(0.01, 2.576), (0.05, 1.96), (0.10, 1.645)]
Z_ELSE = 1.28


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def clamp(p: Column, low: float = CLAMP, high: float = 1 - CLAMP) -> Column:
    return F.greatest(F.least(p, F.lit(high)), F.lit(low))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def softmax(scores: Column) -> Column:
    """Max-shifted softmax of an array column."""
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def z_of(alpha: float) -> float:
    return next((z for a, z in Z_TABLE if alpha <= a), Z_ELSE)


def wilson(p: Column, n: Column | float, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of a share p seen over n, clipped to [0, 1]."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    z2 = z * z
    centre = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def gini(class_weights: list[Column], total: Column) -> Column:
    out = F.lit(1.0)
    for c in class_weights:
        out = out - (c / total) * (c / total)
    return out


def variance(w: Column, wy: Column, wyy: Column) -> Column:
    """Weighted population variance from sums."""
    return wyy / w - (wy / w) * (wy / w)


def draw(seed: int, *parts: Column) -> Column:
    """A portable pseudo-random number below 2**60: the first fifteen hex digits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def draw_py(seed: int, *parts) -> int:
    """The same number on the driver."""
    import hashlib

    return int(hashlib.md5(":".join(map(str, (seed, *parts))).encode()).hexdigest()[:15], 16)


def shapley_weight(size: int, others: int) -> float:
    """s! (k - s - 1)! / k! for a coalition of size s among k = others + 1 players."""
    from math import factorial

    return factorial(size) * factorial(others - size) / factorial(others + 1)
