"""Numeric columns to scores, and rule scores combined by weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.functions import geometry as g


def boolean(x: Column, threshold: float) -> Column:
    return F.when(x >= threshold, 1.0).otherwise(0.0)


def linear(x: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Piecewise linear through the points, constant beyond the ends."""
    ordered = sorted(points)
    out = F.lit(float(ordered[-1][1]))
    for (a, u), (b, v) in reversed(list(zip(ordered, ordered[1:], strict=False))):
        inner = F.lit(float(v)) if b == a else F.lit(float(u)) + (x - a) / (b - a) * (v - u)
        out = F.when(x < b, inner).otherwise(out)
    return F.when(x <= ordered[0][0], float(ordered[0][1])).otherwise(out)


def decay(x: Column, scale: float) -> Column:
    return F.exp(-x / scale)


def discrete(x: Column, ranges: Sequence[tuple[float, float, float]], default: float = 0.0) -> Column:
    """The value of the first half-open range that holds x."""
    out = F.lit(float(default))
    for low, high, value in reversed(ranges):
        out = F.when((x >= low) & (x < high), float(value)).otherwise(out)
    return out


def threshold(x: Column, steps: Sequence[tuple[float, float]], default: float = 0.0) -> Column:
    """The value of the highest threshold reached."""
    out = F.lit(float(default))
    for least, value in sorted(steps):
        out = F.when(x >= least, float(value)).otherwise(out)
    return out


def inverted(score: Column) -> Column:
    return 1.0 - score


def clamped(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(score, F.lit(float(low))), F.lit(float(high)))


def in_range(x: Column, low: float, high: float) -> Column:
    return F.when((x >= low) & (x <= high), 1.0).otherwise(0.0)


def triangular(x: Column, low: float, ideal: float, high: float) -> Column:
    up, down = (x - low) / (ideal - low), (high - x) / (high - ideal)
    return F.when((x <= low) | (x >= high), 0.0).when(x <= ideal, up).otherwise(down)


def white_fill(color: Column, least: float) -> Column:
    """How white an RGB fill is; other numbers of channels score 0."""
    darkest = F.array_min(color)
    return F.when(F.size(color) != 3, 0.0).when(darkest >= least, 1.0).when(darkest > 0.7, 0.6 + 0.4 * (darkest - 0.7) / 0.3).otherwise(0.0)


def colors_match(a: Column, b: Column, tolerance: float = 0.1) -> Column:
    near = F.forall(F.zip_with(a, b, lambda p, q: F.abs(p - q) <= tolerance), lambda t: F.coalesce(t, F.lit(False)))
    return F.coalesce((F.size(a) == F.size(b)) & near, F.lit(False))


def ramp(x: Column, low: float, high: float, least: float = 0.0, most: float = 1.0) -> Column:
    """Linear from ``least`` at ``low`` to ``most`` at ``high``, constant beyond."""
    return F.when(x <= low, float(least)).when(x >= high, float(most)).otherwise(F.lit(float(least)) + (x - low) / (high - low) * (most - least))


def weighted(rules: Sequence[tuple[Column, float, bool]]) -> tuple[Column, Column]:
    """The mean of the scores that are not null, by weight, and whether no required one is 0.

    A null score drops out of numerator and denominator; without any weight the
    mean is 0.
    """
    total, weight, passed = F.lit(0.0), F.lit(0.0), F.lit(True)
    for score, w, required in rules:
        total = total + F.coalesce(score * w, F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), float(w)).otherwise(0.0)
        if required:
            passed = passed & F.coalesce(score != 0.0, F.lit(True))
    return F.when(weight > 0, total / weight).otherwise(0.0), passed


#: Share of part numbers by their length.
PART_NUMBER_LENGTHS = {4: 0.0002, 5: 0.005, 6: 0.0498, 7: 0.9447, 8: 0.0003}


def part_number_length(text: Column) -> Column:
    share = F.lit(0.0)
    for n, p in PART_NUMBER_LENGTHS.items():
        share = F.when(F.char_length(text) == n, p).otherwise(share)
    return 0.5 + 0.5 * share


def beside_top_left(a: g.Box, b: g.Box, tolerance: float) -> Column:
    """How well the centre of ``a`` stands left of and above that of ``b``.

    Each axis is 1 on the right side, falls to half at the tolerance and to 0 at twice
    of it; their geometric mean gets up to 0.2 more near the upper left corner of ``b``.
    """
    (px, py), (qx, qy) = g.center(a), g.center(b)

    def axis(off: Column) -> Column:
        near, far = F.lit(1.0) - off / tolerance * 0.5, F.lit(0.5) - (off - tolerance) / tolerance * 0.5
        return F.when(off <= 0, 1.0).when(off <= tolerance, near).otherwise(F.greatest(F.lit(0.0), far))

    away = F.sqrt((px - b.x0) * (px - b.x0) + (py - b.y0) * (py - b.y0))
    bonus = F.when(away <= tolerance, F.lit(0.2) * (F.lit(1.0) - away / tolerance)).otherwise(0.0)
    return F.least(F.lit(1.0), F.sqrt(axis(px - qx) * axis(py - qy)) + bonus)


def nearness(a: g.Box, b: g.Box, most: float) -> Column:
    """Falls from 1 to 0 with the distance from the centre of ``a`` to the nearest point of ``b``."""
    x, y = g.center(a)
    dx, dy = x - F.least(F.greatest(x, b.x0), b.x1), y - F.least(F.greatest(y, b.y0), b.y1)
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(dx * dx + dy * dy) / most)
