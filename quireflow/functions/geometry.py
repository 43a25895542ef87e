"""Axis-parallel boxes as column expressions.

A box is four double columns; :func:`box` names them by prefix.  ``overlaps`` and
``contains`` are closed (touching counts), the one-axis overlaps are open.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")))


def width(b: Box) -> Column:
    return b.x1 - b.x0


def height(b: Box) -> Column:
    return b.y1 - b.y0


def area(b: Box) -> Column:
    return width(b) * height(b)


def center(b: Box) -> tuple[Column, Column]:
    return (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2


def to_int(b: Box) -> Box:
    """Coordinates cut towards zero."""
    return Box(*(c.cast("int") for c in b))


def equals(a: Box, b: Box) -> Column:
    return (a.x0 == b.x0) & (a.y0 == b.y0) & (a.x1 == b.x1) & (a.y1 == b.y1)


def similar(a: Box, b: Box, tolerance: float = 1.0) -> Column:
    out = F.lit(True)
    for p, q in zip(a, b, strict=True):
        out = out & (F.abs(p - q) <= tolerance)
    return out


def overlaps(a: Box, b: Box) -> Column:
    return (a.x0 <= b.x1) & (b.x0 <= a.x1) & (a.y0 <= b.y1) & (b.y0 <= a.y1)


def contains(outer: Box, inner: Box) -> Column:
    return (outer.x0 <= inner.x0) & (outer.y0 <= inner.y0) & (outer.x1 >= inner.x1) & (outer.y1 >= inner.y1)


def overlaps_horizontal(a: Box, b: Box) -> Column:
    return (a.x0 < b.x1) & (b.x0 < a.x1)


def overlaps_vertical(a: Box, b: Box) -> Column:
    return (a.y0 < b.y1) & (b.y0 < a.y1)


def adjacent(a: Box, b: Box, tolerance: float = 1e-6) -> Column:
    sides = (F.abs(a.x1 - b.x0) < tolerance) | (F.abs(b.x1 - a.x0) < tolerance)
    ends = (F.abs(a.y1 - b.y0) < tolerance) | (F.abs(b.y1 - a.y0) < tolerance)
    return (sides & overlaps_vertical(a, b)) | (ends & overlaps_horizontal(a, b))


def intersection_area(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    h = F.greatest(F.lit(0.0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return w * h


def iou(a: Box, b: Box) -> Column:
    shared = intersection_area(a, b)
    joint = area(a) + area(b) - shared
    return F.when((shared > 0) & (joint > 0), shared / joint).otherwise(F.lit(0.0))


def min_distance(a: Box, b: Box) -> Column:
    dx = F.greatest(F.lit(0.0), b.x0 - a.x1, a.x0 - b.x1)
    dy = F.greatest(F.lit(0.0), b.y0 - a.y1, a.y0 - b.y1)
    return F.sqrt(dx * dx + dy * dy)


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x0, b.x0), F.least(a.y0, b.y0), F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1))


def intersect(a: Box, b: Box) -> Box:
    """The shared box; an axis without overlap shrinks to the middle of the gap."""

    def axis(lo: Column, hi: Column) -> tuple[Column, Column]:
        middle = (lo + hi) / 2
        return F.when(lo > hi, middle).otherwise(lo), F.when(lo > hi, middle).otherwise(hi)

    x0, x1 = axis(F.greatest(a.x0, b.x0), F.least(a.x1, b.x1))
    y0, y1 = axis(F.greatest(a.y0, b.y0), F.least(a.y1, b.y1))
    return Box(x0, y0, x1, y1)


def scale(b: Box, factor: float) -> Box:
    return Box(*(c * factor for c in b))


def expand(b: Box, margin: float) -> Box:
    """Grown by a margin; a negative margin that turns the box inside out is an error."""
    bad = (b.x0 - margin > b.x1 + margin) | (b.y0 - margin > b.y1 + margin)
    checked = F.when(bad, F.raise_error(F.lit("the margin inverts the box")).cast("double")) if margin < 0 else None
    grown = (b.x0 - margin, b.y0 - margin, b.x1 + margin, b.y1 + margin)
    return Box(*(checked.otherwise(c) if checked is not None else c for c in grown))


def clip(b: Box, bounds: Box) -> Box:
    """Cut to ``bounds``; a box outside shrinks to the nearest edge."""
    fit = lambda c, lo, hi: F.least(F.greatest(c, lo), hi)
    return Box(fit(b.x0, bounds.x0, bounds.x1), fit(b.y0, bounds.y0, bounds.y1), fit(b.x1, bounds.x0, bounds.x1), fit(b.y1, bounds.y0, bounds.y1))


def segment_hits(px: Column, py: Column, qx: Column, qy: Column, b: Box) -> Column:
    """Whether a segment meets a box: its parameter interval survives both slabs."""
    dx, dy = qx - px, qy - py

    def slab(p: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
        near = F.when(d == 0, F.lit(0.0)).otherwise(F.least((lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))))
        far = F.when(d == 0, F.lit(1.0)).otherwise(F.greatest((lo - p) / F.nullif(d, F.lit(0.0)), (hi - p) / F.nullif(d, F.lit(0.0))))
        return near, far, (d != 0) | ((p >= lo) & (p <= hi))

    nx, fx, okx = slab(px, dx, b.x0, b.x1)
    ny, fy, oky = slab(py, dy, b.y0, b.y1)
    return okx & oky & (F.greatest(nx, ny, F.lit(0.0)) <= F.least(fx, fy, F.lit(1.0)))


def union_all(b: Box) -> list[Column]:
    """Aggregates that bound all boxes of a group."""
    return [F.min(b.x0).alias("x0"), F.min(b.y0).alias("y0"), F.max(b.x1).alias("x1"), F.max(b.y1).alias("y1")]
