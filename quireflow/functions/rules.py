"""Rules that score a block of a page, as column expressions.

A rule gives a score from 0 to 1, or null where it has nothing to say.  Blocks
have ``tag`` (Text, Drawing, Image), ``text``, ``font_size``, ``stroke``, ``fill``
(arrays of channels) and ``n_curves``; a scale is a function from a column to a score.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quireflow.functions import geometry as g
from quireflow.functions import scales as s
from quireflow.functions import text as tx
from quireflow.functions.geometry import Box

Scale = Callable[[Column], Column]


def _yes(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def of_tag(tag: Column, *tags: str) -> Column:
    return _yes(tag.isin(*tags))


def _only(tag: Column, kind: str, score: Column) -> Column:
    return F.when(tag == kind, score).otherwise(0.0)


def best_of(*scores: Column) -> Column:
    """The greatest score that is not null."""
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


# position and size


def bottom_band(b: Box, page: Box, share: float, invert: bool = False) -> Column:
    inside = g.center(b)[1] >= page.y1 - g.height(page) * share
    return _yes(~inside) if invert else _yes(inside)


def corner(b: Box, page: Box, scale: float) -> Column:
    """Decays with the distance of the centre to the nearer bottom corner."""
    x, y = g.center(b)
    away = lambda cx: F.sqrt((x - cx) * (x - cx) + (y - page.y1) * (y - page.y1))
    return F.exp(-F.least(away(page.x0), away(page.x1)) / scale)


def top_left(b: Box, page: Box, vertical: Scale, horizontal: Scale, weights: tuple[float, float] = (0.7, 0.3)) -> Column:
    x, y = g.center(b)
    down, across = (y - page.y0) / g.height(page), (x - page.x0) / g.width(page)
    return F.when(down > 0.4, 0.0).otherwise(weights[0] * vertical(down) + weights[1] * horizontal(across))


def size_range(b: Box, width: tuple[float | None, float | None] = (None, None), height: tuple[float | None, float | None] = (None, None)) -> Column:
    fits = F.lit(True)
    for size, (low, high) in ((g.width(b), width), (g.height(b), height)):
        fits = fits & (size >= low) if low is not None else fits
        fits = fits & (size <= high) if high is not None else fits
    return _yes(fits)


def size_preference(b: Box, scale: Scale) -> Column:
    return scale((g.width(b) + g.height(b)) / 2)


def aspect(b: Box, low: float, high: float) -> Column:
    return F.when(g.height(b) <= 0, 0.0).otherwise(s.in_range(g.width(b) / F.nullif(g.height(b), F.lit(0.0)), low, high))


def aspect_score(b: Box, scale: Scale) -> Column:
    return F.when(g.height(b) <= 0, 0.0).otherwise(scale(g.width(b) / F.nullif(g.height(b), F.lit(0.0))))


def coverage(b: Box, page: Box, scale: Scale) -> Column:
    return F.when(g.area(page) <= 0, 0.0).otherwise(scale(g.area(b) / F.nullif(g.area(page), F.lit(0.0))))


def edge_proximity(b: Box, page: Box, scale: Scale) -> Column:
    """Scores the mean distance of the four sides to those of the page."""
    return scale((F.abs(b.x0 - page.x0) + F.abs(b.x1 - page.x1) + F.abs(b.y0 - page.y0) + F.abs(b.y1 - page.y1)) / 4)


def page_edge(b: Box, page: Box, margin: float = 4.0) -> Column:
    """Whether the block lies wholly in the margin of one side."""
    return _yes((b.x1 <= page.x0 + margin) | (b.x0 >= page.x1 - margin) | (b.y1 <= page.y0 + margin) | (b.y0 >= page.y1 - margin))


def divider(tag: Column, b: Box, page: Box, upright: bool, thickness: float, length: float, margin: float) -> Column:
    """A thin, long drawing that does not touch the page's sides."""
    if upright:
        shape, free = (g.width(b) <= thickness) & (g.height(b) >= g.height(page) * length), (b.x0 > page.x0 + margin) & (b.x1 < page.x1 - margin)
    else:
        shape, free = (g.height(b) <= thickness) & (g.width(b) >= g.width(page) * length), (b.y0 > page.y0 + margin) & (b.y1 < page.y1 - margin)
    return _only(tag, "Drawing", _yes(shape & free))


def container_fit(ratio: Column) -> Column:
    """Scores the area of a drawing that holds a text as a multiple of the text's; beyond 6 it does not count."""
    return F.when(ratio > 6, 0.0).when((ratio >= 2) & (ratio <= 4), 1.0).when((ratio >= 1) & (ratio < 2), 0.8).when(ratio > 4, 0.6).otherwise(0.1)


def size_ratio(b: Box, page: Box, scale: Scale) -> Column:
    w, h = F.nullif(g.width(page), F.lit(0.0)), F.nullif(g.height(page), F.lit(0.0))
    return F.when((g.width(page) <= 0) | (g.height(page) <= 0), 0.0).otherwise((scale(g.width(b) / w) + scale(g.height(b) / h)) / 2)


def bottom_position(b: Box, page: Box, scale: Scale) -> Column:
    return scale((page.y1 - b.y1) / g.height(page))


def width_coverage(b: Box, page: Box, scale: Scale) -> Column:
    return F.when(g.width(page) <= 0, 0.0).otherwise(scale(g.width(b) / F.nullif(g.width(page), F.lit(0.0))))


def beside(b: Box, other: Box, page: Box, share: float) -> Column:
    """Whether a block ends or begins near another one across the page; null without the other one."""
    away = F.least(F.abs(b.x0 - other.x1), F.abs(b.x1 - other.x0))
    return F.when(other.x0.isNull(), None).otherwise(_yes(away < g.width(page) * share))


# text


def matches(tag: Column, text: Column, pattern: str) -> Column:
    """Whether the text begins with the pattern."""
    return _only(tag, "Text", _yes(tx.strip(text).rlike(f"^(?:{pattern})")))


def font_size(tag: Column, size: Column, b: Box, scale: Scale) -> Column:
    """Scores the font size, or the block's height where it is not known."""
    return _only(tag, "Text", scale(F.coalesce(size, g.height(b))))


def font_range(tag: Column, size: Column, scale: Scale) -> Column:
    return F.when((tag != "Text") | size.isNull(), 0.0).otherwise(scale(size))


def page_value(tag: Column, text: Column, page_number: Column, scale: Scale) -> Column:
    found = tx.page_number(text)
    return F.when((tag != "Text") | found.isNull(), 0.0).otherwise(s.clamped(scale(F.abs(found - page_number).cast("double"))))


def page_text(tag: Column, text: Column) -> Column:
    plain = tx.strip(text)
    return _only(tag, "Text", F.when(plain.rlike(r"^0+\d{1,3}$"), 0.9).when(plain.rlike(r"^\d{1,3}$"), 1.0).otherwise(0.0))


def count_text(tag: Column, text: Column) -> Column:
    return _only(tag, "Text", _yes(tx.part_count(text).isNotNull()))


def part_text(tag: Column, text: Column) -> Column:
    found = tx.element_id(text)
    return _only(tag, "Text", F.when(found.isNull(), 0.0).otherwise(s.part_number_length(found)))


def bag_text(tag: Column, text: Column) -> Column:
    return _only(tag, "Text", _yes(tx.bag_number(text).isNotNull()))


def bag_font(tag: Column, size: Column, scale: Scale) -> Column:
    """Large type: nothing below 35 points, all up to 60, then by the scale but half at least."""
    big = F.when(size < 35, 0.0).when(size <= 60, 1.0).otherwise(s.clamped(scale(size), 0.5, 1.0))
    return F.when((tag != "Text") | size.isNull(), 0.0).otherwise(big)


def step_text(tag: Column, text: Column) -> Column:
    return _only(tag, "Text", _yes(tx.step_number(text).isNotNull()))


def length_value(tag: Column, text: Column) -> Column:
    """Whole numbers from 1 to 32, with a sign or leading zeros or without."""
    found = F.regexp_extract(tx.strip(text), r"^\+?(\d+(?:_\d+)*)$", 1)
    value = F.nullif(F.replace(found, F.lit("_"), F.lit("")), F.lit("")).try_cast("bigint")
    return _only(tag, "Text", _yes(F.coalesce(value.between(1, 32), F.lit(False))))


def step_at_most(tag: Column, text: Column, most: int) -> Column:
    return _only(tag, "Text", _yes(F.coalesce(tx.step_number(text) <= most, F.lit(False))))


def smaller_than(tag: Column, size: Column, b: Box, reference: Column, share: float = 0.85) -> Column:
    ratio = F.coalesce(F.nullif(size, F.lit(0.0)), g.height(b)) / reference
    known = F.when(ratio < share, 1.0).when(ratio < 1, 0.7).otherwise(0.4)
    return F.when(tag != "Text", 0.0).when(reference.isNull(), None).otherwise(known)


def scale_text(tag: Column, text: Column) -> Column:
    return _only(tag, "Text", _yes(tx.is_scale(text)))


def size_match(size: Column, b: Box, target: Column) -> Column:
    """How near a font size is to a target: half without a target, nothing from half the target away."""
    off = F.abs(F.coalesce(size, g.height(b)) - target) / F.nullif(target, F.lit(0.0))
    return F.when(target.isNull(), 0.5).when(target == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - off * 2))


# colours and shapes


def line_color(tag: Column, stroke: Column, fill: Column) -> Column:
    """White lines first; a colour of other than three channels is an error, as a drawing without RGB was not expected."""
    least = lambda c: F.when(F.size(c) == 3, F.array_min(c)).otherwise(F.raise_error(F.lit("three channels expected")).cast("double"))
    line = F.when(least(stroke) > 0.9, 1.0).when(least(stroke) > 0.7, 0.7).otherwise(0.3)
    area = F.when(least(fill) > 0.9, 0.8).when(least(fill) > 0.7, 0.5).otherwise(0.0)
    return _only(tag, "Drawing", F.when(stroke.isNotNull(), line).when(fill.isNotNull(), area).otherwise(0.0))


def curves(tag: Column, n_curves: Column, least: int) -> Column:
    return _only(tag, "Drawing", _yes(F.coalesce(n_curves >= least, F.lit(False))))


def linear(*points: tuple[float, float]) -> Scale:
    return lambda x: s.linear(x, points)


def peak(size: float) -> Scale:
    """One at a size, nothing at half and at one and a half of it."""
    return linear((size * 0.5, 0.0), (size, 1.0), (size * 1.5, 0.0))


Rule = tuple[Column, float, bool]


def classify(rules: Sequence[Rule], least: float = 0.0) -> tuple[Column, Column]:
    """The weighted score, and whether a block is a candidate: no required rule is 0 and the score reaches ``least``."""
    score, passed = s.weighted(rules)
    return score, passed & (score >= least)
