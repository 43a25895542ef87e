"""Queries that score blocks by rules, choose candidates and settle conflicts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quireflow.functions import geometry as g
from quireflow.functions import rules as r
from quireflow.functions import scales as s
from quireflow.functions import text as tx
from quireflow.functions.rules import linear, peak
from quireflow.operators import candidates as c
from quireflow.operators import spatial as sp
from quireflow.plans.registry import query
from quireflow.sources.tables import BLOCKS_SQL, page_blocks

Named = tuple[Callable[[], Column], str]


def _page() -> g.Box:
    return g.Box(*map(F.lit, (0.0, 0.0, 600.0, 800.0)))


def _box() -> g.Box:
    return g.box()


def _tag() -> Column:
    return F.col("tag")


def _text() -> Column:
    return F.col("text")


def _size() -> Column:
    return F.col("font_size")


def _line(x: str, *points: tuple[float, float]) -> str:
    """A piecewise linear scale in SQL, clamped at its ends."""
    cases = [f"WHEN {x} <= {points[0][0]} THEN {points[0][1]}::DOUBLE"]
    for (a, u), (b, v) in zip(points, points[1:], strict=False):
        cases.append(f"WHEN {x} < {b} THEN {u}::DOUBLE + ({x} - {a}) / ({b} - {a}) * ({v - u})::DOUBLE")
    return f"(CASE {' '.join(cases)} ELSE {points[-1][1]}::DOUBLE END)"


def _peak(x: str, size: float) -> str:
    return _line(x, (size * 0.5, 0.0), (size, 1.0), (size * 1.5, 0.0))


def _flag(condition: str) -> str:
    return f"(CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def _if_text(score: str) -> str:
    return f"(CASE WHEN tag = 'Text' THEN {score} ELSE 0.0::DOUBLE END)"


_WD, _HT, _CX, _CY = "(x1 - x0)", "(y1 - y0)", "((x0 + x1) / 2)", "((y0 + y1) / 2)"
_FONT = f"coalesce(font_size, {_HT})"
_PAGE_VALUE = r"coalesce(nullif(regexp_extract(text, '^0*(\d{1,3})$', 1), ''), nullif(regexp_extract(text, '^(?i:page|p\.?)\s*0*(\d{1,3})$', 1), ''))::INT"
_STEP = r"nullif(regexp_extract(text, '^([1-9]\d{0,3})$', 1), '')::INT"
_PART = r"nullif(regexp_extract(text, '^([1-9]\d{3,7})$', 1), '')"

#: Each rule: its column and its SQL.
GEOMETRY: dict[str, Named] = {
    "in_band": (lambda: r.bottom_band(_box(), _page(), 0.1), _flag(f"{_CY} >= 720")),
    "not_in_band": (lambda: r.bottom_band(_box(), _page(), 0.1, invert=True), _flag(f"{_CY} < 720")),
    "corner": (lambda: r.corner(_box(), _page(), 50.0), f"exp(-sqrt(least(power({_CX}, 2), power({_CX} - 600, 2)) + power({_CY} - 800, 2)) / 50)"),
    "top_left": (
        lambda: r.top_left(_box(), _page(), linear((0.0, 1.0), (0.4, 0.0)), lambda x: s.discrete(x, [(0.0, 0.5, 1.0), (0.5, 1.0, 0.3)])),
        f"(CASE WHEN {_CY} / 800 > 0.4 THEN 0.0 ELSE 0.7 * {_line(f'({_CY} / 800)', (0.0, 1.0), (0.4, 0.0))} + 0.3 * CASE WHEN {_CX} / 600 >= 0 AND {_CX} / 600 < 0.5 THEN 1.0 WHEN {_CX} / 600 >= 0.5 AND {_CX} / 600 < 1 THEN 0.3 ELSE 0.0 END END)::DOUBLE",
    ),
    "size_range": (lambda: r.size_range(_box(), (5.0, 15.0), (5.0, 15.0)), _flag(f"{_WD} BETWEEN 5 AND 15 AND {_HT} BETWEEN 5 AND 15")),
    "size_preference": (lambda: r.size_preference(_box(), linear((8.0, 0.0), (25.0, 1.0), (37.5, 0.0))), _line(f"(({_WD} + {_HT}) / 2)", (8.0, 0.0), (25.0, 1.0), (37.5, 0.0))),
    "aspect": (lambda: r.aspect(_box(), 0.9, 1.5), _flag(f"{_WD} / {_HT} BETWEEN 0.9 AND 1.5")),
    "aspect_score": (lambda: r.aspect_score(_box(), linear((3.0, 0.0), (10.0, 1.0))), _line(f"({_WD} / {_HT})", (3.0, 0.0), (10.0, 1.0))),
    "coverage": (lambda: r.coverage(_box(), _page(), linear((0.85, 0.5), (1.0, 1.0))), _line(f"({_WD} * {_HT} / 480000)", (0.85, 0.5), (1.0, 1.0))),
    "edges": (lambda: r.edge_proximity(_box(), _page(), linear((4.0, 1.0), (300.0, 0.0))), _line("((abs(x0) + abs(x1 - 600) + abs(y0) + abs(y1 - 800)) / 4)", (4.0, 1.0), (300.0, 0.0))),
    "page_edge": (lambda: r.page_edge(_box(), _page(), 20.0), _flag("x1 <= 20 OR x0 >= 580 OR y1 <= 20 OR y0 >= 780")),
    "upright": (lambda: r.divider(_tag(), _box(), _page(), True, 5.0, 0.4, 5.0), _flag(f"tag = 'Drawing' AND {_WD} <= 5 AND {_HT} >= 320 AND x0 > 5 AND x1 < 595")),
    "level": (lambda: r.divider(_tag(), _box(), _page(), False, 9.0, 0.4, 5.0), _flag(f"tag = 'Drawing' AND {_HT} <= 9 AND {_WD} >= 240 AND y0 > 5 AND y1 < 795")),
    "size_ratio": (lambda: r.size_ratio(_box(), _page(), linear((0.015, 0.0), (0.1, 1.0), (0.4, 0.0))), f"(({_line(f'({_WD} / 600)', (0.015, 0.0), (0.1, 1.0), (0.4, 0.0))} + {_line(f'({_HT} / 800)', (0.015, 0.0), (0.1, 1.0), (0.4, 0.0))}) / 2)"),
    "bottom": (lambda: r.bottom_position(_box(), _page(), linear((0.0, 1.0), (0.2, 0.0))), _line("((800 - y1) / 800)", (0.0, 1.0), (0.2, 0.0))),
    "wide": (lambda: r.width_coverage(_box(), _page(), linear((0.4, 0.0), (0.8, 1.0))), _line(f"({_WD} / 600)", (0.4, 0.0), (0.8, 1.0))),
}
TEXTS: dict[str, Named] = {
    "is_text": (lambda: r.of_tag(_tag(), "Text"), _flag("tag = 'Text'")),
    "is_shape": (lambda: r.of_tag(_tag(), "Drawing", "Image"), _flag("tag IN ('Drawing', 'Image')")),
    "pattern": (lambda: r.matches(_tag(), _text(), r"\d+x"), _flag(r"tag = 'Text' AND regexp_matches(text, '^\d+x')")),
    "font": (lambda: r.font_size(_tag(), _size(), _box(), peak(20.0)), _if_text(_peak(_FONT, 20.0))),
    "font_range": (lambda: r.font_range(_tag(), _size(), linear((9.0, 0.0), (10.0, 0.7), (11.0, 1.0), (21.0, 1.0), (22.0, 0.0))), f"(CASE WHEN tag <> 'Text' OR font_size IS NULL THEN 0.0::DOUBLE ELSE {_line('font_size', (9.0, 0.0), (10.0, 0.7), (11.0, 1.0), (21.0, 1.0), (22.0, 0.0))} END)"),
    "page_value": (lambda: r.page_value(_tag(), _text(), F.col("page_no"), linear((0.0, 1.0), (10.0, 0.0))), f"(CASE WHEN tag = 'Text' AND {_PAGE_VALUE} IS NOT NULL THEN greatest(0.0, 1 - abs({_PAGE_VALUE} - page_no) / 10.0)::DOUBLE ELSE 0.0::DOUBLE END)"),
    "page_text": (lambda: r.page_text(_tag(), _text()), _if_text(r"CASE WHEN regexp_matches(text, '^0+\d{1,3}$') THEN 0.9::DOUBLE WHEN regexp_matches(text, '^\d{1,3}$') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")),
    "count_text": (lambda: r.count_text(_tag(), _text()), _flag(r"tag = 'Text' AND regexp_matches(text, '^\d{1,3}\s*[xX×]$')")),
    "part_text": (lambda: r.part_text(_tag(), _text()), _if_text(f"CASE length({_PART}) WHEN 4 THEN 0.5001::DOUBLE WHEN 5 THEN 0.5025::DOUBLE WHEN 6 THEN 0.5249::DOUBLE WHEN 7 THEN 0.97235::DOUBLE WHEN 8 THEN 0.50015::DOUBLE ELSE 0.0::DOUBLE END")),
    "bag_text": (lambda: r.bag_text(_tag(), _text()), _flag(r"tag = 'Text' AND regexp_matches(text, '^[1-9]\d?$')")),
    "bag_font": (lambda: r.bag_font(_tag(), _size(), linear((60.0, 1.0), (120.0, 0.5))), "(CASE WHEN tag <> 'Text' OR font_size IS NULL OR font_size < 35 THEN 0.0 WHEN font_size <= 60 THEN 1.0 ELSE greatest(0.5, 1 - (font_size - 60) / 120.0) END)::DOUBLE"),
    "step_text": (lambda: r.step_text(_tag(), _text()), _flag(rf"tag = 'Text' AND {_STEP} IS NOT NULL")),
    "length_value": (lambda: r.length_value(_tag(), _text()), _flag(r"tag = 'Text' AND coalesce(try_cast(regexp_extract(text, '^\+?(\d+)$', 1) AS BIGINT) BETWEEN 1 AND 32, false)")),
    "small_step": (lambda: r.step_at_most(_tag(), _text(), 10), _flag(f"tag = 'Text' AND coalesce({_STEP} <= 10, false)")),
    "smaller": (lambda: r.smaller_than(_tag(), _size(), _box(), F.when(F.col("page_no") % 2 == 0, 24.0)), f"(CASE WHEN tag <> 'Text' THEN 0.0 WHEN page_no % 2 = 1 THEN NULL WHEN {_FONT} / 24 < 0.85 THEN 1.0 WHEN {_FONT} / 24 < 1 THEN 0.7 ELSE 0.4 END)::DOUBLE"),
    "scale_text": (lambda: r.scale_text(_tag(), _text()), _flag(r"tag = 'Text' AND regexp_matches(text, '^1\s*:\s*1$')")),
    "size_match": (lambda: r.size_match(_size(), _box(), F.when(F.col("page_no") % 3 != 0, 24.0)), f"(CASE WHEN page_no % 3 = 0 THEN 0.5 ELSE greatest(0.0, 1 - abs({_FONT} - 24) / 24 * 2) END)::DOUBLE"),
}
_S, _F = "least(s0, 0.95)", "least(f0, 0.95)"
VISUAL: dict[str, Named] = {
    "line_color": (
        lambda: r.line_color(_tag(), F.col("stroke"), F.col("fill")),
        f"(CASE WHEN tag <> 'Drawing' THEN 0.0 WHEN s0 IS NOT NULL THEN CASE WHEN {_S} > 0.9 THEN 1.0 WHEN {_S} > 0.7 THEN 0.7 ELSE 0.3 END WHEN f0 IS NOT NULL THEN CASE WHEN {_F} > 0.9 THEN 0.8 WHEN {_F} > 0.7 THEN 0.5 ELSE 0.0 END ELSE 0.0 END)::DOUBLE",
    ),
    "curves": (lambda: r.curves(_tag(), F.col("n_curves"), 4), _flag("tag = 'Drawing' AND line >= 4")),
    "white": (lambda: F.coalesce(s.white_fill(F.col("fill"), 0.9), F.lit(0.0)), f"coalesce(CASE WHEN f0 IS NULL THEN 0.0 WHEN {_F} >= 0.9 THEN 1.0 WHEN {_F} > 0.7 THEN 0.6 + 0.4 * ({_F} - 0.7) / 0.3 ELSE 0.0 END, 0.0)::DOUBLE"),
    "not_white": (lambda: s.inverted(F.coalesce(s.white_fill(F.col("fill"), 0.9), F.lit(0.0))), f"1 - coalesce(CASE WHEN f0 IS NULL THEN 0.0 WHEN {_F} >= 0.9 THEN 1.0 WHEN {_F} > 0.7 THEN 0.6 + 0.4 * ({_F} - 0.7) / 0.3 ELSE 0.0 END, 0.0)::DOUBLE"),
    "held": (lambda: s.clamped(_size() / 20, 0.5, 1.5), "least(greatest(font_size / 20, 0.5), 1.5)::DOUBLE"),
    "same_color": (lambda: s.colors_match(F.col("stroke"), F.col("fill")), "coalesce(abs(s0 - f0) <= 0.1, false)"),
    "divider_shape": (lambda: r.best_of(GEOMETRY["upright"][0](), GEOMETRY["level"][0]()), f"greatest({GEOMETRY['upright'][1]}, {GEOMETRY['level'][1]})"),
}


def _scored(name: str, rules: dict[str, Named]) -> None:
    shown = ", ".join(f"{sql} AS {n}" if n in ("same_color",) else f"round({sql}, 6) AS {n}" for n, (_, sql) in rules.items())

    @query(name, f"WITH {BLOCKS_SQL} SELECT page, id, {shown} FROM blocks")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return page_blocks(spark, sf_dir).select("page", "id", *((col() if n in ("same_color",) else F.round(col(), 6)).alias(n) for n, (col, _) in rules.items()))


_scored("rules_geometry", GEOMETRY)
_scored("rules_text", TEXTS)
_scored("rules_visual", VISUAL)


@query(
    "rule_container_fit",
    f"""WITH {BLOCKS_SQL}, t AS (SELECT t.page, t.id, (d.x1 - d.x0) * (d.y1 - d.y0) / ((t.x1 - t.x0) * (t.y1 - t.y0)) AS ratio, d.id AS drawing FROM blocks t LEFT JOIN blocks d ON d.page = t.page AND d.tag <> 'Text' AND d.x0 <= t.x0 AND d.y0 <= t.y0 AND d.x1 >= t.x1 AND d.y1 >= t.y1 WHERE t.tag = 'Text')
SELECT page, id, max(CASE WHEN ratio IS NULL OR ratio > 6 THEN 0.0 WHEN ratio >= 2 AND ratio <= 4 THEN 1.0 WHEN ratio >= 1 AND ratio < 2 THEN 0.8 WHEN ratio > 4 THEN 0.6 ELSE 0.1 END)::DOUBLE AS score, arg_min(drawing, (ratio, drawing)) FILTER (ratio <= 6) AS fits FROM t GROUP BY page, id""",
)
def rule_container_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best fit of a text in the shapes that hold it, and the smallest of at most six times its area."""
    blocks = page_blocks(spark, sf_dir).select("page", "id", "tag", *sp.COORDS)
    a, b = g.box("a_"), g.box("b_")
    met = sp.theta_join(blocks.filter("tag = 'Text'"), blocks.filter("tag <> 'Text'"), "page", g.contains(b, a), "left").withColumn("ratio", g.area(b) / g.area(a))
    fit = F.coalesce(r.container_fit(F.col("ratio")), F.lit(0.0))
    smallest = F.min(F.when(F.col("ratio") <= 6, F.struct("ratio", "b_id")))["b_id"]
    fit = F.when(F.col("ratio").isNull(), 0.0).otherwise(fit)
    return met.groupBy("page", F.col("a_id").alias("id")).agg(F.max(fit).alias("score"), smallest.alias("fits"))


def _g(name: str) -> Named:
    return {**GEOMETRY, **TEXTS, **VISUAL}[name]


_STEP_COUNT = linear((9.0, 0.0), (10.0, 0.7), (11.0, 1.0), (21.0, 1.0), (22.0, 0.0))
_BACKGROUND = (lambda: r.edge_proximity(_box(), _page(), linear((4.0, 1.0), (54.0, 0.0))), _line("((abs(x0) + abs(x1 - 600) + abs(y0) + abs(y1 - 800)) / 4)", (4.0, 1.0), (54.0, 0.0)))
_FONT_AT = lambda size: (lambda: r.font_size(_tag(), _size(), _box(), peak(size)), _if_text(_peak(_FONT, size)))
_SMALLER = (lambda: r.smaller_than(_tag(), _size(), _box(), F.lit(24.0)), f"(CASE WHEN tag <> 'Text' THEN 0.0 WHEN {_FONT} / 24 < 0.85 THEN 1.0 WHEN {_FONT} / 24 < 1 THEN 0.7 ELSE 0.4 END)::DOUBLE")
_DRAWING = (lambda: r.of_tag(_tag(), "Drawing"), _flag("tag = 'Drawing'"))
_LOW = (lambda: r.bottom_band(_box(), _page(), 0.25), _flag(f"{_CY} >= 600"))
_EDGE = (lambda: r.page_edge(_box(), _page(), 4.0), _flag("x1 <= 4 OR x0 >= 596 OR y1 <= 4 OR y0 >= 796"))
_ROUND = (lambda: r.aspect(_box(), 0.7, 1.4), _flag(f"{_WD} / {_HT} BETWEEN 0.7 AND 1.4"))

#: Of each label its rules with weight and whether 0 rejects, and the least score.
LABELS: dict[str, tuple[list[tuple[Named, float, bool]], float]] = {
    "page_number": ([(_g("is_text"), 0.0, True), (_g("in_band"), 0.0, True), (_g("page_text"), 0.7, False), (_g("corner"), 0.3, False), (_g("page_value"), 1.0, False), (_FONT_AT(12.0), 0.1, False)], 0.5),
    "progress_bar_indicator": ([(_g("is_shape"), 0.0, True), (_LOW, 0.0, True), (_g("size_preference"), 0.5, True), (_g("aspect"), 0.5, True)], 0.0),
    "full_page_background": ([(_DRAWING, 0.0, True), (_g("coverage"), 0.7, True), (_BACKGROUND, 0.3, True)], 0.0),
    "page_edge": ([(_g("is_shape"), 0.0, True), (_EDGE, 0.0, True)], 0.0),
    "divider": ([(_DRAWING, 0.0, True), (_g("divider_shape"), 0.7, True), (_g("line_color"), 0.3, False)], 0.0),
    "bag_number": ([(_g("is_text"), 0.0, True), (_g("bag_text"), 0.4, True), (_g("top_left"), 0.4, True), (_g("bag_font"), 0.2, True)], 0.0),
    "part_number": ([(_g("is_text"), 0.0, True), (_g("part_text"), 0.7, True), (_FONT_AT(10.0), 0.3, False)], 0.5),
    "scale_text": ([(_g("is_text"), 0.0, True), (_g("scale_text"), 1.0, True)], 0.0),
    "shine": ([(_DRAWING, 0.0, True), (_g("size_range"), 0.3, True), (_ROUND, 0.7, True)], 0.0),
    "step_number": ([(_g("is_text"), 0.0, True), (_g("not_in_band"), 0.0, True), (_g("step_text"), 0.5, True), (_FONT_AT(10.0), 0.5, False)], 0.5),
    "substep_number": ([(_g("is_text"), 0.0, True), (_g("step_text"), 0.4, True), (_g("small_step"), 0.3, True), (_SMALLER, 0.3, False)], 0.5),
    "step_count": ([(_g("is_text"), 0.0, True), (_g("count_text"), 0.6, True), (_g("font_range"), 0.4, False)], 0.5),
}


def _label_sql(label: str) -> str:
    rules, least = LABELS[label]
    weight = sum(w for _, w, _ in rules)
    score = f"(({' + '.join(f'{sql} * {w}::DOUBLE' for (_, sql), w, _ in rules)}) / {weight}::DOUBLE)" if weight else "0.0::DOUBLE"
    needed = " AND ".join(f"{sql} <> 0" for (_, sql), _, required in rules if required)
    return f"SELECT page, id, '{label}' AS label, round({score}, 6) AS score FROM blocks WHERE {needed} AND {score} >= {least}"


_CANDIDATES_SQL = f"{BLOCKS_SQL}, cand AS ({' UNION ALL '.join(map(_label_sql, LABELS))})"


def candidates_of(blocks: DataFrame) -> DataFrame:
    """page, id, label and score of every block that is a candidate of a label; one pass over the blocks."""
    found = []
    for label, (rules, least) in LABELS.items():
        score, passed = r.classify([(column(), w, required) for (column, _), w, required in rules], least)
        found.append(F.when(passed, F.struct(F.lit(label).alias("label"), F.round(score, 6).alias("score"))))
    return blocks.select("page", "id", F.explode(F.array_compact(F.array(*found))).alias("c")).select("page", "id", "c.label", "c.score")


@query("label_candidates", f"WITH {_CANDIDATES_SQL} SELECT * FROM cand")
def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates_of(page_blocks(spark, sf_dir))


@query("page_number_proximity", f"""WITH {_CANDIDATES_SQL}, n AS (SELECT page, x0 AS nx0, x1 AS nx1 FROM cand JOIN blocks USING (page, id) WHERE label = 'page_number' QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, id) = 1)
SELECT page, id, CASE WHEN nx0 IS NULL THEN NULL WHEN least(abs(x0 - nx1), abs(x1 - nx0)) < 180 THEN 1.0 ELSE 0.0 END::DOUBLE AS near FROM blocks LEFT JOIN n USING (page)""")
def page_number_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block is near its page's best page number; null on pages without one."""
    blocks = page_blocks(spark, sf_dir)
    best = c.best(candidates_of(blocks).filter("label = 'page_number'"), ["page"], "id").select("page", "id")
    number = blocks.join(best, ["page", "id"]).select("page", *(F.col(x).alias(f"n_{x}") for x in sp.COORDS))
    return blocks.join(number, "page", "left").select("page", "id", r.beside(_box(), g.box("n_"), _page(), 0.3).alias("near"))


#: Labels in the order in which they take blocks.
_ORDER = ["page_number", "progress_bar_indicator", "full_page_background", "page_edge", "scale_text", "divider", "bag_number", "part_number", "shine", "step_count", "step_number", "substep_number"]
_RANK = f"list_position([{', '.join(f'{x!r}' for x in _ORDER)}], label)"


@query("label_winners", f"WITH {_CANDIDATES_SQL} SELECT page, id, label, score, row_number() OVER (PARTITION BY page, id ORDER BY {_RANK}) > 1 AS failed FROM cand")
def label_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one block: the label that is built first takes it, the others fail."""
    return c.settle_single(candidates_of(page_blocks(spark, sf_dir)), ["page", "id"], _ORDER)


@query(
    "label_report",
    f"""WITH {_CANDIDATES_SQL}, w AS (SELECT *, row_number() OVER (PARTITION BY page, id ORDER BY {_RANK}) = 1 AS won FROM cand) SELECT label, count(*) AS total, count(*) FILTER (score >= 0.5) AS scored, count(*) FILTER (won) AS built, max(score) AS best, count(DISTINCT page) AS pages FROM w GROUP BY label""",
)
def label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.report(c.settle_single(candidates_of(page_blocks(spark, sf_dir)), ["page", "id"], _ORDER), 0.5)


@query("unconsumed_blocks", f"WITH {_CANDIDATES_SQL} SELECT tag, count(*) AS n, count(DISTINCT page) AS pages FROM blocks WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.page = blocks.page AND cand.id = blocks.id) GROUP BY tag")
def unconsumed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that no built candidate holds, by type."""
    blocks = page_blocks(spark, sf_dir)
    built = c.settle_single(candidates_of(blocks), ["page", "id"], _ORDER).filter("NOT failed")
    return c.unconsumed(blocks, built, ["page", "id"]).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("page").alias("pages"))


@query("step_numbers", f"""WITH {_CANDIDATES_SQL} SELECT page, id, step, score FROM (SELECT page, id, {_STEP} AS step, score FROM cand JOIN blocks USING (page, id) WHERE label = 'step_number')
 QUALIFY row_number() OVER (PARTITION BY page, step ORDER BY score DESC, id) = 1""")
def step_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step numbers of a page, each value once: the best scored, first on ties."""
    blocks = page_blocks(spark, sf_dir)
    steps = candidates_of(blocks).filter("label = 'step_number'").join(blocks.select("page", "id", tx.step_number(_text()).alias("step")), ["page", "id"])
    return c.best(steps, ["page", "step"], "id").select("page", "id", "step", "score")


@query(
    "font_histogram",
    rf"""WITH {BLOCKS_SQL}, t AS (SELECT font_size AS size, CASE WHEN regexp_matches(text, '^\d+[xX]$') THEN 'part_count' WHEN regexp_matches(text, '^\d{{6,7}}$') THEN 'element_id' WHEN regexp_matches(text, '^\d+$') AND abs(text::BIGINT - page_no) <= 1 THEN 'page_number' WHEN regexp_matches(text, '^\d+$') THEN 'remaining' END AS bucket FROM blocks WHERE tag = 'Text' AND font_size IS NOT NULL)
SELECT bucket, size, count(*) AS n FROM t WHERE bucket IS NOT NULL GROUP BY 1, 2""",
)
def font_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts of each kind have each font size: kinds exclude each other in this order."""
    plain = tx.strip(_text())
    number = plain.rlike(r"^\d+$")
    bucket = F.when(plain.rlike(r"^\d+[xX]$"), "part_count").when(plain.rlike(r"^\d{6,7}$"), "element_id").when(number & (F.abs(plain.try_cast("bigint") - F.col("page_no")) <= 1), "page_number").when(number, "remaining")
    texts = page_blocks(spark, sf_dir).filter("tag = 'Text' AND font_size IS NOT NULL").select(bucket.alias("bucket"), _size().alias("size"))
    return texts.filter("bucket IS NOT NULL").groupBy("bucket", "size").agg(F.count(F.lit(1)).alias("n"))


@query(
    "overlapping_texts",
    f"WITH {BLOCKS_SQL} SELECT page, id, first_value(id) OVER w AS winner FROM blocks WHERE tag = 'Text' WINDOW w AS (PARTITION BY page, round_even(x0 / 0.5, 0), round_even(y0 / 0.5, 0), round_even(y1 / 0.5, 0) ORDER BY length(text) DESC, x1 - x0 DESC, id)",
)
def overlapping_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts at one place on a grid of half points: the longest, then the widest, then the first is kept."""
    cell = lambda x: F.bround(F.col(x) / 0.5, 0)
    over = Window.partitionBy("page", cell("x0"), cell("y0"), cell("y1")).orderBy(F.length("text").desc(), g.width(_box()).desc(), "id")
    return page_blocks(spark, sf_dir).filter("tag = 'Text'").select("page", "id", F.first("id").over(over).alias("winner"))


@query(
    "contained_effects",
    f"""WITH {BLOCKS_SQL} SELECT t.page, t.id, count(e.id) AS n, min(e.id) AS first_effect FROM blocks t LEFT JOIN blocks e ON e.page = t.page AND e.tag <> 'Text' AND e.x0 >= t.x0 - 30 AND e.y0 >= t.y0 - 30 AND e.x1 <= t.x1 + 30 AND e.y1 <= t.y1 + 30 AND (e.x1 - e.x0) * (e.y1 - e.y0) <= 4 * (t.x1 - t.x0) * (t.y1 - t.y0) WHERE t.tag = 'Text' GROUP BY 1, 2""",
)
def contained_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes wholly inside a text's box grown by a margin, up to a multiple of its area."""
    blocks = page_blocks(spark, sf_dir).select("page", "id", "tag", *sp.COORDS)
    a, b = g.box("a_"), g.box("b_")
    inside = g.contains(g.expand(a, 30.0), b) & (g.area(b) <= F.lit(4.0) * g.area(a))
    met = sp.theta_join(blocks.filter("tag = 'Text'"), blocks.filter("tag <> 'Text'"), "page", inside, "left")
    return met.groupBy("page", F.col("a_id").alias("id")).agg(F.count("b_id").alias("n"), F.min("b_id").alias("first_effect"))


@query(
    "clear_of_page",
    f"WITH {BLOCKS_SQL} SELECT page, id, x0 >= 0 AND y0 >= 0 AND x1 <= 600 AND y1 <= 800 AS inside, (x1 - x0) * (y1 - y0) >= 0.95 * 480000 AS full_page, (x1 - x0) >= 594 AND (y1 - y0) >= 792 AS background FROM blocks",
)
def clear_of_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a block lies inside its page, covers it, or spans it both ways."""
    b = page_blocks(spark, sf_dir)
    return b.select("page", "id", g.contains(_page(), _box()).alias("inside"), (g.area(_box()) >= F.lit(0.95) * g.area(_page())).alias("full_page"), ((g.width(_box()) >= F.lit(0.99) * g.width(_page())) & (g.height(_box()) >= F.lit(0.99) * g.height(_page()))).alias("background"))
