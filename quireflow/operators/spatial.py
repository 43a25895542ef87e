"""Joins of boxes on one page, nesting, clusters and de-duplication.

Inputs have a page key, ``id`` (unique and ordered on the page) and x0, y0, x1,
y1.  All joins are equi-joins on the page with the geometry as condition, so
they are hash or sort-merge joins whose work stays within a page.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import geometry as g

COORDS = ("x0", "y0", "x1", "y1")


def prefixed(boxes: DataFrame, page: str, prefix: str) -> DataFrame:
    return boxes.withColumnsRenamed({c: f"{prefix}{c}" for c in boxes.columns if c != page})


def pairs(boxes: DataFrame, page: str) -> DataFrame:
    """All unordered pairs of one page as a_* and b_* columns."""
    return prefixed(boxes, page, "a_").join(prefixed(boxes, page, "b_"), page).filter("a_id < b_id")


def theta_join(left: DataFrame, right: DataFrame, page: str, condition: Column, how: str = "inner") -> DataFrame:
    """Rows a_* and b_* of one page that meet a condition on the prefixed columns."""
    r = prefixed(right, page, "b_").withColumnRenamed(page, "b_page")
    left_ = prefixed(left, page, "a_")
    return left_.join(r, (left_[page] == r["b_page"]) & condition, how).drop("b_page")


def smallest_container(boxes: DataFrame, page: str) -> DataFrame:
    """Each box with its parent: the smallest other box that holds it (first on ties), null for roots."""
    a, b = g.box("a_"), g.box("b_")
    held = theta_join(boxes.select(page, "id", *COORDS), boxes.select(page, "id", *COORDS), page, g.contains(b, a) & (F.col("a_id") != F.col("b_id")) & ~g.equals(a, b), "left")
    rank = F.row_number().over(Window.partitionBy(page, "a_id").orderBy(g.area(b).asc_nulls_last(), "b_id"))
    return held.withColumn("rank", rank).filter("rank = 1").select(page, F.col("a_id").alias("id"), F.col("b_id").alias("parent_id"))


def depths(parents: DataFrame, page: str) -> DataFrame:
    """Adds the depth of every box below its root, page by page."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        at = {k: i for i, k in enumerate(zip(pdf[page].tolist(), pdf["id"].tolist(), strict=True))}
        up = np.array([at.get(k, -1) for k in zip(pdf[page].tolist(), pdf["parent_id"].tolist(), strict=True)], np.int64)
        depth = (up >= 0).astype(np.int64)
        while (up >= 0).any():  # each turn doubles the steps that are known
            depth, up = depth + np.where(up >= 0, depth[up], 0), np.where(up >= 0, up[up], -1)
        return pdf.assign(depth=depth)

    schema = f"{page} long, id int, parent_id int, depth long"
    return by_page(parents.select(page, "id", "parent_id"), page, lambda pdf: fold(pdf).astype({"parent_id": "Int32"}), schema)


def by_page(df: DataFrame, page: str, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies an ordered fold to whole pages.

    Rows are dealt and sorted by page; each call of ``fold`` gets all pages that end in
    a batch of rows, one after the other, numbered from 0 in the column of the page, and
    returns rows with these numbers.  Rows without a page are one page.
    """
    none = f"{page}__none"

    def turns(pdf: pd.DataFrame) -> np.ndarray:
        where, missing = pdf[page].to_numpy(), pdf[none].to_numpy(bool)
        return np.flatnonzero((where[1:] != where[:-1]) | (missing[1:] != missing[:-1])) + 1

    def whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        first = np.concatenate([[0], turns(pdf)])
        where, missing = pdf[page].to_numpy()[first], pdf[none].to_numpy(bool)[first]
        number = np.zeros(len(pdf), np.int64)
        number[first[1:]] = 1
        out = fold(pdf.drop(columns=none).assign(**{page: np.cumsum(number)}))
        at = out[page].to_numpy(np.int64)
        return out.assign(**{page: pd.arrays.IntegerArray(where[at], missing[at])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the parts of the last page
        for batch in batches:
            if not len(batch):
                continue
            cut = int(max(turns(batch), default=0))
            if cut:
                yield whole([*held, batch.iloc[:cut]])
                held = []
            elif held and any(held[-1][c].iloc[-1] != batch[c].iloc[0] for c in (page, none)):
                yield whole(held)
                held = []
            held.append(batch.iloc[cut:])
        if held:
            yield whole(held)

    # a null among the pages would make a batch's pages floats
    known = df.withColumns({none: F.col(page).isNull(), page: F.coalesce(F.col(page).cast("long"), F.lit(0).cast("long"))})
    return known.repartition(page).sortWithinPartitions(page, none).mapInPandas(run, schema)


def page_components(nodes: DataFrame, edges: DataFrame, page: str) -> DataFrame:
    """(page, id, cluster): the least id of each box's component within its page.

    Only boxes with an edge leave the JVM; every other one is its own component.
    """

    def join(links: pd.DataFrame) -> pd.DataFrame:
        ends = np.stack([np.tile(links[page].to_numpy(np.int64), 2), np.concatenate([links["a_id"], links["b_id"]]).astype(np.int64)])
        order = np.lexsort((ends[1], ends[0]))
        ends = ends[:, order]
        new = np.concatenate([[True], (ends[:, 1:] != ends[:, :-1]).any(axis=0)])
        # boxes numbered by page and id, so that the least number of a component is its least id
        box = np.empty(len(order), np.int64)
        box[order] = np.cumsum(new) - 1
        ends = ends[:, new]
        root = list(range(ends.shape[1]))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in zip(box[: len(links)].tolist(), box[len(links) :].tolist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        return pd.DataFrame({page: ends[0], "id": ends[1], "cluster": ends[1][[find(i) for i in root]]})

    linked = by_page(edges.select(page, "a_id", "b_id"), page, join, f"{page} long, id int, cluster int")
    return nodes.select(page, "id").join(linked, [page, "id"], "left").select(page, "id", F.coalesce("cluster", "id").alias("cluster"))


def clusters(boxes: DataFrame, page: str, tolerance: float = 1e-6) -> DataFrame:
    """Components of boxes that overlap after growing by ``tolerance``."""
    touching = pairs(boxes.select(page, "id", *COORDS), page).filter(g.overlaps(g.expand(g.box("a_"), tolerance), g.box("b_")))
    return page_components(boxes, touching, page)


def duplicates(boxes: DataFrame, page: str, keys: list[str], least_iou: float = 0.9) -> DataFrame:
    """Adds ``winner``: the largest box (first on ties) of each component of near-equal boxes.

    Two boxes are near-equal if their visual keys agree (null equals null) and
    their IoU reaches ``least_iou``.
    """
    both = pairs(boxes.select(page, "id", *COORDS, *keys), page)
    alike = g.iou(g.box("a_"), g.box("b_")) >= least_iou
    for k in keys:
        alike = alike & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    found = page_components(boxes, both.filter(alike), page)
    sized = boxes.join(found, [page, "id"])
    best = Window.partitionBy(page, "cluster").orderBy(g.area(g.box()).desc(), "id")
    return sized.withColumn("winner", F.first("id").over(best))


def first_of_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__rank = 1").drop("__rank")


def similar_groups(boxes: DataFrame, page: str, tolerance: float = 2.0) -> DataFrame:
    """Greedy groups: a box joins the first group whose first member is similar (not transitive)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["id"], pdf[page]))]
        number, x = pdf[page].to_numpy(), pdf[list(COORDS)].to_numpy(float)
        out, left, turn = np.zeros(len(pdf), np.int64), np.arange(len(pdf)), 0
        while len(left):  # on every page the first box left heads a group, and what is similar joins it
            first = np.flatnonzero(np.concatenate([[True], number[left[1:]] != number[left[:-1]]]))
            head = np.repeat(left[first], np.diff(np.concatenate([first, [len(left)]])))
            near = (np.abs(x[head] - x[left]) <= tolerance).all(axis=1)
            near[first] = True
            out[left[near]] = turn
            left, turn = left[~near], turn + 1
        return pd.DataFrame({page: number, "id": pdf["id"].to_numpy(), "grp": out})

    return by_page(boxes.select(page, "id", *COORDS), page, fold, f"{page} long, id int, grp long")


Assign = Callable[[np.ndarray], list[tuple[int, int]]]
#: Costs up to which Python numbers are faster than arrays; changes no result.
FEW_COSTS = 100


def _few_assigned(cost: list[list[float]]) -> list[tuple[int, int]]:
    """:func:`optimal_assignment` of a small table of no more rows than columns, step by step the same."""
    n, m = len(cost), len(cost[0])
    row_price, column_price, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        slack, back, seen, free = [math.inf] * (m + 1), [0] * (m + 1), [], list(range(1, m + 1))
        while owner[at]:
            seen.append(at)
            if at:
                free.remove(at)
            row = cost[owner[at] - 1]
            price, least, nxt = row_price[owner[at]], math.inf, 0
            for j in free:
                reduced = row[j - 1] - price - column_price[j]
                if reduced < slack[j]:
                    slack[j], back[j] = reduced, at
                if slack[j] < least:
                    least, nxt = slack[j], j
            if not math.isfinite(least):
                return []
            for j in seen:
                row_price[owner[j]] += least
                column_price[j] -= least
            for j in free:
                slack[j] -= least
            at = nxt
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return sorted((owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])


def optimal_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least total cost by shortest augmenting paths; empty if no complete finite assignment exists."""
    if not cost.size:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in optimal_assignment(cost.T))
    if cost.size <= FEW_COSTS:
        return _few_assigned(cost.tolist())
    n, m = cost.shape
    row_price, column_price, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        slack, seen, back = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while owner[at]:
            seen[at] = True
            free = ~seen
            free[0] = False
            reduced = cost[owner[at] - 1] - row_price[owner[at]] - column_price[1:]
            better = free[1:] & (reduced < slack[1:])
            slack[1:][better], back[1:][better] = reduced[better], at
            rest = np.where(free, slack, np.inf)
            nxt = int(rest.argmin())
            if not np.isfinite(rest[nxt]):
                return []
            step = rest[nxt]
            row_price[owner[seen]] += step
            column_price[seen] -= step
            slack[free] -= step
            at = nxt
        while at:
            owner[at] = owner[back[at]]
            at = back[at]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


def greedy_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs by rising cost, each side used once; infinite costs never pair."""
    rows, columns, out = set(), set(), []
    for k in np.argsort(cost, axis=None, kind="stable"):
        i, j = divmod(int(k), cost.shape[1])
        if np.isfinite(cost[i, j]) and i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            out.append((i, j))
    return sorted(out)


def match(priced: DataFrame, page: str, assign: Assign) -> DataFrame:
    """Matches a_id to b_id page by page; ``priced`` has the cost of every pair, null where it is forbidden."""

    def number(pdf: pd.DataFrame, side: str) -> tuple[np.ndarray, np.ndarray]:
        """For each row the place of its id among its page's, and how many of them each page has."""
        where, ids = pdf[page].to_numpy(), pdf[side].to_numpy()
        order = np.lexsort((ids, where))
        new = np.concatenate([[True], (where[order][1:] != where[order][:-1]) | (ids[order][1:] != ids[order][:-1])])
        count = np.bincount(where[order][new])
        place = np.empty(len(pdf), np.int64)
        place[order] = np.cumsum(new) - 1
        return place - (np.cumsum(count) - count)[where], count

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["b_id"], pdf["a_id"], pdf[page]))]
        where, cost = pdf[page].to_numpy(), pdf["cost"].fillna(np.inf).to_numpy(float)
        (i, height), (j, width) = number(pdf, "a_id"), number(pdf, "b_id")
        # the tables of all pages end to end: the row of each pair, or -1
        size = height * width
        begin = np.cumsum(size) - size
        row = np.full(size.sum(), -1, np.int64)
        cell = begin[where] + i * width[where] + j
        row[cell] = np.arange(len(pdf))
        if (row[cell] != np.arange(len(pdf))).any():
            raise ValueError("a pair has several costs")
        flat = np.full(len(row), np.inf)
        flat[cell] = cost
        found = []
        for at, n, m in zip(begin.tolist(), height.tolist(), width.tolist(), strict=True):
            found += [at + x * m + y for x, y in assign(flat[at : at + n * m].reshape(n, m))]
        found = row[np.array(found, np.int64)]
        return pd.DataFrame({page: where[found], "a_id": pdf["a_id"].to_numpy()[found], "b_id": pdf["b_id"].to_numpy()[found], "cost": cost[found]})

    return by_page(priced.select(page, "a_id", "b_id", "cost"), page, solve, f"{page} long, a_id int, b_id int, cost double")


def _clipped_by_level(rows: DataFrame, page: str, levels: list[int]) -> DataFrame:
    """:func:`clip_stack` of clips at these levels only, with the same results."""
    known = lambda c: F.nanvl(c, F.lit(None).cast("double"))  # noqa: E731  as the fold returns them
    level, is_clip = F.col("level"), F.col("kind").eqNullSafe("clip")
    holds = is_clip & F.coalesce((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")), F.lit(False))
    other = holds & ~F.coalesce(level.isin(levels), F.lit(False))
    drawn = F.when(other, F.raise_error("a clip is at none of the given levels").cast("boolean")).otherwise(~is_clip)
    boxes = rows.select(F.col(page).cast("long").alias(page), F.col("seq").cast("long").alias("seq"), "kind", "level", *(known(F.col(c).cast("double")).alias(c) for c in COORDS))
    # a level's open clip is the last row at it or above, if that is a clip at just this level
    before = Window.partitionBy(page).orderBy(F.asc_nulls_last("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    clip = lambda at: F.struct(*(F.when(holds & (level == at), F.col(c)).alias(c) for c in COORDS))
    opened = {f"__clip{i}": F.last(F.when(level <= at, clip(at)), ignorenulls=True).over(before) for i, at in enumerate(levels)}
    left = boxes.withColumn("__drawn", drawn).withColumns(opened).filter("__drawn")
    for c in opened:  # from the outermost clip inwards
        limits = {k: F.col(c)[k] for k in COORDS}
        low = {k: F.when(limits[k] > F.col(k), limits[k]).otherwise(F.col(k)) for k in COORDS[:2]}
        high = {k: F.when(limits[k] < F.col(k), limits[k]).otherwise(F.col(k)) for k in COORDS[2:]}
        left = left.withColumns(low | high)
        none = {k: limits[k].isNotNull() & (F.col(a) > F.col(b)) for a, b in zip(COORDS[:2], COORDS[2:], strict=True) for k in (a, b)}
        middle = {k: known((F.col(a) + F.col(b)) / 2) for a, b in zip(COORDS[:2], COORDS[2:], strict=True) for k in (a, b)}
        left = left.withColumns({k: F.when(none[k], middle[k]).otherwise(F.col(k)) for k in COORDS})
    return left.select(page, "seq", *COORDS)


def clip_stack(rows: DataFrame, page: str, levels: Iterable[int] | None = None) -> DataFrame:
    """The visible box of each row below its open clips (ordered by ``seq``).

    A row of kind ``clip`` at level L limits later rows of deeper levels until a
    row of level <= L; inverted clips are ignored.  With ``levels``, all that clips
    are at, a window for each finds its open clips, and no row leaves the JVM; a
    clip at another level is an error.
    """
    if levels is not None:
        return _clipped_by_level(rows, page, sorted(set(levels)))

    def limited(low: float, high: float, clips: list[tuple], k: int) -> tuple[float, float]:
        for clip in clips:
            low, high = max(low, clip[k]), min(high, clip[k + 2])
            if low > high:
                low = high = (low + high) / 2
        return low, high

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["seq"], pdf[page]))]
        drawn = (pdf["kind"] != "clip").to_numpy()
        # open clips: coordinates, level, and what all of them up to there share
        stack, out, here = [], [], None
        for number, draw, level, x0, y0, x1, y1 in zip(pdf[page].tolist(), drawn.tolist(), *(pdf[c].tolist() for c in ("level", *COORDS)), strict=True):
            if number != here:
                stack, here = [], number
            while stack and stack[-1][4] >= level:
                stack.pop()
            if not draw:
                if x0 <= x1 and y0 <= y1:
                    c0, d0, c1, d1 = stack[-1][5] if stack else (x0, y0, x1, y1)
                    stack.append((x0, y0, x1, y1, level, (max(c0, x0), max(d0, y0), min(c1, x1), min(d1, y1))))
                continue
            if stack:
                c0, d0, c1, d1 = stack[-1][5]
                a0, b0, a1, b1 = max(x0, c0), max(y0, d0), min(x1, c1), min(y1, d1)
                # clip by clip only where nothing is left
                x0, x1 = limited(x0, x1, stack, 0) if a0 > a1 else (a0, a1)
                y0, y1 = limited(y0, y1, stack, 1) if b0 > b1 else (b0, b1)
            out.append((x0, y0, x1, y1))
        found = np.array(out, float).reshape(-1, 4)
        return pd.DataFrame({page: pdf[page].to_numpy()[drawn], "seq": pdf["seq"].to_numpy()[drawn], **{c: found[:, k] for k, c in enumerate(COORDS)}})

    return by_page(rows, page, fold, f"{page} long, seq long, x0 double, y0 double, x1 double, y1 double")
