"""Folds over pages: how they are called, and their results against plain loops over one page."""

import math
import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from quireflow.operators import spatial as sp
from quireflow.plans.registry import QUERIES
from quireflow.sources.tables import line_boxes


def by_key(rows, *keys):
    return sorted(rows, key=lambda r: tuple((r[k] is not None, r[k] or 0) for k in keys))


def test_a_fold_takes_all_pages_of_a_batch_and_rows_without_a_page(spark):
    """A call for each page took 1.6 ms of Python a page; rows without a page were left out."""
    big = 2**60  # beyond the whole numbers of a double
    rows = [(p + big, i) for p in range(3000) for i in range(4)] + [(None, i) for i in range(5)] + [(0, i) for i in range(6)]
    df = spark.createDataFrame(rows, "page long, id int")
    count = lambda pdf: pd.DataFrame({"page": pdf["page"], "id": pdf["id"], "pages": pdf["page"].nunique(), "rows": pdf.groupby("page")["id"].transform("size")})
    got = sp.by_page(df, "page", count, "page long, id int, pages long, rows long").collect()
    assert sorted((r.page or -1 if r.page is None else r.page, r.id) for r in got) == sorted((-1 if p is None else p, i) for p, i in rows)
    assert {(r.page, r.rows) for r in got if r.page is None or r.page == 0} == {(None, 5), (0, 6)}
    assert all(r.rows == 4 for r in got if r.page and r.page >= big)
    assert max(r.pages for r in got) > 300


@pytest.mark.parametrize("batch", [1, 3, 10000])
def test_pages_that_run_over_batches_stay_whole(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        sizes = [1, 2, 3, 7, 1, 1, 9, 4, 3]
        df = spark.createDataFrame([(p, i) for p, n in enumerate(sizes) for i in range(n)], "page long, id int")
        count = lambda pdf: pdf.groupby("page", as_index=False).agg(n=("id", "size"))
        assert sorted((r.page, r.n) for r in sp.by_page(df, "page", count, "page long, n long").collect()) == list(enumerate(sizes))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def boxes(seed, pages=60, most=14):
    r = random.Random(seed)
    out = []
    for p in [*range(pages), None]:
        for i in r.sample(range(1, 100), r.randint(1, most)):
            x, y = r.randint(0, 12), r.randint(0, 12)
            out.append((p, i, float(x), float(y) if r.random() < 0.95 else None, float(x + r.randint(-1, 9)), float(y + r.randint(-1, 9))))
    r.shuffle(out)
    return out


BOXES = "page long, id int, x0 double, y0 double, x1 double, y1 double"


def pages_of(rows):
    found = defaultdict(list)
    for r in rows:
        found[r[0]].append(r)
    return {p: sorted(rs, key=lambda r: r[1]) for p, rs in found.items()}


def test_similar_groups_by_loops(spark):
    rows, want = boxes(1), []
    for p, found in pages_of(rows).items():
        heads = []
        for r in found:
            near = [i for i, h in enumerate(heads) if None not in (*h, *r[2:]) and all(abs(a - b) <= 5.0 for a, b in zip(h, r[2:], strict=True))]
            if not near:
                heads.append(r[2:])
            want.append((p, r[1], near[0] if near else len(heads) - 1))
    got = sp.similar_groups(spark.createDataFrame(rows, BOXES), "page", 5.0).collect()
    assert by_key(map(tuple, got), 0, 1) == by_key(want, 0, 1)


def test_clip_stack_by_loops(spark):
    r = random.Random(2)
    rows = [(p, i, "clip" if r.random() < 0.5 else "draw", r.randint(1, 5), *b) for p, i, *b in boxes(2, most=30)]
    want = []
    for p, found in pages_of(rows).items():
        stack = []
        for _, seq, kind, level, *b in found:
            b = [math.nan if v is None else v for v in b]
            while stack and stack[-1][0] >= level:
                stack.pop()
            if kind == "clip":
                if b[0] <= b[2] and b[1] <= b[3]:
                    stack.append((level, b))
                continue
            for _, c in stack:
                for k in range(2):
                    b[k], b[k + 2] = max(b[k], c[k]), min(b[k + 2], c[k + 2])
                    if b[k] > b[k + 2]:
                        b[k] = b[k + 2] = (b[k] + b[k + 2]) / 2
            want.append((p, seq, *(None if math.isnan(v) else v for v in b)))
    df = spark.createDataFrame(rows, BOXES.replace("x0", "kind string, level int, x0", 1)).withColumn("id", sp.F.col("id").cast("long")).withColumnRenamed("id", "seq")
    assert by_key(map(tuple, sp.clip_stack(df, "page").collect()), 0, 1) == by_key(want, 0, 1)


def clip_rows(spark):
    r = random.Random(6)
    value = lambda v: r.choice([math.nan, math.inf, -math.inf, None, v]) if r.random() < 0.04 else v
    rows = [(p, i, r.choice(["clip", "clip", "draw", "draw", None]), r.choice([None, *range(6)]), *map(value, b)) for p, i, *b in boxes(7, pages=300, most=40)]
    # a clip without a level is at none of the given ones
    rows = [(p, i, "draw" if level is None else kind, level, *b) for p, i, kind, level, *b in rows]
    return spark.createDataFrame(rows, BOXES.replace("id int, x0", "seq long, kind string, level int, x0"))


@pytest.mark.parametrize("top", [0, 1, 3, 5])
def test_clips_at_known_levels_are_cut_as_by_the_fold(spark, top):
    df = clip_rows(spark).filter(f"kind is distinct from 'clip' or level <= {top}")
    want = sp.clip_stack(df, "page")
    got = sp.clip_stack(df, "page", levels=range(top + 1))
    assert got.dtypes == want.dtypes
    assert by_key(map(tuple, got.collect()), 0, 1) == by_key(map(tuple, want.collect()), 0, 1)


def test_a_clip_at_another_level_is_an_error(spark):
    df = spark.createDataFrame([(0, 1, "clip", 2, 0.0, 0.0, 1.0, 1.0), (0, 2, "draw", 3, 0.0, 0.0, 2.0, 2.0)], BOXES.replace("id int, x0", "seq long, kind string, level int, x0"))
    assert [tuple(r) for r in sp.clip_stack(df, "page", levels=[2]).collect()] == [(0, 2, 0.0, 0.0, 1.0, 1.0)]
    for levels in ([], [1, 3]):
        with pytest.raises(Exception, match="none of the given levels"):
            sp.clip_stack(df, "page", levels=levels).collect()


def test_clip_stack_query_stays_in_the_jvm(spark):
    """The fold in Python took most of the time of large tables."""
    found = QUERIES["clip_stack"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and plan.count("Exchange hashpartitioning") == 1
    rows = spark.createDataFrame(line_boxes(spark, "/root/testdata/sf0.001").collect())
    kinds = rows.selectExpr("page", "id AS seq", "CASE WHEN id % 3 = 1 THEN 'clip' ELSE 'draw' END AS kind", "CASE WHEN id % 3 = 1 THEN 1 ELSE 2 END AS level", *sp.COORDS)
    assert by_key(map(tuple, found.collect()), 0, 1) == by_key(map(tuple, sp.clip_stack(kinds, "page").collect()), 0, 1)


def tables(seed):
    """Tables of costs by page with many ties, some pairs forbidden and some left out."""
    r = random.Random(seed)
    for p in range(150):
        n, m = r.randint(1, 6), r.randint(1, 6)
        ids = [sorted(r.sample(range(50), k)) for k in (n, m)]
        yield p, {(a, b): None if r.random() < 0.1 else r.choice([-0.5, -0.25, -0.125, -0.1, 0.0, 0.3]) for a in ids[0] for b in ids[1] if p % 3 or r.random() < 0.9}


@pytest.mark.parametrize("assign", [sp.optimal_assignment, sp.greedy_assignment])
def test_matches_by_page(spark, assign):
    rows, want = [], []
    for p, costs in tables(3):
        rows += [(p, a, b, c) for (a, b), c in costs.items()]
        left, right = (sorted({k[side] for k in costs}) for side in (0, 1))
        if not costs:
            continue
        table = np.array([[math.inf if costs.get((a, b)) is None else costs[a, b] for b in right] for a in left])
        want += [(p, left[i], right[j], table[i, j]) for i, j in assign(table)]
    random.Random(4).shuffle(rows)
    got = sp.match(spark.createDataFrame(rows, "page long, a_id int, b_id int, cost double"), "page", assign)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_few_costs_are_assigned_as_by_arrays(monkeypatch):
    r = random.Random(5)
    costs = [np.array([[r.choice([math.inf, *map(float, range(5)), 0.1, 0.2]) for _ in range(m)] for _ in range(n)]) for n in range(1, 7) for m in range(1, 7) for _ in range(40)]
    few = [sp.optimal_assignment(c) for c in costs]
    monkeypatch.setattr(sp, "FEW_COSTS", 0)
    assert few == [sp.optimal_assignment(c) for c in costs]
