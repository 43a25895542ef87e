"""Every query against its SQL on the smallest tables, and the folds against brute force."""

import itertools

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireflow.operators.spatial import greedy_assignment, optimal_assignment
from quireflow.plans.registry import QUERIES, oracle_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations"


def rows(df):
    def plain(x):
        x = x.item() if isinstance(x, np.generic) else x
        if x is None or x != x:
            return None
        return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x

    columns = sorted(df.columns)
    return columns, sorted(str(tuple(map(plain, r))) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, oracle, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(oracle.execute(oracle_sql()[name]).df())


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_optimal_assignment_is_optimal(n, m, data):
    cost = np.array(data.draw(st.lists(st.lists(st.integers(-9, 9), min_size=m, max_size=m), min_size=n, max_size=n)), float)
    found = optimal_assignment(cost)
    few, many = (n, m) if n <= m else (m, n)
    table = cost if n <= m else cost.T
    least = min(sum(table[i, p[i]] for i in range(few)) for p in itertools.permutations(range(many), few))
    assert len(found) == few and sum(cost[i, j] for i, j in found) == least


def test_infeasible_assignment_is_empty():
    assert optimal_assignment(np.array([[np.inf, 1.0], [np.inf, 2.0]])) == []


def test_greedy_takes_least_first():
    assert greedy_assignment(np.array([[1.0, 2.0], [0.5, np.inf]])) == [(0, 1), (1, 0)]
