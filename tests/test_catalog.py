"""Every registered panel query against its SQL, on the tables that the driver uses."""

import glob
import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from crosspanel.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df: pd.DataFrame, whole: list[bool]) -> list[tuple]:
    def plain(v, whole: bool):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, str):
            return v
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        return float(v) if isinstance(v, float | np.floating | Decimal) and not whole else int(v)

    def keys_first(row: tuple) -> tuple:
        return str([v for v in row if not isinstance(v, float)]), str([round(v, 4) for v in row if isinstance(v, float)])

    out = [tuple(map(plain, x, whole)) for x in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(out, key=keys_first)


WHOLE = ("tinyint", "smallint", "int", "bigint")


def same(p, q, whole: bool) -> bool:
    """Whole numbers, dates and texts are equal; other numbers are, up to the rounding of the query."""
    if whole or p is None or q is None or isinstance(p, str) or isinstance(q, str):
        return p == q
    return abs(p - q) <= 2e-4 * max(1, abs(p))


def test_whole_numbers_are_compared_exactly():
    assert not same(1706657350, 1706657349, True) and same(1e9, 1e9 + 1, False) and not same(0.5, 0.51, False) and not same(None, 0, False)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    ours, theirs = df.toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    whole = [kind in WHOLE for _, kind in sorted(df.dtypes)]
    a, b = rows(ours, whole), rows(theirs, whole)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(map(same, x, y, whole)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
