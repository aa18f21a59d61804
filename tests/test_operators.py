"""Edge frames: ties, constants, first publication, events on the row's date, long exponential series."""

from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import crosssection as xs
from crosspanel.operators import evaluate as ev
from crosspanel.operators import pit
from crosspanel.operators import timeseries as ts

D = [date(2024, 1, 1) + timedelta(days=i) for i in range(400)]


def test_as_of_is_inclusive_and_takes_the_last_of_equal_dates(spark):
    left = spark.createDataFrame([(1, D[0]), (1, D[5]), (1, D[9])], "id int, d date")
    facts = spark.createDataFrame([(1, D[5], D[2], 1.0), (1, D[5], D[3], 2.0), (2, D[0], D[0], 9.0)], "id int, av date, period_end date, value double")
    out = {r.d: r.value for r in pit.as_of(left, facts, "av", ["value"], ["period_end"]).collect()}
    assert out == {D[0]: None, D[5]: 2.0, D[9]: 2.0}
    late = {r.d: r.value for r in pit.as_of(left, facts, "av", ["value"], ["period_end"], tolerance=3).collect()}
    assert late == {D[0]: None, D[5]: 2.0, D[9]: None}


def test_event_on_the_row_date_does_not_count(spark):
    rows = spark.createDataFrame([(1, D[0]), (1, D[3]), (1, D[4])], "id int, d date")
    events = spark.createDataFrame([(1, D[3], 0.5), (1, D[4], 0.8)], "id int, d date, f double")
    out = {r.d: round(r.m, 9) for r in pit.event_multiplier(rows, events, "f", "m").collect()}
    assert out == {D[0]: 0.4, D[3]: 0.8, D[4]: 1.0}


@pytest.mark.parametrize(("alpha", "adjust"), [(1 / 3, False), (1 / 14, True), (0.9, False), (0.95, True)])
def test_ewm_equals_pandas_beyond_a_block(spark, alpha, adjust):
    values = [None if i % 11 == 3 else float((i * 37) % 101) for i in range(400)]
    df = spark.createDataFrame([(1, d, v) for d, v in zip(D, values, strict=True)], "id int, d date, x double")
    ours = [r.e for r in ts.ewm(df, "x", alpha, adjust, "e").orderBy("d").collect()]
    theirs = pd.Series(values, dtype=float).ewm(alpha=alpha, adjust=adjust, ignore_na=False).mean()
    assert all(a is None or abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(ours, theirs, strict=True))


@pytest.mark.parametrize("adjust", [True, False])
def test_ewm_with_nulls_at_both_ends_and_in_runs(spark, adjust):
    values = [None, None, 1.0, None, 1.0, 2.0, *[None] * 30, 5.0, 7.0, *[float(i % 13) for i in range(340)], None, None, None]
    df = spark.createDataFrame([(1, d, v) for d, v in zip(D, values, strict=False)], "id int, d date, x double")
    ours = [r.e for r in ts.ewm(df, "x", 0.9, adjust, "e").orderBy("d").collect()]
    theirs = pd.Series(values, dtype=float).ewm(alpha=0.9, adjust=adjust, ignore_na=False).mean().tolist()
    assert [a is None for a in ours] == [b != b for b in theirs]
    assert all(a is None or abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in zip(ours, theirs, strict=True))


def test_event_multiplier_with_zero_and_negative_factors(spark):
    rows = spark.createDataFrame([(1, D[k]) for k in range(4)], "id int, d date")
    events = spark.createDataFrame([(1, D[1], 0.0), (1, D[2], -2.0), (1, D[3], None), (1, D[4], -0.5)], "id int, d date, f double")
    assert {r.d: round(r.m, 9) for r in pit.event_multiplier(rows, events, "f", "m").collect()} == {D[0]: 0.0, D[1]: 1.0, D[2]: -0.5, D[3]: -0.5}


def test_streak_breaks_at_null_and_restarts(spark):
    flags = [True, True, None, True, False, True, True, True]
    df = spark.createDataFrame([(1, d, f) for d, f in zip(D, flags, strict=False)], "id int, d date, f boolean")
    assert [r.s for r in ts.streak(df, F.col("f"), "s").orderBy("d").collect()] == [1, 2, 0, 1, 0, 1, 2, 3]


def test_ranks_with_ties_nulls_and_single_rows(spark):
    df = spark.createDataFrame([(1, D[0], 5.0), (2, D[0], 5.0), (3, D[0], None), (4, D[0], 7.0), (1, D[1], 1.0)], "id int, d date, x double")
    ranks = {(r.id, r.d): r.k for r in xs.average_rank(df, "x", "k").collect()}
    assert ranks == {(1, D[0]): 1.5, (2, D[0]): 1.5, (3, D[0]): None, (4, D[0]): 3.0, (1, D[1]): 1.0}
    centred = {(r.id, r.d): r.k for r in xs.centred_rank(df, "x", "k").collect()}
    assert centred[1, D[1]] is None
    assert centred[4, D[0]] == 0.5


def test_constant_cross_section_has_no_ic(spark):
    df = spark.createDataFrame([(i, D[0], 1.0, float(i)) for i in range(6)], "id int, d date, s double, l double")
    assert ev.rank_ic(df, "s", "l", 5).collect()[0].ic is None
    assert ev.rank_ic(df, "s", "l", 7).count() == 0


def test_features_of_an_entity_do_not_depend_on_the_others(spark):
    df = spark.createDataFrame([(i, d, float((i * 7 + k * 13) % 29)) for i in range(4) for k, d in enumerate(D[:40])], "id int, d date, x double")
    build = lambda p: ts.streak(ts.rolling(ts.pct_change(p.where("x > 0"), "x", 2, "m"), "m", "avg", 5, 2, "a"), F.col("m") > 0, "s")
    whole = {tuple(r) for r in build(df).where("id = 2").collect()}
    assert whole == {tuple(r) for r in build(df.where("id = 2")).collect()}


def test_size_neutral_residuals_with_nulls(spark):
    """Against least squares on group dummies and size, over the rows that have both."""
    import numpy as np

    from crosspanel.operators import crosssection as xs

    r = np.random.default_rng(3)
    rows = [(i, 1, "abc"[i % 3], float(r.normal()) if i % 5 else None, float(r.normal()) if i % 7 else None) for i in range(40)]
    out = xs.neutralise_with_size(spark.createDataFrame(rows, "id int, d int, g string, x double, size double"), "x", "g", "size", "res").collect()
    known = [k for k in rows if k[3] is not None and k[4] is not None]
    a = np.array([[*(k[2] == g for g in "abc"), k[4]] for k in known], float)
    y = np.array([k[3] for k in known])
    residual = dict(zip([k[0] for k in known], y - a @ np.linalg.lstsq(a, y, rcond=None)[0], strict=True))
    assert all((row.res is None) == (row.id not in residual) and (row.res is None or abs(row.res - residual[row.id]) < 1e-9) for row in out)


def test_upsert_keeps_shrinks_or_fills(spark):
    from crosspanel.operators import pit

    old = spark.createDataFrame([(1, 1, "a", "p"), (2, 1, "b", "q"), (1, 2, "c", "r")], "id int, d int, v string, w string")
    new = spark.createDataFrame([(1, 1, "z", None), (3, 1, None, "s")], old.schema)
    got = lambda **how: sorted(map(tuple, pit.upsert(old, new, ["id", "d"], **how).collect()))
    assert got() == [(1, 1, "z", None), (1, 2, "c", "r"), (2, 1, "b", "q"), (3, 1, None, "s")]
    assert got(allow_shrink=True) == [(1, 1, "z", None), (1, 2, "c", "r"), (3, 1, None, "s")]
    assert got(fill=True) == [(1, 1, "z", "p"), (1, 2, "c", "r"), (2, 1, "b", "q"), (3, 1, None, "s")]


def test_payout_yield_without_payout_is_zero(spark):
    from crosspanel.operators import features as ft

    df = spark.createDataFrame([(1.0, 50.0), (None, 50.0), (90.0, 100.0), (1.0, 0.0), (1.0, None), (-1.0, 10.0)], "pay double, close double")
    assert [r.y for r in ft.payout_yield(df, "pay", "close", "y", 0.2).collect()] == [0.02, 0.0, 0.2, 0.0, 0.0, 0.0]
