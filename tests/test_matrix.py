"""The feature matrix: later rows change nothing, and scaled columns equal those scaled one by one."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import crosssection as xs
from crosspanel.operators import matrix

DAY = datetime.date(2020, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    r = random.Random(17)
    rows = []
    for i in range(12):
        x = 100.0
        for k in range(90 - 3 * i):
            x *= 1 + r.gauss(0, 0.02)
            rows.append((i, DAY + datetime.timedelta(days=k), x, x * 1.01, x * 0.98, x * (1 + r.gauss(0, 0.001)), float(r.randrange(1, 900))))
    return spark.createDataFrame(rows, "id int, d date, open double, high double, low double, close double, volume double").cache()


def values(df, upto):
    return {(r.id, r.d): [round(v, 7) for v in r[2:]] for r in df.where(F.col("d") <= upto).collect()}


def test_later_rows_change_nothing(panel):
    market = panel.groupBy("d").agg((F.avg("close") / 100 - 1).alias("ret"))
    cut = DAY + datetime.timedelta(days=70)
    early = panel.where(F.col("d") <= cut)
    whole = matrix.scaled_matrix(*matrix.base_matrix(panel, market))
    short = matrix.scaled_matrix(*matrix.base_matrix(early, market.where(F.col("d") <= cut)))
    assert len(whole.columns) == 36
    a, b = values(whole, cut), values(short, cut)
    assert a.keys() == b.keys() and len(a) == early.count()
    assert all(abs(x - y) < 1e-6 for k in a for x, y in zip(a[k], b[k], strict=True))


def test_long_form_scales_like_one_column(panel):
    base, _ = matrix.base_matrix(panel)
    scaled = {(r.id, r.d): (r.ret_5, r.atr) for r in matrix.scaled_matrix(base, ["ret_5", "atr"]).select("id", "d", "ret_5", "atr").collect()}
    for place, name in enumerate(("ret_5", "atr")):
        one = xs.zscore(xs.winsorise(base.where(F.col(name).isNotNull()), name, 0.01, 0.99, "w"), "w", "z")
        for r in one.select("id", "d", "z").collect():
            assert abs((r.z or 0.0) - scaled[r.id, r.d][place]) < 1e-9


def test_scaling_moves_bounds_not_cells(spark, panel):
    base, names = matrix.base_matrix(panel)
    plan = matrix.scaled_matrix(base, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Pivot" not in plan and plan.count("Join") == -(-len(names) // matrix.AT_ONCE)


def test_bounds_of_gaps_lone_values_and_empty_dates(spark):
    rows = [(k, 1, float(k), None if k % 2 else float(k * k)) for k in range(40)] + [(1, 2, 5.0, float("nan")), (1, 3, None, None), (2, 3, None, 7.0)]
    df = spark.createDataFrame(rows, "id int, k int, a double, b double").selectExpr("id", "date_add(date'2020-01-01', k) d", "a", "b", "id flag")
    got = {(r.id, r.d.day): (r.a, r.b, r.flag) for r in matrix.scaled_matrix(df, ["a", "b"], 0.1, 0.9).collect()}
    assert len(got) == 43 and got[1, 3] == (0.0, 0.0, 1) and got[1, 4] == (0.0, 0.0, 1) and got[2, 4] == (0.0, 0.0, 2)
    for place, known in ((0, list(range(40))), (1, [k * k for k in range(0, 40, 2)])):
        v = np.array(known, float)
        v = np.clip(v, np.quantile(v, 0.1), np.quantile(v, 0.9))
        z = (v - v.mean()) / (v.std(ddof=1) + 1e-9)
        assert np.allclose([got[k, 2][place] for k in (range(40) if place == 0 else range(0, 40, 2))], z, atol=1e-9)
    assert all(got[k, 2][1] == 0.0 for k in range(1, 40, 2))
