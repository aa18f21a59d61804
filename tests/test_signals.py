"""Rules and holdings against figures worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import pit
from crosspanel.operators import quality as dq
from crosspanel.operators import signals as sg

DAYS = [dt.date(2024, 1, k) for k in range(1, 8)]


def test_first_layer_wins(spark):
    df = spark.createDataFrame([(1, True, True, None), (2, None, True, True), (3, False, None, False)], "id int, a boolean, b boolean, c boolean")
    layers = [("full", {"a": F.col("a")}), ("half", {"b": F.col("b"), "c": F.col("c")})]
    got = {x.id: (x.layer, x.action, x.reasons) for x in sg.exit_rules(df, layers).collect()}
    assert got == {1: (1, "full", ["a"]), 2: (2, "half", ["b", "c"]), 3: (None, None, None)}


def test_entry_score_adds_tiers_and_bonus(spark):
    df = spark.createDataFrame([(1, True, 80, 3), (2, None, 59, 3), (3, False, None, 1), (4, True, 60, 9)], "id int, a boolean, pat int, k int")
    out = sg.entry_scores(df, {"a": (F.col("a"), 30)}, F.lit(70), F.col("pat"), [(90, 40), (75, 30), (60, 20)], F.col("k") <= 5)
    assert {x.id: (x.score, x.verdict) for x in out.collect()} == {1: (70, "BUY"), 2: (0, None), 3: (0, None), 4: (50, "WATCH")}


def test_holdings_drift_and_pay_for_changes(spark):
    prices = spark.createDataFrame([("a", d, p) for d, p in zip(DAYS[:4], [10.0, 20.0, 20.0, 10.0])] + [("b", d, p) for d, p in zip(DAYS[:4], [5.0, 5.0, 5.0, 10.0])], "id string, d date, close double")
    log = spark.createDataFrame([("a", DAYS[0], 0.5), ("b", DAYS[0], 0.5), ("b", DAYS[2], 1.0)], "id string, d date, w double")
    out = {x.d: (x.ret, x.bought) for x in sg.holdings_returns(log, "w", prices, "close", pit.calendar(prices), 0.01, 0.02).collect()}
    assert out[DAYS[0]] == pytest.approx((-0.01, 1.0))  # the first purchase
    assert out[DAYS[1]][0] == pytest.approx(0.5) and out[DAYS[1]][1] is None
    assert out[DAYS[2]] == pytest.approx((-(2 / 3) * 0.03, 2 / 3))  # a has drifted to two thirds
    assert out[DAYS[3]][0] == pytest.approx(1.0)


def test_sizes_stay_within_limits(spark):
    df = spark.createDataFrame([(k, DAYS[0], float(10 - k), "x" if k < 6 else "y") for k in range(1, 11)], "id int, d date, s double, g string")
    out = sg.position_sizes(df, "s", "g", "w").collect()
    assert {x.id for x in out} <= set(range(1, 10)) and all(x.w >= 0.03 for x in out)
    assert sum(x.w for x in out) == pytest.approx(0.95, abs=0.002)


def test_swapped_columns_are_found_and_mended(spark):
    moves = [3.0, 8.0, 1.0, 9.0, 4.0, 7.0, 2.0]
    rows, total = [], {"a": 0.0, "b": 0.0}
    for d, m in zip(DAYS, moves):
        for e in "ab":
            total[e] += m - 5
            rows.append((e, d, total[e], *((m, 5.0) if e == "a" else (5.0, m))))
    df = spark.createDataFrame(rows, "id string, d date, bal double, up double, down double")
    said = dq.swap_diagnosis(df, "bal", "up", "down", 5, 0.5)
    assert {x.id: x.verdict for x in said.collect()} == {"a": "keep", "b": "swap"}
    assert all(x.down == 5.0 for x in dq.unswapped(df, said, "up", "down").collect())


def test_empty_tables(spark):
    log = spark.createDataFrame([], "id string, d date, w double")
    prices = spark.createDataFrame([], "id string, d date, close double")
    assert sg.holdings_returns(log, "w", prices, "close", pit.calendar(prices), 0.01, 0.02).count() == 0
    assert dq.limit_scan(prices, "close", F.lit(0.1)).count() == 0
