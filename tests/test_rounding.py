"""Texts with one decimal as printf writes them: halves go to the even digit, by the exact value of the double."""

import datetime
import math
import random

import duckdb

from crosspanel.functions import columns as fn
from crosspanel.plans import catalog


def test_one_decimal_equals_printf(spark):
    r = random.Random(3)
    halves = [(2 * r.randrange(5000) + 1) / 20 for _ in range(500)]
    values = [0.0, 0.25, 0.35, 0.75, 9.95, 1e17 / 3 * 10, 2.0**52 - 0.25, 2.0**119, 6.377136971728083e18, float("inf"), float("nan"), *halves, *[math.nextafter(x, 0) for x in halves], *[math.nextafter(x, 1e9) for x in halves]]
    df = spark.createDataFrame([(x,) for x in values], "x double")
    assert [(t, "%.1f" % x) for x, t in df.select("x", fn.one_decimal(df["x"])).collect() if t != "%.1f" % x] == []


def test_rewards_of_whole_prices_equal_sql(spark, tmp_path):
    r = random.Random(4)
    rows = [(k, 1, k % 5, 1.0, float(r.randrange(100, 160)), datetime.datetime(1995, 1, 2) + datetime.timedelta(weeks=k // 5)) for k in range(600)]
    line = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp")
    line.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    ours = catalog.QUERIES["l06_pattern_helpers"](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    theirs = c.sql(catalog.ORACLES["l06_pattern_helpers"])
    assert ours.columns == theirs.columns
    assert sorted(map(tuple, ours.collect())) == sorted(theirs.fetchall())
