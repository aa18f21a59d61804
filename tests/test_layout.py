"""Plans over stored panels: no exchange of bucketed tables, bounds from footers."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import pit
from crosspanel.operators import timeseries as ts
from crosspanel.sources import files, layout


def panel(spark, n=20):
    r = random.Random(1)
    rows = [(i, datetime.date(2020, 1, 1) + datetime.timedelta(days=k), r.gauss(10, 1)) for i in range(n) for k in range(40)]
    return spark.createDataFrame(rows, "id int, d date, close double")


@pytest.fixture
def stored(spark, tmp_path):
    table = layout.write_bucketed(panel(spark), "stored_panel", 4, path=f"{tmp_path}/panel")
    facts = layout.write_bucketed(panel(spark).where("day(d) % 9 = 0").withColumnRenamed("close", "value"), "stored_facts", 4, path=f"{tmp_path}/facts")
    yield table, facts
    layout.drop_bucketed(spark, "stored_panel")
    layout.drop_bucketed(spark, "stored_facts")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_over_a_bucketed_panel_need_no_exchange(spark, stored):
    table, _ = stored
    for out in (ts.rolling(table, "close", "avg", 5, 3, "m"), ts.ewm(table, "close", 0.2, False, "m"), ts.expanding_z(table, "close", "m", 5), ts.streak(table, F.col("close") > 10, "m")):
        assert "Exchange" not in plan(out)
    plain = panel(spark)
    want = {(r.id, r.d): r.m for r in ts.ewm(plain, "close", 0.2, False, "m").collect()}
    got = {(r.id, r.d): r.m for r in ts.ewm(table, "close", 0.2, False, "m").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert "Exchange" in plan(ts.rolling(plain, "close", "avg", 5, 3, "m"))


def test_joins_and_aggregates_of_bucketed_panels_need_no_exchange(spark, stored):
    table, facts = stored
    assert "Exchange" not in plan(table.hint("merge").join(facts.select("id", "value"), "id"))
    whole = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(whole, "false")
    try:
        assert "Exchange" not in plan(table.hint("merge").join(facts, ["id", "d"]))
    finally:
        spark.conf.unset(whole)
    assert "Exchange" not in plan(table.groupBy("id").agg(F.max("close")))
    found = pit.as_of(table, facts, "d", ["value"])
    assert found.count() == table.count()


def test_bounds_come_from_footers(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(1000).selectExpr("id", "id / 7.0D x", "date_add(date '2020-01-01', cast(id % 50 as int)) d", "cast(id as string) s").write.parquet(path)
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    out = files.column_bounds(spark, path, ["id", "x", "d"])
    assert "PushedAggregation: [MIN(id), MAX(id), MIN(x), MAX(x), MIN(d), MAX(d), COUNT(*)]" in plan(out)
    assert tuple(out.first()) == (0, 999, 0.0, 999 / 7, datetime.date(2020, 1, 1), datetime.date(2020, 2, 19), 1000)
    assert tuple(files.column_bounds(spark, path, ["s"]).first()) == ("0", "999", 1000)
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before and "parquet" in before


def test_missing_tables_are_left_out_or_an_error(spark, tmp_path):
    panel(spark).withColumnRenamed("d", "Date").write.parquet(f"{tmp_path}/prices")
    paths = {"prices": f"{tmp_path}/prices", "flows": f"{tmp_path}/flows"}
    found = files.load_tables(spark, paths, {"prices": "Date"}, required=("prices",))
    assert list(found) == ["prices"] and found["prices"].columns == ["id", "d", "close"]
    with pytest.raises(FileNotFoundError):
        files.load_tables(spark, paths, {}, required=("flows",))
