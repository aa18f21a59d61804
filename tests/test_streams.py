"""Streams of several files: late and out-of-order rows, batches that break, restarts."""

import datetime
import glob
import os

import pytest
from pyspark.sql import functions as F

from crosspanel.streaming import events, tables

T0 = datetime.datetime(2024, 1, 1)
KIND = "event_id long, user_id string, event_type string, ts timestamp"


def at(hours: float) -> datetime.datetime:
    return T0 + datetime.timedelta(hours=hours)


def write(spark, folder, *batches, kind=KIND):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
        for f in glob.glob(f"{folder}/*.parquet"):
            if os.path.getmtime(f) > 1e9 and f not in write.seen:
                write.seen.add(f)
                os.utime(f, (1.7e9 + k, 1.7e9 + k))


write.seen = set()
BATCHES = [
    [(1, "u", "a", at(1)), (2, "u", "a", at(2)), (3, "v", "a", at(30)), (4, None, "a", at(3)), (5, "u", "a", None)],
    [(6, "u", "b", at(40)), (7, "u", "a", at(20)), (8, "v", "b", at(29)), (9, "w", "c", at(60))],  # 7 and 8 are out of order, but in time
    [(10, "u", "b", at(41)), (11, "u", "c", at(5)), (12, "v", "a", at(50)), (13, "v", "a", at(45)), (14, "x", "z", at(200))],  # 11 is late
]


def test_windows_close_and_late_rows_are_dropped(spark, tmp_path):
    folder = f"{tmp_path}/events"
    write(spark, folder, *BATCHES)
    out = events.appended(events.windowed(events.events(spark, folder, 1), "ts", ["user_id"], "1 day", "1 day", "24 hours"))
    got = {(r.user_id, (r.start - T0).days): r.n for r in out.collect()}
    # the watermark is at 6 h after the first file, at 36 h after the second, at 176 h after the last; a batch drops what was final
    # before the batch ahead of it, so the row at 5 h still meets its window, which closes with that batch
    rows = [r for b in BATCHES for r in b if r[3]]
    expected = {}
    for _, user, _, ts in rows:
        if ((ts - T0).days + 1) * 24 <= 176:
            expected[user, (ts - T0).days] = expected.get((user, (ts - T0).days), 0) + 1
    assert got == expected and ("u", 0) in got and got["u", 0] == 4 and ("x", 8) not in got


def test_rows_of_final_windows_are_dropped(spark, tmp_path):
    folder = f"{tmp_path}/events"
    write(spark, folder, *BATCHES, [(20, "u", "a", at(4)), (21, "u", "a", at(195))])
    out = events.appended(events.windowed(events.events(spark, folder, 1), "ts", ["user_id"], "1 day", "1 day", "24 hours"))
    assert {(r.start - T0).days: r.n for r in out.where("user_id = 'u'").collect()} == {0: 4, 1: 2}


def test_streaks_follow_event_time(spark, tmp_path):
    folder = f"{tmp_path}/events"
    write(spark, folder, *BATCHES)
    out = events.latest(events.streaks(events.events(spark, folder, 1), "user_id", "event_type", "ts", "event_id", "24 hours"), ["user_id"])
    got = {r.user_id: (r["last"], r.streak) for r in out.collect()}
    # u in time: a 1 h, a 2 h, a 20 h, b 40 h, b 41 h (c at 5 h came late); v: b 29, a 30, a 45, a 50; x still waits for the watermark
    assert got == {"u": ("b", 2), "v": ("a", 3), "w": ("c", 1)}


def test_streak_goes_on_over_batches(spark, tmp_path):
    folder = f"{tmp_path}/events"
    write(spark, folder, *[[(10 * k + i, "u", "a", at(24 * k + i)) for i in range(3)] for k in range(4)], [(99, "z", "a", at(500))])
    out = events.latest(events.streaks(events.events(spark, folder, 1), "user_id", "event_type", "ts", "event_id", "1 hour"), ["user_id"])
    assert {r.user_id: r.streak for r in out.collect()} == {"u": 12}


DAILY = "id long, d date, v string, seq long"


def day(n: int) -> datetime.date:
    return datetime.date(2024, 1, n)


DAYS = [
    [(1, day(1), "a", 1), (2, day(1), "b", 1), (1, day(2), "c", 1), (9, None, "x", 1)],
    [(1, day(2), "d", 2), (1, day(3), "e", 1), (1, day(3), "f", 2)],
    [(2, day(2), "g", 1), (1, day(2), "old", 0), (3, day(1), None, 5)],
]


def table(spark, path):
    return sorted(((r.id, r.d, r.v) for r in tables.current(spark, path, spark.createDataFrame([], DAILY).schema, "d").collect()), key=str)


EXPECTED = sorted([(1, day(1), "a"), (2, day(1), "b"), (3, day(1), None), (1, day(2), "d"), (2, day(2), "g"), (1, day(3), "f")], key=str)


def test_upsert_survives_a_broken_batch_and_a_restart(spark, tmp_path, monkeypatch):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/table"
    write(spark, folder, *DAYS, kind=DAILY)
    stream = lambda: events.events(spark, folder, 1)
    whole, broken = tables.merge_batch, {"left": 1}

    def breaks(rows, batch, target, *rest):
        if batch == 1 and broken["left"]:
            broken["left"] = 0
            rows.where("d is not null").withColumn("v", F.lit("half")).withColumnRenamed("d", "day").write.partitionBy("day").parquet(f"{target}/data/batch=1")
            raise RuntimeError("lost")  # after data, before its line of the ledger
        whole(rows, batch, target, *rest)

    monkeypatch.setattr(tables, "merge_batch", breaks)
    with pytest.raises(Exception):  # noqa: B017
        tables.upsert_stream(stream(), path, ["id", "d"], "d", "seq")
    assert table(spark, path) == sorted([(1, day(1), "a"), (2, day(1), "b"), (1, day(2), "c")], key=str)
    tables.upsert_stream(stream(), path, ["id", "d"], "d", "seq")
    assert table(spark, path) == EXPECTED
    # the second batch has written its two dates alone
    assert sorted(os.path.basename(x) for x in glob.glob(f"{path}/data/batch=1/day=*")) == ["day=2024-01-02", "day=2024-01-03"]
    write(spark, folder, [(1, day(4), "new", 1)], kind=DAILY)
    tables.upsert_stream(stream(), path, ["id", "d"], "d", "seq")
    assert table(spark, path) == sorted([*EXPECTED, (1, day(4), "new")], key=str)
    tables.compact(spark, path, spark.createDataFrame([], DAILY).schema, "d", f"{tmp_path}/small")
    assert table(spark, f"{tmp_path}/small") == table(spark, path)


def test_shrinking_batches_replace_their_dates(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/table"
    write(spark, folder, *DAYS, kind=DAILY)
    tables.upsert_stream(events.events(spark, folder, 1), path, ["id", "d"], "d", "seq", allow_shrink=True)
    assert table(spark, path) == sorted([(3, day(1), None), (2, day(2), "g"), (1, day(2), "old"), (1, day(3), "f")], key=str)


def test_reading_touches_current_files_only(spark, tmp_path):
    folder, path = f"{tmp_path}/in", f"{tmp_path}/table"
    write(spark, folder, *DAYS, kind=DAILY)
    tables.upsert_stream(events.events(spark, folder, 1), path, ["id", "d"], "d", "seq")
    read = tables.current(spark, path, spark.createDataFrame([], DAILY).schema, "d").inputFiles()
    assert {tuple(f.split("/")[-3:-1]) for f in read} == {("batch=2", "day=2024-01-01"), ("batch=2", "day=2024-01-02"), ("batch=1", "day=2024-01-03")}
