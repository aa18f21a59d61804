"""Column functions on the values that matter."""

import datetime

from pyspark.sql import functions as F

from crosspanel.functions import columns as fn


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_numbers(spark):
    n = F.lit(None).cast("double")
    assert one(spark, fn.ratio(F.lit(1.0), F.lit(0.0)), fn.ratio(F.lit(1e308), F.lit(1e-308)), fn.ratio(n, F.lit(1.0)), fn.ratio(F.lit(3), F.lit(4))) == (None, None, None, 0.75)
    assert one(spark, fn.clipped(n, 0, 1), fn.clipped(F.lit(5), 0, 1), fn.clipped(F.lit(-5), 0, 1), fn.finite(F.lit(float("nan")))) == (None, 1.0, 0.0, None)
    assert one(spark, fn.number(F.lit(" 1e3 ")), fn.number(F.lit("x")), fn.number(F.lit("NaN")), fn.signed_log(F.lit(0.0))) == (1000.0, None, None, 0.0)


def test_texts(spark):
    texts = ["1,234.5", " 12.5 % ", "(3,000)", "--", "", None, "-7"]
    assert one(spark, *[fn.plain_number(F.lit(t)) for t in texts]) == (1234.5, 0.125, -3000.0, None, None, None, -7.0)
    eras = ["112/03/05", "1120305", "990131", "85-2-30", "85.2.3", "x/y/z", "112/3", None]
    d = datetime.date
    assert one(spark, *[fn.era_date(F.lit(t)) for t in eras]) == (d(2023, 3, 5), d(2023, 3, 5), d(2010, 1, 31), None, d(1996, 2, 3), None, None, None)
    assert one(spark, fn.without_affix(F.lit(" a.b.c "), "a.", ".c"), fn.without_affix(F.lit("xyz"), "q", "q"), fn.mapped(F.lit("a"), {"a": "b"}), fn.mapped(F.lit("z"), {"a": "b"}), fn.mapped(F.lit("z"), {})) == ("b", "xyz", "b", "z", "z")


def test_dates(spark):
    day = F.lit("1997-01-31").cast("date")
    d = datetime.date
    assert one(spark, fn.month_end(day), fn.month_end(day, 10, 1), fn.period(day, "Q"), fn.period(day, "Y")) == (d(1997, 1, 31), d(1997, 3, 10), "1997Q1", "1997")
    days = [d(1969, 12, 25) + datetime.timedelta(days=k) for k in range(0, 40, 3)]
    for a in days:
        for b in days[::2]:
            low, high = sorted((a, b))
            n = sum((low + datetime.timedelta(days=k + 1)).weekday() < 5 for k in range((high - low).days))
            assert one(spark, fn.weekdays_between(F.lit(a), F.lit(b)))[0] == (n if a <= b else -n)
            if a > days[3]:
                break


def test_conditions_and_records(spark):
    n = F.lit(None).cast("boolean")
    assert one(spark, fn.chosen(n, F.lit(1), F.lit(2)), fn.within(F.lit(None).cast("int"), F.lit(1), F.lit(2)), fn.moment(F.lit("05/03/1997"), "yyyy-MM-dd", "dd/MM/yyyy").cast("string"), fn.moment(F.lit("50/03/1997"), "dd/MM/yyyy")) == (2, False, "1997-03-05 00:00:00", None)
    records = F.from_json(F.lit('[{"k": "a", "v": 1}, {"k": "b", "v": 2}, {"k": "b", "v": 3}]'), "array<struct<k: string, v: int>>")
    assert one(spark, fn.record_value(records, "k", "v", "b", F.lit(0)), fn.record_value(records, "k", "v", "z", F.lit(0))) == (2, 0)
