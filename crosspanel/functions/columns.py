"""Safe arithmetic, dates, texts, conditions and casts as column expressions.

A null argument gives null unless a docstring says otherwise; nothing raises, also not under ANSI rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- numbers
def finite(x: Column) -> Column:
    """The value, or null where it is not a finite number."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or the result is not finite."""
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def soft_ratio(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """a / (b + eps)."""
    return finite(F.try_divide(a.cast("double"), b.cast("double") + eps))


def signed_log(x: Column) -> Column:
    """sign(x) * log(1 + |x|)."""
    return F.signum(x) * F.log1p(F.abs(x))


def clipped(x: Column, low: float, high: float) -> Column:
    """The value within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x.cast("double"))))


def one_decimal(x: Column) -> Column:
    """A number of 0 or more as text with one decimal, as ``printf`` writes it: halves of the double's exact value go to the even digit.

    ``format_string`` rounds the shortest decimal text up instead: 0.25 would be 0.3, and 0.35, which is less than 7 / 20, 0.4. The
    fraction of a double is exact, and so is its tenfold as a rounded sum and what the sum leaves out.
    """
    x = x.cast("double")
    frac = x - F.floor(x)
    s, a, b = frac * 10, frac * 8, frac * 2
    left = (a - (s - (s - a))) + (b - (s - a))
    n = F.when((s - F.floor(s) == 0.5) & (left != 0), F.when(left > 0, F.ceil(s)).otherwise(F.floor(s))).otherwise(F.rint(s)).cast("int")
    small = F.concat((F.floor(x) + F.floor(n / 10)).cast("string"), F.lit("."), (n % 10).cast("string"))
    high = F.floor(x / 2.0**60)
    whole = high.cast("decimal(20,0)") * F.lit(2**60).cast("decimal(20,0)") + (x - high * 2.0**60).cast("long").cast("decimal(20,0)")
    large = F.concat(whole.cast("decimal(38,0)").cast("string"), F.lit(".0"))
    odd = F.when(F.isnan(x), F.lit("nan")).when(x == float("inf"), F.lit("inf"))
    return F.coalesce(odd, F.when(x < 2.0**62, small).when(x < 2.0**120, large).otherwise(F.format_string("%.1f", x)))


# --- dates
def month_end(d: Column, days: int = 0, months: int = 0) -> Column:
    """The last day of the month so many months later, and so many days on."""
    return F.date_add(F.last_day(F.add_months(d, months)), days)


def period(d: Column, unit: str) -> Column:
    """The name of a date's year (Y), quarter (Q) or month (M): 1997, 1997Q2, 1997-05."""
    if unit == "Q":
        return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    return F.date_format(d, {"Y": "yyyy", "M": "yyyy-MM"}[unit])


def weekdays_between(a: Column, b: Column) -> Column:
    """Days from Monday to Friday after a, up to b; negative if b is earlier."""
    upto = lambda d: F.floor((F.datediff(d, F.lit("1970-01-05").cast("date"))) / 7) * 5 + F.least(F.weekday(d) + 1, F.lit(5))
    return (upto(b) - upto(a)).cast("int")


# --- texts
def plain_number(text: Column) -> Column:
    """A number from text with thousands commas, a per cent sign (then over 100), brackets for minus, or blanks; else null."""
    bare = F.trim(F.regexp_replace(text, "[,\\s]", ""))
    percent, minus = bare.endswith("%"), bare.rlike(r"^\(.*\)$")
    value = F.regexp_replace(bare, "[%()]", "").try_cast("double")
    return F.when(percent, value / 100).otherwise(value) * F.when(minus, -1).otherwise(1)


def era_date(text: Column, first_year: int = 1911) -> Column:
    """A date from era text such as 112/03/05, 112-3-5 or 1120305 (year, month, day); null if there is no such day."""
    parts = F.when(text.rlike(r"^\s*\d{6,7}\s*$"), F.regexp_replace(text, r"^\s*(\d+)(\d{2})(\d{2})\s*$", "$1/$2/$3")).otherwise(F.regexp_replace(text, "[-.]", "/"))
    cut = F.split(F.trim(parts), "/")
    number = lambda k: F.get(cut, F.lit(k)).try_cast("int")
    iso = F.format_string("%04d-%02d-%02d", number(0) + first_year, number(1), number(2))
    return F.when(F.size(cut) == 3, F.when(number(0).isNotNull() & number(1).isNotNull() & number(2).isNotNull(), iso)).try_cast("date")


def without_affix(text: Column, prefix: str = "", suffix: str = "") -> Column:
    """The text, trimmed, without this beginning and this end where it has them."""
    bare = F.trim(text)
    if prefix:
        bare = F.when(bare.startswith(prefix), F.substring(bare, len(prefix) + 1, 1 << 30)).otherwise(bare)
    return F.when(bare.endswith(suffix), F.regexp_replace(bare, re.escape(suffix) + "$", "")).otherwise(bare) if suffix else bare


def mapped(text: Column, names: dict[str, str]) -> Column:
    """The text under its other name; itself if it has none."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), text), text) if pairs else text


# --- conditions and casts
def chosen(condition: Column, yes: Column, no: Column) -> Column:
    """yes where the condition holds, no where it does not or is unknown."""
    return F.when(condition, yes).otherwise(no)


def within(x: Column, low: Column, high: Column) -> Column:
    """Whether low <= x <= high; False where any is unknown."""
    return F.coalesce(x.between(low, high), F.lit(False))


def number(text: Column) -> Column:
    """The text as a number, or null."""
    return finite(F.trim(text).try_cast("double"))


def moment(text: Column, *formats: str) -> Column:
    """The text as a time by the first format that fits, or null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


# --- records
def record_value(records: Column, key: str, value: str, name: str, otherwise: Column) -> Column:
    """Of an array of records, the value of the first whose key is the name; ``otherwise`` if there is none."""
    return F.coalesce(F.get(F.filter(records, lambda r: r[key] == name), F.lit(0))[value], otherwise)
