"""Point-in-time joins: as-of, calendar, interval and event joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PANEL, PanelSpec


def as_of(left: DataFrame, right: DataFrame, available: str, value_cols: list[str], tie: list[str] | None = None, tolerance: int | None = None, spec: PanelSpec = PANEL) -> DataFrame:
    """Each left row with the latest right row of its entity whose ``available`` date is not after the left date.

    Both sides are laid into one series per entity, right rows first on equal dates, and the last right row is carried
    forward: one shuffle and one sort, whatever the number of facts. Equal dates go by ``tie``. Beyond ``tolerance`` days a
    fact counts as missing.
    """
    fact = F.struct(F.col(available).alias("_at"), *value_cols)
    empty = F.lit(None).cast(right.select(fact.alias("x")).schema["x"].dataType)
    order = F.struct(*(tie or value_cols))
    order_type = right.select(order.alias("x")).schema["x"].dataType
    l = left.select(F.col(spec.entity).alias("_e"), F.col(spec.date).cast("date").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(order_type).alias("_tie"), empty.alias("_fact"), F.struct(*left.columns).alias("_row"))  # noqa: E741
    row_type = l.schema["_row"].dataType
    r = right.where(F.col(available).isNotNull()).select(F.col(spec.entity).alias("_e"), F.col(available).cast("date").alias("_t"), F.lit(0).alias("_side"), order.alias("_tie"), fact.alias("_fact"), F.lit(None).cast(row_type).alias("_row"))
    w = Window.partitionBy("_e").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = l.unionByName(r).withColumn("_f", F.last("_fact", ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.lit(True) if tolerance is None else F.datediff("_t", F.col("_f._at")) <= tolerance
    return carried.select("_row.*", *[F.when(fresh, F.col(f"_f.{c}")).alias(c) for c in value_cols])


def calendar(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """d, idx: the panel's dates in order. The window runs over one row a date."""
    return df.select(spec.date).distinct().withColumn("idx", F.row_number().over(Window.orderBy(spec.date)))


def days_later(df: DataFrame, n: int, col: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """The entity's value n calendar positions later; rows without one are dropped."""
    cal = F.broadcast(calendar(df, spec))
    indexed = df.join(cal, spec.date)
    later = indexed.select(spec.entity, (F.col("idx") - n).alias("idx"), F.col(col).alias(out))
    return indexed.join(later, [spec.entity, "idx"])


def expand_intervals(intervals: DataFrame, cal: DataFrame, start: str, end: str, spec: PanelSpec = PANEL) -> DataFrame:
    """One row per calendar date inside each interval. An interval makes its own days, which meet the calendar by equality."""
    days = intervals.withColumn(spec.date, F.explode(F.sequence(start, end)))
    return days.join(F.broadcast(cal.select(spec.date)), spec.date, "left_semi")


def event_multiplier(rows: DataFrame, events: DataFrame, factor: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Product of the factors of an entity's events strictly after the row's date, 1 if none.

    Rows and events share one series in descending order; an event's own date comes after the rows of that date. A factor of 0
    makes the product 0, a negative one turns its sign; a null factor counts as 1.
    """
    row_type = rows.select(F.struct(*rows.columns).alias("x")).schema["x"].dataType
    a = rows.select(F.col(spec.entity).alias("_e"), F.col(spec.date).alias("_t"), F.lit(0).alias("_side"), F.lit(0.0).alias("_ln"), F.lit(0).alias("_zero"), F.lit(0).alias("_minus"), F.struct(*rows.columns).alias("_row"))
    b = events.select(F.col(spec.entity).alias("_e"), F.col(spec.date).alias("_t"), F.lit(1).alias("_side"), F.when(F.col(factor) != 0, F.ln(F.abs(factor))).alias("_ln"), F.when(F.col(factor) == 0, 1).otherwise(0).alias("_zero"), F.when(F.col(factor) < 0, 1).otherwise(0).alias("_minus"), F.lit(None).cast(row_type).alias("_row"))
    w = Window.partitionBy("_e").orderBy(F.col("_t").desc(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.sum("_minus").over(w) % 2 == 1, -1.0).otherwise(1.0)
    product = F.when(F.sum("_zero").over(w) > 0, F.lit(0.0)).otherwise(sign * F.exp(F.sum("_ln").over(w)))
    return a.unionByName(b).withColumn("_m", product).where("_side = 0").select("_row.*", F.col("_m").alias(out))


def adjust_prices(rows: DataFrame, events: DataFrame, factor: str, columns: list[str], invert: bool = False, spec: PanelSpec = PANEL) -> DataFrame:
    """The columns times the factors of all later events of the entity, or divided by them to get back; null where that is 0."""
    held = event_multiplier(rows, events, factor, "_by", spec)
    return held.withColumns({c: F.try_divide(F.col(c), F.col("_by")) if invert else F.col(c) * F.col("_by") for c in columns}).drop("_by")


def side_join(base: DataFrame, side: DataFrame, names: dict[str, str], defaults: dict[str, Column] | None = None, fill: bool = True, spec: PanelSpec = PANEL) -> DataFrame:
    """The base with the columns of a side table under new names, by entity and date.

    A name that the base has keeps the base's value, and takes the side's where that is null. New columns are carried forward within
    the entity if ``fill``, then get their default. Of side rows with one key the one with the largest values counts.
    """
    defaults = defaults or {}
    once = side.groupBy(spec.entity, spec.date).agg(F.max(F.struct(*[F.col(a).alias(f"_s_{b}") for a, b in names.items()])).alias("_s"))
    out = base.join(once, [spec.entity, spec.date], "left")
    for b in names.values():
        value = F.col(f"_s._s_{b}")
        if b in base.columns:
            out = out.withColumn(b, F.coalesce(F.col(b), value))
            continue
        if fill:
            value = F.last(value, ignorenulls=True).over(spec.past())
        out = out.withColumn(b, F.coalesce(value, defaults[b]) if b in defaults else value)
    return out.drop("_s")


def two_sided(df: DataFrame, col: str, tolerance: float, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Fills a gap from the values before and after if they agree within the tolerance, or from the only one."""
    before = F.last(col, ignorenulls=True).over(spec.past())
    after = F.first(col, ignorenulls=True).over(spec.series().rowsBetween(0, Window.unboundedFollowing))
    pair = df.withColumn("_a", before).withColumn("_b", after)
    agree = F.abs(F.col("_a") - F.col("_b")) <= tolerance * F.abs(F.col("_a"))
    value = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull() | agree, F.col("_a"))
    return pair.withColumn(out, value).drop("_a", "_b")


def near_event(rows: DataFrame, events: DataFrame, days: int, spec: PanelSpec = PANEL) -> DataFrame:
    """Rows with an event of their entity within so many days. Each event marks the days around it; the rest is equality."""
    around = events.select(spec.entity, F.explode(F.sequence(F.date_sub(spec.date, days), F.date_add(spec.date, days))).alias(spec.date)).distinct()
    return rows.join(around, [spec.entity, spec.date], "left_semi")


def publication_date(period_end: Column, lag: int = 45, year_end_lag: int = 90) -> Column:
    """When a quarter's statement is public: 45 days after its end, 90 for the last quarter."""
    return F.date_add(period_end, F.when(F.month(period_end) == 12, F.lit(year_end_lag)).otherwise(F.lit(lag)))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], allow_shrink: bool = False, fill: bool = False, spec: PanelSpec = PANEL) -> DataFrame:
    """New rows win; rows only in the old snapshot stay, since a batch that lacks an entity may just be incomplete.

    With ``allow_shrink`` the old rows of every date of the batch go, so that the batch alone says what the date holds. With ``fill``
    nulls of a new row are filled from the old row of its key. Of new rows with one key the one with the largest values counts, column by column in order.
    """
    if allow_shrink:
        old = old.join(new.select(spec.date).distinct(), spec.date, "left_anti").select(*old.columns)
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    values = [c for c in rows.columns if c not in (*keys, "_new")]
    w = Window.partitionBy(*keys).orderBy(F.col("_new").desc(), *[F.col(c).desc_nulls_last() for c in values])
    if fill:
        whole = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        rows = rows.select(*keys, "_new", *[F.first(c, ignorenulls=True).over(whole).alias(c) for c in values], F.row_number().over(w).alias("_r"))
        return rows.where("_r = 1").drop("_new", "_r")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_new", "_r")


def market_as_of(rows: DataFrame, level: DataFrame, available: str, value_cols: list[str], spec: PanelSpec = PANEL) -> DataFrame:
    """Each row with the latest market-level values available on its date: as-of on the dates alone, then one equality join.

    The windows run over one row a date and one a publication.
    """
    days = rows.select(F.col(spec.date).alias("_t")).distinct().select("_t", F.lit(1).alias("_side"), F.lit(None).cast(level.select(F.struct(*value_cols).alias("x")).schema["x"].dataType).alias("_f"))
    facts = level.where(F.col(available).isNotNull()).select(F.col(available).alias("_t"), F.lit(0).alias("_side"), F.struct(*value_cols).alias("_f"))
    w = Window.orderBy("_t", "_side", "_f").rowsBetween(Window.unboundedPreceding, 0)
    found = days.unionByName(facts).withColumn("_f", F.last("_f", ignorenulls=True).over(w)).where("_side = 1").select(F.col("_t").alias(spec.date), "_f")
    return rows.join(F.broadcast(found), spec.date, "left").select(*[F.col(c) for c in rows.columns], "_f.*")


def splice(old: DataFrame, new: DataFrame, col: str, spec: PanelSpec = PANEL) -> DataFrame:
    """The new series, and the old one before it scaled by new / old at their first common date; src tells them apart.

    Old rows from the new series' first date on, and of entities without a common date, go.
    """
    keys = [spec.entity, spec.date]
    both = old.select(*keys, F.col(col).alias("_o")).where("_o > 0").join(new.select(*keys, F.col(col).alias("_n")), keys)
    factor = both.groupBy(spec.entity).agg(F.min_by(F.col("_n") / F.col("_o"), spec.date).alias("_f"))
    first = new.groupBy(spec.entity).agg(F.min(spec.date).alias("_first"))
    scaled = old.join(factor, spec.entity).join(first, spec.entity).where(F.col(spec.date) < F.col("_first"))
    return scaled.select(*keys, (F.col(col) * F.col("_f")).alias(col), F.lit("old").alias("src")).unionByName(new.select(*keys, col, F.lit("new").alias("src")))


def event_in_gap(rows: DataFrame, events: DataFrame, out: str = "hit", spec: PanelSpec = PANEL) -> DataFrame:
    """Whether an event of the entity falls after its row before and not after this row; False on the first row.

    Rows and events share one series, events first on equal dates; each row counts the events since the row before.
    """
    kind = rows.select(F.struct(*rows.columns).alias("x")).schema["x"].dataType
    a = rows.select(F.col(spec.entity).alias("_e"), F.col(spec.date).alias("_t"), F.lit(1).alias("_side"), F.struct(*rows.columns).alias("_row"))
    b = events.select(F.col(spec.entity).alias("_e"), F.col(spec.date).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_row"))
    w = Window.partitionBy("_e").orderBy("_t", "_side")
    n = F.sum(1 - F.col("_side")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    counted = a.unionByName(b).withColumn("_n", n).where("_side = 1")
    before = F.lag("_n", 1).over(Window.partitionBy("_e").orderBy("_t"))
    return counted.withColumn("_hit", F.coalesce(F.col("_n") > before, F.lit(False))).select("_row.*", F.col("_hit").alias(out))
