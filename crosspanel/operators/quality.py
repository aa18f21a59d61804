"""Profiling, reconciliation and data-quality reports, each one pass per table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PANEL, PanelSpec
from .quantiles import with_quantiles


def _stacked(df: DataFrame, cols: list[str], by: list, measures: dict) -> DataFrame:
    """One row for each group and column: the measures of all columns in one aggregate, stacked after it."""
    one = df.groupBy(*by).agg(*[f(F.col(c).cast("double")).alias(f"_{m}_{k}") for k, c in enumerate(cols) for m, f in measures.items()])
    rows = [F.struct(F.lit(c).alias("name"), *[F.col(f"_{m}_{k}").alias(m) for m in measures]) for k, c in enumerate(cols)]
    keys = [c for c in one.columns if not any(c.startswith(f"_{m}_") for m in measures)]
    return one.select(*keys, F.explode(F.array(*rows)).alias("_c")).select(*keys, "_c.*")


def column_profile(df: DataFrame, cols: list[str], by: list[str] | None = None, near: float = 1e-6) -> DataFrame:
    """Null, zero and near-zero shares, range and deviation of each column, by group if wanted."""
    measures = {
        "null_share": lambda v: F.avg(v.isNull().cast("double")), "zero_share": lambda v: F.avg((v == 0).cast("double")),
        "near_zero_share": lambda v: F.avg((F.abs(v) < near).cast("double")), "low": F.min, "high": F.max, "std": F.stddev_samp,
    }
    return _stacked(df, cols, by or [], measures)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def rule_violations(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Counts of values below and above each column's bounds, in one pass."""
    found = df.agg(*[c.alias(f"{name}_{side}") for name, (low, high) in bounds.items() for side, c in (
        ("low", F.count_if(F.col(name) < low) if low is not None else F.lit(0).cast("long")), ("high", F.count_if(F.col(name) > high) if high is not None else F.lit(0).cast("long")))])
    rows = [F.struct(F.lit(n).alias("rule_column"), F.col(f"{n}_low").alias("below"), F.col(f"{n}_high").alias("above")) for n in bounds]
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def daily_counts(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Distinct entities per date, and the change since the date before."""
    n = df.groupBy(spec.date).agg(F.countDistinct(spec.entity).alias("n"))
    return n.withColumn("change", F.col("n") - F.lag("n", 1).over(Window.orderBy(spec.date)))


def lifecycle(df: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    gap = F.datediff(spec.date, F.lag(spec.date, 1).over(spec.series()))
    return df.withColumn("_gap", gap).groupBy(spec.entity).agg(F.min(spec.date).alias("first_d"), F.max(spec.date).alias("last_d"), F.count(F.lit(1)).alias("n"), F.max("_gap").alias("max_gap"))


def staleness(sources: dict[str, tuple[DataFrame, str]], budget: int) -> DataFrame:
    """Last date of each source, its lag behind the latest of all, and whether it is over budget."""
    lasts = [df.agg(F.max(F.to_date(col)).alias("last_d"), F.min(F.to_date(col)).alias("first_d")).withColumn("name", F.lit(name)) for name, (df, col) in sources.items()]
    every = reduce(DataFrame.unionByName, lasts)
    newest = F.max("last_d").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return every.withColumn("lag_days", F.datediff(newest, "last_d")).withColumn("stale", F.col("lag_days") > budget)


def coverage(base: DataFrame, side: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Share of the base rows of each year that the side source has."""
    keys = side.select(spec.entity, spec.date).distinct().withColumn("_hit", F.lit(1.0))
    joined = base.join(keys, [spec.entity, spec.date], "left")
    return joined.groupBy(F.year(spec.date).alias("year")).agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("coverage"), F.count(F.lit(1)).alias("n"))


def dead_days(df: DataFrame, cols: list[str], eps: float = 1e-6, spec: PanelSpec = PANEL) -> DataFrame:
    """Share of a year's dates on which a column barely varies across entities."""
    days = _stacked(df, cols, [spec.date], {"s": F.stddev_samp})
    return days.groupBy(F.year(spec.date).alias("year"), "name").agg(F.avg((F.coalesce("s", F.lit(0.0)) < eps).cast("double")).alias("dead_share"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str, by: str, tolerance: float) -> DataFrame:
    """Median ratio of two sources' values by type, and the share within tolerance."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    ratio = F.col("_a") / F.nullif("_b", F.lit(0.0))
    both = both.withColumn("_r", ratio)
    groups = both.groupBy(by).agg(F.avg((F.abs(F.col("_r") - 1) <= tolerance).cast("double")).alias("within"), F.count(F.lit(1)).alias("n"))
    return with_quantiles(groups, both, "_r", [by], {"median_ratio": 0.5})


def compare_builds(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of either build, differing rows, null mismatches and the largest difference."""
    both = a.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_ia")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_ib")), keys, "full_outer")
    here = F.col("_ia").isNotNull() & F.col("_ib").isNotNull()
    return both.agg(
        F.count_if(here).alias("common"), F.count_if(F.col("_ib").isNull()).alias("only_a"), F.count_if(F.col("_ia").isNull()).alias("only_b"),
        F.count_if(here & (F.col("_a") != F.col("_b"))).alias("differ"), F.count_if(here & (F.col("_a").isNull() != F.col("_b").isNull())).alias("null_mismatch"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"),
    )


def churn(old: DataFrame, new: DataFrame, key: str, col: str) -> DataFrame:
    """Transition counts of a category between two snapshots."""
    both = old.select(key, F.col(col).alias("before")).join(new.select(key, F.col(col).alias("after")), key)
    return both.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def single_period(df: DataFrame, value: str, out: str, key: list[str], period: str) -> DataFrame:
    """Year-to-date figures to single quarters: the first of a year as it is, later ones less the one before."""
    w = Window.partitionBy(*key, F.year(period)).orderBy(period)
    first = F.quarter(period) == 1
    previous = F.when(F.quarter(F.lag(period, 1).over(w)) == F.quarter(period) - 1, F.lag(value, 1).over(w))
    return df.withColumn(out, F.when(first, F.col(value)).otherwise(F.col(value) - previous)).where(F.col(out).isNotNull())


def business_days(day: Column) -> Column:
    """Weekdays from Monday 1970-01-05 up to a date, exclusive; differences count the weekdays between two dates."""
    days = F.datediff(day, F.lit("1970-01-05").cast("date"))
    return F.floor(days / 7) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(5))


def calendar_holes(df: DataFrame, most: int = 5, spec: PanelSpec = PANEL) -> DataFrame:
    """entity, after, date, gap: consecutive dates of an entity more than ``most`` weekdays apart."""
    before = F.lag(spec.date).over(Window.partitionBy(spec.entity).orderBy(spec.date))
    steps = df.select(spec.entity, spec.date).distinct().withColumn("after", before)
    return steps.withColumn("gap", (business_days(F.col(spec.date)) - business_days(F.col("after"))).cast("long")).where(F.col("gap") > most)


def identity_checks(df: DataFrame, by: Column, rules: dict[str, Column]) -> DataFrame:
    """Share of each group's rows on which each identity holds; a rule that is null fails."""
    return df.groupBy(by).agg(*[F.avg(rule.cast("double")).alias(name) for name, rule in rules.items()], F.count(F.lit(1)).alias("n"))


def extreme_changes(df: DataFrame, col: str, events: DataFrame, least: float, days: int, low: float, spec: PanelSpec = PANEL) -> DataFrame:
    """Rows that changed by ``least`` or more, with the first cause that fits: event, gap, low base, unexplained."""
    w = spec.series()
    moved = df.withColumn("_low", F.lag(col, 1).over(w)).withColumn("_before", F.lag(spec.date, 1).over(w)).where(F.abs(F.try_divide(F.col(col), F.col("_low")) - 1) >= least)
    known = events.select(spec.entity, spec.date, F.lit(True).alias("_event")).distinct()
    cause = F.when(F.col("_event"), "event").when(F.datediff(spec.date, "_before") > days, "gap").when(F.col("_low") < low, "low base").otherwise("unexplained")
    return moved.join(known, [spec.entity, spec.date], "left").withColumn("cause", cause).drop("_low", "_before", "_event")


def expectations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """rule, passed: aggregate conditions over a table, all in one pass; an unknown result fails."""
    found = df.agg(*[F.coalesce(F.expr(x), F.lit(False)).alias(f"_r{k}") for k, x in enumerate(rules.values())])
    return found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_r{k}").alias("passed")) for k, n in enumerate(rules)])).alias("r")).select("r.*")


def inventory(sources: dict[str, tuple[DataFrame, str]], until: str) -> DataFrame:
    """name, first_d, last_d, lag_days behind a reference date, and whether the source reaches it."""
    end = F.lit(until).cast("date")
    one = [df.agg(F.min(F.to_date(c)).alias("first_d"), F.max(F.to_date(c)).alias("last_d")).select(F.lit(n).alias("name"), "first_d", "last_d") for n, (df, c) in sources.items()]
    return reduce(DataFrame.unionByName, one).withColumn("lag_days", F.datediff(end, "last_d")).withColumn("covers", F.col("last_d") >= end)


def swap_diagnosis(df: DataFrame, balance: str, added: str, taken: str, least: int, threshold: float, spec: PanelSpec = PANEL) -> DataFrame:
    """entity, year, n, verdict: whether two columns are swapped, by the correlation of the balance's change with their difference.

    A year with ``least`` moves or more decides for itself, else the entity's whole history; keep, swap, or unknown.
    """
    step = F.col(balance) - F.lag(balance).over(spec.series())
    moves = df.withColumns({"_b": step, "_n": F.col(added) - F.col(taken), "year": F.year(spec.date).cast("long")}).where((F.col("_b") != 0) | (F.col("_b").isNotNull() & (F.col("_n") != 0)))
    rho = F.when((F.count(F.lit(1)) >= least) & (F.stddev_pop("_b") * F.stddev_pop("_n") > 0), F.corr("_b", "_n"))
    years = moves.groupBy(spec.entity, "year").agg(F.count(F.lit(1)).alias("n"), rho.alias("_y"))
    both = years.join(moves.groupBy(spec.entity).agg(rho.alias("_e")), spec.entity)
    say = lambda c: F.when(F.col(c) < -threshold, "swap").when(F.col(c) > threshold, "keep")
    return both.select(spec.entity, "year", "n", F.coalesce(say("_y"), say("_e"), F.lit("unknown")).alias("verdict"))


def unswapped(df: DataFrame, verdicts: DataFrame, added: str, taken: str, spec: PanelSpec = PANEL) -> DataFrame:
    """The rows with both columns exchanged where the verdict is swap."""
    year = F.year(spec.date).cast("long")
    marked = df.withColumn("year", year).join(verdicts.select(spec.entity, "year", "verdict"), [spec.entity, "year"], "left")
    wrong = F.coalesce(F.col("verdict") == "swap", F.lit(False))
    return marked.withColumns({added: F.when(wrong, F.col(taken)).otherwise(F.col(added)), taken: F.when(wrong, F.col(added)).otherwise(F.col(taken))}).drop("year", "verdict")


def limit_scan(df: DataFrame, col: str, limit: Column, around: int = 5, spec: PanelSpec = PANEL) -> DataFrame:
    """Adds over (change beyond the limit), spike (the next one too, the other way) and near (any within ``around`` rows)."""
    w = spec.series()
    moved = df.withColumns({"_r": F.col(col) / F.nullif(F.lag(col).over(w), F.lit(0.0)) - 1, "_limit": limit})
    moved = moved.withColumns({"over": F.coalesce(F.abs("_r") > F.col("_limit"), F.lit(False)), "_next": F.lead("_r").over(w)})
    spike = F.col("over") & (F.abs("_next") > F.col("_limit")) & (F.signum("_r") != F.signum("_next"))
    near = F.max(F.col("over").cast("int")).over(w.rowsBetween(-around, around)) == 1
    return moved.withColumns({"spike": F.coalesce(spike, F.lit(False)), "near": near}).drop("_r", "_limit", "_next")


def fill_check(df: DataFrame, col: str, held: Column, tolerance: float, spec: PanelSpec = PANEL) -> DataFrame:
    """n, coverage, median and 95 % relative error, passed: held-out values against the mean of their neighbours outside."""
    rest = df.where(F.col(col) > 0).withColumn("_held", held).withColumn("_known", F.when(~F.col("_held"), F.col(col)))
    w = spec.series()
    before = F.last("_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_known", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    error = rest.withColumn("_error", F.abs((before + after) / 2 - F.col(col)) / F.col(col)).where("_held")
    found = error.agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("_error").isNotNull().cast("double")).alias("coverage"), F.avg((F.col("_error") <= tolerance).cast("double")).alias("passed")
    )
    return with_quantiles(found, error, "_error", [], {"median": 0.5, "p95": 0.95})


def build_gate(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str], inside: Column) -> DataFrame:
    """inside, column, n, only_a, only_b, differing, null_mismatch, largest: two builds of a table, in and outside a window."""
    one = lambda t, tag: t.select(*keys, F.lit(1).alias(f"_in_{tag}"), *[F.col(c).cast("double").alias(f"_{tag}_{c}") for c in cols])
    both = one(a, "a").join(one(b, "b"), keys, "full_outer").withColumn("inside", inside)
    met = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_a_{c}").alias("x"), F.col(f"_b_{c}").alias("y")) for c in cols])).alias("c")
    long = both.select("inside", met.alias("met"), F.col("_in_a").isNull().alias("no_a"), F.col("_in_b").isNull().alias("no_b"), cells).select("*", "c.*")
    return long.groupBy("inside", "column").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("no_b").alias("only_a"), F.count_if("no_a").alias("only_b"), F.count_if(F.col("met") & (F.col("x") != F.col("y"))).alias("differing"),
        F.count_if(F.col("met") & (F.col("x").isNull() != F.col("y").isNull())).alias("null_mismatch"), F.max(F.abs(F.col("x") - F.col("y"))).alias("largest"),
    )


def event_parts(events: DataFrame, dates: dict[str, list[str]], sums: list[str], spec: PanelSpec = PANEL) -> DataFrame:
    """entity, date and the sums of the parts that fall on it: ``dates`` names for each date column the parts that it stands for.

    A record with two dates counts on each with its own parts; parts on one date are added.
    """
    rows = None
    for date, parts in dates.items():
        one = events.where(F.col(date).isNotNull()).select(spec.entity, F.col(date).alias(spec.date), *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in parts else F.lit(0.0)).alias(c) for c in sums])
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(spec.entity, spec.date).agg(*[F.sum(c).alias(c) for c in sums])


def reference_value(before: Column, cash: Column, stock: Column, rate: Column, price: Column) -> Column:
    """The value after an event that pays cash, adds stock by a ratio, and sells new stock by a rate at a price."""
    return F.try_divide(before - cash + price * rate, 1 + stock + rate)


def reference_check(official: DataFrame, parts: DataFrame, value: str, before: str, units: list[float], tolerances: list[float], by: list[str], spec: PanelSpec = PANEL) -> DataFrame:
    """by, unit, n, median, share within each tolerance, chosen: theoretical over official values, for each unit that the rate may be in.

    The unit with the largest share within the second tolerance (or the only one) is chosen, over all rows; ties go to the smaller unit.
    """
    met = official.join(parts, [spec.entity, spec.date])
    each = met.withColumn("unit", F.explode(F.array(*[F.lit(float(u)) for u in units])))
    theory = reference_value(F.col(before), F.col("cash"), F.col("stock"), F.col("rate") / F.col("unit"), F.col("price"))
    each = each.withColumn("_r", F.try_divide(theory, F.col(value))).where("_r is not null and not isnan(_r) and abs(_r) < double('inf')")
    near = lambda t: F.avg((F.abs(F.col("_r") - 1) <= t).cast("double"))
    best = each.groupBy("unit").agg(near(tolerances[min(1, len(tolerances) - 1)]).alias("_w")).orderBy(F.col("_w").desc(), "unit").limit(1).select("unit").withColumn("chosen", F.lit(True))
    found = each.groupBy(*by, "unit").agg(F.count(F.lit(1)).alias("n"), *[near(t).alias(f"within_{k}") for k, t in enumerate(tolerances)])
    found = with_quantiles(found, each, "_r", [*by, "unit"], {"median": 0.5})
    return found.join(F.broadcast(best), "unit", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))  # one row


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key: the last in this order (nulls first); rows equal in it are told apart by all their columns."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order], F.xxhash64(*df.columns))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def column_profile_by(df: DataFrame, cols: list[str], by: list[Column], near: float = 1e-9) -> DataFrame:
    """by, name, n, null_share, zero_share, near_zero_share, low, high, std of each column, in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("c")
    share = lambda flag: F.coalesce(F.avg(flag.cast("double")), F.lit(0.0))
    v = F.col("c.v")
    return df.select(*by, cells).groupBy(*[df.select(b).columns[0] for b in by], F.col("c.name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v.isNull().cast("double")).alias("null_share"), share(v == 0).alias("zero_share"), share(F.abs(v) < near).alias("near_zero_share"),
        F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("std"),
    )


def count_breaches(df: DataFrame, tolerance: float, spec: PanelSpec = PANEL) -> DataFrame:
    """date, n, change, breach: distinct entities a date, and whether they changed by more than a share of the date before."""
    counts = df.groupBy(spec.date).agg(F.countDistinct(spec.entity).alias("n"))
    before = F.lag("n").over(Window.orderBy(spec.date))  # one row a date
    return counts.withColumn("change", F.col("n") - before).withColumn("breach", F.coalesce(F.abs("change") > F.lit(tolerance) * before, F.lit(False)))


def calendar_difference(df: DataFrame, reference: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """date, side: dates of the reference that the table lacks (missing) and of the table that the reference lacks (extra), between the
    first and the last date of the table."""
    own, ref = df.select(spec.date).distinct(), reference.select(spec.date).distinct()
    ends = own.agg(F.min(spec.date).alias("_a"), F.max(spec.date).alias("_b"))
    within = ref.join(F.broadcast(ends), F.col(spec.date).between(F.col("_a"), F.col("_b"))).select(spec.date)  # one row
    lacks = within.join(own, spec.date, "left_anti").withColumn("side", F.lit("missing"))
    return lacks.unionByName(own.join(ref, spec.date, "left_anti").withColumn("side", F.lit("extra")))


def same_day_coverage(base: DataFrame, sides: dict[str, DataFrame], tradable: Column, spec: PanelSpec = PANEL) -> DataFrame:
    """date, n and, for each side source, the share of the date's tradable rows that it has."""
    rows = base.where(tradable).select(spec.entity, spec.date)
    for name, side in sides.items():
        rows = rows.join(side.select(spec.entity, spec.date).distinct().withColumn(name, F.lit(1.0)), [spec.entity, spec.date], "left")
    return rows.groupBy(spec.date).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(name, F.lit(0.0))).alias(name) for name in sides])


def constant_days(df: DataFrame, cols: list[str], spec: PanelSpec = PANEL) -> DataFrame:
    """name, values (distinct over all rows), days, constant_days: whether a column has one value for all entities of a date."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("c")
    long = df.select(spec.date, cells).select(spec.date, "c.*").where("v is not null")
    days = long.groupBy("name", spec.date).agg((F.min("v") == F.max("v")).alias("one"))
    values = long.groupBy("name", "v").agg(F.lit(1).alias("_")).groupBy("name").agg(F.count(F.lit(1)).alias("values"))
    return days.groupBy("name").agg(F.count(F.lit(1)).alias("days"), F.count_if("one").alias("constant_days")).join(values, "name")


def members_changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, change: entities that a snapshot lost, gained, or has under another value."""
    a, b = (t.select(key, F.col(value).alias(n), F.lit(True).alias(f"_{n}")) for t, n in ((before, "before"), (after, "after")))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_after").isNull(), "removed").when(F.col("_before").isNull(), "added").when(~F.col("before").eqNullSafe(F.col("after")), "moved")
    return both.withColumn("change", change).where("change is not null").select(key, "before", "after", "change")


def build_ratios(a: DataFrame, b: DataFrame, keys: list[str], col: str, by: Column, shares: dict[str, float], extreme: float) -> DataFrame:
    """period, n, equal, extremes and quantiles of b / a over common rows: how a rebuilt column differs, period by period."""
    both = a.select(*keys, F.col(col).alias("_a")).join(b.select(*keys, F.col(col).alias("_b")), keys).withColumn("period", by).withColumn("_r", F.try_divide("_b", "_a"))
    found = both.groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_a") == F.col("_b")).cast("double")).alias("equal"), F.count_if(F.abs(F.col("_r") - 1) > extreme).alias("extremes"))
    return with_quantiles(found, both, "_r", ["period"], shares)


def sparsest(df: DataFrame, k: int, spec: PanelSpec = PANEL) -> DataFrame:
    """The k entities with the fewest rows for their dates: entity, n, of (dates from first to last seen), share; ties by entity."""
    cal = df.select(spec.date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(spec.date)))  # one row a date
    met = df.join(F.broadcast(cal), spec.date).groupBy(spec.entity).agg(F.countDistinct(spec.date).alias("n"), (F.max("_i") - F.min("_i") + 1).cast("long").alias("of"))
    return met.withColumn("share", F.col("n") / F.col("of")).orderBy("share", spec.entity).limit(k)


def key_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """only_a, only_b, both, superset (whether a has every key of b), in one shuffle of the keys."""
    rows = a.select(*keys, F.lit(1).alias("_s")).unionByName(b.select(*keys, F.lit(2).alias("_s")))
    each = rows.groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
    return each.agg(F.count_if(F.col("_s") == 1).alias("only_a"), F.count_if(F.col("_s") == 2).alias("only_b"), F.count_if(F.col("_s") == 3).alias("both")).withColumn("superset", F.col("only_b") == 0)
