"""Per-entity windows. Each function adds one column; windows of one spec share one sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PANEL, PanelSpec, at_least


def pct_change(df: DataFrame, col: str, n: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(col), F.lag(col, n).over(spec.series())) - 1)


def forward_return(df: DataFrame, col: str, n: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    return df.withColumn(out, F.try_divide(F.lead(col, n).over(spec.series()), F.col(col)) - 1)


def difference(df: DataFrame, col: str, k: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    return df.withColumn(out, F.col(col) - F.lag(col, k).over(spec.series()))


def rolling(df: DataFrame, col: str, how: str, rows: int, least: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """``how`` names an aggregate: avg, stddev_samp, min, max, sum, median."""
    w = spec.series(rows)
    if how == "median":  # no frames for it: the frame's values, sorted, give it
        v, n = F.sort_array(F.collect_list(col).over(w)), F.count(col).over(w)
        value = (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2
    else:
        value = getattr(F, how)(col).over(w)
    return df.withColumn(out, at_least(value, F.col(col), least, w))


def lag_block(df: DataFrame, cols: list[str], lags: list[int], spec: PanelSpec = PANEL) -> DataFrame:
    w = spec.series()
    return df.select("*", *[F.lag(c, n).over(w).alias(f"{c}_lag{n}") for c in cols for n in lags])


def forward_fill(df: DataFrame, col: str, out: str, default: Column | None = None, spec: PanelSpec = PANEL) -> DataFrame:
    filled = F.last(col, ignorenulls=True).over(spec.past())
    return df.withColumn(out, filled if default is None else F.coalesce(filled, default))


def true_range(df: DataFrame, out: str, high: str = "high", low: str = "low", close: str = "close", spec: PanelSpec = PANEL) -> DataFrame:
    """The largest of high - low and the distances of either to the last close; nulls are skipped."""
    before = F.lag(close, 1).over(spec.series())
    return df.withColumn(out, F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before)))


#: Beyond this exponent of e, powers of the decay would leave the range of doubles.
EWM_RANGE = 600.0


def ewm(df: DataFrame, col: str, alpha: float, adjust: bool, out: str, least: int = 1, spec: PanelSpec = PANEL) -> DataFrame:
    """Exponentially weighted mean by prefix sums; weights follow row positions, rows with null included.

    With r = 1 - alpha. Adjusted: each row decays what is before it by r, and the sum is divided by that of the weights. Not
    adjusted: a value g rows after the one before keeps ``r^g / (r^g + alpha)`` of the mean so far and adds the rest of itself,
    so a constant series stays constant over gaps. Rows with null show the mean so far. Rows are re-based whenever they have
    decayed by ``e^EWM_RANGE``; a block adds the block before it with its decay, so long series stay in range.
    """
    r = 1.0 - alpha
    w, known = spec.series(), F.col(col).isNotNull()
    base = df.withColumn("_n", F.row_number().over(w)).withColumn("_seen", F.count(col).over(spec.past()))
    if adjust:
        decayed = base.withColumn("_l", F.col("_n") * math.log(r)).withColumn("_part", F.when(known, F.lit(1.0)))
    else:
        gap = F.col("_n") - F.max(F.when(known, F.col("_n"))).over(spec.past(-1))
        fade = F.pow(F.lit(r), F.col("_g"))
        keep = F.when(known & F.col("_g").isNotNull(), F.log(fade / (fade + alpha))).otherwise(F.lit(0.0))
        part = F.when(known, F.when(F.col("_g").isNull(), F.lit(1.0)).otherwise(alpha / (fade + alpha)))
        decayed = base.withColumn("_g", gap).withColumn("_k", keep).withColumn("_part", part).withColumn("_l", F.sum("_k").over(spec.past())).drop("_g", "_k")
    based = decayed.withColumn("_b", F.floor(-F.col("_l") / EWM_RANGE)).withColumn("_m", F.col("_l") + F.col("_b") * EWM_RANGE)
    in_block = based.withColumn("_w", F.col("_part") * F.exp(-F.col("_m")))
    own = Window.partitionBy(spec.entity, "_b").orderBy(spec.date).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(spec.entity, "_b")
    last_block = Window.partitionBy(spec.entity).orderBy("_b").rangeBetween(-1, -1)
    # the block before counts through its sums at its end; older ones weigh less than e**-600
    at_end = F.lit(math.exp(-EWM_RANGE))
    summed = in_block.select(
        "*", F.sum(F.col("_w") * F.col(col)).over(own).alias("_s"), F.sum("_w").over(own).alias("_t"),
        (F.sum(F.col("_w") * F.col(col)).over(whole) * at_end).alias("_se"), (F.sum("_w").over(whole) * at_end).alias("_te"),
    )
    carried = summed.select("*", F.coalesce(F.max("_se").over(last_block), F.lit(0.0)).alias("_sp"), F.coalesce(F.max("_te").over(last_block), F.lit(0.0)).alias("_tp"))
    top = F.coalesce("_s", F.lit(0.0)) + F.col("_sp")
    value = top / F.nullif(F.coalesce("_t", F.lit(0.0)) + F.col("_tp"), F.lit(0.0)) if adjust else F.exp("_m") * top
    ready = F.when(F.col("_seen") >= least, value)
    return carried.withColumn(out, ready).drop("_n", "_seen", "_l", "_part", "_b", "_m", "_w", "_s", "_t", "_se", "_te", "_sp", "_tp")


def rsi(df: DataFrame, col: str, out: str, alpha: float, adjust: bool, least: int = 14, spec: PanelSpec = PANEL, floor: float | None = None) -> DataFrame:
    """Relative strength from exponentially weighted gains and losses; a loss of 0 gives null, or counts as ``floor``."""
    step = F.col(col) - F.lag(col, 1).over(spec.series())
    moved = df.withColumn("_step", step).withColumn("_up", F.greatest("_step", F.lit(0.0))).withColumn("_down", F.greatest(-F.col("_step"), F.lit(0.0)))
    moved = moved.withColumn("_up", F.when(F.col("_step").isNotNull(), F.col("_up"))).withColumn("_down", F.when(F.col("_step").isNotNull(), F.col("_down")))
    both = ewm(ewm(moved, "_up", alpha, adjust, "_u", least, spec), "_down", alpha, adjust, "_v", least, spec)
    return both.withColumn(out, 100 - 100 / (1 + F.col("_u") / (F.nullif("_v", F.lit(0.0)) if floor is None else F.when(F.col("_v") == 0, F.lit(floor)).otherwise(F.col("_v"))))).drop("_step", "_up", "_down", "_u", "_v")


def rsi_window(df: DataFrame, col: str, out: str, rows: int, period: int = 14, otherwise: float = 50.0, spec: PanelSpec = PANEL) -> DataFrame:
    """Relative strength over each row's last ``rows`` rows: means of the first ``period`` moves, then smoothed by 1 / period.

    ``otherwise`` with fewer than ``period + 2`` rows. A frame holds ``rows`` values at most; nulls are left out.
    """
    from .patterns import relative_strength

    seen = df.withColumn("_c", F.collect_list(F.col(col).cast("double")).over(spec.series(rows)))
    return seen.withColumn(out, F.when(F.size("_c") >= period + 2, relative_strength(F.col("_c"), period)).otherwise(float(otherwise))).drop("_c")


def expanding_z(df: DataFrame, col: str, out: str, least: int, clip: float = 3.0, spec: PanelSpec = PANEL) -> DataFrame:
    """Z-score against all rows before this one, within +-clip."""
    w = spec.past(-1)
    z = (F.col(col) - F.avg(col).over(w)) / F.nullif(F.stddev_samp(col).over(w), F.lit(0.0))
    return df.withColumn(out, at_least(F.greatest(F.lit(-clip), F.least(F.lit(clip), z)), F.col(col), least, w))


def moments(df: DataFrame, col: str, spec: PanelSpec = PANEL) -> DataFrame:
    """entity, until, n, mean, m2: what later rows need to know of an entity's values so far (m2: sum of squares around the mean)."""
    known = df.where(F.col(col).isNotNull())
    return known.groupBy(spec.entity).agg(F.max(spec.date).alias("until"), F.count(col).alias("n"), F.avg(col).alias("mean"), (F.var_pop(col) * F.count(col)).alias("m2"))


def merge_moments(a: DataFrame, b: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """The moments of both, one row an entity each: those of a history and of the rows that came since, for example."""
    other = b.select(spec.entity, *[F.col(c).alias(f"_{c}") for c in ("until", "n", "mean", "m2")])
    both = a.join(other, spec.entity, "full_outer")
    m, k = F.coalesce("n", F.lit(0)), F.coalesce("_n", F.lit(0))
    apart = F.when((m > 0) & (k > 0), F.col("_mean") - F.col("mean")).otherwise(0.0)
    return both.select(
        spec.entity, F.greatest("until", "_until").alias("until"), (m + k).alias("n"), (F.coalesce("mean", "_mean") + apart * k / (m + k)).alias("mean"),
        (F.coalesce("m2", F.lit(0.0)) + F.coalesce("_m2", F.lit(0.0)) + apart * apart * m * k / (m + k)).alias("m2"),
    )


def expanding_z_tail(tail: DataFrame, history: DataFrame, col: str, out: str, least: int, clip: float = 3.0, spec: PanelSpec = PANEL) -> DataFrame:
    """``expanding_z`` of the rows after a history, of which only the moments are read.

    Values are taken from the history's mean, so that its sum is 0 and running sums of the tail alone give mean and deviation of all rows before.
    """
    met = tail.join(history.select(spec.entity, F.col("n").alias("_n"), F.col("mean").alias("_mean"), F.col("m2").alias("_m2")), spec.entity, "left")
    first = F.first(col, ignorenulls=True).over(spec.series().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = met.withColumn("_mean", F.coalesce("_mean", first)).withColumn("_x", F.col(col) - F.col("_mean"))
    w = spec.past(-1)
    n = F.coalesce("_n", F.lit(0)) + F.count("_x").over(w)
    s1, s2 = F.coalesce(F.sum("_x").over(w), F.lit(0.0)), F.coalesce("_m2", F.lit(0.0)) + F.coalesce(F.sum(F.col("_x") * F.col("_x")).over(w), F.lit(0.0))
    deviation = F.sqrt(F.greatest(F.lit(0.0), s2 - s1 * s1 / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0)))
    z = (F.col("_x") - s1 / F.nullif(n, F.lit(0))) / F.nullif(deviation, F.lit(0.0))
    return met.withColumn(out, F.when(n >= least, F.greatest(F.lit(-clip), F.least(F.lit(clip), z)))).drop("_n", "_mean", "_m2", "_x")


def streak(df: DataFrame, flag: Column, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Rows in a row, up to this one, on which the flag holds."""
    island = F.sum(F.when(flag, F.lit(0)).otherwise(F.lit(1))).over(spec.past())
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False))).withColumn("_island", island)
    w = Window.partitionBy(spec.entity, "_island").orderBy(spec.date).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(out, F.sum(F.col("_flag").cast("long")).over(w)).drop("_flag", "_island")


def on_balance_volume(df: DataFrame, close: str, volume: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    step = F.signum(F.col(close) - F.lag(close, 1).over(spec.series())) * F.col(volume)
    return df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn(out, F.sum("_step").over(spec.past())).drop("_step")


def local_minimum(df: DataFrame, col: str, order: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Whether a value is the least within ``order`` rows on either side; rows too near an end are not."""
    w = spec.series().rowsBetween(-order, order)
    return df.withColumn(out, (F.count(F.lit(1)).over(w) == 2 * order + 1) & (F.col(col) <= F.min(col).over(w)))


def hysteresis(df: DataFrame, rank: str, enter: int, leave: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """1 from a rank up to ``enter`` until one beyond ``leave``."""
    mark = F.when(F.col(rank) <= enter, F.lit(1)).when(F.col(rank) > leave, F.lit(0))
    return df.withColumn("_mark", mark).withColumn(out, F.coalesce(F.last("_mark", ignorenulls=True).over(spec.past()), F.lit(0))).drop("_mark")


def beta(df: DataFrame, y: str, x: str, rows: int, least: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    w = spec.series(rows)
    both = F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), F.lit(1))
    paired = lambda c: F.when(both.isNotNull(), F.col(c))
    value = F.covar_samp(paired(y), paired(x)).over(w) / F.nullif(F.var_samp(paired(x)).over(w), F.lit(0.0))
    return df.withColumn(out, at_least(value, both, least, w))


def local_extrema(df: DataFrame, col: str, order: int, spec: PanelSpec = PANEL) -> DataFrame:
    """The rows that are lowest or highest among ``order`` rows on either side, with kind (low, high); of a plateau the first row.

    Rows nearer than ``order`` to an end of the series are none; a row that is both is a low.
    """
    w, s = spec.series().rowsBetween(-order, order), spec.series()
    full = F.count(F.lit(1)).over(w) == 2 * order + 1
    flagged = df.withColumns({"_low": full & (F.col(col) <= F.min(col).over(w)), "_high": full & (F.col(col) >= F.max(col).over(w))})
    first = lambda c: F.col(c) & ~F.coalesce(F.lag(c).over(s), F.lit(False))
    return flagged.withColumn("kind", F.when(first("_low"), "low").when(first("_high"), "high")).where("kind is not null").drop("_low", "_high")
