"""Evaluation of ranked panels: rank correlation, its summary, spreads and return statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import period
from ..spec import PANEL, PanelSpec
from .crosssection import equal_bins, unique_rank


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of two columns without nulls; null if either is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def rank_ic(df: DataFrame, score: str, label: str, least: int, out: str = "ic", by: tuple[str, ...] = (), spec: PanelSpec = PANEL) -> DataFrame:
    """Spearman correlation per date (and group), null for a constant side; dates with fewer rows are left out."""
    both = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    day = [spec.date, *by]
    for col, rank in ((score, "_rs"), (label, "_rl")):
        w = Window.partitionBy(*day).orderBy(col)
        both = both.withColumn(rank, F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(*day, col)) - 1) / 2)
    moments = both.groupBy(*day).agg(correlation("_rs", "_rl").alias(out), F.count(F.lit(1)).alias("n"))
    return moments.where(F.col("n") >= least).select(*day, out, "n")


def pearson_ic(df: DataFrame, score: str, label: str, least: int, spec: PanelSpec = PANEL) -> DataFrame:
    both = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return both.groupBy(spec.date).agg(correlation(score, label).alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def ic_summary(ic: DataFrame, col: str = "ic", sample: bool = True) -> DataFrame:
    std = F.stddev_samp(col) if sample else F.stddev_pop(col)
    return ic.agg(F.avg(col).alias("mean"), std.alias("std"), F.count(col).alias("n"), F.avg((F.col(col) > 0).cast("double")).alias("positive")).select(
        "mean", "std", (F.col("mean") / F.nullif("std", F.lit(0.0))).alias("icir"), (F.col("mean") / F.nullif("std", F.lit(0.0)) * F.sqrt("n")).alias("t"), "positive", "n"
    )


def newey_west_t(series: DataFrame, col: str, lag: int, spec: PanelSpec = PANEL) -> DataFrame:
    """t of the mean with Bartlett weights. ``series`` has one row a date, so its windows are small."""
    w = Window.orderBy(spec.date)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    flat = series.where(F.col(col).isNotNull()).withColumn("_e", F.col(col) - F.avg(col).over(every))
    products = [F.sum(F.col(f"_p{k}")) for k in range(lag + 1)]
    lagged = flat.select(col, *[(F.col("_e") * F.lag("_e", k).over(w)).alias(f"_p{k}") for k in range(lag + 1)])
    total = products[0]
    for k in range(1, lag + 1):
        total = total + 2 * (1 - k / (lag + 1)) * products[k]
    return lagged.agg(F.avg(col).alias("mean"), F.count(col).alias("n"), total.alias("_v")).select("mean", "n", (F.col("mean") / F.sqrt(F.col("_v") / F.col("n") / F.col("n"))).alias("t"))


def top_return(df: DataFrame, score: str, ret: str, n: int, spec: PanelSpec = PANEL) -> DataFrame:
    """Mean return of the date's n best, and its excess over the date's mean."""
    ranked = unique_rank(df.where(F.col(ret).isNotNull()), score, "_r", spec)
    return ranked.groupBy(spec.date).agg(F.avg(F.when(F.col("_r") <= n, F.col(ret))).alias("top"), F.avg(ret).alias("mean")).withColumn("excess", F.col("top") - F.col("mean"))


def decile_profile(df: DataFrame, score: str, label: str, bins: int = 10, spec: PanelSpec = PANEL) -> DataFrame:
    """Mean over dates of the mean label of each score bin."""
    binned = equal_bins(df.where(F.col(label).isNotNull()), score, bins, "bin", spec)
    return binned.groupBy(spec.date, "bin").agg(F.avg(label).alias("m")).groupBy("bin").agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("days"))


def drawdown(series: DataFrame, ret: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Compounded curve of one return a date, and its distance from the running peak."""
    w = Window.orderBy(spec.date).rowsBetween(Window.unboundedPreceding, 0)
    curve = series.withColumn("curve", F.exp(F.sum(F.log1p(ret)).over(w)))
    return curve.withColumn("drawdown", F.col("curve") / F.greatest(F.lit(1.0), F.max("curve").over(w)) - 1)


def return_summary(series: DataFrame, ret: str, periods: int = 252, spec: PanelSpec = PANEL) -> DataFrame:
    down = drawdown(series, ret, spec)
    total = F.exp(F.sum(F.log1p(ret))) - 1
    return down.agg(
        total.alias("total"), (F.exp(F.sum(F.log1p(ret)) * periods / F.count(ret)) - 1).alias("annual"),
        (F.avg(ret) / F.nullif(F.stddev_pop(ret), F.lit(0.0)) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg((F.col(ret) > 0).cast("double")).alias("win_rate"),
    )


def membership_change(members: DataFrame, cal: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Kept, added and dropped entities between consecutive dates of a membership table."""
    now = members.join(F.broadcast(cal), spec.date).select(spec.entity, "idx")
    before = now.select(spec.entity, (F.col("idx") + 1).alias("idx"), F.lit(1).alias("_b"))
    both = now.withColumn("_a", F.lit(1)).join(before, [spec.entity, "idx"], "full_outer")
    counted = both.groupBy("idx").agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("kept"), F.count_if(F.col("_b").isNull()).alias("added"), F.count_if(F.col("_a").isNull()).alias("dropped")
    )
    return counted.join(F.broadcast(cal), "idx").select(spec.date, "kept", "added", "dropped")


def autocorrelation(df: DataFrame, score: str, lag: int, cal: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """Correlation per date of scores with the same entities' scores ``lag`` calendar positions before."""
    now = df.join(F.broadcast(cal), spec.date).select(spec.entity, spec.date, "idx", F.col(score).alias("_a"))
    before = now.select(spec.entity, (F.col("idx") + lag).alias("idx"), F.col("_a").alias("_b"))
    return now.join(before, [spec.entity, "idx"]).groupBy(spec.date).agg(correlation("_a", "_b").alias("rho"), F.count(F.lit(1)).alias("n"))


def expanding_folds(cal: DataFrame, test_months: int, step_months: int, min_train_months: int, spec: PanelSpec = PANEL) -> DataFrame:
    """fold, train_end, test_end with counts of dates. The fold table is small and meets the calendar by range."""
    edge = cal.agg(F.min(spec.date).alias("a"), F.max(spec.date).alias("b"))
    starts = edge.select("a", F.explode(F.sequence(F.add_months("a", min_train_months), F.add_months("b", -test_months), F.expr(f"interval {step_months} months"))).alias("train_end"))
    folds = starts.withColumn("test_end", F.add_months("train_end", test_months))
    met = cal.join(F.broadcast(folds), F.col(spec.date) < F.col("test_end"))
    return met.groupBy("train_end", "test_end").agg(F.count_if(F.col(spec.date) < F.col("train_end")).alias("train_days"), F.count_if(F.col(spec.date) >= F.col("train_end")).alias("test_days"))


def segment_by_trend(series: DataFrame, ret: str, rows: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """up or down by the sign of the trailing compounded return; null until the window is full."""
    w = Window.orderBy(spec.date).rowsBetween(1 - rows, 0)
    value = F.exp(F.sum(F.log1p(ret)).over(w)) - 1
    return series.withColumn(out, F.when(F.count(ret).over(w) >= rows, F.when(value >= 0, "up").otherwise("down")))


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def ic_decay(df: DataFrame, score: str, targets: list[str], least: int, spec: PanelSpec = PANEL) -> DataFrame:
    """target, mean, std, n: the dates' rank correlations with each of several targets, in one pass over the long form."""
    long = df.unpivot([spec.entity, spec.date, score], targets, "target", "_value")
    daily = rank_ic(long, score, "_value", least, "ic", ("target",), spec)
    return daily.groupBy("target").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.count("ic").alias("n"))


def period_evaluation(df: DataFrame, score: str, ret: str, narrow: int, wide: int, spec: PanelSpec = PANEL) -> DataFrame:
    """date, narrow, wide, curve, drawdown: mean return of a date's best, and the compounded curve of the wider choice."""
    ranked = unique_rank(df.where(F.col(ret).isNotNull()), score, "_r", spec)
    mean = lambda n: F.avg(F.when(F.col("_r") <= n, F.col(ret)))
    return drawdown(ranked.groupBy(spec.date).agg(mean(narrow).alias("narrow"), mean(wide).alias("wide")), "wide", spec)


def signal_health(ic: DataFrame, col: str, rows: int, spec: PanelSpec = PANEL) -> DataFrame:
    """era (year), mean, n, negative, longest: of the means over the last ``rows`` dates, the share below 0 and the longest run of such
    dates within the year. The windows run over one row a date."""
    w = Window.orderBy(spec.date).rowsBetween(1 - rows, 0)
    mean = F.round(F.when(F.count(col).over(w) >= rows, F.avg(col).over(w)), 9)
    days = ic.select(F.year(spec.date).cast("long").alias("era"), spec.date, col, mean.alias("_m"))
    low = F.coalesce(F.col("_m") < 0, F.lit(False))
    of_era = Window.partitionBy("era").orderBy(spec.date)
    days = days.withColumn("_island", F.sum(F.when(low, 0).otherwise(1)).over(of_era))
    run = F.sum(low.cast("long")).over(Window.partitionBy("era", "_island").orderBy(spec.date))
    return days.withColumn("_run", run).groupBy("era").agg(
        F.avg(col).alias("mean"), F.count("_m").alias("n"), F.avg((F.col("_m") < 0).cast("double")).alias("negative"), F.max("_run").alias("longest")
    )


def segment_performance(returns: DataFrame, segments: DataFrame, ret: str, periods: float, spec: PanelSpec = PANEL) -> DataFrame:
    """seg, n, mean, annual (compounded, ``periods`` a year), hit: a strategy's returns by market segment; dates without one are left out."""
    met = returns.join(F.broadcast(segments.where("seg is not null")), spec.date)  # one row a date
    return met.groupBy("seg").agg(
        F.count(F.lit(1)).alias("n"), F.avg(ret).alias("mean"), F.expm1(F.avg(F.log1p(ret)) * periods).alias("annual"), F.avg((F.col(ret) > 0).cast("double")).alias("hit")
    )


def index_level(df: DataFrame, price: str, dates: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """date, level: the mean price of each of the dates, carried forward over dates without one. The window runs over one row a date."""
    means = df.groupBy(spec.date).agg(F.avg(price).alias("_m"))
    w = Window.orderBy(spec.date).rowsBetween(Window.unboundedPreceding, 0)
    return dates.select(spec.date).distinct().join(means, spec.date, "left").select(spec.date, F.last("_m", ignorenulls=True).over(w).alias("level"))


def best_day_share(returns: DataFrame, ret: str, k: int, spec: PanelSpec = PANEL) -> DataFrame:
    """best_days, mean_without, n: the share of the sum that the k best dates make, and the mean without them. One row a date."""
    placed = returns.withColumn("_k", F.row_number().over(Window.orderBy(F.col(ret).desc(), spec.date)))
    return placed.agg(
        (F.sum(F.when(F.col("_k") <= k, F.col(ret))) / F.nullif(F.sum(ret), F.lit(0.0))).alias("best_days"), F.avg(F.when(F.col("_k") > k, F.col(ret))).alias("mean_without"), F.count(F.lit(1)).alias("n")
    )


def zone_ics(df: DataFrame, score: str, label: str, least: int, tails: float = 0.2, middle: tuple[float, float] = (0.3, 0.7), spec: PanelSpec = PANEL) -> DataFrame:
    """grp, mean, n: the rank correlation inside the extreme scores of a date and inside the middle ones, on one set of labels."""
    place = F.row_number().over(spec.day().orderBy(score, spec.entity)) - 1
    p = df.withColumn("_p", place / F.greatest(F.count(F.lit(1)).over(spec.day()) - 1, F.lit(1)))
    grp = F.when((F.col("_p") <= tails) | (F.col("_p") >= 1 - tails), "tails").when(F.col("_p").between(*middle), "middle")
    daily = rank_ic(p.withColumn("grp", grp).where("grp is not null"), score, label, least, "ic", ("grp",), spec)
    return daily.groupBy("grp").agg(F.avg("ic").alias("mean"), F.count("ic").alias("n"))


def tail_members(df: DataFrame, score: str, bins: int, spec: PanelSpec = PANEL) -> DataFrame:
    """The rows of the lowest and the highest score bin of each date, with bin."""
    return equal_bins(df.where(F.col(score).isNotNull()), score, bins, "bin", spec).where(F.col("bin").isin(1, bins))


def tail_by_quarter(df: DataFrame, score: str, label: str, bins: int = 10, spec: PanelSpec = PANEL) -> DataFrame:
    """bin, quarter, days, mean: daily mean labels of the two tails, by calendar quarter."""
    daily = tail_members(df, score, bins, spec).where(F.col(label).isNotNull()).groupBy("bin", spec.date).agg(F.avg(label).alias("_m"))
    return daily.groupBy("bin", period(F.col(spec.date), "Q").alias("quarter")).agg(F.count(F.lit(1)).alias("days"), F.avg("_m").alias("mean"))


def tail_past_correlation(df: DataFrame, score: str, past: str, bins: int = 10, spec: PanelSpec = PANEL) -> DataFrame:
    """bin, n, corr: how far the scores of each tail follow a past return."""
    return tail_members(df, score, bins, spec).where(F.col(past).isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.corr(score, past).alias("corr"))


def tail_without_best(df: DataFrame, score: str, label: str, k: int, bins: int = 10, spec: PanelSpec = PANEL) -> DataFrame:
    """bin, days, mean, without: daily mean labels of the two tails, with and without each one's k best dates. One row a date and tail."""
    daily = tail_members(df, score, bins, spec).where(F.col(label).isNotNull()).groupBy("bin", spec.date).agg(F.avg(label).alias("_m"))
    placed = daily.withColumn("_k", F.row_number().over(Window.partitionBy("bin").orderBy(F.col("_m").desc(), spec.date)))
    return placed.groupBy("bin").agg(F.count(F.lit(1)).alias("days"), F.avg("_m").alias("mean"), F.avg(F.when(F.col("_k") > k, F.col("_m"))).alias("without"))
