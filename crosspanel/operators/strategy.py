"""Returns of ranked choices as closed aggregates: rebalanced cohorts, spreads, weights, risk and comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PANEL, PanelSpec
from .crosssection import equal_bins, top_n, unique_rank
from .evaluate import drawdown, newey_west_t, rank_ic
from .regression import gram, ridge


def top_n_strategy(df: DataFrame, score: str, ret: str, n: int, cal: DataFrame, spec: PanelSpec = PANEL) -> DataFrame:
    """date, ret, mean (of all), turnover (share of members that the calendar date before did not have)."""
    known = df.where(F.col(ret).isNotNull())
    members = unique_rank(known, score, "_r", spec).join(F.broadcast(cal), spec.date)
    now = members.withColumn("_top", F.col("_r") <= n)
    before = now.where("_top").select(spec.entity, (F.col("idx") + 1).alias("idx"), F.lit(1).alias("_had"))
    both = now.join(before, [spec.entity, "idx"], "left")
    top = F.col("_top")
    return both.groupBy(spec.date).agg(
        F.avg(F.when(top, F.col(ret))).alias("ret"), F.avg(ret).alias("mean"),
        (F.count_if(top & F.col("_had").isNull()) / F.count_if(top)).alias("turnover"),
    )


def weighted_return(df: DataFrame, weight: str, ret: str, spec: PanelSpec = PANEL) -> DataFrame:
    """date, ret: mean return by positive weights; dates without any are left out."""
    held = df.where((F.col(weight) > 0) & F.col(ret).isNotNull())
    return held.groupBy(spec.date).agg((F.sum(F.col(weight) * F.col(ret)) / F.sum(weight)).alias("ret"))


def last_rebalance(idx: Column, freq: int) -> Column:
    """Index of the last rebalance date (1, 1 + freq, ...) before a calendar index."""
    return (F.floor((idx - 2) / freq) * freq + 1).cast("int")


def decile_spread(df: DataFrame, score: str, returns: DataFrame, ret: str, cal: DataFrame, freq: int, bins: int = 10, least: int = 50, spec: PanelSpec = PANEL) -> DataFrame:
    """date, long, short, spread: mean returns of the highest and lowest bin, chosen every ``freq`` dates and held between.

    Dates with fewer than ``least`` scored names choose nothing.
    """
    chosen = df.where(F.col(score).isNotNull()).join(F.broadcast(cal.where((F.col("idx") - 1) % freq == 0)), spec.date)
    chosen = chosen.withColumn("_n", F.count(F.lit(1)).over(spec.day())).where(F.col("_n") >= least)
    tails = equal_bins(chosen, score, bins, "_bin", spec).where(F.col("_bin").isin(1, bins)).select(spec.entity, F.col("idx").alias("_at"), "_bin")
    days = returns.where(F.col(ret).isNotNull()).join(F.broadcast(cal), spec.date).withColumn("_at", last_rebalance(F.col("idx"), freq))
    held = days.join(tails, [spec.entity, "_at"])
    side = lambda b: F.avg(F.when(F.col("_bin") == b, F.col(ret)))
    return held.groupBy(spec.date).agg(side(bins).alias("long"), side(1).alias("short")).withColumn("spread", F.col("long") - F.col("short"))


def cohort_backtest(df: DataFrame, score: str, prices: DataFrame, price: str, cal: DataFrame, freq: int, n: int, buy: float, sell: float, spec: PanelSpec = PANEL) -> DataFrame:
    """date, value, turnover, ret: the n best, equally weighted, bought every ``freq`` dates and held to the next time.

    A member's value is its price over its price at the purchase, the last known one on dates without a price. The cost of the
    members that changed is charged on the first date of a cohort.
    """
    cal = F.broadcast(cal)
    best = top_n(df.join(cal.where((F.col("idx") - 1) % freq == 0), spec.date).where(F.col(score).isNotNull()), score, n, spec).select(spec.entity, F.col("idx").alias("_at"))
    start = best.join(prices.join(cal, spec.date).select(spec.entity, F.col("idx").alias("_at"), F.col(price).alias("_p0")), [spec.entity, "_at"])
    held = start.join(F.broadcast(cal.withColumn("_at", last_rebalance(F.col("idx"), freq))), "_at")
    seen = held.join(prices.join(cal, spec.date).select(spec.entity, "idx", F.col(price).alias("_p")), [spec.entity, "idx"], "left")
    w = Window.partitionBy(spec.entity, "_at").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    valued = seen.withColumn("_v", F.coalesce(F.last("_p", ignorenulls=True).over(w), F.col("_p0")) / F.col("_p0"))
    daily = valued.groupBy("_at", "idx", spec.date).agg(F.avg("_v").alias("value"))
    before = best.select(spec.entity, (F.col("_at") + freq).alias("_at"), F.lit(1).alias("_had"))
    changes = best.withColumn("_has", F.lit(1)).join(before, [spec.entity, "_at"], "full_outer").groupBy("_at").agg(
        (F.count_if(F.col("_had").isNull()) / F.lit(float(n))).alias("turnover"), (F.count_if(F.col("_has").isNull()) / F.lit(float(n))).alias("_sold")
    )
    of = Window.partitionBy("_at").orderBy("idx")
    path = daily.withColumn("_before", F.lag("value", 1).over(of)).join(F.broadcast(changes), "_at")
    cost = F.when(F.col("_before").isNull(), F.col("turnover") * buy + F.col("_sold") * sell).otherwise(F.lit(0.0))
    return path.select(spec.date, "value", "turnover", (F.col("value") / F.coalesce("_before", F.lit(1.0)) - 1 - cost).alias("ret"))


def risk_summary(series: DataFrame, ret: str, periods: int, rows: int = 20, deep: float = -0.15, spec: PanelSpec = PANEL) -> DataFrame:
    """Annual and rolling volatility, longest drawdown in dates, shares of dates under water and under ``deep``, half means."""
    down = drawdown(series.where(F.col(ret).isNotNull()), ret, spec)
    w = Window.orderBy(spec.date)
    root = F.sqrt(F.lit(float(periods)))
    rolled = down.withColumn("_v", F.when(F.count(ret).over(w.rowsBetween(1 - rows, 0)) >= rows, F.stddev_samp(ret).over(w.rowsBetween(1 - rows, 0)) * root))
    rolled = rolled.withColumn("_under", F.col("drawdown") < -1e-12).withColumn("_island", F.sum(F.when(F.col("_under"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rolled = rolled.withColumn("_run", F.sum(F.col("_under").cast("int")).over(Window.partitionBy("_island"))).withColumn("_half", F.ntile(2).over(w))
    half = lambda k: F.avg(F.when(F.col("_half") == k, F.col(ret)))
    return rolled.agg(
        (F.stddev_samp(ret) * root).alias("volatility"), F.median("_v").alias("rolling_median"), F.max("_v").alias("rolling_max"), F.max("_run").alias("longest"),
        F.avg(F.col("_under").cast("double")).alias("under_water"), F.count_if(F.col("drawdown") < deep).alias("deep_days"), half(1).alias("first_half"), half(2).alias("second_half"),
    )


def tracking_error(series: DataFrame, benchmark: DataFrame, ret: str, periods: int, spec: PanelSpec = PANEL) -> DataFrame:
    both = series.select(spec.date, F.col(ret).alias("_a")).join(benchmark.select(spec.date, F.col(ret).alias("_b")), spec.date)
    gap = F.col("_a") - F.col("_b")
    return both.agg((F.stddev_pop(gap) * F.sqrt(F.lit(float(periods)))).alias("tracking_error"), (F.avg(gap) * periods).alias("excess"), F.count(gap).alias("n"))


def grouped_ic(df: DataFrame, score: str, label: str, size: str, groups: int, least: int, spec: PanelSpec = PANEL) -> DataFrame:
    """group, mean, n: mean rank correlation within each group of equal count by a measure of size."""
    binned = equal_bins(df.where(F.col(size).isNotNull()), size, groups, "group", spec)
    return rank_ic(binned, score, label, least, "ic", ("group",), spec).groupBy("group").agg(F.avg("ic").alias("mean"), F.count("ic").alias("n"))


def score_agreement(a: DataFrame, b: DataFrame, score: str, n: int, least: int, spec: PanelSpec = PANEL) -> DataFrame:
    """date, rho, overlap: rank correlation of two sets of scores, and the share of the n best that they have in common."""
    keys = [spec.entity, spec.date]
    both = a.select(*keys, F.col(score).alias("_a")).join(b.select(*keys, F.col(score).alias("_b")), keys)
    rho = rank_ic(both, "_a", "_b", least, "rho", (), spec).select(spec.date, "rho")
    common = top_n(a, score, n, spec).select(*keys).join(top_n(b, score, n, spec).select(*keys), keys).groupBy(spec.date).agg((F.count(F.lit(1)) / F.lit(float(n))).alias("overlap"))
    return rho.join(common, spec.date, "left").select(spec.date, "rho", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def paired_difference(a: DataFrame, b: DataFrame, col: str, lag: int, trim: int, spec: PanelSpec = PANEL) -> DataFrame:
    """mean, n, t (Newey-West), positive, trimmed: of the difference of two daily series on common dates.

    ``trimmed`` is the mean without the ``trim`` largest differences by size. One row a date: the windows are small.
    """
    gap = a.select(spec.date, F.col(col).alias("_a")).join(b.select(spec.date, F.col(col).alias("_b")), spec.date).select(spec.date, F.round(F.col("_a") - F.col("_b"), 9).alias("gap")).where("gap is not null")
    ranked = gap.withColumn("_r", F.row_number().over(Window.orderBy(F.abs("gap").desc(), spec.date)))
    rest = ranked.agg(F.avg((F.col("gap") > 0).cast("double")).alias("positive"), F.avg(F.when(F.col("_r") > trim, F.col("gap"))).alias("trimmed"))
    return newey_west_t(gap, "gap", lag, spec).crossJoin(rest)  # one row each


def cost_sensitivity(daily: DataFrame, cost: float, multipliers: list[float], periods: int) -> DataFrame:
    """multiplier, annual: yearly mean of returns less so many times the cost of the turnover."""
    rows = F.explode(F.array(*[F.lit(float(m)) for m in multipliers])).alias("multiplier")
    return daily.select("ret", "turnover", rows).groupBy("multiplier").agg((F.avg(F.col("ret") - F.col("multiplier") * cost * F.col("turnover")) * periods).alias("annual"))


def purged_folds(cal: DataFrame, train: int, test: int, step: int, purge: int, embargo: int) -> DataFrame:
    """fold, train_from, train_to, test_from, test_to in calendar positions, and the number of dates dropped between.

    A fold's training ends ``purge`` dates (the label's horizon) and ``embargo`` more before its test begins.
    """
    last = cal.agg(F.max("idx").alias("n"))
    folds = last.select(F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - train - test) / step).cast("int"))).alias("fold"), "n").where(F.col("n") >= train + test)
    begin = F.col("fold") * step
    return folds.select(
        "fold", (begin + 1).alias("train_from"), (begin + train - purge - embargo).alias("train_to"), (begin + train + 1).alias("test_from"),
        (begin + train + test).alias("test_to"), F.lit(purge + embargo).alias("dropped"),
    )


def leaks(folds: DataFrame, horizon: int) -> DataFrame:
    """Folds whose training labels, ``horizon`` dates ahead, reach into the test: none if the folds are sound."""
    return folds.where(F.col("train_to") + horizon >= F.col("test_from"))


def fold_summary(ic: DataFrame, folds: DataFrame, cal: DataFrame, mean: float = 0.05, ratio: float = 0.5, spec: PanelSpec = PANEL) -> DataFrame:
    """fold, mean, icir, n, passed: a daily correlation over each fold's test dates. The folds, a few rows, are broadcast."""
    placed = ic.join(F.broadcast(cal), spec.date).join(F.broadcast(folds), F.expr("idx between test_from and test_to"))
    found = placed.groupBy("fold").agg(F.avg("ic").alias("mean"), (F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0))).alias("icir"), F.count("ic").alias("n"))
    return found.withColumn("passed", F.coalesce((F.col("mean") > mean) & (F.col("icir") > ratio), F.lit(False)))


def capped_weights(df: DataFrame, raw: str, cap: str, out: str, passes: int = 5, spec: PanelSpec = PANEL) -> DataFrame:
    """Weights in proportion to ``raw`` per date, none above ``cap``; the excess goes to the others by weight, pass by pass."""
    w = spec.day()
    now = df.withColumn(out, F.col(raw) / F.sum(raw).over(w))
    for _ in range(passes):
        over = F.greatest(F.col(out) - F.col(cap), F.lit(0.0))
        room = F.when(F.col(out) < F.col(cap), F.col(out)).otherwise(F.lit(0.0))
        now = now.withColumn("_over", F.sum(over).over(w)).withColumn("_room", F.sum(room).over(w))
        filled = F.when(F.col(out) < F.col(cap), F.col(out) + F.coalesce(F.try_divide(F.col("_over") * F.col(out), F.col("_room")), F.lit(0.0))).otherwise(F.col(cap))
        now = now.withColumn(out, filled).drop("_over", "_room")
    return now


def concentration(df: DataFrame, weight: str, group: str, k: int = 3, spec: PanelSpec = PANEL) -> DataFrame:
    """date, largest, top: the largest share of a group in the weights, and that of the k largest."""
    shares = df.groupBy(spec.date, group).agg(F.sum(weight).alias("_s"))
    ranked = shares.withColumn("_r", F.row_number().over(spec.day().orderBy(F.col("_s").desc(), group)))
    return ranked.groupBy(spec.date).agg(F.max("_s").alias("largest"), F.sum(F.when(F.col("_r") <= k, F.col("_s"))).alias("top"))


def clipped_list(df: DataFrame, score: str, weight: str, n: int, most: float, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """The date's n best with their weights clipped at ``most`` and scaled to 1."""
    listed = top_n(df, score, n, spec).withColumn("_w", F.least(F.col(weight), F.lit(most)))
    return listed.withColumn(out, F.col("_w") / F.nullif(F.sum("_w").over(spec.day()), F.lit(0.0))).drop("_w")


def linear_score(df: DataFrame, weights: dict[str, float], intercept: float, out: str) -> DataFrame:
    """The weighted sum of columns, missing values counting as 0."""
    total = F.lit(float(intercept))
    for c, w in weights.items():
        total = total + F.coalesce(F.col(c), F.lit(0.0)) * F.lit(float(w))
    return df.withColumn(out, total)


def walk_forward_ridge(df: DataFrame, features: list[str], target: str, period: str, alpha: float, out: str) -> DataFrame:
    """Each period's rows scored by a ridge on all periods before the last one, whose labels may still reach into it.

    One pass gathers the sums by period; only those, periods times features squared, come to the driver.
    """
    by_period: dict = {}
    for r in gram(df, features, target, [period]).collect():
        by_period.setdefault(r[period], {})[r.i, r.j] = r.value
    total: dict[tuple[str, str], float] = {}
    periods, weights = sorted(by_period), []
    for k, p in enumerate(periods):
        if k >= 2:
            for ij, v in by_period[periods[k - 2]].items():
                total[ij] = total.get(ij, 0.0) + v
            if total["1", "1"] > len(features):
                beta, c = ridge([(i, j, v) for (i, j), v in total.items()], features, target, alpha)
                weights.append((p, c, *[beta[f] for f in features]))
    names = [f"_w{k}" for k in range(len(features))]
    kind = df.schema[period].dataType.simpleString()
    table = df.sparkSession.createDataFrame(weights, f"{period} {kind}, _c double, " + ", ".join(f"{x} double" for x in names))
    score = F.col("_c")
    for f, x in zip(features, names, strict=True):
        score = score + F.coalesce(F.col(f), F.lit(0.0)) * F.col(x)
    return df.join(F.broadcast(table), period).withColumn(out, score).drop("_c", *names)


def scheme_weights(df: DataFrame, by: str | None, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Weights that sum to 1 on each date: equal, or in proportion to a column, where a missing value counts as the date's median.

    Rows are the chosen ones of a date; dates where no row has a value get equal weights.
    """
    w = spec.day()
    if by is None:
        return df.withColumn(out, 1 / F.count(F.lit(1)).over(w))
    value = F.coalesce(F.col(by), F.median(by).over(w), F.lit(1.0))  # the members of a date, a few
    return df.withColumn("_v", value).withColumn(out, F.col("_v") / F.nullif(F.sum("_v").over(w), F.lit(0.0))).drop("_v")
