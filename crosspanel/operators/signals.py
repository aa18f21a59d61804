"""Rules over ranked panels: entry scores, exit layers, position sizes, contributions of conditions, holdings logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import one_decimal
from ..spec import PANEL, PanelSpec
from .crosssection import equal_bins, unique_rank
from .evaluate import rank_ic
from .quantiles import with_quantiles
from .regression import gram, ridge
from .strategy import linear_score


def entry_scores(df: DataFrame, conditions: dict[str, tuple[Column, int]], threshold: Column, pattern: Column | None = None, tiers: list[tuple[int, int]] | None = None, confirmed: Column | None = None, bonus: int = 10) -> DataFrame:
    """Adds base, score, met (names of conditions that hold) and verdict: BUY from the threshold on, WATCH with any condition.

    ``tiers`` (least pattern score, points) go from the highest down; ``bonus`` is added where ``confirmed`` holds as well as
    the lowest tier. Unknown conditions do not hold.
    """
    base = reduce(lambda a, b: a + b, [F.when(c, F.lit(w)).otherwise(F.lit(0)) for c, w in conditions.values()])
    score = base
    if pattern is not None and tiers:
        points = F.lit(None)
        for least, extra in tiers:
            points = F.coalesce(points, F.when(pattern >= least, F.lit(extra)))
        score = score + F.coalesce(points, F.lit(0))
        if confirmed is not None:
            score = score + F.when(confirmed & (pattern >= min(least for least, _ in tiers)), F.lit(bonus)).otherwise(F.lit(0))
    met = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, (c, _) in conditions.items()]))
    out = df.withColumns({"base": base, "score": score, "met": met})
    return out.withColumn("verdict", F.when(F.col("score") >= threshold, "BUY").when(F.size("met") >= 1, "WATCH"))


def exit_rules(df: DataFrame, layers: list[tuple[str, dict[str, Column]]]) -> DataFrame:
    """Adds layer, action and reasons: all rules that fire in the first layer in which any does; null if none fires."""
    found = []
    for k, (action, rules) in enumerate(layers, 1):
        fired = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
        found.append(F.when(F.size(fired) > 0, F.struct(F.lit(k).alias("layer"), F.lit(action).alias("action"), fired.alias("reasons"))))
    return df.withColumn("_exit", F.coalesce(*found)).select("*", "_exit.*").drop("_exit")


def volume_ratio(df: DataFrame, volume: str, out: str, rows: int = 5, spec: PanelSpec = PANEL) -> DataFrame:
    """Volume over the mean of the ``rows`` before; 1 without as many rows or with a mean of 0."""
    w = spec.series(rows, -1)
    mean = F.when((F.count(F.lit(1)).over(w) >= rows) & (F.avg(volume).over(w) > 0), F.avg(volume).over(w))
    return df.withColumn(out, F.coalesce(F.col(volume) / mean, F.lit(1.0)))


def drawdown_points(peak: Column, low: Column, tiers: list[tuple[float, int]]) -> Column:
    """Points by how far the low lies under the peak; tiers (more than this share, points) go from the deepest down."""
    fall = F.when((peak > 0) & (low > 0), (peak - low) / peak)
    points = F.lit(None)
    for more, n in tiers:
        points = F.coalesce(points, F.when(fall > more, F.lit(n)))
    return F.coalesce(points, F.lit(0))


def risk_reward(target: Column, price: Column, stop: Column) -> Column:
    """``1:x.x`` if the price lies between stop and target, else N/A."""
    return F.coalesce(F.when((price > stop) & (target > price), F.concat(F.lit("1:"), one_decimal((target - price) / (price - stop)))), F.lit("N/A"))


def position_sizes(df: DataFrame, score: str, group: str, out: str, n: int = 20, low: float = 0.03, high: float = 0.15, most: float = 0.4, invested: float = 0.95, spec: PanelSpec = PANEL) -> DataFrame:
    """Weights per date: the 2n best in proportion to positive scores, within [low, high], groups scaled to ``most`` at most,
    then the n largest scaled to ``invested``; those below ``low`` are left out. Rows with a score of 0 or less hold nothing.
    """
    day = spec.day()
    best = unique_rank(df.where(F.col(score) > 0), score, "_r", spec).where(F.col("_r") <= 2 * n)
    sized = best.withColumn("_w", F.greatest(F.lit(low), F.least(F.lit(high), F.col(score) / F.sum(score).over(day) * invested)))
    total = F.sum("_w").over(spec.day(group))
    sized = sized.withColumn("_t", total).withColumn("_w", F.round(F.when(F.col("_t") > most, F.col("_w") * most / F.col("_t")).otherwise(F.col("_w")), 9))
    kept = sized.withColumn("_k", F.row_number().over(day.orderBy(F.col("_w").desc(), "_r"))).where(F.col("_k") <= n)
    final = kept.withColumn(out, F.round(F.col("_w") / F.sum("_w").over(day) * invested, 4))
    return final.where(F.col(out) >= low).drop("_r", "_w", "_t", "_k")


def condition_pools(df: DataFrame, pools: Column, base: Column, ret: str, spec: PanelSpec = PANEL) -> DataFrame:
    """pool, days, signals, mean, hit_rate, edge: daily mean excess of each pool over its days, and over the base pool's.

    ``pools`` is an array of the pools that a row belongs to; excess is the return less the date's mean.
    """
    rows = df.where(F.col(ret).isNotNull()).withColumn("_e", F.col(ret) - F.avg(ret).over(spec.day()))
    reference = rows.where(base).groupBy(spec.date).agg(F.avg("_e").alias("_base"))
    daily = rows.select(spec.date, "_e", F.explode(pools).alias("pool")).groupBy(spec.date, "pool").agg(F.round(F.avg("_e"), 12).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return daily.join(reference, spec.date, "left").groupBy("pool").agg(
        F.count(F.lit(1)).alias("days"), F.sum("_n").alias("signals"), F.avg("_m").alias("mean"),
        F.avg((F.col("_m") > 0).cast("double")).alias("hit_rate"), F.avg(F.col("_m") - F.col("_base")).alias("edge"),
    )


def two_by_two(df: DataFrame, a: Column, b: Column, value: str, spec: PanelSpec = PANEL) -> DataFrame:
    """date, neither, a, b, both, interaction: mean of each cell per date, and (both - b) - (a - neither)."""
    known = df.where(F.col(value).isNotNull()).withColumns({"_a": F.coalesce(a, F.lit(False)), "_b": F.coalesce(b, F.lit(False))})
    cell = lambda x, y: F.avg(F.when((F.col("_a") == x) & (F.col("_b") == y), F.col(value)))
    cells = known.groupBy(spec.date).agg(cell(False, False).alias("neither"), cell(True, False).alias("a"), cell(False, True).alias("b"), cell(True, True).alias("both"))
    return cells.withColumn("interaction", F.col("both") - F.col("b") - F.col("a") + F.col("neither"))


def tail_profile(df: DataFrame, score: str, columns: list[str], label: str, cal: DataFrame, bins: int = 10, spec: PanelSpec = PANEL) -> DataFrame:
    """bin, n, unlabelled, stayed and the median of each column, of the lowest and highest score bin.

    ``stayed`` is the share of members that were in the bin on the calendar date before.
    """
    tails = equal_bins(df.where(F.col(score).isNotNull()), score, bins, "bin", spec).where(F.col("bin").isin(1, bins)).join(F.broadcast(cal), spec.date)
    before = tails.select(spec.entity, "bin", (F.col("idx") + 1).alias("idx"), F.lit(1).alias("_had"))
    both = tails.join(before, [spec.entity, "bin", "idx"], "left")
    out = both.groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(label).isNull().cast("double")).alias("unlabelled"), F.avg(F.col("_had").isNotNull().cast("double")).alias("stayed")
    )
    for c in columns:
        out = with_quantiles(out, both, c, ["bin"], {c: 0.5})
    return out


def holdings_returns(log: DataFrame, weight: str, prices: DataFrame, price: str, cal: DataFrame, buy: float, sell: float, spec: PanelSpec = PANEL) -> DataFrame:
    """date, ret, bought: returns of a log of holdings (entity, date, weights that sum to 1 on each rebalance date).

    Between rebalances the value is the weighted sum of prices over those of the rebalance (closed form of the drift), the last
    known price on dates without one; entities without a price then keep their value. On a rebalance the old holdings earn the
    date's return first; then the change from drifted to new weights is charged.
    """
    e = spec.entity
    spans = log.select(spec.date).distinct().join(F.broadcast(cal), spec.date).select(F.col("idx").alias("_at")).withColumn("_to", F.lead("_at").over(Window.orderBy("_at")))
    placed = prices.where(F.col(price) > 0).join(F.broadcast(cal), spec.date).select(e, "idx", F.col(price).alias("_p"))
    held = log.join(F.broadcast(cal), spec.date).select(e, F.col("idx").alias("_at"), F.col(weight).alias("_w")).join(F.broadcast(spans), "_at")
    start = held.join(placed.withColumnsRenamed({"idx": "_at", "_p": "_p0"}), [e, "_at"], "left")
    last = cal.agg(F.max("idx").alias("_last"))
    rows = start.join(F.broadcast(last)).withColumn("idx", F.explode(F.sequence(F.col("_at"), F.coalesce("_to", "_last")))).drop("_last")
    w = Window.partitionBy(e, "_at").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.join(placed, [e, "idx"], "left").withColumn("_v", F.col("_w") * F.coalesce(F.last("_p", ignorenulls=True).over(w) / F.col("_p0"), F.lit(1.0)))
    value = seen.groupBy("_at", "idx").agg(F.sum("_v").alias("_value"))
    daily = value.withColumn("_ret", F.col("_value") / F.lag("_value").over(Window.partitionBy("_at").orderBy("idx")) - 1)
    drifted = seen.where(F.col("idx") == F.col("_to")).withColumn("_old", F.col("_v") / F.sum("_v").over(Window.partitionBy("_at"))).select(e, "idx", "_old")
    change = held.select(e, F.col("_at").alias("idx"), "_w").join(drifted, [e, "idx"], "full_outer").withColumn("_d", F.coalesce("_w", F.lit(0.0)) - F.coalesce("_old", F.lit(0.0)))
    cost = change.groupBy("idx").agg(F.sum(F.greatest("_d", F.lit(0.0))).alias("bought"), F.sum(F.greatest(-F.col("_d"), F.lit(0.0))).alias("_sold"))
    earned = daily.where(F.col("_ret").isNotNull()).select("idx", "_ret")
    both = earned.join(cost, "idx", "full_outer").join(F.broadcast(cal), "idx")
    return both.select(spec.date, (F.coalesce("_ret", F.lit(0.0)) - F.coalesce(F.col("bought") * buy + F.col("_sold") * sell, F.lit(0.0))).alias("ret"), "bought")


def log_summary(daily: DataFrame, periods: int) -> DataFrame:
    """n, total, annual, stderr (of the annual mean, null with fewer than two dates or no spread), rebalances, mean turnover."""
    grown, sd, n = F.sum(F.log1p("ret")), F.stddev_pop("ret"), F.count("ret")
    return daily.agg(
        n.alias("n"), (F.exp(grown) - 1).alias("total"), (F.exp(grown * periods / n) - 1).alias("annual"),
        F.when((n > 1) & (sd > 0), sd * periods / F.sqrt(n)).alias("stderr"), F.count("bought").alias("rebalances"), F.avg("bought").alias("turnover"),
    )


def point_in_time_check(df: DataFrame, stored: str, same: str, before: str, least: int, spec: PanelSpec = PANEL) -> DataFrame:
    """same, before, verdict: mean rank correlation of stored values with the raw ones of their date and of the one before.

    ``lagged`` values follow the date before, ``same day`` ones may hold what was not known yet.
    """
    long = df.unpivot([spec.entity, spec.date, stored], [same, before], "_against", "_raw")
    means = rank_ic(long, stored, "_raw", least, "ic", ("_against",), spec).agg(*[F.avg(F.when(F.col("_against") == c, F.col("ic"))).alias(out) for c, out in ((same, "same"), (before, "before"))])
    return means.withColumn("verdict", F.when(F.round("before", 9) > F.round("same", 9), "lagged").otherwise("same day"))


def horizon_grid(df: DataFrame, score: str, labels: list[str], n: int, cost: float, least: int, spec: PanelSpec = PANEL) -> DataFrame:
    """label, ic, days, gross, net: mean rank correlation and mean return of the n best for each label, before and after cost."""
    long = df.unpivot([spec.entity, spec.date, score], labels, "label", "_value").where(F.col("_value").isNotNull())
    ic = rank_ic(long, score, "_value", least, "ic", ("label",), spec).groupBy("label").agg(F.avg("ic").alias("ic"), F.count("ic").alias("days"))
    w = Window.partitionBy(spec.date, "label").orderBy(F.col(score).desc_nulls_last(), spec.entity)
    top = long.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).groupBy("label", spec.date).agg(F.avg("_value").alias("_g"))
    return ic.join(top.groupBy("label").agg(F.avg("_g").alias("gross")), "label", "left").withColumn("net", F.col("gross") - cost)


def universe_ic(df: DataFrame, common: DataFrame, score: str, label: str, least: int, tolerance: float, spec: PanelSpec = PANEL) -> DataFrame:
    """own, common, delta, verdict: mean rank correlation on all keys and on those that ``common`` has too."""
    mean = lambda rows, out: rank_ic(rows, score, label, least, "ic", (), spec).agg(F.avg("ic").alias(out))
    shared = df.join(common.select(spec.entity, spec.date).distinct(), [spec.entity, spec.date], "left_semi")
    both = mean(df, "own").crossJoin(mean(shared, "common")).withColumn("delta", F.col("common") - F.col("own"))  # one row each
    return both.withColumn("verdict", F.when(F.abs("delta") <= tolerance, "same").otherwise("differs"))


def ridge_grid(train: DataFrame, valid: DataFrame, features: list[str], target: str, alphas: list[float], least: int, spec: PanelSpec = PANEL) -> DataFrame:
    """alpha, ic: mean rank correlation on the validation rows of a ridge for each alpha.

    Training is one pass for the sums of ``gram``, features squared, which come to the driver; all alphas are scored in one pass.
    """
    cells = [(r.i, r.j, r.value) for r in gram(train, features, target, []).collect()]
    scored, names = valid, []
    for k, alpha in enumerate(alphas):
        beta, c = ridge(cells, features, target, alpha)
        names.append(f"_s{k}")
        scored = linear_score(scored, beta, c, names[-1])
    long = scored.unpivot([spec.entity, spec.date, target], names, "_name", "_score").withColumn("_score", F.round("_score", 10))
    of = F.create_map(*[F.lit(x) for n, a in zip(names, alphas, strict=True) for x in (n, float(a))])
    return rank_ic(long, "_score", target, least, "ic", ("_name",), spec).groupBy(of[F.col("_name")].alias("alpha")).agg(F.avg("ic").alias("ic"))
