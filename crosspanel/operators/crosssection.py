"""Per-date windows: ranks, scaling, neutralisation, bins, top-k and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PANEL, PanelSpec


def average_rank(df: DataFrame, col: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Rank per date, from 1; ties share the mean of their places, nulls have none."""
    rank = F.rank().over(spec.day().orderBy(F.col(col).asc_nulls_last()))
    ties = F.count(col).over(Window.partitionBy(spec.date, col))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), rank + (ties - 1) / 2))


def centred_rank(df: DataFrame, col: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """(rank - 1) / (n - 1) - 0.5 for dates with more than one value."""
    n = F.count(col).over(spec.day())
    return average_rank(df, col, "_rank", spec).withColumn(out, F.when(n > 1, (F.col("_rank") - 1) / (n - 1) - 0.5)).drop("_rank")


def unique_rank(df: DataFrame, col: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """1 for the highest value of a date; ties go by entity."""
    return df.withColumn(out, F.row_number().over(spec.day().orderBy(F.col(col).desc_nulls_last(), spec.entity)))


def quantile(df: DataFrame, col: str, share: float, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """The date's interpolated quantile on each of its rows, from ranks in one window: no date is held in one buffer."""
    r = F.row_number().over(spec.day().orderBy(F.col(col).asc_nulls_last(), spec.entity))
    placed = df.withColumn("_r", r).withColumn("_p", (F.count(col).over(spec.day()) - 1) * share + 1)
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col(col))).over(spec.day())
    low = at(F.floor("_p"))
    high = F.coalesce(at(F.floor("_p") + 1), low)
    return placed.withColumn(out, low + (high - low) * (F.col("_p") - F.floor("_p"))).drop("_r", "_p")


def above_quantile(df: DataFrame, col: str, share: float, spec: PanelSpec = PANEL) -> DataFrame:
    """Rows at or above their date's quantile."""
    return quantile(df, col, share, "_q", spec).where(F.col(col) >= F.col("_q")).drop("_q")


def winsorise(df: DataFrame, col: str, low: float, high: float, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Values within the date's interpolated quantiles."""
    bounded = quantile(quantile(df, col, low, "_a", spec), col, high, "_b", spec)
    inside = F.greatest(F.least(F.col(col), F.col("_b")), F.col("_a"))
    return bounded.withColumn(out, F.when(F.col(col).isNotNull(), inside)).drop("_a", "_b")


def zscore(df: DataFrame, col: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    w = spec.day()
    return df.withColumn(out, (F.col(col) - F.avg(col).over(w)) / (F.stddev_samp(col).over(w) + 1e-9))


def neutralise(df: DataFrame, col: str, group: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    return df.withColumn(out, F.col(col) - F.avg(col).over(spec.day(group)))


def neutralise_with_size(df: DataFrame, col: str, group: str, size: str, out: str, least: int = 10, spec: PanelSpec = PANEL) -> DataFrame:
    """Residual of a regression per date on group dummies and size, over the rows that have a value and a size: both are demeaned by
    group, then one slope is taken. Other rows have no residual."""
    w, g = spec.day(), spec.day(group)
    known = F.col(col).isNotNull() & F.col(size).isNotNull()
    x, y = (F.when(known, F.col(c)) - F.avg(F.when(known, F.col(c))).over(g) for c in (size, col))
    moved = df.withColumn("_x", x).withColumn("_y", y)
    slope = F.sum(F.col("_x") * F.col("_y")).over(w) / F.nullif(F.sum(F.col("_x") * F.col("_x")).over(w), F.lit(0.0))
    value = F.col("_y") - F.coalesce(slope, F.lit(0.0)) * F.col("_x")
    return moved.withColumn(out, F.when(F.count(F.when(known, F.lit(1))).over(w) >= least, value).otherwise(F.col(col))).drop("_x", "_y")


def equal_bins(df: DataFrame, col: str, bins: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Bins of equal count by unique ascending rank: bin 1 is the lowest."""
    r = F.row_number().over(spec.day().orderBy(F.col(col).asc_nulls_last(), spec.entity))
    n = F.count(F.lit(1)).over(spec.day())
    return df.withColumn(out, F.greatest(F.lit(1), F.ceil((r - 1) * bins / F.greatest(n - 1, F.lit(1)))).cast("int"))


def top_n(df: DataFrame, col: str, n: int, spec: PanelSpec = PANEL) -> DataFrame:
    return unique_rank(df, col, "rank", spec).where(F.col("rank") <= n)


def quantile_label(df: DataFrame, col: str, low: float, high: float, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """High at or below the low quantile of an uncertainty, Low at or above the high one, else Medium."""
    q = quantile(quantile(df, col, low, "_l", spec), col, high, "_h", spec)
    label = F.when(F.col(col) <= F.col("_l"), "High").when(F.col(col) >= F.col("_h"), "Low").when(F.col(col).isNotNull(), "Medium")
    return q.withColumn(out, label).drop("_l", "_h")


def proportional_weights(df: DataFrame, col: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Positive values over their sum per date; 0 otherwise."""
    positive = F.greatest(F.coalesce(F.col(col), F.lit(0.0)), F.lit(0.0))
    return df.withColumn("_p", positive).withColumn(out, F.coalesce(F.col("_p") / F.nullif(F.sum("_p").over(spec.day()), F.lit(0.0)), F.lit(0.0))).drop("_p")


def last_dates(df: DataFrame, n: int, until: Column | None = None, spec: PanelSpec = PANEL) -> DataFrame:
    """Rows of the last n dates; the dates, n rows, are broadcast."""
    days = df.select(spec.date).distinct() if until is None else df.where(F.col(spec.date) <= until).select(spec.date).distinct()
    return df.join(F.broadcast(days.orderBy(F.col(spec.date).desc()).limit(n)), spec.date, "left_semi")


def last_rows(df: DataFrame, n: int, spec: PanelSpec = PANEL) -> DataFrame:
    w = Window.partitionBy(spec.entity).orderBy(F.col(spec.date).desc())
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def largest_by_size(df: DataFrame, col: str, k: int, spec: PanelSpec = PANEL) -> DataFrame:
    """The k rows whose value is farthest from zero; ties go by date, then entity."""
    return df.where(F.col(col).isNotNull()).orderBy(F.abs(col).desc(), spec.date, spec.entity).limit(k)


def capped_signals(df: DataFrame, col: str, up: int, down: int, spec: PanelSpec = PANEL) -> DataFrame:
    """Each entity's strongest signals: at most ``up`` above zero and ``down`` below; ties go to the earlier date."""
    signed = df.where(F.col(col) != 0).withColumn("_up", F.col(col) > 0)
    place = F.row_number().over(Window.partitionBy(spec.entity, "_up").orderBy(F.abs(col).desc(), spec.date))
    return signed.withColumn("_k", place).where(F.col("_k") <= F.when(F.col("_up"), up).otherwise(down)).drop("_up", "_k")


def quantile_bin(df: DataFrame, col: str, bins: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """ceil(rank / n * bins) among a date's values by ascending unique rank; rows without a value go."""
    known = df.where(F.col(col).isNotNull())
    rank = F.row_number().over(spec.day().orderBy(col, spec.entity))
    return known.withColumn(out, F.ceil(rank * bins / F.count(F.lit(1)).over(spec.day())).cast("long"))


def fixed_bins(df: DataFrame, col: str, edges: list[float], names: list[str], out: str) -> DataFrame:
    """The name of the bin that a value lies in: up to the first edge, above it up to the second, and so on; null without a value."""
    label = F.when(F.col(col).isNotNull(), F.lit(names[-1]))
    for edge, name in sorted(zip(edges, names, strict=False), reverse=True):
        label = F.when(F.col(col) <= edge, F.lit(name)).otherwise(label)
    return df.withColumn(out, label)


def positional_rank(df: DataFrame, col: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """(place - 1) / (n - 1) - 0.5 by place in the date's order, ties by entity; null for a date of one row."""
    place = F.row_number().over(spec.day().orderBy(F.col(col).asc_nulls_last(), spec.entity))
    n = F.count(F.lit(1)).over(spec.day())
    return df.withColumn(out, F.when(n > 1, (place - 1) / (n - 1) - 0.5))
