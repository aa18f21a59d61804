"""The feature matrix of a panel: base columns, lags, rolling blocks and flags, bounded and scaled by date.

Columns of an entity's past come from windows that share one sort of the panel. Scaling deals a few columns at a time by date, where
their bounds and moments are found, and joins these back: rows do not move twice. A value depends on rows up to its date alone: later
rows, or none, change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.columns import ratio
from ..sources.files import written
from ..spec import PANEL, PanelSpec
from . import timeseries as ts


def base_matrix(panel: DataFrame, market: DataFrame | None = None, spec: PanelSpec = PANEL) -> tuple[DataFrame, list[str]]:
    """entity, date and the base columns of prices and volumes; and the columns' names. ``market`` (date, ret) adds relative ones."""
    p, names = panel, []

    def add(*made: str) -> None:
        names.extend(made)

    for n in (1, 5, 20, 60):
        p = ts.pct_change(p, "close", n, f"ret_{n}")
        add(f"ret_{n}")
    p = p.withColumn("_log", F.log1p("ret_1"))
    for n in (5, 20, 60):
        p = ts.rolling(p, "_log", "stddev_samp", n, max(3, n // 2), f"vol_{n}")
        add(f"vol_{n}")
    for n in (5, 20, 60):
        p = ts.rolling(p, "close", "avg", n, n // 2 + 1, f"_m{n}").withColumn(f"bias_{n}", ratio(F.col("close"), F.col(f"_m{n}")) - 1)
        p = ts.rolling(p, "volume", "avg", n, n // 2 + 1, f"_v{n}").withColumn(f"volume_ratio_{n}", ratio(F.col("volume"), F.col(f"_v{n}")))
        add(f"bias_{n}", f"volume_ratio_{n}")
    p = ts.rolling(p, "close", "stddev_samp", 20, 10, "_s20").withColumn("band", ratio(F.col("close") - F.col("_m20"), F.col("_s20") * 2))
    p = ts.ewm(ts.true_range(p, "_tr"), "_tr", 2 / 15, True, "_atr", 7).withColumn("atr", ratio(F.col("_atr"), F.col("close")))
    p = ts.rsi(p, "close", "rsi", 1 / 14, False)
    p = ts.rolling(ts.rolling(p, "low", "min", 9, 5, "_lo"), "high", "max", 9, 5, "_hi")
    p = ts.ewm(p.withColumn("_rsv", 100 * ratio(F.col("close") - F.col("_lo"), F.col("_hi") - F.col("_lo"))), "_rsv", 1 / 3, False, "stochastic")
    p = ts.ewm(ts.ewm(p, "close", 2 / 13, False, "_fast"), "close", 2 / 27, False, "_slow").withColumn("macd", ratio(F.col("_fast") - F.col("_slow"), F.col("close")))
    p = ts.on_balance_volume(p, "close", "volume", "_obv")
    p = ts.rolling(ts.rolling(p, "_obv", "avg", 60, 20, "_om"), "_obv", "stddev_samp", 60, 20, "_os").withColumn("flow", ratio(F.col("_obv") - F.col("_om"), F.col("_os")))
    add("band", "atr", "rsi", "stochastic", "macd", "flow")
    if market is not None:
        w = Window.orderBy(spec.date)  # one row a date
        level = market.select(spec.date, F.exp(F.sum(F.log1p("ret")).over(w)).alias("_level"))
        p = p.join(F.broadcast(level), spec.date, "left")
        for n in (5, 20):
            p = ts.pct_change(p, "_level", n, f"_b{n}").withColumn(f"strength_{n}", F.col(f"ret_{n}") - F.col(f"_b{n}"))
            add(f"strength_{n}")
    for name in ("ret_5", "vol_20", "rsi", "volume_ratio_20"):
        for n in (1, 5):
            p = p.withColumn(f"{name}_lag{n}", F.lag(name, n).over(spec.series()))
            add(f"{name}_lag{n}")
        p = ts.rolling(p, name, "avg", 20, 10, f"{name}_rmean20")
        add(f"{name}_rmean20")
    p = p.withColumn("avail_long", F.col("ret_60").isNotNull().cast("double"))
    return p.select(spec.entity, spec.date, *names, "avail_long"), names


#: Columns whose values are dealt by date at once.
AT_ONCE = 11


def date_bounds(matrix: DataFrame, names: list[str], low: float, high: float, spec: PanelSpec = PANEL) -> DataFrame:
    """date, and for each name an array: its date's interpolated quantiles, and mean, above the lower one, and sample deviation of the values within them.

    Nulls and NaN take no part; a name without a value on a date has null. One task holds the rows of a date.
    """

    def bounds(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = {spec.date: pa.array([key[0].as_py()], day)}
        for c in names:
            v = rows.column(c).to_numpy()
            v, found = v[~np.isnan(v)], None
            if n := len(v):
                at = [(n - 1) * share for share in (low, high)]
                places = [min(int(x) + k, n - 1) for x in at for k in (0, 1)]
                a, a2, b, b2 = np.partition(v, sorted(set(places)))[places]
                with np.errstate(all="ignore"):
                    a, b = a + (a2 - a) * (at[0] - int(at[0])), b + (b2 - b) * (at[1] - int(at[1]))
                    above = np.maximum(np.minimum(v, b), a) - a  # so that values far from 0 keep their digits
                    found = [a, b, above.mean(), above.std(ddof=1) if n > 1 else None]
            out[c] = pa.array([found], pa.list_(pa.float64()))
        return pa.table(out)

    kind = matrix.schema[spec.date].dataType
    day = to_arrow_type(kind)
    values = matrix.select(spec.date, *[F.col(c).cast("double").alias(c) for c in names])
    return values.groupBy(spec.date).applyInArrow(bounds, ", ".join([f"`{spec.date}` {kind.simpleString()}", *[f"`{c}` array<double>" for c in names]]))


def scaled_matrix(matrix: DataFrame, names: list[str], low: float = 0.01, high: float = 0.99, spec: PanelSpec = PANEL) -> DataFrame:
    """The matrix with each column within its date's interpolated quantiles, then as z-score of the date; missing values become 0.

    Columns not named stay as they are. ``AT_ONCE`` columns at a time go to their dates, and only bounds, means and deviations come
    back, one row a date: the matrix is computed again for each of these passes and for the result, and stands on disk in none.
    """
    out = matrix
    for at in range(0, len(names), AT_ONCE):
        some = names[at : at + AT_ONCE]
        found = written(date_bounds(matrix, some, low, high, spec)).select(F.col(spec.date), *[F.col(c).alias(f"_of_{c}") for c in some])
        out = out.join(F.broadcast(found), spec.date, "left")

    def z(c: str):
        v, of = F.col(c).cast("double"), F.col(f"_of_{c}")
        inside = (F.greatest(F.least(v, of[1]), of[0]) - of[0] - of[2]) / (of[3] + 1e-9)
        return F.coalesce(F.when(v.isNotNull() & ~F.isnan(v), F.nanvl(inside, F.lit(0.0))), F.lit(0.0)).alias(c)

    others = [c for c in matrix.columns if c not in (*names, spec.entity, spec.date)]
    return out.select(spec.entity, spec.date, *[z(c) for c in names], *others)
