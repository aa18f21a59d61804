"""Feature blocks of a panel: column lineage, categories, ratios, stops, sequences and flat matrices."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PANEL, PanelSpec
from .quantiles import exact_quantiles


def last_pivot(df: DataFrame, keys: list[str], kind: str, kinds: list[str], value: str, sequence: str) -> DataFrame:
    """One row for each key with the last value of each kind by the sequence; null where a kind is missing."""
    return df.groupBy(*keys).pivot(kind, kinds).agg(F.max_by(value, sequence))


def lineage(columns: list[str], base: str) -> dict[str, list[str]]:
    """The columns made from a base column by kind: lag, rmean, rstd, mom."""
    found: dict[str, list[str]] = {k: [] for k in ("lag", "rmean", "rstd", "mom")}
    for c in columns:
        if m := re.fullmatch(re.escape(base) + r"_(lag|rmean|rstd|mom)\d+", c):
            found[m[1]].append(c)
    return found


def zero_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(0.0) for c in columns})


def canonical(df: DataFrame, col: str, aliases: dict[str, str], suffixes: list[str], unknown: str = "UNKNOWN") -> DataFrame:
    """Categories in upper case without the suffixes, by alias where one is given; blanks and nulls are unknown."""
    name = F.upper(F.trim(col))
    for s in suffixes:
        name = F.regexp_replace(name, re.escape(s) + "$", "")
    mapped = name
    for a, b in aliases.items():
        mapped = F.when(name == a, F.lit(b)).otherwise(mapped)
    return df.withColumn(col, F.coalesce(F.nullif(mapped, F.lit("")), F.lit(unknown)))


def gated_ratio(df: DataFrame, top: str, bottom: str, out: str, most: float) -> DataFrame:
    """A ratio of two columns, null everywhere if its median over all rows is beyond ``most`` by size."""
    ratio = F.col(top) / F.nullif(bottom, F.lit(0.0))
    middle = exact_quantiles(df, ratio, [], [0.5])
    gate = middle.agg(F.coalesce(F.abs(F.max("value")) <= most, F.lit(False)).alias("_open"))
    return df.crossJoin(F.broadcast(gate)).withColumn(out, F.when(F.col("_open"), ratio)).drop("_open")  # one row


def payout_yield(df: DataFrame, payout: str, price: str, out: str, most: float) -> DataFrame:
    """Payouts over the price, between 0 and ``most``; 0 where there is no payout, no price or a price of 0."""
    value = F.coalesce(F.try_divide(payout, price), F.lit(0.0))
    return df.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), value)))


def share_distribution(df: DataFrame, bucket: str, value: str, small: float, large: float, spec: PanelSpec = PANEL) -> DataFrame:
    """entity, date, retail, rest, large: percent of the value in small buckets, its complement, and in large buckets."""
    total = F.sum(value)
    of = lambda flag: 100.0 * F.coalesce(F.sum(F.when(flag, F.col(value))), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    got = df.groupBy(spec.entity, spec.date).agg(
        (100.0 * F.sum(F.when(F.col(bucket) <= small, F.col(value))) / F.nullif(total, F.lit(0.0))).alias("retail"), of(F.col(bucket) > large).alias("large")
    )
    return got.withColumn("rest", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.col("retail"))))


def trailing_stop(df: DataFrame, price: str, tiers: list[tuple[float, float]], floor: float, best: str, stop: str, spec: PanelSpec = PANEL) -> DataFrame:
    """The best return since an entity's first row, and the stop that its tier sets; a stop never falls."""
    gain = F.col(price) / F.first(price).over(spec.past()) - 1
    peaked = df.withColumn("_gain", gain).withColumn(best, F.max("_gain").over(spec.past())).drop("_gain")
    level = F.lit(float(floor))
    for least, value in sorted(tiers):
        level = F.when(F.col(best) >= least, F.lit(float(value))).otherwise(level)
    return peaked.withColumn(stop, level)


def alignment(df: DataFrame, col: str, rows: list[int], out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """How many steps of value > mean over the shortest window > ... > over the longest hold; null until that one is full."""
    means = [F.col(col), *[F.avg(col).over(spec.series(n)) for n in rows]]
    total = F.lit(0)
    for a, b in zip(means, means[1:], strict=False):
        total = total + F.coalesce((a > b).cast("int"), F.lit(0))
    return df.withColumn(out, F.when(F.row_number().over(spec.series()) >= max(rows), total))


def residual_returns(df: DataFrame, ret: str, most: float, least: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Returns less their date's mean, without those of ``most`` or more by size and entities with fewer than ``least``."""
    sane = df.where(F.abs(ret) < most).withColumn(out, F.col(ret) - F.avg(ret).over(spec.day()))
    return sane.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(spec.entity))).where(F.col("_n") >= least).drop("_n")


def sequences(df: DataFrame, columns: list[str], rows: int, least: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """Each row's last ``rows`` rows as an array of arrays, zeros before the first, with a mask of the places that hold data.

    Rows with fewer than ``least`` rows so far are left out. Nulls count as 0. A frame holds ``rows`` rows at most.
    """
    one = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    held = df.withColumn("rows", F.row_number().over(spec.series())).withColumn("_seq", F.collect_list(one).over(spec.series(rows))).where(F.col("rows") >= least)
    lack = F.lit(rows) - F.size("_seq")
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * len(columns)), lack)
    return held.withColumn(out, F.concat(zeros, "_seq")).withColumn("mask", F.concat(F.array_repeat(F.lit(0), lack), F.array_repeat(F.lit(1), F.size("_seq")))).drop("_seq")


#: Rows of one array of a sequence store.
STORE_ROWS = 4096


def sequence_store(df: DataFrame, columns: list[str], rows: int, spec: PanelSpec = PANEL, block_rows: int = STORE_ROWS) -> DataFrame:
    """entity, block, first, values: each entity's rows in arrays of bounded length, every row once but for the overlap of blocks.

    A block holds its own ``block_rows`` rows and the ``rows - 1`` before them, so that every window lies in one block: the store takes
    1 + (rows - 1) / block_rows times the panel, where windows of their own would take ``rows`` times. Nulls count as 0.
    """
    one = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])
    numbered = df.select(spec.entity, (F.row_number().over(spec.series()) - 1).alias("_n"), one.alias("_x"))
    own = F.floor(F.col("_n") / block_rows).cast("long")
    last = own + F.floor((F.col("_n") % block_rows + rows - 1) / block_rows).cast("long")
    placed = numbered.select(spec.entity, F.explode(F.sequence(own, last)).alias("block"), "_n", "_x")
    held = placed.groupBy(spec.entity, "block").agg(F.array_sort(F.collect_list(F.struct("_n", "_x"))).alias("_v"))
    return held.select(spec.entity, "block", F.col("_v")[0]["_n"].alias("first"), F.transform("_v", lambda v: v["_x"]).alias("values"))


def sequence_index(df: DataFrame, rows: int, least: int, target: str | None = None, spec: PanelSpec = PANEL, block_rows: int = STORE_ROWS) -> DataFrame:
    """entity, date, rows (so far), block, end: where each window ends in the store, for rows with ``least`` rows so far.

    ``target`` is added as its z-score among the date's values.
    """
    n = F.row_number().over(spec.series())
    out = df.withColumns({"rows": n, "block": F.floor((n - 1) / block_rows).cast("long"), "end": (n - 1).cast("long")})
    keep = [spec.entity, spec.date, "rows", "block", "end"]
    if target is not None:
        w = spec.day()
        z = (F.col(target) - F.avg(target).over(w)) / F.nullif(F.stddev_samp(target).over(w), F.lit(0.0))
        out, keep = out.withColumn("_z", z).drop(target).withColumnRenamed("_z", target), [*keep, target]
    return out.where(F.col("rows") >= least).select(*keep)


def sliced(index: DataFrame, store: DataFrame, columns: int, rows: int, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """The index with each window as an array of arrays, zeros before the first row, and the mask: made at read, stored nowhere."""
    met = index.join(store, [spec.entity, "block"])
    size = F.least(F.col("end") + 1, F.lit(rows)).cast("int")
    window = F.slice("values", (F.col("end") - F.col("first") - size + 2).cast("int"), size)
    lack = F.lit(rows) - size
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * columns), lack)
    return met.withColumns({out: F.concat(zeros, window), "mask": F.concat(F.array_repeat(F.lit(0), lack), F.array_repeat(F.lit(1), size))}).drop("values", "first")


def flat_matrix(df: DataFrame, columns: list[str], lags: list[int], means: list[int], momenta: list[int], keep: tuple[str, ...] = (), spec: PanelSpec = PANEL) -> DataFrame:
    """Base columns, lags, rolling means and momenta in a fixed order, from one window pass; nulls become 0. ``keep`` are added as they are."""
    w = spec.series()
    made = {c: F.col(c) for c in columns}
    for c in columns:
        made |= {f"{c}_lag{n}": F.lag(c, n).over(w) for n in lags}
        made |= {f"{c}_rmean{n}": F.when(F.count(c).over(spec.series(n)) >= n, F.avg(c).over(spec.series(n))) for n in means}
        made |= {f"{c}_mom{n}": F.try_divide(F.col(c), F.lag(c, n).over(w)) - 1 for n in momenta}
    return df.select(spec.entity, spec.date, *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in made.items()], *keep)


def calibrated(df: DataFrame, official: str, estimate: str, out: str, low: float = 0.5, high: float = 2.0, spec: PanelSpec = PANEL) -> DataFrame:
    """Adds ``out`` and source: the official value, else the estimate times the date's median ratio, else the last official one.

    A median ratio outside [low, high], or none, counts as 1.
    """
    ratio = F.median(F.col(official) / F.nullif(F.col(estimate), F.lit(0.0))).over(spec.day())
    scaled = df.withColumn("_f", F.round(ratio, 9)).withColumn("_f", F.when(F.col("_f").between(low, high), F.col("_f")).otherwise(F.lit(1.0)))
    scaled = scaled.withColumns({"_calc": F.col(estimate) * F.col("_f"), "_stale": F.last(official, ignorenulls=True).over(spec.past())})
    source = F.when(F.col(official).isNotNull(), "observed").when(F.col("_calc").isNotNull(), "derived").when(F.col("_stale").isNotNull(), "stale")
    return scaled.withColumns({out: F.coalesce(official, "_calc", "_stale"), "source": source}).drop("_f", "_calc", "_stale")


def coded_positions(df: DataFrame, date: str, on: str, codes: dict[str, dict[str, str]], numbers: list[str]) -> DataFrame:
    """Rows of one date (``yyyy/MM/dd`` texts) with codes mapped, unknown ones dropped, and numbers freed of commas and dashes."""
    found = df.withColumn(date, F.try_to_timestamp(F.trim(date), F.lit("yyyy/MM/dd")).cast("date")).where(F.col(date) == F.lit(on).cast("date"))
    for c, names in codes.items():
        known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        found = found.withColumn(c, F.try_element_at(known, F.trim(c))).where(F.col(c).isNotNull())
    clean = lambda c: F.regexp_replace(F.trim(F.col(c).cast("string")), ",", "").try_cast("double")
    return found.withColumns({c: clean(c) for c in numbers})


def statement_facts(wide: DataFrame, keys: list[str], items: dict[str, tuple[str, int]], scale: float) -> DataFrame:
    """keys, type, value, origin: the items of a wide statement in long form, each under the type of its name, in other units.

    ``items`` names for each column its type and priority; of columns of one type the one with the smallest priority that has a value
    counts. The map is part of the plan: no table is joined.
    """
    cells = F.array(*[F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("p"), F.lit(name).alias("origin"), (F.col(name).cast("double") * scale).alias("value")) for name, (kind, priority) in items.items()])
    long = wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*").where("value is not null")
    best = long.groupBy(*keys, "type").agg(F.min(F.struct("p", "origin", "value")).alias("b"))
    return best.select(*keys, "type", "b.value", "b.origin")


def any_observed(df: DataFrame, columns: list[str], out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """1 where any of the columns has had a value of the entity up to the row, else 0."""
    seen = F.coalesce(*[F.last(c, ignorenulls=True).over(spec.past()) for c in columns])
    return df.withColumn(out, seen.isNotNull().cast("double"))


def swap_columns(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The table with these columns from another build, by key; keys that the other build lacks get null, and stay."""
    once = other.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_o"))
    met = df.join(once, keys, "left")
    return met.select(*[F.col(f"_o.{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def best_category(rows: DataFrame, category: str, classes: dict[str, int], seen: str, out: str, spec: PanelSpec = PANEL) -> DataFrame:
    """entity, out: one category an entity: of the best class first (categories not named are class 0), then the newest, then by name."""
    rank = F.lit(0)
    for name, k in classes.items():
        rank = F.when(F.col(category) == name, F.lit(k)).otherwise(rank)
    w = Window.partitionBy(spec.entity).orderBy(rank, F.col(seen).desc_nulls_last(), category)
    return rows.where(F.col(category).isNotNull()).withColumn("_k", F.row_number().over(w)).where("_k = 1").select(spec.entity, F.col(category).alias(out))
