"""Registered queries of the variants that a row of the inventory names beside its main form, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import crosssection as xs
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import graph as gr
from ..operators import matrix as mx
from ..operators import quality as dq
from ..operators import strategy as st
from ..operators import timeseries as ts
from ..sources import files
from ..sources import fixtures as fx

from .catalog import TR, P, S, W, W_, bench, ewm_sql, query, r, sql
from .more import BIN, IC, WIDE


# --- A: loading, bounds, statements, text
@query("a01_loaded_tables", "select 'lineitem' as name, count(*) n, min(cast(l_shipdate as date)) first_d, max(cast(l_shipdate as date)) last_d from lineitem union all select 'orders', count(*), min(cast(o_orderdate as date)), max(cast(o_orderdate as date)) from orders")
def _(s, d):
    paths = {t: f"{d}/{t}.parquet" for t in ("lineitem", "orders", "dividends")}
    tables = files.load_tables(s, paths, {"lineitem": "l_shipdate", "orders": "o_orderdate"}, required=("lineitem",))
    each = [t.agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d")).select(F.lit(n).alias("name"), "*") for n, t in tables.items()]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


@query("a03_column_bounds", "select min(l_orderkey) low_l_orderkey, max(l_orderkey) high_l_orderkey, min(l_quantity) low_l_quantity, max(l_quantity) high_l_quantity, count(*) n from lineitem")
def _(s, d):
    return files.column_bounds(s, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("a12_statement_facts", sql(f"""select id, period_end, 'revenue' as type, round(case when id % 3 = 0 then qty else rev end * 1000, 2) as value, case when id % 3 = 0 then 'qty' else 'rev' end origin from ({WIDE}) where case when id % 3 = 0 then qty else rev end is not null
 union all select id, period_end, 'tax', round(tax * 1000, 2), 'tax' from ({WIDE}) where tax is not null""", "facts"))
def _(s, d):
    wide = fx.facts(s, d).groupBy("id", "period_end").pivot("type", ["rev", "qty", "tax"]).agg(F.max("value"))
    wide = wide.withColumn("rev", F.when(F.col("id") % 3 != 0, F.col("rev")))  # the best name is missing for a third
    items = {"rev": ("revenue", 1), "qty": ("revenue", 2), "tax": ("tax", 1)}
    return ft.statement_facts(wide, ["id", "period_end"], items, 1000.0).select("id", "period_end", "type", r("value", 2), "origin")


@query("a13_plain_numbers", "select o_orderkey, o_totalprice * case o_orderkey % 4 when 1 then -1 when 2 then 0.01 else 1 end as num, case when o_orderkey % 4 < 3 then cast(o_orderdate as date) end d from orders where o_orderkey % 4 < 3 union all select o_orderkey, null, null from orders where o_orderkey % 4 = 3")
def _(s, d):
    money = F.format_number(F.col("o_totalprice").cast("double"), 2)
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, money).when(k == 1, F.concat(F.lit("("), money, F.lit(")"))).when(k == 2, F.concat(F.lit(" "), money, F.lit("% "))).otherwise("--")
    year = F.year("o_orderdate") - 1911
    era = F.when(k == 0, F.concat_ws("/", year, F.month("o_orderdate"), F.dayofmonth("o_orderdate"))).when(k == 1, F.format_string("%d%02d%02d", year, F.month("o_orderdate"), F.dayofmonth("o_orderdate")))
    era = era.when(k == 2, F.concat_ws("-", year, F.month("o_orderdate"), F.dayofmonth("o_orderdate"))).otherwise("85/13/40")
    rows = fx.read(s, d, "orders").select("o_orderkey", text.alias("t"), era.alias("e"))
    return rows.select("o_orderkey", fn.plain_number(F.col("t")).alias("num"), fn.era_date(F.col("e")).alias("d"))


# --- B: flags, swaps, categories, labels
@query("b06_any_observed", sql(f"select id, d, (count(unc) {W_(100000)} + count(case when label > 0.1 then 1 end) {W_(100000)} > 0)::int::double flag from scores", "scores"))
def _(s, d):
    p = S(s, d).withColumn("big", F.when(F.col("label") > 0.1, F.col("label")))
    return ft.any_observed(p, ["unc", "big"], "flag").select("id", "d", "flag")


@query("b10_column_swap", sql("select p.id, p.d, round(o.close, 6) as close, p.volume from panel p left join (select id, d, close + 5 as close from panel where id % 6 <> 0) o using (id, d)", "panel"))
def _(s, d):
    other = P(s, d).where("id % 6 <> 0").select("id", "d", (F.col("close") + 5).alias("close"))
    return ft.swap_columns(P(s, d).select("id", "d", "close", "volume"), other, ["id", "d"], ["close"]).select("id", "d", r("close"), "volume")


@query("b11_best_category", "select id, category from (select o_custkey id, o_orderpriority category, row_number() over (partition by o_custkey order by case o_orderpriority when '4-NOT SPECIFIED' then 2 when '5-LOW' then 1 else 0 end, o_orderdate desc, o_orderpriority) k from orders) where k = 1")
def _(s, d):
    rows = fx.read(s, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("p"), "o_orderdate")
    return ft.best_category(rows, "p", {"4-NOT SPECIFIED": 2, "5-LOW": 1}, "o_orderdate", "category")


@query("b12_top_signals", sql("select id, d, k as rank from (select id, d, row_number() over (partition by d order by score desc, id) k from scores where score > 0.5) where k <= 5", "scores"))
def _(s, d):
    return xs.top_n(S(s, d).where("score > 0.5"), "score", 5).select("id", "d", F.col("rank").cast("long").alias("rank"))


@query("b13_fixed_bins", sql("select id, d, case when unc <= 0.2 then 'High' when unc <= 0.5 then 'Medium' when unc > 0.5 then 'Low' end confidence from scores", "scores"))
def _(s, d):
    return xs.fixed_bins(S(s, d), "unc", [0.2, 0.5], ["High", "Medium", "Low"], "confidence").select("id", "d", "confidence")


# --- D: reports
TWICE = "(select id, d, close, 1 as v from panel union all select id, d, close + 1, 2 from panel where id % 9 = 0)"


@query("d12_keep_last", sql(f"select id, d, round(arg_max(close, v), 6) as close from {TWICE} group by 1, 2", "panel"))
def _(s, d):
    p = P(s, d).select("id", "d", "close", F.lit(1).alias("v"))
    again = p.where("id % 9 = 0").withColumns({"close": F.col("close") + 1, "v": F.lit(2)})
    return dq.keep_last(p.unionByName(again), ["id", "d"], ["v"]).select("id", "d", r("close"))


@query("d15_profile_by_year", sql("""select year(d)::bigint as year, name, count(*) n, round(avg((v is null)::int), 6) null_share, round(coalesce(avg((v = 0)::int), 0), 6) zero_share, round(coalesce(avg((abs(v) < 0.01)::int), 0), 6) near_zero_share, round(stddev_samp(v), 6) std
 from (select d, unnest(['score', 'unc', 'label']) as name, unnest([score, unc, label]) v from scores) group by 1, 2""", "scores"))
def _(s, d):
    out = dq.column_profile_by(S(s, d), ["score", "unc", "label"], [F.year("d").cast("long").alias("year")], 0.01)
    return out.select("year", "name", "n", *[r(c) for c in ("null_share", "zero_share", "near_zero_share", "std")])


@query("d15_worst_columns", sql("select name, round(bad, 6) bad from (select name, avg((v is null or v = 0)::int) bad from (select unnest(['score', 'unc', 'label']) as name, unnest([score, unc, label]) v from scores) group by 1) order by bad desc, name limit 2", "scores"))
def _(s, d):
    out = dq.column_profile_by(S(s, d), ["score", "unc", "label"], [])
    bad = F.col("null_share") + F.col("zero_share") * (1 - F.col("null_share"))
    return out.select("name", F.round(bad, 6).alias("bad")).orderBy(F.col("bad").desc(), "name").limit(2)


@query("d17_count_breaches", sql("select d, n, n - b change, coalesce(abs(n - b) > 0.05 * b, false) breach from (select d, n, lag(n) over (order by d) b from (select d, count(distinct id) n from panel group by d))", "panel"))
def _(s, d):
    return dq.count_breaches(P(s, d), 0.05)


@query("d18_calendar_difference", "select d, 'missing' side from (select distinct cast(o_orderdate as date) d from orders) where d between (select min(cast(l_shipdate as date)) from lineitem where l_quantity > 45) and (select max(cast(l_shipdate as date)) from lineitem where l_quantity > 45) and d not in (select cast(l_shipdate as date) from lineitem where l_quantity > 45) union all select d, 'extra' from (select distinct cast(l_shipdate as date) d from lineitem where l_quantity > 45) where d not in (select cast(o_orderdate as date) from orders)")
def _(s, d):
    line = fx.read(s, d, "lineitem").where("l_quantity > 45").select(F.to_date("l_shipdate").alias("d"))
    return dq.calendar_difference(line, fx.read(s, d, "orders").select(F.to_date("o_orderdate").alias("d")))


@query("d20_same_day_coverage", sql("select p.d, count(*) n, round(avg((s.id is not null)::int), 6) scored, round(avg((e.id is not null)::int), 6) adjusted from panel p left join (select id, d from scores where unc is not null) s using (id, d) left join ex e using (id, d) where p.volume > 20 group by 1", "scores", "ex"))
def _(s, d):
    sides = {"scored": S(s, d).where("unc is not null"), "adjusted": fx.adjustments(s, d)}
    return dq.same_day_coverage(P(s, d), sides, F.col("volume") > 20).select("d", "n", r("scored"), r("adjusted"))


@query("d21_constant_days", sql("select name, count(distinct v) as \"values\", count(distinct d) as days, count(distinct case when one then d end) constant_days from (select *, min(v) over (partition by name, d) = max(v) over (partition by name, d) one from (select d, unnest(['volume', 'month']) as name, unnest([volume, month(d)::double]) v from panel)) group by 1", "panel"))
def _(s, d):
    return dq.constant_days(P(s, d).withColumn("month", F.month("d")), ["volume", "month"]).select("name", "values", "days", "constant_days")


@query("d22_members_changed", "select o_custkey, a.p before, b.p as after, case when b.p is null then 'removed' when a.p is null then 'added' else 'moved' end change from (select o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) p from orders where o_orderdate < timestamp '1995-01-01' group by 1) a full join (select o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) p from orders where o_orderdate >= timestamp '1997-01-01' group by 1) b using (o_custkey) where a.p is distinct from b.p")
def _(s, d):
    at, o = F.struct("o_orderdate", "o_orderkey"), fx.read(s, d, "orders")
    snap = lambda rule: o.where(rule).groupBy("o_custkey").agg(F.max_by("o_orderpriority", at).alias("p"))
    return dq.members_changed(snap("o_orderdate < timestamp '1995-01-01'"), snap("o_orderdate >= timestamp '1997-01-01'"), "o_custkey", "p")


@query("d27_build_ratios", sql("select year(d)::bigint period, count(*) n, round(avg((x = close)::int), 6) as equal, count(*) filter (abs(x / close - 1) > 0.0009) extremes, round(quantile_cont(x / close, 0.05), 8) p05, round(quantile_cont(x / close, 0.5), 8) p50, round(quantile_cont(x / close, 0.95), 8) p95 from (select id, d, close, case when id % 10 = 0 then close + 1 else close end x from panel) group by 1", "panel"))
def _(s, d):
    a = P(s, d).select("id", "d", "close")
    b = a.withColumn("close", F.expr("case when id % 10 = 0 then close + 1 else close end"))
    out = dq.build_ratios(a, b, ["id", "d"], "close", F.year("d").cast("long"), {"p05": 0.05, "p50": 0.5, "p95": 0.95}, 0.0009)
    return out.select("period", "n", r("equal"), "extremes", *[r(x, 8) for x in ("p05", "p50", "p95")])


@query("d30_index_level", sql("select d, round(last_value(x ignore nulls) over (order by d), 6) lvl from (select d, x from (select distinct d from panel) left join (select d, avg(close) x from panel where volume > 30 and month(d) <> 7 group by d) using (d))", "panel"))
def _(s, d):
    p = P(s, d)
    level = ev.index_level(p.where("volume > 30 and month(d) <> 7"), "close", p.select("d").distinct())
    return level.select("d", F.round("level", 6).alias("lvl"))


@query("d33_sparsest", sql("select id, n, of_ as \"of\", round(n / of_::double, 6) share from (select id, count(distinct d) n, max(idx) - min(idx) + 1 of_ from panel join cal using (d) group by id) order by n / of_::double, id limit 10", "cal"))
def _(s, d):
    return dq.sparsest(P(s, d), 10).select("id", "n", "of", r("share"))


# --- E: evaluation
@query("e06_period_ics", sql("", "scores", "ics").rstrip() + " select i.d, round(ic, 6) ic, round(t, 6) top from ics i join (select d, avg(label) t from (select *, row_number() over (partition by d order by score desc, id) k from scores where label is not null) where k <= 10 group by d) using (d)")
def _(s, d):
    daily = ev.rank_ic(S(s, d), "score", "label", 10)
    top = xs.top_n(S(s, d).where("label is not null"), "score", 10).groupBy("d").agg(F.avg("label").alias("top"))
    return daily.join(top, "d").select("d", r("ic"), r("top"))


@query("e10_subset_study", sql("""select era, both_, count(*) as days, round(avg(x), 6) mean from (select year(d)::bigint era, d, both_, avg(label) x from (select d, label, row_number() over (partition by d order by score desc, id) <= 20 and row_number() over (partition by d order by coalesce(unc, 9e9), id) <= 20 both_ from scores) where label is not null group by 1, 2, 3) group by 1, 2""", "scores"))
def _(s, d):
    p = xs.unique_rank(S(s, d), "score", "k").withColumn("u", -F.coalesce("unc", F.lit(9e9)))
    p = xs.unique_rank(p, "u", "j").where("label is not null").withColumn("both_", (F.col("k") <= 20) & (F.col("j") <= 20))
    daily = p.groupBy(F.year("d").cast("long").alias("era"), "d", "both_").agg(F.avg("label").alias("x"))
    return daily.groupBy("era", "both_").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("x"), 6).alias("mean"))


TAILS = f"tl as (select * from (select *, {BIN.format('score', 10)} bin from scores) where bin in (1, 10))"


@query("e16_tail_quarters", sql("", "scores").rstrip() + f", {TAILS} select bin, year(d) || 'Q' || quarter(d) qtr, count(*) as days, round(avg(m), 6) mean from (select bin, d, avg(label) m from tl where label is not null group by 1, 2) group by 1, 2")
def _(s, d):
    return ev.tail_by_quarter(S(s, d), "score", "label").select("bin", F.col("quarter").alias("qtr"), "days", r("mean"))


@query("e16_tail_past_returns", sql("", "scores").rstrip() + f", pr as (select id, d, close / lag(close, 20) {W} - 1 past from panel), {TAILS} select bin, count(*) n, round(corr(score, past), 5) as corr from tl join pr using (id, d) where past is not null group by 1")
def _(s, d):
    past = ts.pct_change(P(s, d), "close", 20, "past").select("id", "d", "past")
    return ev.tail_past_correlation(S(s, d).join(past, ["id", "d"]), "score", "past").select("bin", "n", r("corr", 5))


@query("e16_tail_without_best", sql("", "scores").rstrip() + f", {TAILS} select bin, count(*) as days, round(avg(m), 6) mean, round(avg(m) filter (k > 10), 6) rest from (select bin, d, m, row_number() over (partition by bin order by m desc, d) k from (select bin, d, avg(label) m from tl where label is not null group by 1, 2)) group by 1")
def _(s, d):
    return ev.tail_without_best(S(s, d), "score", "label", 10).select("bin", "days", r("mean"), F.round("without", 6).alias("rest"))


@query("e21_concentration", sql("", "scores").rstrip() + """, t as (select d, avg(label) x from (select *, row_number() over (partition by d order by score desc, id) k from scores where label is not null) where k <= 10 group by d)
 select round(sum(x) filter (k <= 10) / sum(x), 6) best_days, round(avg(x) filter (k > 10), 8) mean_without, count(*) n from (select x, row_number() over (order by x desc, d) k from t)""")
def _(s, d):
    top = xs.top_n(S(s, d).where("label is not null"), "score", 10).groupBy("d").agg(F.avg("label").alias("x"))
    return ev.best_day_share(top, "x", 10).select(r("best_days"), r("mean_without", 8), "n")


@query("e26_restricted_universe", sql("", "scores").rstrip() + ", u as (select *, ntile_ from (select *, ceil(row_number() over (partition by d order by close * volume, id) * 3.0::double / count(*) over (partition by d))::bigint ntile_ from scores) where ntile_ = 3) select round(avg(x), 6) mean, count(*) n from (select d, avg(label) x from (select *, row_number() over (partition by d order by score desc, id) k from u where label is not null) where k <= 5 group by d)")
def _(s, d):
    liquid = xs.quantile_bin(S(s, d).withColumn("money", F.expr("close * volume")), "money", 3, "third").where("third = 3 and label is not null")
    top = xs.top_n(liquid, "score", 5).groupBy("d").agg(F.avg("label").alias("x"))
    return top.agg(F.round(F.avg("x"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


ZONES = """z as (select *, (row_number() over (partition by d order by score, id) - 1) / greatest(count(*) over (partition by d) - 1, 1)::double p from scores where label is not null),
 zz as (select d, score, label, case when p <= 0.2 or p >= 0.8 then 'tails' when p between 0.3 and 0.7 then 'middle' end grp from z)"""


@query("e35_zone_ics", sql("", "scores").rstrip() + f", {ZONES}, zk as (select * from zz where grp is not null) select grp, round(avg(ic), 6) mean, count(ic) n from ({IC.format('zk', 'd, grp', 'score', 'label', 10)}) group by grp")
def _(s, d):
    return ev.zone_ics(S(s, d).where("label is not null"), "score", "label", 10).select("grp", r("mean"), "n")


@query("e35_contrasts", sql("select round(avg(m) filter (bin = 10) - avg(m) filter (bin in (5, 6)), 6) top_less_middle, round(avg(m) filter (bin = 1) - avg(m) filter (bin in (5, 6)), 6) bottom_less_middle, round(avg(m) filter (bin = 10) - avg(m) filter (bin = 1), 6) spread from (select d, bin, avg(label) m from (select d, label, greatest(1, ceil((k - 1) * 10 / greatest(n - 1, 1)::double))::int bin from (select d, label, row_number() over (partition by d order by score, id) k, count(*) over (partition by d) n from scores where label is not null)) group by 1, 2)", "scores"))
def _(s, d):
    binned = xs.equal_bins(S(s, d).where("label is not null"), "score", 10, "bin").groupBy("d", "bin").agg(F.avg("label").alias("m"))
    mean = lambda *bins: F.avg(F.when(F.col("bin").isin(*bins), F.col("m")))
    return binned.agg(F.round(mean(10) - mean(5, 6), 6).alias("top_less_middle"), F.round(mean(1) - mean(5, 6), 6).alias("bottom_less_middle"), F.round(mean(10) - mean(1), 6).alias("spread"))


# --- F, G: windows and ranks
@query("f06_atr_market", sql(f"select id, d, round(case when seen >= 14 then value end, 5) atr from ({ewm_sql('tr', 1 / 14, True, TR)})", "panel"))
def _(s, d):
    return ts.ewm(ts.true_range(P(s, d), "tr"), "tr", 1 / 14, True, "atr", 14).select("id", "d", r("atr", 5))


@query("f08_obv_z", sql(f"select id, d, round(case when count(obv) {W_(60)} >= 20 then (obv - avg(obv) {W_(60)}) / nullif(stddev_samp(obv) {W_(60)}, 0) end, 5) z, obv > avg(obv) {W_(20)} rising from (select id, d, sum(coalesce(sign(ret) * volume, 0)) {W} obv from rets)", "rets"))
def _(s, d):
    p = ts.on_balance_volume(P(s, d), "close", "volume", "obv")
    p = ts.rolling(ts.rolling(ts.rolling(p, "obv", "avg", 60, 20, "m"), "obv", "stddev_samp", 60, 20, "s"), "obv", "avg", 20, 1, "t")
    return p.select("id", "d", F.round(F.expr("(obv - m) / nullif(s, 0)"), 5).alias("z"), (F.col("obv") > F.col("t")).alias("rising"))


@query("f11_strength_block", sql("""select id, d, """ + ", ".join(f"round(coalesce(last_value(x{n} ignore nulls) over (partition by id order by d), 0), 6) rs{n}" for n in (5, 20, 60)) + " from (select id, d, " + ", ".join(f"close / lag(close, {n}) {W} - 1 - (lvl / lag(lvl, {n}) {W} - 1) x{n}" for n in (5, 20, 60)) + " from panel left join (select d, exp(sum(ln(1 + ret)) over (order by d)) lvl from bench) using (d))", "bench"))
def _(s, d):
    level = bench(s, d).select("d", F.exp(F.sum(F.log1p("ret")).over(Window.orderBy("d"))).alias("lvl"))  # one row a date
    p = P(s, d).join(F.broadcast(level), "d", "left")
    for n in (5, 20, 60):
        p = ts.pct_change(ts.pct_change(p, "close", n, "a"), "lvl", n, "b").withColumn(f"x{n}", F.col("a") - F.col("b"))
        p = ts.forward_fill(p, f"x{n}", f"rs{n}", F.lit(0.0))
    return p.select("id", "d", *[r(f"rs{n}") for n in (5, 20, 60)])


@query("f16_scaled_momentum", sql("", "panel").rstrip() + f""", m as (select id, d, close / lag(close, 10) {W} - 1 m from panel), q as (select d, quantile_cont(m, 0.01) a, quantile_cont(m, 0.99) b from m group by d), w as (select id, d, case when m is not null then greatest(least(m, b), a) end w from m join q using (d))
 select id, d, round((w - avg(w) over (partition by d)) / (stddev_samp(w) over (partition by d) + 1e-9), 5) z from w""")
def _(s, d):
    p = xs.winsorise(ts.pct_change(P(s, d), "close", 10, "m"), "m", 0.01, 0.99, "w")
    return xs.zscore(p, "w", "z").select("id", "d", r("z", 5))


@query("f15_scaled_means", sql("", "panel").rstrip() + ", m as (select id, d, name, v from (select id, d, " + ", ".join(f"case when count({c}) {W_(n)} >= {n} then avg({c}) {W_(n)} end {c}_rmean{n}" for c in ("close", "volume") for n in (5, 20)) + """ from panel) unpivot include nulls (v for name in (close_rmean5, close_rmean20, volume_rmean5, volume_rmean20))),
 q as (select d, name, quantile_cont(v, 0.01) a, quantile_cont(v, 0.99) b from m group by d, name), w as (select id, d, name, case when v is not null then greatest(least(v, b), a) end w from m join q using (d, name)) select id, d, name, round((w - avg(w) over (partition by d, name)) / (stddev_samp(w) over (partition by d, name) + 1e-9), 4) z from w""")
def _(s, d):
    p, made = P(s, d), []
    for c in ("close", "volume"):
        for n in (5, 20):
            p = ts.rolling(p, c, "avg", n, n, f"{c}_rmean{n}")
            made.append(f"{c}_rmean{n}")
    for c in made:
        p = xs.zscore(xs.winsorise(p, c, 0.01, 0.99, "w"), "w", f"{c}_z")
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(f"{c}_z", 4).alias("z")) for c in made])).alias("x")
    return p.select("id", "d", long).select("id", "d", "x.*")


@query("f23_local_extrema", sql("select id, d, case when lo and not coalesce(lag(lo) over w, false) then 'low' else 'high' end kind from (select id, d, c = 11 and close <= mn lo, c = 11 and close >= mx hi from (select id, d, close, min(close) over v mn, max(close) over v mx, count(*) over v c from panel window v as (partition by id order by d rows between 5 preceding and 5 following))) window w as (partition by id order by d) qualify (lo and not coalesce(lag(lo) over w, false)) or (hi and not coalesce(lag(hi) over w, false))", "panel"))
def _(s, d):
    return ts.local_extrema(P(s, d), "close", 5).select("id", "d", "kind")


@query("g06_positional_rank", sql("select id, d, round(case when n > 1 then (k - 1) / (n - 1)::double - 0.5 end, 6) k from (select id, d, count(*) over (partition by d) n, row_number() over (partition by d order by score, id) k from scores)", "scores"))
def _(s, d):
    return xs.positional_rank(S(s, d), "score", "k").select("id", "d", r("k"))


@query("g14_weight_schemes", sql("", "scores").rstrip() + """, t as (select * from (select *, row_number() over (partition by d order by score desc, id) k, close * volume money from scores) where k <= 10)
 select id, d, round(1.0 / count(*) over (partition by d), 6) equal, round(coalesce(m, md) / sum(coalesce(m, md)) over (partition by d), 6) liquid from (select *, median(m) over (partition by d) md from (select *, case when id % 8 <> 0 then money end m from t))""")
def _(s, d):
    top = xs.top_n(S(s, d), "score", 10).withColumn("m", F.when(F.col("id") % 8 != 0, F.expr("close * volume")))
    out = st.scheme_weights(st.scheme_weights(top, None, "equal"), "m", "liquid")
    return out.select("id", "d", r("equal"), r("liquid"))


# --- I, K: sets and graphs
@query("i03_key_sets", sql("select sum(a and not b)::bigint only_a, sum(b and not a)::bigint only_b, sum(a and b)::bigint both_, sum(b and not a) = 0 superset from (select bool_or(t = 'a') a, bool_or(t = 'b') b from (select id, d, 'a' t from panel union all select id, d, 'b' from ex where id % 2 = 0) group by id, d)", "panel", "ex"))
def _(s, d):
    return dq.key_sets(P(s, d), fx.adjustments(s, d).where("id % 2 = 0"), ["id", "d"]).select("only_a", "only_b", F.col("both").alias("both_"), "superset")


@query("k03_both_ways", "with p as (select distinct l_suppkey % 40 a, l_partkey % 40 b from lineitem where l_quantity = 50) select src, dst, 1.0::double weight from (select src, dst, row_number() over (partition by src order by dst) k from (select a src, b dst from p where a <> b union select b, a from p where a <> b)) where k <= 20")
def _(s, d):
    pairs = fx.read(s, d, "lineitem").where("l_quantity = 50").select((F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b"))
    return gr.both_ways(pairs, "a", "b", 20, 1.0)


LAYERS = "b as (select l_suppkey src, l_partkey % 97 dst, 1.0::double w from lineitem where l_quantity > 48 group by 1, 2), n as (select l_suppkey src, l_partkey % 97 dst, round(avg(l_discount), 6) * 10 w from lineitem where l_quantity < 10 group by 1, 2)"


def layers(s, d):
    line = fx.read(s, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 97).alias("dst"), "l_quantity", "l_discount")
    base = line.where("l_quantity > 48").select("src", "dst").distinct().withColumn("weight", F.lit(1.0))
    return base, line.where("l_quantity < 10").groupBy("src", "dst").agg((F.round(F.avg("l_discount"), 6) * 10).alias("weight"))


@query("k06_additive_merge", f"with {LAYERS}, x as (select src, dst, w, row_number() over (partition by src order by w desc, dst) k from n where not exists (select 1 from b where b.src = n.src and b.dst = n.dst)) select src, dst, round(w, 6) weight from b union all select src, dst, round(w, 6) from x where k <= 5")
def _(s, d):
    base, new = layers(s, d)
    return gr.add_edges(base, new, 5).select("src", "dst", r("weight"))


@query("k08_subgraph_coverage", f"with {LAYERS}, k as (select distinct src node from b where src % 3 = 0) select count(*) edges, count(distinct src) covered, (select count(*) from k) nodes, round(count(distinct src) / (select count(*) from k)::double, 6) share from n where src in (select node from k) and dst in (select node from k)")
def _(s, d):
    base, new = layers(s, d)
    return gr.subgraph_coverage(new, base.where("src % 3 = 0").select(F.col("src").alias("node")).distinct(), "node").select("edges", "covered", "nodes", r("share"))


@query("k09_weight_histogram", f"with {LAYERS} select least(9, floor(w * 10))::int bin, count(*) n from n group by 1")
def _(s, d):
    return gr.weight_histogram(layers(s, d)[1], 10, 1.0)


@query("k09_old_and_new", f"with {LAYERS} select count(*) filter (b.w is not null and n.w is null) removed, count(*) filter (b.w is null) added, count(*) filter (b.w is not null and n.w is not null) kept, round(avg(abs(b.w - n.w)), 6) moved from b full join n on b.src = n.src and b.dst = n.dst")
def _(s, d):
    return gr.compare_edges(*layers(s, d)).select("removed", "added", "kept", r("moved"))


# --- J: column functions
@query("j01_math", "select l_orderkey, l_linenumber, round(sign(l_quantity - 25) * ln(1 + abs(l_quantity - 25)), 6) slog, greatest(5.0, least(45.0, l_quantity)) clip, round(sqrt(l_extendedprice), 4) root from lineitem")
def _(s, d):
    line, q = fx.read(s, d, "lineitem"), F.col("l_quantity").cast("double")
    return line.select("l_orderkey", "l_linenumber", F.round(fn.signed_log(q - 25), 6).alias("slog"), fn.clipped(q, 5, 45).alias("clip"), F.round(F.sqrt("l_extendedprice"), 4).alias("root"))


@query("j02_ratios", "select l_orderkey, l_linenumber, round(l_quantity / nullif(l_discount, 0), 4) ratio, round(l_quantity / (l_discount + 1e-9), 2) soft from lineitem")
def _(s, d):
    q, x = F.col("l_quantity"), F.col("l_discount")
    return fx.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(fn.ratio(q, x), 4).alias("ratio"), F.round(fn.soft_ratio(q, x), 2).alias("soft"))


@query("j03_dates", """select o_orderkey, cast(last_day(cast(o_orderdate as date) + interval 2 month) as date) + 10 due, year(o_orderdate) || 'Q' || quarter(o_orderdate) q, strftime(o_orderdate, '%Y-%m') m, isodow(o_orderdate)::int dow,
 (select count(*) from range(cast(o_orderdate as date) + 1, cast(o_orderdate as date) + 1 + (o_orderkey % 30)::int, interval 1 day) t(x) where isodow(x) < 6)::int as days from orders""")
def _(s, d):
    day = F.to_date("o_orderdate")
    later = F.date_add(day, (F.col("o_orderkey") % 30).cast("int"))
    return fx.read(s, d, "orders").select("o_orderkey", fn.month_end(day, 10, 2).alias("due"), fn.period(day, "Q").alias("q"), fn.period(day, "M").alias("m"), (F.weekday(day) + 1).alias("dow"), fn.weekdays_between(day, later).alias("days"))


@query("j04_texts", "select o_orderkey, case o_orderpriority when '1-URGENT' then 'now' when '5-LOW' then 'later' else o_orderpriority end mapped, case when o_orderpriority like '1-%' then substr(o_orderpriority, 3) else o_orderpriority end bare, regexp_extract(o_orderpriority, '[A-Z]+', 0) word, o_orderpriority like '%E%' has_e from orders")
def _(s, d):
    p = F.col("o_orderpriority")
    return fx.read(s, d, "orders").select("o_orderkey", fn.mapped(p, {"1-URGENT": "now", "5-LOW": "later"}).alias("mapped"), fn.without_affix(p, "1-").alias("bare"), F.regexp_extract(p, "[A-Z]+", 0).alias("word"), p.contains("E").alias("has_e"))


@query("j05_conditions", sql("select id, d, case when unc > 0.3 then 'wild' else 'calm' end mood, coalesce(unc between 0.1 and 0.3, false) usual, coalesce(unc, score, 0) first_known from scores", "scores"))
def _(s, d):
    u = F.col("unc")
    return S(s, d).select("id", "d", fn.chosen(u > 0.3, F.lit("wild"), F.lit("calm")).alias("mood"), fn.within(u, F.lit(0.1), F.lit(0.3)).alias("usual"), F.coalesce(u, "score", F.lit(0.0)).alias("first_known"))


@query("j07_casts", "select doc_id, try_cast(substr(text, 1, 3) as double) num, cast(try_strptime(lpad(cast(doc_id % 40 as varchar), 2, '0') || '/03/1997', '%d/%m/%Y') as date) as on_day from documents where text is not null")
def _(s, d):
    day = F.concat(F.lpad((F.col("doc_id") % 40).cast("string"), 2, "0"), F.lit("/03/1997"))
    return fx.read(s, d, "documents").where("text is not null").select("doc_id", fn.number(F.substring("text", 1, 3)).alias("num"), fn.moment(day, "yyyy-MM-dd", "dd/MM/yyyy").cast("date").alias("on_day"))


# --- M: the whole matrix
@query("m09_wide_matrix", None)
def _(s, d):
    bars = files.written(P(s, d).select("id", "d", "high", "low", "close", "volume"))
    returns = ts.pct_change(bars, "close", 1, "ret").where("ret is not null")
    p, names = mx.base_matrix(bars, files.written(returns.groupBy("d").agg(F.avg("ret").alias("ret"))))
    out = mx.scaled_matrix(p, names)
    return out.select("id", "d", *[r(c, 5) for c in names], "avail_long")
