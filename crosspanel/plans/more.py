"""Further registered queries: strategies, folds, sources, features, weights, graphs and models, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import crosssection as xs
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import graph as gr
from ..operators import pit
from ..operators import quality as dq
from ..operators import regression as rg
from ..operators import strategy as st
from ..operators import timeseries as ts
from ..sources import files
from ..sources import fixtures as fx
from ..streaming import events as sv
from ..streaming import tables as tb
from ..spec import PANEL
from .catalog import P, S, W, W_, bench, ics, query, r, rets, sql


def cal(s, d):
    return pit.calendar(P(s, d))


# --- A: files
MONTHS = "select id, cast(date_trunc('month', d) as date) d, sum(volume) volume from panel group by 1, 2"


def months(s, d):
    return P(s, d).groupBy("id", F.trunc("d", "month").alias("d")).agg(F.sum("volume").alias("volume"))


@query("a05_dated_csv", sql(f"select id, d, volume from ({MONTHS}) where d between date '1994-01-01' and date '1996-12-01'", "panel"))
def _(s, d):
    root = files.scratch(s)
    months(s, d).withColumn("folder", F.col("d").cast("string")).drop("d").repartition("folder").write.partitionBy("folder").option("header", True).csv(root)
    return files.read_dated_csv(s, root, "id long, volume double", "d", "1994-01-01", "1996-12-01").select("id", "d", "volume")


@query("a06_signal_json", sql(f"select d, id, volume from ({MONTHS}) where volume >= 100", "panel"))
def _(s, d):
    root, one = files.scratch(s), F.struct("id", "volume")
    high = lambda low, top: F.collect_list(F.when((F.col("volume") >= low) & (F.col("volume") < top), one))
    days = months(s, d).groupBy(F.col("d").cast("string").alias("folder")).agg(high(100, 200).alias("watch"), high(200, 1e18).alias("buy"))
    days.repartition("folder").write.partitionBy("folder").json(root)
    kind = "array<struct<id: long, volume: double>>"
    return files.read_signal_json(s, root, f"watch {kind}, buy {kind}", ["buy", "watch"]).select("d", "id", "volume")


@query("a07_last_log_record", "select cast(o_orderdate as date) d, arg_max(o_orderkey, o_orderkey) o_orderkey, arg_max(o_totalprice, o_orderkey) o_totalprice from orders group by 1")
def _(s, d):
    path = files.scratch(s)
    fx.read(s, d, "orders").select(F.to_date("o_orderdate").alias("d"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").cast("double").alias("o_totalprice")).write.json(path)
    return files.read_log(s, path, "d date, seq long, o_totalprice double").select("d", F.col("seq").alias("o_orderkey"), "o_totalprice")


@query("a08_archive", sql(f"select id, d, volume from ({MONTHS}) where d in (select distinct d from ({MONTHS}) order by d desc limit 12)", "panel"))
def _(s, d):
    path = files.scratch(s)
    files.write_archive(months(s, d), path)
    files.write_archive(months(s, d).where("d >= '1998-01-01'"), path, keep=12)
    return s.read.parquet(path).select("id", F.col("d").cast("date").alias("d"), "volume")


@query("a10_merge_staging", sql("select id, d, round(coalesce(n.close, p.close), 9) as close, case when n.id is null then p.volume end volume from panel p full join (select id, d, close + 1 as close from panel where id % 5 = 0) n using (id, d)", "panel"))
def _(s, d):
    old = P(s, d).select("id", "d", "close", "volume")
    staged = old.where("id % 5 = 0").select("id", "d", (F.col("close") + 1).alias("CLOSE"), F.lit(1).alias("batch"), F.lit("x").alias("note"))
    staged = staged.unionByName(staged.withColumn("batch", F.lit(0)).withColumn("CLOSE", F.lit(0.0)))
    return files.merge_staging(old, staged, ["id", "d"], "batch").select("id", "d", r("close", 9), "volume")


@query("a11_history_index", sql("select id, d, k from (select id, d, row_number() over (partition by d order by score desc, id) k from scores) where k <= 50 and d in (select distinct d from scores order by d desc limit 60)", "scores"))
def _(s, d):
    top = xs.top_n(S(s, d), "score", 50).select("id", "d", F.col("rank").cast("long").alias("k"))
    last = xs.last_dates(top, 1)
    return files.update_history(files.update_history(top, last, 60), last, 60)


# --- B: filters
@query("b02_tradable", sql("select s.id, s.d, s.score from scores s where exists (select 1 from panel p where p.id = s.id and p.d = s.d and p.close > 0 and p.volume >= 30)", "scores"))
def _(s, d):
    return S(s, d).join(P(s, d).where("close > 0 and volume >= 30").select("id", "d"), ["id", "d"], "left_semi").select("id", "d", "score")


@query("b10_column_ablation", sql(f"select id, d, 0.0::double close_lag1, 0.0::double close_lag5, volume_lag1, volume_lag5 from (select id, d, lag(volume, 1) {W} volume_lag1, lag(volume, 5) {W} volume_lag5 from panel)", "panel"))
def _(s, d):
    block = ts.lag_block(P(s, d), ["close", "volume"], [1, 5])
    return ft.zero_columns(block, ft.lineage(block.columns, "close")["lag"]).select("id", "d", "close_lag1", "close_lag5", "volume_lag1", "volume_lag5")


@query("b11_categories", sql("select id, case upper(category) when 'MIDDLE EAST' then 'EMEA' when 'AFRICA' then 'EMEA' else coalesce(upper(category), 'UNKNOWN') end category from cat", "cat"))
def _(s, d):
    return ft.canonical(fx.categories(s, d).withColumn("category", F.concat("category", F.lit(" industry"))), "category", {"MIDDLE EAST": "EMEA", "AFRICA": "EMEA"}, [" INDUSTRY"]).select("id", "category")


@query("b17_quality_ratio", sql("select id, d, round(score / (unc + 1e-6), 5) ratio, row_number() over (partition by d order by score / (unc + 1e-6) desc nulls last, id) k from scores", "scores"))
def _(s, d):
    p = S(s, d).withColumn("ratio", F.col("score") / (F.col("unc") + 1e-6))
    return xs.unique_rank(p, "ratio", "k").select("id", "d", r("ratio", 5), F.col("k").cast("long").alias("k"))


# --- C: joins
LEVEL = "select cast(d as date) day_, avg(close) x from panel where day(d) <= 7 group by d"


@query("c04_market_as_of", sql(f"select p.id, p.d, round(m.x, 6) market from panel p asof left join (select cast(day_ + interval 1 month as date) av, x from ({LEVEL})) m on p.d >= m.av", "panel"))
def _(s, d):
    level = P(s, d).where(F.dayofmonth("d") <= 7).groupBy("d").agg(F.avg("close").alias("market")).select(F.add_months("d", 1).alias("av"), "market")
    return pit.market_as_of(P(s, d), level, "av", ["market"]).select("id", "d", r("market"))


@query("c12_size_measure", sql("select p.id, p.d, round(p.close * f.value, 4) size from panel p asof join (select id, period_end av, value from facts where type = 'qty' and value > 0) f on p.id = f.id and p.d >= f.av where p.close * f.value > 0", "panel", "facts"))
def _(s, d):
    shares = fx.facts(s, d).where("type = 'qty' and value > 0")
    out = pit.as_of(P(s, d), shares, "period_end", ["value"]).withColumn("size", F.col("close") * F.col("value"))
    return out.where("size > 0").select("id", "d", r("size", 4))


SEAM = """o as (select id, d, close * (1 + (id % 3)) as close from panel where d < date '1996-02-01'), n as (select id, d, close from panel where d >= date '1996-01-01'),
 f as (select id, arg_min(n.close / o.close, d) f from o join n using (id, d) where o.close > 0 group by id)"""


@query("c14_seam_splice", sql("", "panel").rstrip() + f", {SEAM} select o.id, o.d, round(o.close * f, 6) as close, 'old' as src from o join f using (id) where not exists (select 1 from n where n.id = o.id and n.d <= o.d) union all select id, d, round(close, 6), 'new' from n")
def _(s, d):
    old = P(s, d).where("d < '1996-02-01'").select("id", "d", (F.col("close") * (1 + F.col("id") % 3)).alias("close"))
    return pit.splice(old, P(s, d).where("d >= '1996-01-01'").select("id", "d", "close"), "close").select("id", "d", r("close"), "src")


@query("c16_event_in_gap", sql(f"select id, d from (select id, d, lag(d) {W} before from panel) p where exists (select 1 from (select id, d + 3 d from ex) e where e.id = p.id and e.d <= p.d and e.d > p.before)", "panel", "ex"))
def _(s, d):
    return pit.event_in_gap(P(s, d), fx.adjustments(s, d).withColumn("d", F.date_add("d", 3))).where("hit").select("id", "d")


@query("c18_realised_returns", sql("select h.id, h.d, round(x.fwd, 6) realised from (select id, d from (select id, d, row_number() over (partition by d order by score desc, id) k from scores) where k <= 10) h left join (select id, d, lead(close, 5) over (partition by id order by d) / close - 1 fwd from panel) x using (id, d)", "scores"))
def _(s, d):
    fwd = ts.forward_return(P(s, d), "close", 5, "fwd").select("id", "d", "fwd")
    return xs.top_n(S(s, d), "score", 10).select("id", "d").join(fwd, ["id", "d"], "left").select("id", "d", F.round("fwd", 6).alias("realised"))


@query("c19_attach_price", sql("select id, s.d, score, round(close, 9) as close from (select id, d, score from scores) s left join (select id, d, max(close) as close from panel group by id, d) p using (id, d)", "scores"))
def _(s, d):
    prices = P(s, d).unionByName(P(s, d)).groupBy("id", "d").agg(F.max("close").alias("close"))
    return S(s, d).select("id", "d", "score").join(prices, ["id", "d"], "left").select("id", "d", "score", r("close", 9))


# --- D: ratios and checks
WIDE = "select id, period_end, max(value) filter (type = 'rev') rev, max(value) filter (type = 'qty') qty, max(value) filter (type = 'tax') tax from facts group by 1, 2"


@query("d04_ratio_features", sql(f"select id, period_end, round((rev - tax) / nullif(rev, 0), 6) margin, case when abs((select median(tax / nullif(qty, 0)) from ({WIDE}))) <= 5000 then round(tax / nullif(qty, 0), 6) end gated, round(rev - tax, 4) flow from ({WIDE})", "facts"))
def _(s, d):
    w = fx.facts(s, d).groupBy("id", "period_end").pivot("type", ["rev", "qty", "tax"]).agg(F.max("value"))
    w = ft.gated_ratio(w, "tax", "qty", "gated", 5000)
    return w.select("id", "period_end", F.round(F.expr("(rev - tax) / nullif(rev, 0)"), 6).alias("margin"), r("gated"), F.round(F.expr("rev - tax"), 4).alias("flow"))


LEVELS = """select id, d, 100.0 * sum(q) filter (b <= 10) / sum(q) retail, greatest(0, least(100, 100.0 - 100.0 * sum(q) filter (b <= 10) / sum(q))) rest, 100.0 * coalesce(sum(q) filter (b > 40), 0) / sum(q) large
 from (select l_suppkey id, last_day(cast(date_trunc('quarter', l_shipdate) + interval 2 month as date)) d, l_quantity b, l_quantity q from lineitem) group by 1, 2"""


@query("d08_share_distribution", f"select id, d, round(retail, 6) retail, round(rest, 6) rest, round(large, 6) large, round(large - lag(large, 5) over (partition by id order by d), 6) change from ({LEVELS})")
def _(s, d):
    line = fx.read(s, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.last_day(F.add_months(F.date_trunc("quarter", "l_shipdate"), 2)).alias("d"), F.col("l_quantity").alias("q"))
    out = ft.share_distribution(line, "q", "q", 10, 40)
    return ts.difference(out, "large", 5, "change").select("id", "d", r("retail"), r("rest"), r("large"), r("change"))


@query("d09_payout_yield", sql("select p.id, p.d, round(case when f.pay is null or p.close is null or p.close = 0 then 0.0 when f.pay / p.close > 0.2 then 0.2 when f.pay / p.close < 0 then 0.0 else f.pay / p.close end, 6) yield from panel p asof left join (select id, d, sum(100 * (1 - adj_factor)) pay from ex group by id, d) f on p.id = f.id and p.d >= f.d", "panel", "ex"))
def _(s, d):
    pay = fx.adjustments(s, d).groupBy("id", "d").agg(F.sum(F.expr("100 * (1 - adj_factor)")).alias("pay"))
    out = pit.as_of(P(s, d), pay, "d", ["pay"])
    return ft.payout_yield(out, "pay", "close", "yield", 0.2).select("id", "d", r("yield"))


@query("d22_category_churn", "select a.o_orderpriority before, b.o_orderpriority as after, count(*) n from (select o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) o_orderpriority from orders group by 1) a join (select o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) o_orderpriority from orders group by 1) b using (o_custkey) group by 1, 2")
def _(s, d):
    at, o = F.struct("o_orderdate", "o_orderkey"), fx.read(s, d, "orders")
    snap = lambda f: o.groupBy("o_custkey").agg(f("o_orderpriority", at).alias("p"))
    return dq.churn(snap(F.min_by), snap(F.max_by), "o_custkey", "p")


@query("d23_identities", sql(f"select year(period_end)::bigint as year, round(avg((abs(rev - (rev - tax) - tax) <= 1)::int), 6) rolled, round(avg((abs(tax / nullif(rev, 0) - 0.04) <= 0.05)::int), 6) parted, count(*) n from ({WIDE}) group by 1", "facts"))
def _(s, d):
    w = fx.facts(s, d).groupBy("id", "period_end").pivot("type", ["rev", "qty", "tax"]).agg(F.max("value"))
    rules = {"rolled": F.expr("abs(rev - (rev - tax) - tax) <= 1"), "parted": F.expr("abs(tax / nullif(rev, 0) - 0.04) <= 0.05")}
    return dq.identity_checks(w, F.year("period_end").cast("long").alias("year"), rules).select("year", r("rolled"), r("parted"), "n")


@query("d28_extreme_changes", sql(f"""select year(d)::bigint as year, cause, count(*) n from (select p.id, p.d, case when e.d is not null then 'event' when p.d - before > 14 then 'gap' when low < 1000 then 'low base' else 'unexplained' end cause
 from (select id, d, close, lag(close) {W} low, lag(d) {W} before from panel) p left join ex e on e.id = p.id and e.d = p.d where abs(close / low - 1) >= 0.3) group by 1, 2""", "panel", "ex"))
def _(s, d):
    return dq.extreme_changes(P(s, d), "close", fx.adjustments(s, d), 0.3, 14, 1000).groupBy(F.year("d").cast("long").alias("year"), "cause").agg(F.count(F.lit(1)).alias("n"))


RULES = {"rows": "count(*) >= 100", "positive_close": "avg((close <= 0)::int) = 0", "range": "max(close) < 1e7 and min(close) > 0", "nulls": "avg((volume is null)::int) <= 0.01", "many_ids": "count(distinct id) >= 1000"}


@query("d34_expectations", sql("select * from (select " + ", ".join(f"({x}) as {n}" for n, x in RULES.items()) + " from panel) unpivot (passed for rule in (" + ", ".join(RULES) + "))", "panel"))
def _(s, d):
    spark = {n: x.replace("(close <= 0)::int", "cast(close <= 0 as int)").replace("(volume is null)::int", "cast(volume is null as int)") for n, x in RULES.items()}
    return dq.expectations(P(s, d), spark)


@query("d35_source_inventory", "select name, first_d, last_d, date '1998-08-01' - last_d lag_days, last_d >= date '1998-08-01' covers from (select 'lineitem' as name, min(cast(l_shipdate as date)) first_d, max(cast(l_shipdate as date)) last_d from lineitem union all select 'orders', min(cast(o_orderdate as date)), max(cast(o_orderdate as date)) from orders)")
def _(s, d):
    return dq.inventory({"lineitem": (fx.read(s, d, "lineitem"), "l_shipdate"), "orders": (fx.read(s, d, "orders"), "o_orderdate")}, "1998-08-01").withColumn("lag_days", F.col("lag_days").cast("long"))


# --- E: strategies and folds
RANKED = "k as (select *, row_number() over (partition by d order by score desc, id) k from scores where label is not null)"
STRATEGY = f"{RANKED}, m as (select k.*, idx from k join cal using (d)), t as (select m.d, avg(m.label) filter (m.k <= 10) ret, avg(m.label) mean, count(*) filter (m.k <= 10 and b.id is null) / count(*) filter (m.k <= 10)::double turnover from m left join (select id, idx + 1 idx from m where k <= 10) b on m.id = b.id and m.idx = b.idx group by m.d)"


@query("e18_top_n_strategy", sql("", "scores", "cal").rstrip() + f", {STRATEGY} select d, round(ret, 6) ret, round(mean, 6) mean, round(turnover, 6) turnover from t")
def _(s, d):
    return st.top_n_strategy(S(s, d), "score", "label", 10, cal(s, d)).select("d", r("ret"), r("mean"), r("turnover"))


@query("e19_weighted_return", sql("select d, round(sum(score * label) / sum(score), 6) ret from scores where score > 0 and label is not null group by d", "scores"))
def _(s, d):
    return st.weighted_return(S(s, d), "score", "label").select("d", r("ret"))


@query("e26_cost_sensitivity", sql("", "scores", "cal").rstrip() + f", {STRATEGY} select m multiplier, round(avg(ret - m * 0.003 * turnover) * 52, 6) annual from t, (values (0.0::double), (1.0), (2.0)) v(m) group by 1")
def _(s, d):
    return st.cost_sensitivity(st.top_n_strategy(S(s, d), "score", "label", 10, cal(s, d)), 0.003, [0, 1, 2], 52).select("multiplier", r("annual"))


@query("e27_naive_benchmarks", sql("select d, round(avg(label), 6) equal, round(avg(label) filter (k <= 10), 6) random from (select *, row_number() over (partition by d order by md5('7:' || id || ':' || d), id) k from scores where label is not null) group by d", "scores"))
def _(s, d):
    p = S(s, d).where("label is not null").withColumn("h", F.md5(F.concat_ws(":", F.lit("7"), "id", "d").cast("binary")))
    w = PANEL.day().orderBy("h", "id")
    return p.withColumn("k", F.row_number().over(w)).groupBy("d").agg(F.round(F.avg("label"), 6).alias("equal"), F.round(F.avg(F.when(F.col("k") <= 10, F.col("label"))), 6).alias("random"))


BIN = "greatest(1, ceil((row_number() over (partition by d order by {0}, id) - 1) * {1} / greatest(count(*) over (partition by d) - 1, 1)::double))::int"


@query("e15_decile_spread", sql("", "scores", "cal").rstrip() + f""", c as (select id, idx r0, {BIN.format('score', 10)} bin, count(*) over (partition by d) n from scores join cal using (d) where score is not null and (idx - 1) % 4 = 0),
 h as (select d, id, ret, ((idx - 2) // 4) * 4 + 1 r0 from rets join cal using (d) where ret is not null)
 select d, round(avg(ret) filter (bin = 10), 6) long, round(avg(ret) filter (bin = 1), 6) short, round(avg(ret) filter (bin = 10) - avg(ret) filter (bin = 1), 6) spread from h join c using (id, r0) where n >= 20 and bin in (1, 10) group by d""")
def _(s, d):
    return st.decile_spread(S(s, d), "score", rets(s, d), "ret", cal(s, d), 4, 10, 20).select("d", r("long"), r("short"), r("spread"))


@query("e17_cohort_backtest", sql("", "scores", "cal").rstrip() + """, b as (select id, idx r0 from (select id, idx, row_number() over (partition by d order by score desc, id) k from scores join cal using (d) where (idx - 1) % 5 = 0) where k <= 10),
 pi as (select id, idx, close from panel join cal using (d)), st as (select b.*, close p0 from b join pi on b.id = pi.id and b.r0 = pi.idx), hd as (select st.*, idx, d from st join (select *, ((idx - 2) // 5) * 5 + 1 r0 from cal) c using (r0)),
 v as (select r0, idx, d, coalesce(last_value(close ignore nulls) over (partition by id, r0 order by idx rows unbounded preceding), p0) / p0 v from hd left join pi using (id, idx)),
 dy as (select r0, idx, d, avg(v) as value from v group by all), ch as (select coalesce(x.r0, y.r0) r0, count(*) filter (y.id is null) / 10.0 turnover, count(*) filter (x.id is null) / 10.0 sold from b x full join (select id, r0 + 5 r0 from b) y on x.id = y.id and x.r0 = y.r0 group by 1)
 select d, round(value, 6) as value, round(turnover::double, 6) turnover, round(value / coalesce(before, 1) - 1 - case when before is null then turnover * 0.001 + sold * 0.004 else 0 end, 6) ret from (select *, lag(value) over (partition by r0 order by idx) before from dy) join ch using (r0)""")
def _(s, d):
    return st.cohort_backtest(S(s, d), "score", P(s, d), "close", cal(s, d), 5, 10, 0.001, 0.004).select("d", r("value"), r("turnover"), r("ret"))


@query("e21_risk_summary", sql("""select round(stddev_samp(ret) * sqrt(52.0), 6) volatility, round(median(v), 6) rolling_median, round(max(v), 6) rolling_max, max(run)::bigint longest, round(avg(under::int), 6) under_water, count(*) filter (dd < -0.15) deep_days,
 round(avg(ret) filter (half = 1), 8) first_half, round(avg(ret) filter (half = 2), 8) second_half from (select *, sum(under::int) over (partition by island) run from (select *, sum(case when under then 0 else 1 end) over (order by d) island from (
 select *, dd < -1e-12 under from (select d, ret, ntile(2) over (order by d) half, case when count(ret) over w >= 20 then stddev_samp(ret) over w * sqrt(52.0) end v, curve / greatest(1.0, max(curve) over (order by d)) - 1 dd from (
 select d, ret, exp(sum(ln(1 + ret)) over (order by d)) curve from bench) window w as (order by d rows between 19 preceding and current row)))))""", "bench"))
def _(s, d):
    out = st.risk_summary(bench(s, d), "ret", 52)
    return out.select(r("volatility"), r("rolling_median"), r("rolling_max"), "longest", r("under_water"), "deep_days", r("first_half", 8), r("second_half", 8))


@query("e24_tracking_error", sql("", "scores", "bench").rstrip() + f", {RANKED} select round(stddev_pop(a.x - b.ret) * sqrt(52.0), 5) tracking_error, round(avg(a.x - b.ret) * 52, 5) excess, count(*) n from (select d, avg(label) filter (k <= 10) x from k group by d) a join bench b using (d)")
def _(s, d):
    top = ev.top_return(S(s, d), "score", "label", 10).select("d", F.col("top").alias("ret"))
    return st.tracking_error(top, bench(s, d), "ret", 52).select(r("tracking_error", 5), r("excess", 5), "n")


IC = "select {1}, case when isfinite(c) then c end ic from (select {1}, corr(rs, rl) c, count(*) n from (select *, rank() over (partition by {1} order by {2}) + (count(*) over (partition by {1}, {2}) - 1) / 2.0 rs, rank() over (partition by {1} order by {3}) + (count(*) over (partition by {1}, {3}) - 1) / 2.0 rl from {0} where {2} is not null and {3} is not null) group by {1}) where n >= {4}"


@query("e11_ic_by_size", sql("", "scores").rstrip() + f", g as (select *, {BIN.format('volume', 3)} grp from scores) select grp as \"group\", round(avg(ic), 6) mean, count(ic) n from ({IC.format('g', 'd, grp', 'score', 'label', 5)}) group by 1")
def _(s, d):
    return st.grouped_ic(S(s, d), "score", "label", "volume", 3, 5).select("group", r("mean"), "n")


SMOOTH = f"select id, d, round(avg(score) {W_(3)}, 9) score from scores"


@query("e12_score_agreement", sql("", "scores").rstrip() + f""", t as ({SMOOTH}), j as (select s.id, s.d, s.score a, t.score b from scores s join t using (id, d)), o as (select d, count(*) / 10.0 overlap from (select id, d from (select *, row_number() over (partition by d order by score desc, id) k from scores) where k <= 10)
 join (select id, d from (select *, row_number() over (partition by d order by score desc, id) k from t) where k <= 10) using (id, d) group by d) select d, round(i.ic, 6) rho, coalesce(overlap, 0)::double overlap from ({IC.format('j', 'd', 'a', 'b', 10)}) i left join o using (d)""")
def _(s, d):
    smooth = ts.rolling(S(s, d), "score", "avg", 3, 1, "x").select("id", "d", F.round("x", 9).alias("score"))
    return st.score_agreement(S(s, d), smooth, "score", 10, 10).select("d", r("rho"), "overlap")


@query("e13_paired_difference", sql("", "ics").rstrip() + f""", t as (select s.id, s.d, s.label, t.score from scores s join ({SMOOTH}) t using (id, d)), g as (select d, round(a.ic - b.ic, 9) gap from ics a join ({IC.format('t', 'd', 'score', 'label', 10)}) b using (d) where a.ic - b.ic is not null)
 select round(any_value(m), 6) mean, count(*) n, round(any_value(m) / sqrt((sum(e*e) + 2*(2/3.0)*sum(e*l1) + 2*(1/3.0)*sum(e*l2)) / count(*) / count(*)), 4) t, round(avg((gap > 0)::int), 6) positive, round(avg(gap) filter (k > 5), 6) trimmed
 from (select *, lag(e, 1) over (order by d) l1, lag(e, 2) over (order by d) l2 from (select *, avg(gap) over () m, gap - avg(gap) over () e, row_number() over (order by abs(gap) desc, d) k from g))""")
def _(s, d):
    smooth = ts.rolling(S(s, d), "score", "avg", 3, 1, "x").withColumn("score", F.round("x", 9))
    return st.paired_difference(ics(s, d), ev.rank_ic(smooth, "score", "label", 10), "ic", 2, 5).select(r("mean"), "n", r("t", 4), r("positive"), r("trimmed"))


FOLDS = "folds as (select fold, fold * 26 + 1 train_from, fold * 26 + 104 - 5 - 2 train_to, fold * 26 + 105 test_from, fold * 26 + 130 test_to, 7 dropped from (select unnest(range(0, ((select max(idx) from cal) - 130) // 26 + 1))::int fold) where (select max(idx) from cal) >= 130)"


@query("e33_purged_folds", sql("", "cal").rstrip() + f", {FOLDS} select * from folds")
def _(s, d):
    return st.purged_folds(cal(s, d), 104, 26, 26, 5, 2)


@query("e33_leaking_folds", sql("", "cal").rstrip() + f", {FOLDS} select fold, test_from from (select fold, train_to + 7 train_to, test_from from folds) where train_to + 5 >= test_from union all select fold, test_from from folds where train_to + 5 >= test_from")
def _(s, d):
    folds = st.purged_folds(cal(s, d), 104, 26, 26, 5, 2)
    careless = st.purged_folds(cal(s, d), 104, 26, 26, 0, 0)
    return st.leaks(careless, 5).unionByName(st.leaks(folds, 5)).select("fold", "test_from")


@query("e34_fold_summary", sql("", "ics", "cal").rstrip() + f", {FOLDS} select fold, round(avg(ic), 6) mean, round(avg(ic) / stddev_samp(ic), 6) icir, count(ic) n, coalesce(avg(ic) > 0.05 and avg(ic) / stddev_samp(ic) > 0.5, false) passed from ics join cal using (d) join folds on idx between test_from and test_to group by fold")
def _(s, d):
    return st.fold_summary(ics(s, d), st.purged_folds(cal(s, d), 104, 26, 26, 5, 2), cal(s, d)).select("fold", r("mean"), r("icir"), "n", "passed")


@query("e28_factor_ics", sql("", "scores").rstrip() + f", f as (select d, label, name, v from (select d, label, score, -unc unc_, close * 1.0 close_ from scores) unpivot (v for name in (score, unc_, close_))) select name, round(avg(ic), 6) mean, round(avg(ic) / stddev_samp(ic), 5) icir, count(ic) n from ({IC.format('f', 'd, name', 'v', 'label', 10)}) group by name")
def _(s, d):
    p = S(s, d).select("id", "d", "label", "score", (-F.col("unc")).alias("unc_"), F.col("close").alias("close_"))
    long = p.unpivot(["id", "d", "label"], ["score", "unc_", "close_"], "name", "v")
    daily = ev.rank_ic(long, "v", "label", 10, "ic", ("name",))
    return daily.groupBy("name").agg(F.round(F.avg("ic"), 6).alias("mean"), F.round(F.avg("ic") / F.stddev_samp("ic"), 5).alias("icir"), F.count("ic").alias("n"))


# --- F, G, H: features, masks and weights
@query("f15_rolling_block", sql(f"select id, d, round((m - avg(m) over (partition by d)) / (stddev_samp(m) over (partition by d) + 1e-9), 4) z20, round(v, 6) sd20 from (select id, d, case when count(close) {W_(20)} >= 10 then avg(close) {W_(20)} end m, case when count(close) {W_(20)} >= 10 then stddev_samp(close) {W_(20)} end v from panel)", "panel"))
def _(s, d):
    p = ts.rolling(ts.rolling(P(s, d), "close", "avg", 20, 10, "m"), "close", "stddev_samp", 20, 10, "v")
    return xs.zscore(p, "m", "z").select("id", "d", F.round("z", 4).alias("z20"), F.round("v", 6).alias("sd20"))


TIERS = "case when best >= 0.1 then 0.06 when best >= 0.06 then 0.02 when best >= 0.02 then -0.02 else -0.05 end"


@query("f19_trailing_stop", sql(f"select id, d, round(best, 6) best, {TIERS} stop from (select id, d, max(close / first - 1) {W} best from (select id, d, close, first_value(close) over (partition by id order by d) first from panel))", "panel"))
def _(s, d):
    return ft.trailing_stop(P(s, d), "close", [(0.1, 0.06), (0.06, 0.02), (0.02, -0.02)], -0.05, "best", "stop").select("id", "d", r("best"), "stop")


@query("f22_alignment_score", sql(f"select id, d, (close > a)::int + (a > b)::int + (b > c)::int aligned from (select id, d, close, avg(close) {W_(20)} a, avg(close) {W_(60)} b, avg(close) {W_(120)} c, row_number() {W} k from panel) where k >= 120", "panel"))
def _(s, d):
    return ft.alignment(P(s, d), "close", [20, 60, 120], "aligned").where("aligned is not null").select("id", "d", "aligned")


@query("g11_quantile_mask", sql("select s.id, s.d from scores s join (select d, quantile_cont(score, 2/3.0) q from scores group by d) q on s.d = q.d where s.score >= q.q", "scores"))
def _(s, d):
    return xs.above_quantile(S(s, d), "score", 2 / 3).select("id", "d")


@query("g12_residual_returns", sql("select id, d, round(res, 9) res from (select id, d, res, count(*) over (partition by id) n from (select id, d, ret - avg(ret) over (partition by d) res from rets where abs(ret) < 0.5)) where n >= 30", "rets"))
def _(s, d):
    return ft.residual_returns(rets(s, d), "ret", 0.5, 30, "res").select("id", "d", r("res", 9))


@query("g13_limit_flags", sql("select id, d, ret >= t as up, ret <= -t as down from (select id, d, ret, case when d < date '1995-06-01' then 0.07 else 0.1 end - 0.005 t from rets where ret is not null)", "rets"))
def _(s, d):
    limit = F.when(F.col("d") < F.lit("1995-06-01").cast("date"), 0.07).otherwise(0.1) - 0.005
    return rets(s, d).where("ret is not null").select("id", "d", (F.col("ret") >= limit).alias("up"), (F.col("ret") <= -limit).alias("down"))


@query("g14_capped_weights", sql("", "scores").rstrip() + ", b as (select id, d, 1 / coalesce(nullif(unc, 0), median(nullif(unc, 0)) over (partition by d)) x, 3.0::double / count(*) over (partition by d) cap from scores where d in (select d from scores where unc > 0 group by d)), w0 as (select *, x / sum(x) over (partition by d) w from b)" + "".join(
    f", w{k + 1} as (select id, d, cap, case when w < cap then w + coalesce(o * w / nullif(m, 0), 0) else cap end w from (select *, sum(greatest(w - cap, 0)) over (partition by d) o, sum(case when w < cap then w else 0 end) over (partition by d) m from w{k}))" for k in range(5)) + " select id, d, round(w, 8) w from w5")
def _(s, d):
    p = S(s, d).withColumn("u", F.nullif("unc", F.lit(0.0))).withColumn("m", F.median("u").over(PANEL.day())).where("m is not null")
    p = p.withColumn("x", 1 / F.coalesce("u", "m")).withColumn("cap", 3.0 / F.count(F.lit(1)).over(PANEL.day()))
    return st.capped_weights(p, "x", "cap", "w").select("id", "d", r("w", 8))


@query("g15_concentration", sql("select d, round(max(s), 6) largest, round(sum(s) filter (k <= 3), 6) top from (select *, row_number() over (partition by d order by s desc, category) k from (select d, category, sum(w) s from (select id, d, greatest(score, 0) / nullif(sum(greatest(score, 0)) over (partition by d), 0) w from scores) join cat using (id) group by 1, 2)) where s is not null group by d", "scores", "cat"))
def _(s, d):
    p = xs.proportional_weights(S(s, d), "score", "w").withColumn("t", F.sum("w").over(PANEL.day())).where("t > 0")
    return st.concentration(p.join(fx.categories(s, d).select("id", "category"), "id"), "w", "category").select("d", r("largest"), r("top"))


@query("h06_clipped_list", sql("select id, d, round(c / sum(c) over (partition by d), 8) w from (select id, d, least(w, 0.1) c, k from (select id, d, greatest(score, 0) / nullif(sum(greatest(score, 0)) over (partition by d), 0) w, row_number() over (partition by d order by score desc, id) k from scores)) where k <= 15 and c is not null and d in (select d from scores group by d having sum(greatest(score, 0)) > 0)", "scores"))
def _(s, d):
    p = xs.proportional_weights(S(s, d), "score", "p").withColumn("t", F.sum("p").over(PANEL.day())).where("t > 0")
    return st.clipped_list(p, "score", "p", 15, 0.1, "w").select("id", "d", r("w", 8))


# --- K, M: graphs and models
@query("k04_rolling_correlation_edges", sql("", "rets").rstrip() + """, w as (select id, d, ln(1 + ret) x from rets where ret > -1 and d in (select distinct d from rets where ret is not null order by d desc limit 60)),
 e as (select a.id src, b.id dst, round(corr(a.x, b.x), 7) weight from w a join w b on a.d = b.d and a.id <> b.id group by 1, 2 having count(*) >= 30 and isfinite(corr(a.x, b.x)) and round(corr(a.x, b.x), 7) > 0.15)
 select src, dst, round(weight, 6) weight from (select *, row_number() over (partition by src order by weight desc, dst) k from e) where k <= 15""")
def _(s, d):
    logs = rets(s, d).where("ret > -1").withColumn("x", F.log1p("ret"))
    edges = gr.rolling_correlation_edges(logs, "x", 60, 0.15, 15, 30)
    return edges.select("src", "dst", (F.round(F.col("weight") * 1e6) / 1e6).alias("weight"))  # of 7 digits: a half would go up by its text


@query("k03_url_links", """with l as (select page_id src, lower(unnest(list_distinct(regexp_extract_all(coalesce(html, ''), 'href="([^"]+)"', 1)))) dst from pages) select count(*) n, count(distinct src) sources, count(distinct dst) targets from (select src, dst from (select *, row_number() over (partition by src order by dst) k from (select distinct src, dst from l)) where k <= 20)""")
def _(s, d):
    links = gr.extracted_links(fx.read(s, d, "pages"), "page_id", "html", 'href="([^"]+)"', 20)
    return links.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query("k06_merged_edges", sql("""select src, dst, round(weight, 6) weight from (select *, row_number() over (partition by src order by weight desc, dst) k from (select src, dst, max(weight) weight from (
 select a.id src, b.id dst, 1.0::double weight from cat a join cat b on a.category = b.category and a.id <> b.id and abs(a.id - b.id) <= 10 union all
 select a.id, b.id, 1 / (1.0::double + abs(a.size_v - b.size_v)) from cat a join cat b on abs(a.id - b.id) <= 3 and a.id <> b.id) group by 1, 2)) where k <= 5""", "cat"))
def _(s, d):
    c = fx.categories(s, d)
    near = lambda n: c.withColumn("o", F.explode(F.sequence(F.col("id") - n, F.col("id") + n))).where("o <> id").join(c.select(F.col("id").alias("o"), F.col("category").alias("c2"), F.col("size_v").alias("s2")), "o")
    one = near(10).where("category = c2").select(F.col("id").alias("src"), F.col("o").alias("dst"), F.lit(1.0).alias("weight"))
    two = near(3).select(F.col("id").alias("src"), F.col("o").alias("dst"), (1 / (1.0 + F.abs(F.col("size_v") - F.col("s2")))).cast("double").alias("weight"))
    return gr.merge_edges([one, two], 5).select("src", "dst", r("weight"))


@query("m01_gram", sql("""select y, i, j, round(v, 5) as value from (select year(d)::bigint y, count(*)::double a, sum(score) b, sum(unc) c, sum(label) e, sum(score * score) f, sum(score * unc) g, sum(score * label) h, sum(unc * unc) k, sum(unc * label) l, sum(label * label) m
 from scores where score is not null and unc is not null and label is not null group by 1), lateral (values ('1', '1', a), ('1', 'score', b), ('1', 'unc', c), ('1', 'label', e), ('score', 'score', f), ('score', 'unc', g), ('score', 'label', h), ('unc', 'unc', k), ('unc', 'label', l), ('label', 'label', m)) t(i, j, v)""", "scores"))
def _(s, d):
    p = S(s, d).withColumn("y", F.year("d").cast("long"))
    return rg.gram(p, ["score", "unc"], "label", ["y"]).select("y", "i", "j", r("value", 5))


RIDGE1 = """a as (select y, sum(n) over w n, sum(sx) over w sx, sum(sy) over w sy, sum(xx) over w xx, sum(xy) over w xy from (select year(d)::bigint y, count(*)::double n, sum(score) sx, sum(label) sy, sum(score * score) xx, sum(score * label) xy from scores where score is not null and label is not null group by 1) window w as (order by y rows between unbounded preceding and 2 preceding)),
 b as (select y, sx / n mx, sy / n my, (xy / n - sx / n * sy / n) / ((xx / n - sx / n * sx / n) * (1 + 1.0 / n)) beta from a where n > 1)"""


@query("m03_walk_forward_ridge", sql("", "scores").rstrip() + f", {RIDGE1} select id, d, round(my + beta * (score - mx), 6) pred from scores join b on b.y = year(d)")
def _(s, d):
    p = S(s, d).withColumn("y", F.year("d").cast("long"))
    return st.walk_forward_ridge(p, ["score"], "label", "y", 1.0, "pred").select("id", "d", r("pred"))


@query("m01_wide_gram", None)
def _(s, d):
    """300 features: the last 60 rows of open, high, low, close and volume, over the row's own close."""
    p = ft.sequences(P(s, d), ["open", "high", "low", "close", "volume"], 60, 60, "seq").withColumn("x", F.transform(F.flatten("seq"), lambda v: v / F.col("close")))
    p = ts.forward_return(p, "close", 5, "label")
    return rg.gram(p, [f"f{k:03d}" for k in range(300)], "label", [], "x")


LASSO = """t as (select count(*)::double n, avg(score) mx, avg(unc) mz, avg(label) my, stddev_pop(score) sx, stddev_pop(unc) sz, corr(score, unc) r, covar_pop(score, label) / stddev_pop(score) gx, covar_pop(unc, label) / stddev_pop(unc) gz from scores where d < date '1996-01-01' and score is not null and unc is not null and label is not null),
 c as (select al, t.*, i, j, case when i <> 0 and j <> 0 then ((gx - al * i) - r * (gz - al * j)) / (1 - r * r) when i <> 0 then gx - al * i else 0 end wx, case when i <> 0 and j <> 0 then ((gz - al * j) - r * (gx - al * i)) / (1 - r * r) when j <> 0 then gz - al * j else 0 end wz from t, (values (0.02::double), (0.005), (0.001)) v(al), (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(j)),
 b as (select al, wx / sx bx, wz / sz bz, my - wx / sx * mx - wz / sz * mz b0, (i <> 0)::int + (j <> 0)::int nonzero from c where sign(wx) = i and sign(wz) = j and (i <> 0 or abs(gx - r * wz) <= al) and (j <> 0 or abs(gz - r * wx) <= al))"""


@query("m04_lasso_path", sql("", "scores").rstrip() + f", {LASSO} select al alpha, round(bx, 7) score, round(bz, 7) unc, round(b0, 7) intercept, nonzero from b")
def _(s, d):
    train = S(s, d).where("d < '1996-01-01'")
    cells = [(x.i, x.j, x.value) for x in rg.gram(train, ["score", "unc"], "label", []).collect()]  # features squared
    path = rg.lasso_path(cells, ["score", "unc"], "label", [0.02, 0.005, 0.001])
    rows = [(a, round(w["score"], 7), round(w["unc"], 7), round(c, 7), sum(v != 0 for v in w.values())) for a, w, c in path]
    return s.createDataFrame(rows, "alpha double, score double, unc double, intercept double, nonzero int")


@query("m04_lasso_scores", None)
def _(s, d):
    """Scored by the lasso of 14 lags, means and momenta whose penalty does best on the validation year."""
    p = ts.forward_return(P(s, d).where("id is not null and d is not null"), "close", 5, "label").withColumn("label", F.round("label", 9))
    p = files.written(ft.flat_matrix(p, ["close", "volume"], lags=[1, 2], means=[5, 20], momenta=[5, 20], keep=("label",)))  # read by four passes
    features = [c for c in p.columns if c not in ("id", "d", "label")]
    fit, valid = p.where("d < '1996-01-01'"), p.where("d >= '1996-01-01' and d < '1997-01-01'")
    weights, c, _ = rg.lasso(fit, valid, features, "label", [0.03, 0.01, 0.003, 0.001, 0.0003], 10)
    return st.linear_score(p.where("d >= '1997-01-01'"), weights, c, "pred").select("id", "d", r("pred"))


@query("m04_boosted_trees", None)
def _(s, d):
    """Scored by boosted trees of score and uncertainty, stopped early on the validation year."""
    p = S(s, d).withColumn("label", F.round("label", 9))
    return rg.boosted_trees(p, ["score", "unc", "volume"], "label", F.col("d") >= F.lit("1996-01-01").cast("date"), "pred", rounds=10, depth=3).select("id", "d", r("pred"))


@query("m05_linear_score", sql("select id, d, round(0.5 + 2 * coalesce(score, 0) - 3 * coalesce(unc, 0), 6) pred from scores", "scores"))
def _(s, d):
    return st.linear_score(S(s, d), {"score": 2.0, "unc": -3.0}, 0.5, "pred").select("id", "d", r("pred"))


@query("m06_sequence_windows", sql(f"select id, d, n, round(list_sum(seq), 4) total, padded from (select id, d, n, list(close) {W_(20)} seq, 20 - least(n, 20) padded from (select *, row_number() {W} n from panel)) where n >= 16", "panel"))
def _(s, d):
    p = P(s, d).select("id", "d", "close")
    out = ft.sliced(ft.sequence_index(p, 20, 16), ft.sequence_store(p, ["close"], 20), 1, 20, "seq")
    total = F.aggregate("seq", F.lit(0.0), lambda a, x: a + x[0])
    return out.select("id", "d", F.col("rows").cast("long").alias("n"), F.round(total, 4).alias("total"), F.size(F.filter("mask", lambda m: m == 0)).cast("long").alias("padded"))


@query("m06_sequence_targets", sql(f"select id, d, n, round(z, 6) z from (select id, d, row_number() {W} n, (label - avg(label) over (partition by d)) / nullif(stddev_samp(label) over (partition by d), 0) z from scores) where n >= 16", "scores"))
def _(s, d):
    out = ft.sequence_index(S(s, d).withColumn("label", F.round("label", 9)), 20, 16, "label")
    return out.select("id", "d", F.col("rows").cast("long").alias("n"), F.round("label", 6).alias("z"))


@query("m07_flat_matrix", sql(f"select id, d, coalesce(round(close, 6), 0) as close, coalesce(round(lag(close, 1) {W}, 6), 0) close_lag1, coalesce(round(case when count(close) {W_(5)} >= 5 then avg(close) {W_(5)} end, 6), 0) close_rmean5, coalesce(round(close / lag(close, 5) {W} - 1, 6), 0) close_mom5 from panel", "panel"))
def _(s, d):
    out = ft.flat_matrix(P(s, d), ["close"], lags=[1], means=[5], momenta=[5])
    return out.select("id", "d", *[r(c) for c in ("close", "close_lag1", "close_rmean5", "close_mom5")])


# --- N: streams, each run to the end of its input; events come in three batches by time, a twentieth of them with the last one
def batches(s, d):
    """A stream of three files, one a batch: up to the 10th, up to the 20th, and the rest with those that come late."""
    root, rows = files.scratch(s), fx.read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    part = F.when((F.col("event_id") % 20 == 0) | (F.dayofmonth("ts") > 20), 2).when(F.dayofmonth("ts") > 10, 1).otherwise(0)
    for k in range(3):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(root)
    return sv.events(s, root, 1)


LATE = "e as (select *, event_id % 20 = 0 or day(ts) > 20 as last_file from events), m as (select max(ts) filter (not last_file) seen, max(ts) filter (not last_file and day(ts) <= 10) first_seen, max(ts) newest from e)"


@query("n01_stream_upsert", "select user_id, cast(ts as date) d, arg_max(event_type, (ts, event_id)) event_type from events group by 1, 2")
def _(s, d):
    daily = batches(s, d).select("user_id", F.to_date("ts").alias("d"), "event_type", F.struct("ts", "event_id").alias("seq"))
    path = files.scratch(s)
    tb.upsert_stream(daily, path, ["user_id", "d"], "d", "seq")
    return tb.current(s, path, daily.schema, "d").select("user_id", "d", "event_type")


@query("n02_stream_windows", f"""with {LATE} select event_type, cast(extract(epoch from w) as bigint) start_s, count(*) n from (select event_type, date_trunc('day', ts) w, newest from e, m
 where not (last_file and date_trunc('day', ts) + interval 1 day <= first_seen - interval 3 day)) where w + interval 1 day <= newest - interval 3 day group by 1, 2""")
def _(s, d):
    rows = sv.windowed(batches(s, d), "ts", ["event_type"], "1 day", "1 day", "3 days")
    return sv.appended(rows).select("event_type", F.unix_timestamp("start").alias("start_s"), "n")


@query("n03_stream_streaks", f"""with {LATE}, k as (select e.* from e, m where not (last_file and ts <= seen - interval 3 day) and ts <= newest - interval 3 day)
 select user_id, last_type as "last", count(*) streak from (select user_id, last_type, sum(case when event_type = last_type then 0 else 1 end) over (partition by user_id order by ts desc, event_id desc) breaks
 from (select *, first_value(event_type) over (partition by user_id order by ts desc, event_id desc) last_type from k)) where breaks = 0 group by 1, 2""")
def _(s, d):
    return sv.latest(sv.streaks(batches(s, d), "user_id", "event_type", "ts", "event_id", "3 days"), ["user_id"]).select("user_id", "last", "streak")


@query("n04_once_per_key", "select count(*) n, count(distinct event_id) ids from (select distinct event_id from events)")
def _(s, d):
    twice = sv.events(s, f"{d}/events.parquet").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return sv.appended(sv.once(twice, ["event_id"], "ts", "60 days")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("n05_stream_freshness", "select event_type as source, cast(floor(extract(epoch from max(ts))) as bigint) last_s from events group by 1")
def _(s, d):
    return sv.complete(sv.freshness(sv.events(s, f"{d}/events.parquet"), "event_type", "ts")).select("source", F.unix_timestamp("last").alias("last_s"))
