"""Registered queries, one per operator of the inventory, each with its SQL. Keys begin with the operator's id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import crosssection as xs
from ..operators import evaluate as ev
from ..operators import features as ft
from ..operators import graph as gr
from ..operators import pit
from ..operators import quality as dq
from ..operators import timeseries as ts
from ..sources import fixtures as fx
from ..spec import PANEL

QUERIES = {}
ORACLES = {}

PRICE, PICK = "l_extendedprice/l_quantity", "(l_shipdate,l_orderkey,l_linenumber,l_extendedprice,l_quantity)"
CTE = {
    "panel": f"""select l_suppkey id, cast(date_trunc('week', l_shipdate) as date) d, arg_min({PRICE}, {PICK}) as open, max({PRICE}) high,
        min({PRICE}) low, arg_max({PRICE}, {PICK}) as close, sum(l_quantity) volume from lineitem group by 1, 2""",
    "facts": """select id, period_end, type, value from (select l_suppkey id, last_day(cast(date_trunc('quarter', l_shipdate) + interval 2 month as date)) period_end,
        sum(l_extendedprice*(1-l_discount)) rev, sum(l_quantity) qty, sum(l_extendedprice*l_tax) tax from lineitem group by 1, 2) unpivot (value for type in (rev, qty, tax))""",
    "cat": """select s_suppkey id, r_name category, s_acctbal size_v from supplier join nation on s_nationkey=n_nationkey join region on n_regionkey=r_regionkey""",
    "ex": """select l_suppkey id, cast(date_trunc('week', l_shipdate) as date) d, min(1-l_discount) adj_factor from lineitem where l_returnflag='R' and l_discount >= 0.08 group by 1, 2""",
    "spans": """select user_id id, event_type status, min(cast(ts as date)) start_d, max(cast(ts as date)) end_d from events group by user_id, event_type, date_trunc('week', ts)""",
    "cal": "select d, row_number() over (order by d) idx from (select distinct d from panel)",
    "rets": "select *, close / lag(close, 1) over (partition by id order by d) - 1 ret from panel",
    "scores": """select * from (select id, d, close, volume, round(-(close/lag(close,5) over w - 1),9) score, case when count(ret) over w20 >= 10 then round(stddev_samp(ret) over w20,9) end unc,
        round(lead(close,5) over w/close - 1,9) label from rets window w as (partition by id order by d), w20 as (partition by id order by d rows between 19 preceding and current row)) where score is not null""",
    "ics": """select d, case when isfinite(c) then c end ic, n from (select d, corr(rs, rl) c, count(*) n from (select d,
        rank() over (partition by d order by score) + (count(*) over (partition by d, score) - 1) / 2.0 rs,
        rank() over (partition by d order by label) + (count(*) over (partition by d, label) - 1) / 2.0 rl from scores where score is not null and label is not null) group by d) where n >= 10""",
    "bench": "select d, avg(ret) ret from rets where ret is not null group by d",
}
NEEDS = {"cal": ["panel"], "rets": ["panel"], "scores": ["rets"], "ics": ["scores"], "bench": ["rets"]}


def sql(body: str, *views: str) -> str:
    """The query with its fixture views in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for v in views:
        add(v)
    return "with " + ", ".join(f"{v} as ({CTE[v]})" for v in order) + " " + body


def query(name: str, oracle: str | None):
    def register(f):
        f.__name__ = f.__qualname__ = name
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


def r(col: str, digits: int = 6):
    """Rounded, so that engines that sum in another order agree."""
    return F.round(col, digits).alias(col)


P, S = fx.panel, fx.scores
W = "over (partition by id order by d)"


def W_(n: int) -> str:  # noqa: N802
    return f"over (partition by id order by d rows between {n - 1} preceding and current row)"


def rets(s: SparkSession, d: str) -> DataFrame:
    return ts.pct_change(P(s, d), "close", 1, "ret")


def ics(s: SparkSession, d: str) -> DataFrame:
    return ev.rank_ic(S(s, d), "score", "label", 10)


def bench(s: SparkSession, d: str) -> DataFrame:
    return rets(s, d).where("ret is not null").groupBy("d").agg(F.avg("ret").alias("ret"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Daily rank IC of the reversal factor, winsorised, neutralised by category and scaled, against the forward return."""
    p = ts.forward_return(ts.pct_change(P(s, d), "close", 5, "mom"), "close", 5, "label")
    p = p.withColumn("factor", F.round(-F.col("mom"), 9)).where("factor is not null")
    p = xs.winsorise(p, "factor", 0.01, 0.99, "w").join(fx.categories(s, d).select("id", "category"), "id")
    p = xs.zscore(xs.neutralise(p, "w", "category", "nw"), "nw", "z").withColumn("z", F.round("z", 9)).withColumn("label", F.round("label", 9))
    return ev.rank_ic(p, "z", "label", 10).select("d", r("ic"), "n")


FACTOR = """f as (select * from (select id, d, close, round(-(close/lag(close,5) over (partition by id order by d)-1),9) factor, round(lead(close,5) over (partition by id order by d)/close-1,9) label from panel) where factor is not null),
 q as (select d, quantile_cont(factor, 0.01) a, quantile_cont(factor, 0.99) b from f group by d), w as (select f.*, category, greatest(least(factor, b), a) w from f join q using (d) join cat using (id)),
 nw as (select *, w - avg(w) over (partition by d, category) nw from w), z as (select *, round((nw - avg(nw) over (partition by d)) / (stddev_samp(nw) over (partition by d) + 1e-9), 9) z from nw)"""
query("m09_flagship_feature_ic", sql("", "panel", "cat").rstrip() + ", " + FACTOR + """ select d, round(corr(a, b), 6) ic, count(*) n from (select d,
 rank() over (partition by d order by z) + (count(*) over (partition by d, z) - 1) / 2.0 a, rank() over (partition by d order by label) + (count(*) over (partition by d, label) - 1) / 2.0 b
 from z where z is not null and label is not null) group by d having count(*) >= 10""")(flagship)


# --- A: sources and sinks
@query("a01_panel", sql("select id, d, round(open,9) as open, round(high,9) high, round(low,9) low, round(close,9) as close, volume from panel", "panel"))
def _(s, d):
    return P(s, d).select("id", "d", r("open", 9), r("high", 9), r("low", 9), r("close", 9), "volume")


@query("a02_filtered_scan", "select l_suppkey id, l_orderkey, l_quantity from lineitem where l_suppkey in (1, 2, 3) and l_shipdate >= timestamp '1996-01-01'")
def _(s, d):
    return fx.read(s, d, "lineitem").where("l_suppkey in (1, 2, 3) and l_shipdate >= timestamp '1996-01-01'").select(F.col("l_suppkey").alias("id"), "l_orderkey", "l_quantity")


@query("a03_last_dates", "select 'lineitem' as name, max(cast(l_shipdate as date)) last_d from lineitem union all select 'orders', max(cast(o_orderdate as date)) from orders")
def _(s, d):
    one = lambda t, c: fx.read(s, d, t).agg(F.max(F.to_date(c)).alias("last_d")).select(F.lit(t).alias("name"), "last_d")
    return one("lineitem", "l_shipdate").unionByName(one("orders", "o_orderdate"))


@query("a04_latest_snapshot", "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc nulls last, o_orderkey desc) r from orders) where r = 1")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc())
    return fx.read(s, d, "orders").withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


@query("a09_upsert", sql("""select id, d, round(coalesce(n.close, p.close), 9) as close from panel p full join (select id, d, close * 2 as close from panel where id % 7 = 0 and d >= date '1996-01-01') n using (id, d)""", "panel"))
def _(s, d):
    old = P(s, d).select("id", "d", "close")
    new = old.where("id % 7 = 0 and d >= date '1996-01-01'").withColumn("close", F.col("close") * 2)
    return pit.upsert(old, new, ["id", "d"]).select("id", "d", r("close", 9))


@query("a09_upsert_shrink", sql("""select id, d, round(close, 9) as close from panel where d not in (select d from panel where id % 7 = 0 and d >= date '1996-01-01') union all select id, d, round(close * 2, 9) from panel where id % 7 = 0 and d >= date '1996-01-01'""", "panel"))
def _(s, d):
    old = P(s, d).select("id", "d", "close")
    new = old.where("id % 7 = 0 and d >= date '1996-01-01'").withColumn("close", F.col("close") * 2)
    return pit.upsert(old, new, ["id", "d"], allow_shrink=True).select("id", "d", r("close", 9))


@query("a12_wide_to_long", sql("select id, period_end, type, round(value, 4) as value from facts", "facts"))
def _(s, d):
    return fx.facts(s, d).select("id", "period_end", "type", r("value", 4))


@query("a13_text_numbers", "select doc_id, try_cast(regexp_replace(regexp_extract(text, '[0-9][0-9,]*', 0), ',', '', 'g') as bigint) as num from documents")
def _(s, d):
    digits = F.regexp_replace(F.regexp_extract("text", "[0-9][0-9,]*", 0), ",", "")
    return fx.read(s, d, "documents").select("doc_id", digits.try_cast("bigint").alias("num"))


# --- B: filters and labels
@query("b01_tradable_universe", sql("select id, d from panel where regexp_matches(cast(id as varchar), '^[1-9][0-9]*$') and not regexp_matches(cast(id as varchar), '^9') and id not in (select id from cat where category = 'ASIA')", "panel", "cat"))
def _(s, d):
    p = P(s, d).where(F.col("id").cast("string").rlike("^[1-9][0-9]*$") & ~F.col("id").cast("string").rlike("^9"))
    return p.join(fx.categories(s, d).where("category = 'ASIA'").select("id"), "id", "left_anti").select("id", "d")


@query("b03_enough_values", sql("select id, d from scores where (score is not null)::int + (unc is not null)::int + (label is not null)::int >= 2", "scores"))
def _(s, d):
    return S(s, d).na.drop(thresh=2, subset=["score", "unc", "label"]).select("id", "d")


@query("b04_eligible_history", sql(f"select id, d from (select id, d, row_number() {W} r from panel) where r >= 202", "panel"))
def _(s, d):
    return P(s, d).withColumn("r", F.row_number().over(PANEL.series())).where("r >= 202").select("id", "d")


@query("b05_default_fill", sql("select id, d, coalesce(unc, 0.5) unc, coalesce(label, 0) as label from scores", "scores"))
def _(s, d):
    return S(s, d).select("id", "d", "unc", "label").na.fill({"unc": 0.5, "label": 0.0})


@query("b06_availability_flag", sql("select id, d, case when count(unc) over (partition by id order by d rows unbounded preceding) > 0 then 1.0::double else 0.0::double end flag from scores", "scores"))
def _(s, d):
    return ts.forward_fill(S(s, d), "unc", "f").select("id", "d", F.col("f").isNotNull().cast("double").alias("flag"))


@query("b07_liquidity_gate", sql("select id, d, case when close * volume >= 50000 then score else -999 end gated from scores", "scores"))
def _(s, d):
    return S(s, d).select("id", "d", F.when(F.col("close") * F.col("volume") >= 50000, F.col("score")).otherwise(F.lit(-999.0)).alias("gated"))


@query("b08_net_score", sql("""select id, d, round(score - case when volume >= 100 then 0.001 when volume >= 40 then 0.003 else 0.01 end, 9) net,
 case when unc is not null then round(greatest(-10, least(10, score / (unc + 1e-6))), 5) end quality, round(score / (unc + 1e-6), 5) raw from scores""", "scores"))
def _(s, d):
    cost = F.when(F.col("volume") >= 100, 0.001).when(F.col("volume") >= 40, 0.003).otherwise(0.01)
    raw = F.col("score") / (F.col("unc") + 1e-6)
    clipped = F.when(raw.isNotNull(), F.greatest(F.lit(-10.0), F.least(F.lit(10.0), raw)))
    return S(s, d).select("id", "d", F.round(F.col("score") - cost, 9).alias("net"), F.round(clipped, 5).alias("quality"), F.round(raw, 5).alias("raw"))


@query("b09_day_stride", sql("select id, d from panel join cal using (d) where (idx - 1) % 4 = 0", "cal"))
def _(s, d):
    p = P(s, d)
    return p.join(F.broadcast(pit.calendar(p)), "d").where("(idx - 1) % 4 = 0").select("id", "d")


@query("b12_signal_label", sql("select id, d, case when score > 0.5 then 'BUY' when score < -0.5 then 'SELL' else 'HOLD' end signal, row_number() over (partition by d order by score desc, id) as rank from scores", "scores"))
def _(s, d):
    label = F.when(F.col("score") > 0.5, "BUY").when(F.col("score") < -0.5, "SELL").otherwise("HOLD")
    return xs.unique_rank(S(s, d), "score", "rank").select("id", "d", label.alias("signal"), F.col("rank").cast("long").alias("rank"))


@query("b13_confidence_label", sql("""select s.id, s.d, case when unc <= a then 'High' when unc >= b then 'Low' when unc is not null then 'Medium' end confidence from scores s join
 (select d, quantile_cont(unc, 0.3) a, quantile_cont(unc, 0.7) b from scores group by d) q on s.d = q.d""", "scores"))
def _(s, d):
    return xs.quantile_label(S(s, d), "unc", 0.3, 0.7, "confidence").select("id", "d", "confidence")


@query("b14_regime", sql("select d, case when ret_level >= avg(ret_level) over (order by d rows between 59 preceding and current row) then 70 else 90 end threshold from (select d, round(avg(close), 9) ret_level from panel group by d)", "panel"))
def _(s, d):
    days = P(s, d).groupBy("d").agg(F.round(F.avg("close"), 9).alias("x"))
    mean = F.avg("x").over(Window.orderBy("d").rowsBetween(-59, 0))
    return days.select("d", F.when(F.col("x") >= mean, F.lit(70)).otherwise(F.lit(90)).alias("threshold"))


@query("b15_sign_counts", sql("select d, count(*) filter (score > 0) up, count(*) filter (score < 0) down from scores group by d", "scores"))
def _(s, d):
    return S(s, d).groupBy("d").agg(F.count_if(F.col("score") > 0).alias("up"), F.count_if(F.col("score") < 0).alias("down"))


@query("b16_url_dedupe", "select url, min(page_id) page_id from pages where url is not null and trim(url) <> '' group by url")
def _(s, d):
    return fx.read(s, d, "pages").where("url is not null and trim(url) <> ''").groupBy("url").agg(F.min("page_id").alias("page_id"))


# --- C: joins
@query("c01_side_table_join", sql("select p.id, p.d, coalesce(adj_factor, 1.0) as factor from panel p left join ex e on p.id = e.id and p.d = e.d", "panel", "ex"))
def _(s, d):
    return P(s, d).join(fx.adjustments(s, d), ["id", "d"], "left").select("id", "d", F.coalesce("adj_factor", F.lit(1.0)).alias("factor"))


@query("c02_market_join", sql("select p.id, p.d, round(m.x, 6) market from panel p left join (select d, avg(close) x from panel group by d) m using (d)", "panel"))
def _(s, d):
    p = P(s, d)
    return p.join(F.broadcast(p.groupBy("d").agg(F.avg("close").alias("market"))), "d", "left").select("id", "d", r("market"))


PUB = "period_end + case when month(period_end) = 12 then 90 else 45 end"


@query("c03_as_of", sql(f"select p.id, p.d, round(f.value, 4) as value from panel p asof left join (select id, {PUB} av, value from facts where type = 'rev') f on p.id = f.id and p.d >= f.av", "panel", "facts"))
def _(s, d):
    f = fx.facts(s, d).where("type = 'rev'").withColumn("av", pit.publication_date(F.col("period_end")))
    return pit.as_of(P(s, d), f, "av", ["value"], ["period_end"]).select("id", "d", r("value", 4))


@query("c06_as_of_tolerance", sql(f"select p.id, p.d, case when p.d - f.av <= 20 then round(f.value, 4) end as value from panel p asof left join (select id, {PUB} av, value from facts where type = 'qty') f on p.id = f.id and p.d >= f.av", "panel", "facts"))
def _(s, d):
    f = fx.facts(s, d).where("type = 'qty'").withColumn("av", pit.publication_date(F.col("period_end")))
    return pit.as_of(P(s, d), f, "av", ["value"], ["period_end"], tolerance=20).select("id", "d", r("value", 4))


@query("c05_two_sided", sql("""select id, d, round(case when a is null then b when b is null or abs(a - b) <= 0.05 * abs(a) then a end, 9) filled from (select id, d,
 last_value(x ignore nulls) over (partition by id order by d rows between unbounded preceding and current row) a, first_value(x ignore nulls) over (partition by id order by d rows between current row and unbounded following) b
 from (select id, d, case when volume < 60 then close end x from panel))""", "panel"))
def _(s, d):
    p = P(s, d).withColumn("x", F.when(F.col("volume") < 60, F.col("close")))
    return pit.two_sided(p, "x", 0.05, "filled").select("id", "d", r("filled", 9))


@query("c07_days_later", sql("select p.id, p.d, round(q.close / p.close - 1, 6) fwd from (select * from panel join cal using (d)) p join (select * from panel join cal using (d)) q on p.id = q.id and q.idx = p.idx + 10", "cal"))
def _(s, d):
    out = pit.days_later(P(s, d), 10, "close", "later")
    return out.select("id", "d", F.round(F.col("later") / F.col("close") - 1, 6).alias("fwd"))


@query("c08_interval_days", sql("select id, status, c.d from spans join (select distinct cast(ts as date) d from events) c on c.d between start_d and end_d", "spans"))
def _(s, d):
    cal = fx.read(s, d, "events").select(F.to_date("ts").alias("d")).distinct()
    return pit.expand_intervals(fx.spans(s, d), cal, "start_d", "end_d").select("id", "status", "d")


@query("c09_anti_join", sql("select id, d from panel where not exists (select 1 from ex where ex.id = panel.id and ex.d = panel.d)", "panel", "ex"))
def _(s, d):
    return P(s, d).join(fx.adjustments(s, d), ["id", "d"], "left_anti").select("id", "d")


@query("c10_semi_join", sql("select id, d from panel where id in (select id from cat where size_v > 5000)", "panel", "cat"))
def _(s, d):
    return P(s, d).join(fx.categories(s, d).where("size_v > 5000"), "id", "left_semi").select("id", "d")


@query("c11_ratio_join", sql("select p.id, p.d, round(p.volume / f.v, 6) ratio from panel p join (select id, sum(value) v from facts where type = 'qty' group by id) f using (id) where f.v > 0", "panel", "facts"))
def _(s, d):
    f = fx.facts(s, d).where("type = 'qty'").groupBy("id").agg(F.sum("value").alias("v")).where("v > 0")
    return P(s, d).join(f, "id").select("id", "d", F.round(F.col("volume") / F.col("v"), 6).alias("ratio"))


@query("c13_event_multiplier", sql("select p.id, p.d, round(coalesce(exp(sum(ln(e.adj_factor))), 1.0), 9) mult from panel p left join ex e on e.id = p.id and e.d > p.d group by p.id, p.d", "panel", "ex"))
def _(s, d):
    return pit.event_multiplier(P(s, d), fx.adjustments(s, d), "adj_factor", "mult").select("id", "d", r("mult", 9))


@query("c15_near_event", sql("select id, d from panel p where exists (select 1 from ex e where e.id = p.id and abs(e.d - p.d) <= 5)", "panel", "ex"))
def _(s, d):
    return pit.near_event(P(s, d), fx.adjustments(s, d), 5).select("id", "d")


@query("c17_score_autocorrelation", sql("select a.d, round(corr(a.score, b.score), 6) rho, count(*) n from (select * from scores join cal using (d)) a join (select * from scores join cal using (d)) b on a.id = b.id and b.idx = a.idx - 1 group by a.d having count(*) >= 10", "scores", "cal"))
def _(s, d):
    return ev.autocorrelation(S(s, d), "score", 1, pit.calendar(P(s, d))).where("n >= 10").select("d", r("rho"), "n")


@query("c20_dimension_names", sql("select p.id, p.d, coalesce(category, 'unknown') category from panel p left join (select * from cat where size_v > 0) c using (id)", "panel", "cat"))
def _(s, d):
    c = fx.categories(s, d).where("size_v > 0").select("id", "category")
    return P(s, d).join(c, "id", "left").select("id", "d", F.coalesce("category", F.lit("unknown")).alias("category"))


# --- D: profiles and reconciliation
@query("d01_pivot", "select l_suppkey id, l_returnflag d, " + ", ".join(f"arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice, l_quantity)) filter (l_linestatus = '{m}') {m.lower()}" for m in "FO") + " from lineitem group by 1, 2")
def _(s, d):
    line = fx.read(s, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("d"), F.lower("l_linestatus").alias("type"), "l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity").alias("seq"))
    return ft.last_pivot(line, ["id", "d"], "type", ["f", "o"], "l_quantity", "seq")


@query("d02_preferred_type", sql("select id, period_end, arg_min(type, pref) as type, round(arg_min(value, pref), 4) as value from (select *, case type when 'tax' then 1 when 'rev' then 2 else 3 end pref from facts) group by 1, 2", "facts"))
def _(s, d):
    pref = F.expr("case type when 'tax' then 1 when 'rev' then 2 else 3 end")
    return fx.facts(s, d).withColumn("pref", pref).groupBy("id", "period_end").agg(F.min_by("type", "pref").alias("type"), F.round(F.min_by("value", "pref"), 4).alias("value"))


YTD = "select id, period_end, sum(value) over (partition by id, year(period_end) order by period_end) ytd from facts where type = 'rev'"


@query("d03_single_period", sql(f"select * from (select id, period_end, round(case when quarter(period_end) = 1 then ytd else ytd - case when quarter(lag(period_end) over w) = quarter(period_end) - 1 then lag(ytd) over w end end, 4) single from ({YTD}) window w as (partition by id, year(period_end) order by period_end)) where single is not null", "facts"))
def _(s, d):
    w = Window.partitionBy("id", F.year("period_end")).orderBy("period_end")
    f = fx.facts(s, d).where("type = 'rev'").withColumn("ytd", F.sum("value").over(w))
    return dq.single_period(f, "ytd", "single", ["id"], "period_end").select("id", "period_end", r("single", 4))


@query("d05_growth_and_trailing", sql("select id, period_end, round(value / lag(value, 4) over w - 1, 6) yoy, round(case when count(value) over w4 >= 4 then sum(value) over w4 end, 4) ttm from facts where type = 'rev' window w as (partition by id order by period_end), w4 as (partition by id order by period_end rows between 3 preceding and current row)", "facts"))
def _(s, d):
    from ..spec import PanelSpec

    q = PanelSpec(date="period_end")
    f = ts.rolling(ts.pct_change(fx.facts(s, d).where("type = 'rev'"), "value", 4, "yoy", q), "value", "sum", 4, 4, "ttm", q)
    return f.select("id", "period_end", r("yoy"), r("ttm", 4))


@query("d06_net_position", "select cast(ts as date) d, sum(case when event_type = 'purchase' then 1 when event_type = 'click' then -1 else 0 end)::bigint net from events group by 1")
def _(s, d):
    side = F.expr("case when event_type = 'purchase' then 1 when event_type = 'click' then -1 else 0 end")
    return fx.read(s, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.sum(side).alias("net"))


@query("d07_conditional_ratio", "select cast(ts as date) d, round(count(*) filter (event_type = 'click') / nullif(count(*) filter (event_type = 'purchase'), 0)::double, 6) ratio from events group by 1")
def _(s, d):
    n = lambda x: F.count_if(F.col("event_type") == x)
    return fx.read(s, d, "events").groupBy(F.to_date("ts").alias("d")).agg(F.round(n("click") / F.nullif(n("purchase"), F.lit(0)), 6).alias("ratio"))


@query("d11_breadth", sql("select d, count(*) filter (ret > 0) up, count(*) filter (ret < 0) down, round(count(*) filter (ret > 0) / count(ret)::double, 6) ratio from rets where ret is not null group by d", "rets"))
def _(s, d):
    up = F.count_if(F.col("ret") > 0)
    return rets(s, d).where("ret is not null").groupBy("d").agg(up.alias("up"), F.count_if(F.col("ret") < 0).alias("down"), F.round(up / F.count("ret"), 6).alias("ratio"))


@query("d12_duplicate_keys", "select l_orderkey, l_linenumber, count(*) n from lineitem group by 1, 2 having count(*) > 1")
def _(s, d):
    return dq.duplicate_keys(fx.read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("d14_group_flow_top", sql("select category, round(flow, 2) flow, case when flow > 0 then 'in' else 'out' end direction from (select category, sum(close * volume * sign(ret)) flow from rets join cat using (id) where ret is not null and d in (select distinct d from panel order by d desc limit 5) group by 1) order by abs(flow) desc, category limit 8", "rets", "cat"))
def _(s, d):
    p = xs.last_dates(rets(s, d), 5).where("ret is not null").join(fx.categories(s, d), "id")
    flow = p.groupBy("category").agg(F.sum(F.expr("close * volume * sign(ret)")).alias("flow"))
    top = flow.orderBy(F.abs("flow").desc(), "category").limit(8)
    return top.select("category", r("flow", 2), F.when(F.col("flow") > 0, "in").otherwise("out").alias("direction"))


@query("d15_column_profile", sql("select name, round(avg((v is null)::int), 6) null_share, round(coalesce(avg((v = 0)::int), 0), 6) zero_share, round(min(v), 6) low, round(max(v), 6) high, round(stddev_samp(v), 6) std from (select 'score' as name, score v from scores union all select 'unc', unc from scores union all select 'label', label from scores) group by name", "scores"))
def _(s, d):
    return dq.column_profile(S(s, d), ["score", "unc", "label"]).select("name", r("null_share"), r("zero_share"), r("low"), r("high"), r("std"))


@query("d16_rule_violations", sql("select 'close' rule_column, count(*) filter (close < 950) below, count(*) filter (close > 2000) above from panel union all select 'volume', count(*) filter (volume < 10), 0 from panel", "panel"))
def _(s, d):
    return dq.rule_violations(P(s, d), {"close": (950, 2000), "volume": (10, None)})


@query("d17_daily_counts", sql("select d, n, n - lag(n) over (order by d) change from (select d, count(distinct id) n from panel group by d)", "panel"))
def _(s, d):
    return dq.daily_counts(P(s, d))


@query("d19_staleness", "select name, last_d, first_d, max(last_d) over () - last_d lag_days, max(last_d) over () - last_d > 30 stale from (select 'lineitem' as name, max(cast(l_shipdate as date)) last_d, min(cast(l_shipdate as date)) first_d from lineitem union all select 'orders', max(cast(o_orderdate as date)), min(cast(o_orderdate as date)) from orders)")
def _(s, d):
    return dq.staleness({"lineitem": (fx.read(s, d, "lineitem"), "l_shipdate"), "orders": (fx.read(s, d, "orders"), "o_orderdate")}, 30).withColumn("lag_days", F.col("lag_days").cast("long"))


@query("d20_coverage", sql("select year(p.d) as year, round(avg((e.id is not null)::int), 6) coverage, count(*) n from panel p left join ex e on p.id = e.id and p.d = e.d group by 1", "panel", "ex"))
def _(s, d):
    return dq.coverage(P(s, d), fx.adjustments(s, d)).select(F.col("year").cast("long").alias("year"), r("coverage"), "n")


@query("d21_dead_days", sql("select year(d)::bigint as year, name, round(avg((coalesce(s, 0) < 1e-6)::int), 6) dead_share from (select d, 'close' as name, stddev_samp(close) s from panel group by d union all select d, 'volume', stddev_samp(volume) from panel group by d) group by 1, 2", "panel"))
def _(s, d):
    return dq.dead_days(P(s, d), ["close", "volume"]).select(F.col("year").cast("long").alias("year"), "name", r("dead_share"))


@query("d26_reconcile", sql("select f.type, round(median(f.value / g.value), 6) median_ratio, round(avg((abs(f.value / g.value - 1) <= 0.01)::int), 6) as within, count(*) n from facts f join (select id, period_end, type, value * (1 + (id % 5) * 0.004) as value from facts) g using (id, period_end, type) group by 1", "facts"))
def _(s, d):
    f = fx.facts(s, d)
    g = f.withColumn("value", F.col("value") * (1 + (F.col("id") % 5) * 0.004))
    return dq.reconcile(f, g, ["id", "period_end", "type"], "value", "type", 0.01).select("type", r("median_ratio"), r("within"), "n")


@query("d27_build_diff", sql("select count(*) filter (a.id is not null and b.id is not null) common, count(*) filter (b.id is null) only_a, count(*) filter (a.id is null) only_b, count(*) filter (a.close <> b.close) differ, count(*) filter (a.id is not null and b.id is not null and (a.close is null) <> (b.close is null)) null_mismatch, round(max(abs(a.close - b.close)), 6) max_diff from panel a full join (select id, d, case when id % 10 = 0 then close + 1 else close end as close from panel where id % 11 <> 0) b on a.id = b.id and a.d = b.d", "panel"))
def _(s, d):
    a = P(s, d).select("id", "d", "close")
    b = a.where("id % 11 <> 0").withColumn("close", F.expr("case when id % 10 = 0 then close + 1 else close end"))
    return dq.compare_builds(a, b, ["id", "d"], "close").withColumn("max_diff", F.round("max_diff", 6))


@query("d30_equal_weight_index", sql("select d, round(ret, 9) ret from bench", "bench"))
def _(s, d):
    return bench(s, d).select("d", r("ret", 9))


@query("d33_lifecycle", sql(f"select id, min(d) first_d, max(d) last_d, count(*) n, max(gap) max_gap from (select id, d, d - lag(d) {W} gap from panel) group by id", "panel"))
def _(s, d):
    return dq.lifecycle(P(s, d)).withColumn("max_gap", F.col("max_gap").cast("long"))


# --- E: evaluation
@query("e01_rank_ic", sql("select d, round(ic, 6) ic, n from ics", "ics"))
def _(s, d):
    return ics(s, d).select("d", r("ic"), "n")


@query("e02_pearson_ic", sql("select d, round(corr(score, label), 6) ic, count(*) n from scores where score is not null and label is not null group by d having count(*) >= 10", "scores"))
def _(s, d):
    return ev.pearson_ic(S(s, d), "score", "label", 10).select("d", r("ic"), "n")


@query("e03_ic_summary", sql("select round(avg(ic), 6) mean, round(stddev_samp(ic), 6) std, round(avg(ic) / stddev_samp(ic), 6) icir, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 5) t, round(avg((ic > 0)::int), 6) positive, count(ic) n from ics", "ics"))
def _(s, d):
    return ev.ic_summary(ics(s, d)).select(r("mean"), r("std"), r("icir"), r("t", 5), r("positive"), "n")


@query("e04_newey_west", sql("select round(any_value(m), 6) mean, count(*) n, round(any_value(m) / sqrt((sum(e*e) + 2*(3/4.0)*sum(e*l1) + 2*(2/4.0)*sum(e*l2) + 2*(1/4.0)*sum(e*l3)) / count(*) / count(*)), 5) t from (select m, e, lag(e,1) over (order by d) l1, lag(e,2) over (order by d) l2, lag(e,3) over (order by d) l3 from (select d, avg(ic) over () m, ic - avg(ic) over () e from ics where ic is not null))", "ics"))
def _(s, d):
    return ev.newey_west_t(ics(s, d), "ic", 3).select(r("mean"), "n", r("t", 5))


@query("e07_top_excess", sql("select d, round(avg(label) filter (k <= 10), 6) as top, round(avg(label), 6) mean, round(avg(label) filter (k <= 10) - avg(label), 6) excess from (select *, row_number() over (partition by d order by score desc, id) k from scores where label is not null) group by d", "scores"))
def _(s, d):
    return ev.top_return(S(s, d), "score", "label", 10).select("d", r("top"), r("mean"), r("excess"))


@query("e08_rolling_ic", sql("select d, round(case when count(ic) over w >= 3 then avg(ic) over w end, 6) ic5 from ics window w as (order by d rows between 4 preceding and current row)", "ics"))
def _(s, d):
    w = Window.orderBy("d").rowsBetween(-4, 0)
    return ics(s, d).select("d", F.round(F.when(F.count("ic").over(w) >= 3, F.avg("ic").over(w)), 6).alias("ic5"))


@query("e20_return_summary", sql("""select round(exp(sum(ln(1 + ret))) - 1, 6) total, round(exp(sum(ln(1 + ret)) * 52 / count(ret)) - 1, 6) annual, round(avg(ret) / stddev_pop(ret) * sqrt(52.0), 6) sharpe,
 round(min(curve / greatest(1.0, peak) - 1), 6) max_drawdown, round(avg((ret > 0)::int), 6) win_rate from (select *, max(curve) over (order by d) peak from (select d, ret, exp(sum(ln(1 + ret)) over (order by d)) curve from bench))""", "bench"))
def _(s, d):
    return ev.return_summary(bench(s, d), "ret", 52).select(r("total"), r("annual"), r("sharpe"), r("max_drawdown"), r("win_rate"))


@query("e25_market_segments", sql("select d, case when n >= 20 then case when x >= 0 then 'up' else 'down' end end seg from (select d, count(ret) over w n, exp(sum(ln(1 + ret)) over w) - 1 x from bench window w as (order by d rows between 19 preceding and current row))", "bench"))
def _(s, d):
    return ev.segment_by_trend(bench(s, d), "ret", 20, "seg").select("d", "seg")


@query("e32_folds", sql("""select train_end, test_end, count(*) filter (d < train_end) train_days, count(*) filter (d >= train_end) test_days from (select cast(unnest(generate_series((select min(d) + interval 36 month from cal), (select max(d) - interval 6 month from cal), interval 3 month)) as date) train_end) f,
 lateral (select cast(train_end + interval 6 month as date) test_end) t, cal where d < test_end group by 1, 2""", "cal"))
def _(s, d):
    return ev.expanding_folds(pit.calendar(P(s, d)), 6, 3, 36).select("train_end", "test_end", "train_days", "test_days")


@query("e35_decile_profile", sql("select bin, round(avg(m), 6) mean, count(*) as days from (select d, bin, avg(label) m from (select d, label, greatest(1, ceil((k - 1) * 10 / greatest(n - 1, 1)::double))::int bin from (select d, label, row_number() over (partition by d order by score, id) k, count(*) over (partition by d) n from scores where label is not null)) group by 1, 2) group by 1", "scores"))
def _(s, d):
    return ev.decile_profile(S(s, d), "score", "label").select("bin", r("mean"), "days")


# --- F: series windows
@query("f01_pct_change", sql(f"select id, d, round(close / lag(close, 5) {W} - 1, 6) mom from panel", "panel"))
def _(s, d):
    return ts.pct_change(P(s, d), "close", 5, "mom").select("id", "d", r("mom"))


@query("f02_rolling", sql(f"select id, d, round(case when count(close) {W_(20)} >= 10 then avg(close) {W_(20)} end, 6) mean, round(case when count(close) {W_(20)} >= 10 then median(close) {W_(20)} end, 9) med, round(case when count(close) {W_(9)} >= 5 then min(close) {W_(9)} end, 9) low9 from panel", "panel"))
def _(s, d):
    p = ts.rolling(P(s, d), "close", "avg", 20, 10, "mean")
    p = ts.rolling(ts.rolling(p, "close", "median", 20, 10, "med"), "close", "min", 9, 5, "low9")
    return p.select("id", "d", r("mean"), r("med", 9), r("low9", 9))


@query("f03_true_range", sql(f"select id, d, round(greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})), 9) tr from panel", "panel"))
def _(s, d):
    return ts.true_range(P(s, d), "tr").select("id", "d", r("tr", 9))


def ewm_sql(x: str, alpha: float, adjust: bool, source: str) -> str:
    """The closed form over at most a few thousand rows: id, d, seen, value."""
    rate, w = 1 - alpha, "over (partition by id order by d)"
    base = f"select *, row_number() {w} n, count({x}) {w} seen from {source}"
    if adjust:
        return f"select *, sum({x} * pow({rate!r}, -n)) {w} / nullif(sum(case when {x} is not null then pow({rate!r}, -n) end) {w}, 0) as value from ({base})"
    # a value that follows another at a distance of g rows takes alpha / (rate^g + alpha) of the weight
    gaps = f"select *, n - max(case when {x} is not null then n end) over (partition by id order by d rows between unbounded preceding and 1 preceding) g from ({base})"
    parts = f"select *, case when {x} is null or g is null then 0 else ln(pow({rate!r}, g) / (pow({rate!r}, g) + {alpha!r})) end keep, case when {x} is null then null when g is null then {x} else {x} * {alpha!r} / (pow({rate!r}, g) + {alpha!r}) end part from ({gaps})"
    return f"select *, exp(kept) * sum(part * exp(-kept)) {w} as value from (select *, sum(keep) {w} kept from ({parts}))"


@query("f04_ewm_adjusted", sql(f"select id, d, round(case when seen >= 7 then value end, 6) e from ({ewm_sql('close', 1 / 14, True, 'panel')})", "panel"))
def _(s, d):
    return ts.ewm(P(s, d), "close", 1 / 14, True, "e", 7).select("id", "d", r("e"))


@query("f04_ewm_recursive", sql(f"select id, d, round(value, 6) e from ({ewm_sql('close', 1 / 3, False, 'panel')})", "panel"))
def _(s, d):
    return ts.ewm(P(s, d), "close", 1 / 3, False, "e").select("id", "d", r("e"))


GAINS = "(select id, d, greatest(x, 0.0) up, greatest(-x, 0.0) down from (select id, d, close - lag(close) over (partition by id order by d) x from panel))"


@query("f05_rsi_wilder", sql(f"select u.id, u.d, round(100 - 100 / (1 + u.value / nullif(v.value, 0)), 5) rsi from ({ewm_sql('up', 1 / 14, False, '(select id, d, case when x is not null then greatest(x, 0.0) end up from (select id, d, close - lag(close) over (partition by id order by d) x from panel))')}) u join ({ewm_sql('down', 1 / 14, False, '(select id, d, case when x is not null then greatest(-x, 0.0) end down from (select id, d, close - lag(close) over (partition by id order by d) x from panel))')}) v on u.id = v.id and u.d = v.d where u.seen >= 14", "panel"))
def _(s, d):
    return ts.rsi(P(s, d), "close", "rsi", 1 / 14, False).withColumn("k", F.count("close").over(PANEL.past())).where("k >= 15").select("id", "d", r("rsi", 5))


@query("f08_obv", sql(f"select id, d, round(sum(coalesce(sign(ret) * volume, 0)) {W}, 4) obv from rets", "rets"))
def _(s, d):
    return ts.on_balance_volume(P(s, d), "close", "volume", "obv").select("id", "d", r("obv", 4))


@query("f10_bollinger", sql(f"select id, d, round((close - (m - 2 * s)) / nullif(4 * s, 0), 5) pct_b, round(close / m - 1, 6) bias from (select *, avg(close) {W_(20)} m, stddev_samp(close) {W_(20)} s, count(close) {W_(20)} c from panel) where c >= 20", "panel"))
def _(s, d):
    p = ts.rolling(ts.rolling(P(s, d), "close", "avg", 20, 20, "m"), "close", "stddev_samp", 20, 20, "s").where("m is not null")
    return p.select("id", "d", F.round(F.expr("(close - (m - 2 * s)) / nullif(4 * s, 0)"), 5).alias("pct_b"), F.round(F.expr("close / m - 1"), 6).alias("bias"))


@query("f11_relative_strength", sql(f"select id, d, round(coalesce(ret - b.ret_b, 0), 6) rs from rets left join (select d, ret ret_b from bench) b using (d)", "bench"))
def _(s, d):
    b = F.broadcast(bench(s, d).withColumnRenamed("ret", "ret_b"))
    return rets(s, d).join(b, "d", "left").select("id", "d", F.round(F.coalesce(F.expr("ret - ret_b"), F.lit(0.0)), 6).alias("rs"))


@query("f12_forward_fill", sql("select id, d, coalesce(last_value(unc ignore nulls) over (partition by id order by d rows between unbounded preceding and current row), 0) filled from (select id, d, case when volume < 60 then unc end unc from scores)", "scores"))
def _(s, d):
    p = S(s, d).withColumn("x", F.when(F.col("volume") < 60, F.col("unc")))
    return ts.forward_fill(p, "x", "filled", F.lit(0.0)).select("id", "d", "filled")


@query("f13_difference", sql(f"select id, d, round(close - lag(close, 5) {W}, 9) diff from panel", "panel"))
def _(s, d):
    return ts.difference(P(s, d), "close", 5, "diff").select("id", "d", r("diff", 9))


@query("f14_lag_block", sql(f"select id, d, round(lag(close, 1) {W}, 9) close_lag1, round(lag(close, 5) {W}, 9) close_lag5, lag(volume, 1) {W} volume_lag1, lag(volume, 5) {W} volume_lag5 from panel", "panel"))
def _(s, d):
    return ts.lag_block(P(s, d), ["close", "volume"], [1, 5]).select("id", "d", r("close_lag1", 9), r("close_lag5", 9), "volume_lag1", "volume_lag5")


@query("f17_expanding_z", sql("select id, d, round(case when count(close) over w >= 52 then greatest(-3, least(3, (close - avg(close) over w) / nullif(stddev_samp(close) over w, 0))) end, 5) z from panel window w as (partition by id order by d rows between unbounded preceding and 1 preceding)", "panel"))
def _(s, d):
    return ts.expanding_z(P(s, d), "close", "z", 52).select("id", "d", r("z", 5))


@query("f17_tail_splice", sql("select id, d, z from (select id, d, round(case when count(close) over w >= 52 then greatest(-3, least(3, (close - avg(close) over w) / nullif(stddev_samp(close) over w, 0))) end, 5) z from panel window w as (partition by id order by d rows between unbounded preceding and 1 preceding)) where d >= date '1998-01-01'", "panel"))
def _(s, d):
    """The last year's z-scores from the moments of the years before, which are merged from two parts."""
    p = P(s, d)
    history = ts.merge_moments(ts.moments(p.where("d < '1996-01-01'"), "close"), ts.moments(p.where("d >= '1996-01-01' and d < '1998-01-01'"), "close"))
    return ts.expanding_z_tail(p.where("d >= '1998-01-01'"), history, "close", "z", 52).select("id", "d", r("z", 5))


@query("f18_streak", sql("select id, d, sum(f) over (partition by id, island order by d)::bigint streak from (select id, d, (coalesce(ret, 0) > 0)::int f, sum(case when ret > 0 then 0 else 1 end) over (partition by id order by d) island from rets)", "rets"))
def _(s, d):
    return ts.streak(rets(s, d), F.col("ret") > 0, "streak").select("id", "d", "streak")


@query("f20_forward_return", sql(f"select id, d, round(lead(close, 5) {W} / close - 1, 6) label from panel", "panel"))
def _(s, d):
    return ts.forward_return(P(s, d), "close", 5, "label").select("id", "d", r("label"))


@query("f21_beta", sql(f"select id, d, round(case when count(ret) {W_(60)} >= 20 then covar_samp(ret, ret_b) {W_(60)} / nullif(var_samp(case when ret is not null then ret_b end) {W_(60)}, 0) end, 5) beta from (select rets.*, b.ret_b from rets left join (select d, ret ret_b from bench) b using (d))", "bench"))
def _(s, d):
    p = rets(s, d).join(F.broadcast(bench(s, d).withColumnRenamed("ret", "ret_b")), "d", "left")
    return ts.beta(p, "ret", "ret_b", 60, 20, "beta").select("id", "d", r("beta", 5))


@query("f23_local_minimum", sql("select id, d from (select id, d, close, min(close) over w m, count(*) over w c from panel window w as (partition by id order by d rows between 5 preceding and 5 following)) where c = 11 and close <= m", "panel"))
def _(s, d):
    return ts.local_minimum(P(s, d), "close", 5, "low").where("low").select("id", "d")


@query("f25_score_smoothing", sql(f"select id, d, round(avg(score) {W_(5)}, 6) smooth from scores", "scores"))
def _(s, d):
    return ts.rolling(S(s, d), "score", "avg", 5, 1, "smooth").select("id", "d", r("smooth"))


@query("f26_hysteresis", sql("select id, d, coalesce(last_value(case when k <= 10 then 1 when k > 20 then 0 end ignore nulls) over (partition by id order by d rows between unbounded preceding and current row), 0) held from (select id, d, row_number() over (partition by d order by score desc, id) k from scores)", "scores"))
def _(s, d):
    return ts.hysteresis(xs.unique_rank(S(s, d), "score", "k"), "k", 10, 20, "held").select("id", "d", "held")


# --- G, H, I: per-date windows, top-k, sets
@query("g01_winsorise", sql("select s.id, s.d, round(greatest(least(score, b), a), 6) w from scores s join (select d, quantile_cont(score, 0.01) a, quantile_cont(score, 0.99) b from scores group by d) q on s.d = q.d", "scores"))
def _(s, d):
    return xs.winsorise(S(s, d), "score", 0.01, 0.99, "w").select("id", "d", r("w"))


@query("g02_zscore", sql("select id, d, round((score - avg(score) over (partition by d)) / (stddev_samp(score) over (partition by d) + 1e-9), 5) z from scores", "scores"))
def _(s, d):
    return xs.zscore(S(s, d), "score", "z").select("id", "d", r("z", 5))


@query("g03_neutralise", sql("select id, d, round(score - avg(score) over (partition by d, category), 6) neutral from scores join cat using (id)", "scores", "cat"))
def _(s, d):
    p = S(s, d).join(fx.categories(s, d), "id")
    return xs.neutralise(p, "score", "category", "neutral").select("id", "d", r("neutral"))


@query("g04_neutralise_size", sql("""select id, d, round(case when count(score) over (partition by d) >= 10 then y - coalesce(sum(x * y) over (partition by d) / nullif(sum(x * x) over (partition by d), 0), 0) * x else score end, 6) neutral
 from (select id, d, score, score - avg(score) over (partition by d, category) y, size_v - avg(size_v) over (partition by d, category) x from scores join cat using (id))""", "scores", "cat"))
def _(s, d):
    p = S(s, d).join(fx.categories(s, d), "id")
    return xs.neutralise_with_size(p, "score", "category", "size_v", "neutral").select("id", "d", r("neutral"))


@query("g05_average_rank", sql("select id, d, rank() over (partition by d order by score) + (count(*) over (partition by d, score) - 1) / 2.0::double k from scores", "scores"))
def _(s, d):
    return xs.average_rank(S(s, d), "score", "k").select("id", "d", "k")


@query("g06_centred_rank", sql("select id, d, round(case when n > 1 then (k - 1) / (n - 1)::double - 0.5 end, 6) k from (select id, d, count(score) over (partition by d) n, rank() over (partition by d order by score) + (count(*) over (partition by d, score) - 1) / 2.0 k from scores)", "scores"))
def _(s, d):
    return xs.centred_rank(S(s, d), "score", "k").select("id", "d", r("k"))


@query("g10_equal_bins", sql("select id, d, greatest(1, ceil((k - 1) * 5 / greatest(n - 1, 1)::double))::int bin from (select id, d, row_number() over (partition by d order by score, id) k, count(*) over (partition by d) n from scores)", "scores"))
def _(s, d):
    return xs.equal_bins(S(s, d), "score", 5, "bin").select("id", "d", "bin")


@query("h01_top_n", sql("select id, d, rank from (select id, d, row_number() over (partition by d order by score desc, id) as rank from scores) where rank <= 10", "scores"))
def _(s, d):
    return xs.top_n(S(s, d), "score", 10).select("id", "d", F.col("rank").cast("long").alias("rank"))


@query("h05_last_rows", sql("select id, d from (select id, d, row_number() over (partition by id order by d desc) k from panel) where k <= 60", "panel"))
def _(s, d):
    return xs.last_rows(P(s, d), 60).select("id", "d")


@query("i02_intersection", sql("select id, d from panel intersect select id, d from ex", "panel", "ex"))
def _(s, d):
    return P(s, d).select("id", "d").intersect(fx.adjustments(s, d).select("id", "d"))


@query("i04_membership_change", sql("""select c.d, count(*) filter (a = 1 and b = 1) kept, count(*) filter (b is null) added, count(*) filter (a is null) dropped from (select coalesce(x.id, y.id) id, coalesce(x.idx, y.idx) idx, x.a, y.b from
 (select id, idx, 1 a from m) x full join (select id, idx + 1 idx, 1 b from m) y on x.id = y.id and x.idx = y.idx) join cal c on c.idx = coalesce(x.idx, y.idx) group by 1""", "scores", "cal").replace(" select c.d", ", m as (select id, idx from (select id, d, row_number() over (partition by d order by score desc, id) k from scores) join cal using (d) where k <= 10) select c.d", 1).replace("c.idx = coalesce(x.idx, y.idx)", "c.idx = idx_"). replace("coalesce(x.idx, y.idx) idx, x.a", "coalesce(x.idx, y.idx) idx_, x.a"))
def _(s, d):
    return ev.membership_change(xs.top_n(S(s, d), "score", 10), pit.calendar(P(s, d)))


# --- K, L, M: graph, weights, ensembles
@query("k01_category_edges", sql("select distinct a.id src, b.id dst, 1.0::double weight from k a join k b on a.category = b.category and a.id <> b.id and (b.r <= 3 or abs(a.r - b.r) <= 2)", "cat").replace(" select distinct", ", k as (select *, row_number() over (partition by category order by size_v desc, id) r from cat) select distinct", 1))
def _(s, d):
    return gr.category_edges(fx.categories(s, d), "category", "size_v", 3, 4, 1.0)


@query("k04_correlation_edges", sql("""select src, dst, weight from (select *, row_number() over (partition by src order by weight desc, dst) k from (select src, dst, weight from e union all select dst, src, weight from e)) where k <= 5""", "rets").replace(" select src, dst, weight from (", ", e as (select a.id src, b.id dst, round(corr(a.ret, b.ret), 9) weight from rets a join rets b on a.d = b.d and a.id < b.id where a.ret is not null and b.ret is not null group by 1, 2 having count(*) >= 30 and round(corr(a.ret, b.ret), 9) > 0.15) select src, dst, weight from (", 1))
def _(s, d):
    return gr.correlation_edges(rets(s, d), "ret", 0.15, 5, 30)


@query("l07_proportional_weights", sql("select id, d, round(coalesce(greatest(score, 0) / nullif(sum(greatest(score, 0)) over (partition by d), 0), 0), 6) w from scores", "scores"))
def _(s, d):
    return xs.proportional_weights(S(s, d), "score", "w").select("id", "d", r("w"))


@query("m08_ensemble_reduction", "select vec_id, round(avg(x), 6) mean, round(stddev_samp(x), 6) std from (select vec_id, unnest(embedding)::double x from embeddings) group by 1")
def _(s, d):
    long = fx.read(s, d, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("x"))
    return long.groupBy("vec_id").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"))


@query("j06_json_props", "select event_type, count(*) n, sum(try_cast(json_extract_string(props, '$.k') as bigint))::bigint total from events group by 1")
def _(s, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return fx.read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"))


# --- further compositions of the same operators
TR = f"(select id, d, greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W})) tr from panel)"


@query("f06_atr", sql(f"select id, d, round(case when seen >= 7 then value end, 5) atr from ({ewm_sql('tr', 2 / 15, True, TR)})", "panel"))
def _(s, d):
    return ts.ewm(ts.true_range(P(s, d), "tr"), "tr", 2 / 15, True, "atr", 7).select("id", "d", r("atr", 5))


RSV = f"(select id, d, case when count(close) {W_(9)} >= 5 then 100 * (close - min(low) {W_(9)}) / (max(high) {W_(9)} - min(low) {W_(9)} + 1e-9) end rsv from panel)"


@query("f07_stochastic_k", sql(f"select id, d, round(value, 5) k from ({ewm_sql('rsv', 1 / 3, False, RSV)}) where seen > 0", "panel"))
def _(s, d):
    p = ts.rolling(ts.rolling(P(s, d), "low", "min", 9, 5, "lo"), "high", "max", 9, 5, "hi")
    p = p.withColumn("rsv", F.expr("100 * (close - lo) / (hi - lo + 1e-9)"))
    return ts.ewm(p, "rsv", 1 / 3, False, "k").withColumn("c", F.count("rsv").over(PANEL.past())).where("c > 0").select("id", "d", r("k", 5))


@query("f09_macd", sql(f"select a.id, a.d, round(a.value - b.value, 5) macd from ({ewm_sql('close', 2 / 13, False, 'panel')}) a join ({ewm_sql('close', 2 / 27, False, 'panel')}) b on a.id = b.id and a.d = b.d", "panel"))
def _(s, d):
    p = ts.ewm(ts.ewm(P(s, d), "close", 2 / 13, False, "fast"), "close", 2 / 27, False, "slow")
    return p.select("id", "d", F.round(F.expr("fast - slow"), 5).alias("macd"))


@query("f16_momentum_block", sql(f"select id, d, round(close / lag(close, 5) {W} - 1, 6) m5, round(close / lag(close, 20) {W} - 1, 6) m20, round(close / lag(close, 60) {W} - 1, 6) m60 from panel", "panel"))
def _(s, d):
    p = P(s, d)
    for n in (5, 20, 60):
        p = ts.pct_change(p, "close", n, f"m{n}")
    return p.select("id", "d", r("m5"), r("m20"), r("m60"))


@query("f24_rebalance_dates", sql("select d, idx from cal where (idx - 1) % 20 = 0", "cal"))
def _(s, d):
    return pit.calendar(P(s, d)).where("(idx - 1) % 20 = 0").withColumn("idx", F.col("idx").cast("long"))


@query("g07_unique_rank_tradable", sql("select id, d, case when volume >= 30 then k end k from (select id, d, volume, row_number() over (partition by d order by score desc, id) k from scores)", "scores"))
def _(s, d):
    return xs.unique_rank(S(s, d), "score", "k").select("id", "d", F.when(F.col("volume") >= 30, F.col("k").cast("long")).alias("k"))


@query("g08_liquidity_percentile", sql(f"select id, d, round((rank() over (partition by d order by v) + (count(*) over (partition by d, v) - 1) / 2.0) / count(v) over (partition by d), 6) pct from (select id, d, round(median(close * volume) {W_(20)}, 4) v, count(close) {W_(20)} c from panel) where c >= 5", "panel"))
def _(s, d):
    p = ts.rolling(P(s, d).withColumn("value", F.expr("close * volume")), "value", "median", 20, 5, "v").where("v is not null").withColumn("v", F.round("v", 4))
    return xs.average_rank(p, "v", "k").select("id", "d", F.round(F.col("k") / F.count("v").over(PANEL.day()), 6).alias("pct"))


@query("h04_last_dates", sql("select id, d from panel where d in (select distinct d from panel where d <= date '1997-06-30' order by d desc limit 5)", "panel"))
def _(s, d):
    return xs.last_dates(P(s, d), 5, F.lit("1997-06-30").cast("date")).select("id", "d")


@query("h07_worst_days", sql("select d, round(ret, 9) ret from bench order by ret, d limit 5", "bench"))
def _(s, d):
    return bench(s, d).orderBy("ret", "d").limit(5).select("d", r("ret", 9))


@query("i01_tagged_union", sql("select id, d, 'panel' as src from panel union all select id, d, 'event' from ex", "panel", "ex"))
def _(s, d):
    tag = lambda df, name: df.select("id", "d", F.lit(name).alias("src"))
    return tag(P(s, d), "panel").unionByName(tag(fx.adjustments(s, d), "event"))


@query("i03_key_difference", sql("select id, d from ex except select id, d from panel where volume < 40", "panel", "ex"))
def _(s, d):
    return fx.adjustments(s, d).select("id", "d").subtract(P(s, d).where("volume < 40").select("id", "d"))


@query("k08_induced_subgraph", ORACLES["k01_category_edges"].replace("select distinct a.id src", "select distinct a.id as src").rstrip() + " and a.id % 2 = 0 and b.id % 2 = 0")
def _(s, d):
    c = fx.categories(s, d)
    return gr.induced(gr.category_edges(c, "category", "size_v", 3, 4, 1.0), c.where("id % 2 = 0"))


@query("k09_degrees", "select min(n) low, median(n) as median, max(n) high, count(*) filter (n = 0) isolated from (select c.s_suppkey, count(e.src) n from supplier c left join (" + ORACLES["k01_category_edges"] + ") e on e.src = c.s_suppkey group by 1)")
def _(s, d):
    c = fx.categories(s, d)
    return gr.degrees(gr.category_edges(c, "category", "size_v", 3, 4, 1.0), c)


PEERS = sql("select distinct a.id src, b.id dst, 1.0::double weight from w a join w b on a.category = b.category and a.id <> b.id and (b.r <= 5 or b.r between a.lo and a.lo + 10)", "cat").replace(" select distinct", """, k as (select *,
 row_number() over (partition by category order by coalesce(size_v, 0) desc, id) r, count(*) over (partition by category) n from cat), w as (select *, greatest(1, least(r - 5, n - 10)) lo from k) select distinct""", 1)


def peers(s: SparkSession, d: str) -> DataFrame:
    return gr.category_peers(fx.categories(s, d), "category", "size_v", 5, 10, 1.0)


@query("k01_category_peers", PEERS)
def _(s, d):
    return peers(s, d)


@query("k08_induced_peers", PEERS + " and a.size_v > 0 and b.size_v > 0")
def _(s, d):
    return gr.induced(peers(s, d), fx.categories(s, d).where("size_v > 0"))


@query("k09_peer_degrees", "select min(n) low, median(n) as median, max(n) high, count(*) filter (n = 0) isolated from (select c.s_suppkey, count(e.src) n from supplier c left join (" + PEERS + ") e on e.src = c.s_suppkey group by 1)")
def _(s, d):
    return gr.degrees(peers(s, d), fx.categories(s, d))


@query("h02_capped_signals", sql("select id, d, score from (select *, row_number() over (partition by id, score > 0 order by abs(score) desc, d) k from scores where score <> 0) where k <= case when score > 0 then 2 else 1 end", "scores"))
def _(s, d):
    return xs.capped_signals(S(s, d), "score", 2, 1).select("id", "d", "score")


@query("h03_largest_moves", sql("select id, d, score from scores order by abs(score) desc, d, id limit 8", "scores"))
def _(s, d):
    return xs.largest_by_size(S(s, d), "score", 8).select("id", "d", "score")


@query("d10_flow_summary", sql("select category, d, round(sum(close * volume), 2) flow from panel join cat using (id) where d in (select distinct d from panel order by d desc limit 5) group by rollup (category, d)", "panel", "cat"))
def _(s, d):
    recent = xs.last_dates(P(s, d), 5).join(fx.categories(s, d), "id")
    return recent.rollup("category", "d").agg(F.round(F.sum(F.expr("close * volume")), 2).alias("flow"))


@query("d13_snapshot", sql("select d, sum(volume) volume, count(*) n, round(sum(close * volume) / greatest(sum(volume), 1), 6) price from panel where d = (select max(d) from panel where d <= date '1997-06-30') group by d", "panel"))
def _(s, d):
    last = xs.last_dates(P(s, d), 1, F.lit("1997-06-30").cast("date"))
    return last.groupBy("d").agg(F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n"), F.round(F.expr("sum(close * volume) / greatest(sum(volume), 1)"), 6).alias("price"))


WEEKDAYS = "((({0} - date '1970-01-05') // 7) * 5 + least(({0} - date '1970-01-05') % 7, 5))"


@query("d18_calendar_holes", sql(f"select id, after, d, gap from (select id, d, after, {WEEKDAYS.format('d')} - {WEEKDAYS.format('after')} gap from (select id, d, lag(d) over (partition by id order by d) as after from panel)) where gap > 5", "panel"))
def _(s, d):
    return dq.calendar_holes(P(s, d), 5).select("id", "after", "d", "gap")


@query("e10_calibration", sql("""select era, bin, count(*) as days, round(avg(x), 6) mean, round(avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(*)), 4) t from (
    select year(d) era, d, bin, avg(label) x from (select d, label, ceil(row_number() over (partition by d order by unc, id) * 5.0::double / count(*) over (partition by d))::bigint bin
    from scores where unc is not null) where label is not null group by all) group by era, bin""", "scores"))  # fmt: skip
def _(s, d):
    binned = xs.quantile_bin(S(s, d), "unc", 5, "bin").where("label is not null")
    daily = binned.groupBy(F.year("d").cast("long").alias("era"), "d", "bin").agg(F.avg("label").alias("x"))
    t = F.expr("avg(x) / nullif(stddev_samp(x), 0) * sqrt(count(*))")
    return daily.groupBy("era", "bin").agg(F.count(F.lit(1)).alias("days"), F.round(F.avg("x"), 6).alias("mean"), F.round(t, 4).alias("t"))


@query("e05_ic_decay", sql("""select target, round(avg(c), 6) mean, round(stddev_samp(c), 6) std, count(c) n from (select target, case when isfinite(c) then c end c from (
    select d, target, corr(rs, rl) c, count(*) n from (select d, target, rank() over (partition by d, target order by score) + (count(*) over (partition by d, target, score) - 1) / 2.0 rs,
    rank() over (partition by d, target order by v) + (count(*) over (partition by d, target, v) - 1) / 2.0 rl from (select * from (
    select d, score, round(lead(close, 1) over w / close - 1, 9) f1, round(lead(close, 5) over w / close - 1, 9) f5, round(lead(close, 20) over w / close - 1, 9) f20 from scores window w as (partition by id order by d))
    unpivot (v for target in (f1, f5, f20)))) group by d, target) where n >= 10) group by target""", "scores"))  # fmt: skip
def _(s, d):
    p = S(s, d)
    for n in (1, 5, 20):
        p = ts.forward_return(p, "close", n, f"f{n}").withColumn(f"f{n}", F.round(f"f{n}", 9))
    return ev.ic_decay(p, "score", ["f1", "f5", "f20"], 10).select("target", r("mean"), r("std"), "n")


@query("e06_period_evaluation", sql("""select d, round(narrow, 6) narrow, round(wide, 6) wide, round(curve / greatest(1.0, max(curve) over (order by d)) - 1, 6) drawdown from (
    select d, narrow, wide, exp(sum(ln(1 + wide)) over (order by d)) curve from (select d, avg(label) filter (k <= 5) narrow, avg(label) filter (k <= 10) wide from (
    select *, row_number() over (partition by d order by score desc, id) k from scores where label is not null) group by d))""", "scores"))  # fmt: skip
def _(s, d):
    return ev.period_evaluation(S(s, d), "score", "label", 5, 10).select("d", r("narrow"), r("wide"), r("drawdown"))


from . import more, rules, variants, wider  # noqa: E402, F401  register their queries
