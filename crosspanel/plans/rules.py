"""Registered queries of rules, holdings, checks and layers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import crosssection as xs
from ..operators import features as ft
from ..operators import graph as gr
from ..operators import patterns as pt
from ..operators import pit
from ..operators import quality as dq
from ..operators import signals as sg
from ..operators import timeseries as ts
from ..sources import fixtures as fx
from ..spec import PANEL, PanelSpec
from .catalog import P, S, W, W_, query, r, rets, sql
from .more import BIN, IC, cal

# fixed values: least pattern score and its points; the weights of the entry conditions
TIERS = [(90, 40), (75, 30), (60, 20)]
FALLS = [(0.7, 20), (0.5, 15), (0.3, 10)]


# --- A, D, F, G: cleansing, checks, calendars
@query("a14_coded_positions", "select o_orderkey id, date '1996-01-01' as day, case o_orderstatus when 'F' then 'call' when 'O' then 'put' end side, cast(o_totalprice as double) as amount from orders where date_trunc('month', o_orderdate) = date '1996-01-01' and o_orderstatus in ('F', 'O')")
def _(s, d):
    text = fx.read(s, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy/MM/01").alias("day"), F.concat("o_orderstatus", F.lit(" ")).alias("side"),
        F.regexp_replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), r"(\d)(\d{3}\.)", "$1,$2").alias("amount"),
    )
    return ft.coded_positions(text, "day", "1996-01-01", {"side": {"F": "call", "O": "put"}}, ["amount"])


SWAPPED = f"b as (select id, d, sum(volume - 30) {W} bal, case when id % 3 = 0 then 30.0 else volume end a, case when id % 3 = 0 then volume else 30.0 end t from panel), m as (select id, year(d)::bigint as year, bal - lag(bal) {W} x, a - t y from b)"
VERDICT = """mm as (select * from m where x <> 0 or (x is not null and y <> 0)), v as (select id, year, n, case when yc < -0.5 then 'swap' when yc > 0.5 then 'keep' when ec < -0.5 then 'swap' when ec > 0.5 then 'keep' else 'unknown' end verdict
 from (select id, year, count(*) n, case when count(*) >= 8 and stddev_pop(x) * stddev_pop(y) > 0 then corr(x, y) end yc from mm group by 1, 2) join (select id, case when count(*) >= 8 and stddev_pop(x) * stddev_pop(y) > 0 then corr(x, y) end ec from mm group by 1) using (id))"""


def swapped(s, d):
    wrong = F.col("id") % 3 == 0
    p = P(s, d).withColumn("bal", F.sum(F.col("volume") - 30).over(PANEL.past()))
    return p.select("id", "d", "bal", F.when(wrong, F.lit(30.0)).otherwise(F.col("volume")).alias("a"), F.when(wrong, F.col("volume")).otherwise(F.lit(30.0)).alias("t"))


@query("d24_swap_diagnosis", sql("", "panel").rstrip() + f", {SWAPPED}, {VERDICT} select * from v")
def _(s, d):
    return dq.swap_diagnosis(swapped(s, d), "bal", "a", "t", 8, 0.5)


@query("d24_unswapped", sql("", "panel").rstrip() + f", {SWAPPED}, {VERDICT} select b.id, b.d, case when verdict = 'swap' then t else a end a, case when verdict = 'swap' then a else t end t from b left join v on b.id = v.id and year(b.d) = v.year")
def _(s, d):
    p = swapped(s, d)
    return dq.unswapped(p, dq.swap_diagnosis(p, "bal", "a", "t", 8, 0.5), "a", "t").select("id", "d", "a", "t")


@query("d29_limit_scan", sql(f"""select id, d, over_ as "over", coalesce(over_ and abs(nxt) > lim and sign(ret) <> sign(nxt), false) spike, max(over_::int) over (partition by id order by d rows between 5 preceding and 5 following) = 1 near
 from (select *, coalesce(abs(ret) > lim, false) over_, lead(ret) {W} nxt from (select id, d, ret, case when d < date '1995-06-01' then 0.07 else 0.1 end + 0.008 lim from rets))""", "rets"))
def _(s, d):
    limit = F.when(F.col("d") < F.lit("1995-06-01").cast("date"), 0.07).otherwise(0.1) + 0.008
    return dq.limit_scan(P(s, d), "close", limit).select("id", "d", "over", "spike", "near")


@query("d31_fill_check", sql("""select count(*) n, round(avg((e is not null)::int), 6) coverage, round(quantile_cont(e, 0.5), 6) as median, round(quantile_cont(e, 0.95), 6) p95, round(avg((e <= 0.1)::int), 6) passed from (select abs((a + b) / 2 - close) / close e, held from (
 select close, held, last_value(case when not held then close end ignore nulls) over (partition by id order by d rows between unbounded preceding and 1 preceding) a, first_value(case when not held then close end ignore nulls) over (partition by id order by d rows between 1 following and unbounded following) b
 from (select *, left(md5('7:' || id || ':' || d), 1) in ('0', '1', '2') held from panel where close > 0))) where held""", "panel"))
def _(s, d):
    held = F.left(F.md5(F.concat_ws(":", F.lit("7"), "id", "d").cast("binary")), F.lit(1)).isin("0", "1", "2")
    return dq.fill_check(P(s, d), "close", held, 0.1).select("n", r("coverage"), r("median"), r("p95"), r("passed"))


@query("d32_build_gate", sql("""select inside, name as "column", count(*) n, count(*) filter (nb is null) only_a, count(*) filter (na is null) only_b, count(*) filter (na = 1 and nb = 1 and x <> y) differing, count(*) filter (na = 1 and nb = 1 and (x is null) <> (y is null)) null_mismatch, round(max(abs(x - y)), 4) largest
 from (select d >= date '1997-01-01' inside, na, nb, unnest([{'name': 'close', 'x': a.close, 'y': b.close}, {'name': 'volume', 'x': a.volume, 'y': b.volume}], recursive := true)
 from (select id, d, 1 na, close::double as close, volume::double volume from panel where id % 11 <> 1) a full join (select id, d, 1 nb, (case when d >= date '1997-01-01' then close * 1.5 else close end)::double as close, (case when id % 5 = 0 then null else volume end)::double volume from panel where id % 7 <> 1) b using (id, d)) group by 1, 2""", "panel"))
def _(s, d):
    a, b = P(s, d).where("id % 11 <> 1"), P(s, d).where("id % 7 <> 1")
    recent = F.col("d") >= F.lit("1997-01-01").cast("date")
    b = b.withColumns({"close": F.when(recent, F.col("close") * 1.5).otherwise(F.col("close")), "volume": F.when(F.col("id") % 5 != 0, F.col("volume"))})
    return dq.build_gate(a, b, ["id", "d"], ["close", "volume"], recent).withColumn("largest", F.round("largest", 4))


@query("f27_foreign_calendar", sql("select c.d, f.f as foreign_d, coalesce(c.d - f.f > 1, true) closed from (select d from cal) c asof left join (select distinct cast(o_orderdate as date) f, cast(o_orderdate as date) + 1 av from orders where dayofweek(cast(o_orderdate as date)) between 1 and 5) f on c.d >= f.av", "cal"))
def _(s, d):
    days = fx.read(s, d, "orders").select(F.to_date("o_orderdate").alias("foreign_d")).distinct().where(F.dayofweek("foreign_d").between(2, 6))
    seen = pit.market_as_of(cal(s, d).select("d"), days.withColumn("av", F.date_add("foreign_d", 1)), "av", ["foreign_d"])
    return seen.select("d", "foreign_d", F.coalesce(F.datediff("d", "foreign_d") > 1, F.lit(True)).alias("closed"))


EST = "e as (select id, d, case when volume >= 60 then close end o, case when volume >= 30 then open * 1.25 end c from panel)"


@query("g09_calibrated", sql("", "panel").rstrip() + f""", {EST}, m as (select *, round(median(o / nullif(c, 0)) over (partition by d), 9) f from e), g as (select id, d, o, c * (case when f between 0.5 and 2 then f else 1 end) c, last_value(o ignore nulls) {W} st from m)
 select id, d, round(coalesce(o, c, st), 7) as value, case when o is not null then 'observed' when c is not null then 'derived' when st is not null then 'stale' end as source from g""")
def _(s, d):
    p = P(s, d).select("id", "d", F.when(F.col("volume") >= 60, F.col("close")).alias("o"), F.when(F.col("volume") >= 30, F.col("open") * 1.25).alias("c"))
    return ft.calibrated(p, "o", "c", "value").select("id", "d", r("value", 7), "source")


# --- E: contributions, tails, logs and horizons
FLAGS = f"""fl as (select s.*, k, st, q from (select *, row_number() over (partition by d order by score desc, id) k from scores) s join (select id, d, sum(f) over (partition by id, island order by d)::bigint st from (select id, d, (k <= 10)::int f, sum(case when k <= 10 then 0 else 1 end) {W} island
 from (select id, d, row_number() over (partition by d order by score desc, id) k from scores))) using (id, d) join (select d, quantile_cont(unc, 0.3) q from scores group by d) using (d)),
 fm as (select *, coalesce(st >= 2, false) c1, coalesce(unc <= q, false) c2, coalesce(round(close, 9) < round(avg(close) {W_(20)}, 9), false) c3, coalesce(volume >= 40, false) c4 from fl)"""


def flagged(s, d):
    p = xs.quantile(xs.unique_rank(S(s, d), "score", "k"), "unc", 0.3, "q")
    p = ts.rolling(ts.streak(p, F.col("k") <= 10, "st"), "close", "avg", 20, 1, "ma")
    flags = {"c1": F.col("st") >= 2, "c2": F.col("unc") <= F.col("q"), "c3": F.round("close", 9) < F.round("ma", 9), "c4": F.col("volume") >= 40}
    return p.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})


@query("e09_condition_pools", sql("", "scores").rstrip() + f""", {FLAGS}, x as (select *, label - avg(label) over (partition by d) e from fm where label is not null), b as (select d, avg(e) base from x where k <= 10 group by d),
 p as (select d, pool, round(avg(e), 12) m, count(*) n from (select d, e, unnest(list_filter([case when c1 then 'rank' end, case when c2 then 'sure' end, case when c3 then 'low' end, case when c4 then 'traded' end, 'met ' || (c1::int + c2::int + c3::int + c4::int)], lambda z: z is not null)) pool from x) group by 1, 2)
 select pool, count(*) as days, sum(n)::bigint signals, round(avg(m), 6) mean, round(avg((m > 0)::int), 6) hit_rate, round(avg(m - base), 6) edge from p left join b using (d) group by 1""")
def _(s, d):
    names = {"c1": "rank", "c2": "sure", "c3": "low", "c4": "traded"}
    met = F.concat(F.lit("met "), sum([F.col(c).cast("int") for c in names], F.lit(0)).cast("string"))
    pools = F.array_compact(F.array(*[F.when(F.col(c), F.lit(n)) for c, n in names.items()], met))
    return sg.condition_pools(flagged(s, d), pools, F.col("k") <= 10, "label").select("pool", "days", "signals", r("mean"), r("hit_rate"), r("edge"))


CELLS = "avg(label) filter (a and b) x, avg(label) filter (b and not a) y, avg(label) filter (a and not b) z, avg(label) filter (not a and not b) w"


@query("e14_two_by_two", sql(f"select d, round(w, 6) neither, round(z, 6) a, round(y, 6) b, round(x, 6) \"both\", round(x - y - z + w, 6) interaction from (select d, {CELLS} from (select d, label, coalesce(score > 0, false) a, coalesce(volume >= 40, false) b from scores where label is not null) group by d)", "scores"))
def _(s, d):
    cells = sg.two_by_two(S(s, d), F.col("score") > 0, F.col("volume") >= 40, "label")
    return cells.select("d", *[r(c) for c in ("neither", "a", "b", "both", "interaction")])


@query("e16_tail_profile", sql("", "scores", "cal").rstrip() + f""", t as (select s.*, idx from (select *, {BIN.format('score', 10)} bin from scores) s join cal using (d) where bin in (1, 10))
 select t.bin, count(*) n, round(avg((t.label is null)::int), 6) unlabelled, round(avg((b.id is not null)::int), 6) stayed, round(median(t.volume), 4) volume, round(median(t.unc), 6) unc from t left join (select id, bin, idx + 1 idx from t) b on t.id = b.id and t.bin = b.bin and t.idx = b.idx group by 1""")
def _(s, d):
    return sg.tail_profile(S(s, d), "score", ["volume", "unc"], "label", cal(s, d)).select("bin", "n", r("unlabelled"), r("stayed"), r("volume", 4), r("unc"))


LOG = """lg as (select id, idx r0, (11 - k) / sum(11 - k) over (partition by idx)::double w from (select id, idx, row_number() over (partition by d order by score desc, id) k from scores join cal using (d) where (idx - 1) % 5 = 0) where k <= 10),
 pi as (select id, idx, close from panel join cal using (d) where close > 0), rb as (select r0, coalesce(lead(r0) over (order by r0), (select max(idx) from cal)) r1, lead(r0) over (order by r0) nx from (select distinct r0 from lg)),
 hd as (select lg.*, r1, nx, close p0 from lg join rb using (r0) left join pi on pi.id = lg.id and pi.idx = lg.r0), sn as (select h.id, h.r0, nx, h.idx, h.w * coalesce(last_value(close ignore nulls) over (partition by h.id, h.r0 order by h.idx rows unbounded preceding) / p0, 1) v
 from (select *, unnest(range(r0, r1 + 1)) idx from hd) h left join pi on pi.id = h.id and pi.idx = h.idx), va as (select r0, idx, sum(v) t from sn group by 1, 2), dl as (select idx, t / lag(t) over (partition by r0 order by idx) - 1 ret from va),
 ol as (select id, idx, v / sum(v) over (partition by r0) o from sn where idx = nx), ch as (select coalesce(n.idx, ol.idx) idx, sum(greatest(coalesce(w, 0) - coalesce(o, 0), 0)) bought, sum(greatest(coalesce(o, 0) - coalesce(w, 0), 0)) sold from (select id, r0 idx, w from lg) n full join ol on n.id = ol.id and n.idx = ol.idx group by 1),
 pf as (select cal.d, coalesce(e.ret, 0) - coalesce(bought * 0.001 + sold * 0.004, 0) ret, bought from (select * from dl where ret is not null) e full join ch on e.idx = ch.idx join cal on cal.idx = coalesce(e.idx, ch.idx))"""


def holdings(s, d):
    days = cal(s, d)
    best = xs.top_n(S(s, d).join(F.broadcast(days.where("(idx - 1) % 5 = 0")), "d"), "score", 10).withColumn("w", 11 - F.col("rank"))
    log = best.withColumn("w", F.col("w") / F.sum("w").over(PANEL.day())).select("id", "d", "w")
    return sg.holdings_returns(log, "w", P(s, d), "close", days, 0.001, 0.004)


@query("e23_holdings_returns", sql("", "scores", "cal").rstrip() + f", {LOG} select d, round(ret, 6) ret, round(bought, 6) bought from pf")
def _(s, d):
    return holdings(s, d).select("d", r("ret"), r("bought"))


@query("e23_log_summary", sql("", "scores", "cal").rstrip() + f", {LOG} select count(ret) n, round(sum(ln(1 + ret)), 5) total, round(sum(ln(1 + ret)) * 52 / count(ret), 5) annual, round(case when count(ret) > 1 and stddev_pop(ret) > 0 then stddev_pop(ret) * 52 / sqrt(count(ret)) end, 5) stderr, count(bought) rebalances, round(avg(bought), 6) turnover from pf")
def _(s, d):
    return sg.log_summary(holdings(s, d), 52).select("n", F.round(F.log1p("total"), 5).alias("total"), F.round(F.log1p("annual"), 5).alias("annual"), r("stderr", 5), "rebalances", r("turnover"))


@query("e29_point_in_time", sql("", "panel").rstrip() + f", p as (select *, close same, lag(close) {W} before, lag(close) {W} stored from panel), l as (select d, stored, same raw, 'same' w from p union all select d, stored, before, 'before' from p), i as ({IC.format('l', 'd, w', 'stored', 'raw', 10)}), m as (select avg(ic) filter (w = 'same') same, avg(ic) filter (w = 'before') before from i) select round(same, 6) same, round(before, 6) before, case when round(before, 9) > round(same, 9) then 'lagged' else 'same day' end verdict from m")
def _(s, d):
    p = P(s, d).withColumn("before", F.lag("close").over(PANEL.series())).select("id", "d", F.col("close").alias("same"), "before", F.col("before").alias("stored"))
    return sg.point_in_time_check(p, "stored", "same", "before", 10).select(r("same"), r("before"), "verdict")


@query("e30_horizon_grid", sql("", "scores").rstrip() + f""", h as (select id, d, score, l5, l10, l20 from scores join (select id, d, {', '.join(f'round(lead(close, {n}) {W} / close - 1, 9) l{n}' for n in (5, 10, 20))} from panel) using (id, d)), l as (select * from h unpivot (v for name in (l5, l10, l20))),
 g as (select name, avg(g) gross from (select name, d, avg(v) g from (select *, row_number() over (partition by d, name order by score desc, id) k from l) where k <= 10 group by 1, 2) group by 1), i as ({IC.format('l', 'd, name', 'score', 'v', 10)})
 select name as label, round(avg(ic), 6) ic, count(ic) as days, round(any_value(gross), 6) gross, round(any_value(gross) - 0.003, 6) net from i join g using (name) group by 1""")
def _(s, d):
    p = P(s, d)
    for n in (5, 10, 20):
        p = ts.forward_return(p, "close", n, f"l{n}").withColumn(f"l{n}", F.round(f"l{n}", 9))
    p = S(s, d).select("id", "d", "score").join(p.select("id", "d", "l5", "l10", "l20"), ["id", "d"])
    return sg.horizon_grid(p, "score", ["l5", "l10", "l20"], 10, 0.003, 10).select("label", r("ic"), "days", r("gross"), r("net"))


@query("e31_universe_ic", sql("", "scores").rstrip() + f", c as (select * from scores where unc is not null and volume >= 30), m as (select (select avg(ic) from ({IC.format('scores', 'd', 'score', 'label', 10)})) own, (select avg(ic) from ({IC.format('c', 'd', 'score', 'label', 10)})) common) select round(own, 6) own, round(common, 6) common, round(common - own, 6) delta, case when abs(common - own) <= 0.005 then 'same' else 'differs' end verdict from m")
def _(s, d):
    p = S(s, d)
    return sg.universe_ic(p, p.where("unc is not null and volume >= 30"), "score", "label", 10, 0.005).select(r("own"), r("common"), r("delta"), "verdict")


# --- K: layers
RESIDUAL = f"""rs as (select id, d, round(x, 12) x from (select id, d, ret - avg(ret) over (partition by d) x, count(*) over (partition by id) n from rets where abs(ret) < 0.5 and d <= date '1997-12-31') where n >= 30),
 rw as (select * from rs where d in (select distinct d from rs order by d desc limit 120)), rp as (select a.id src, b.id dst, corr(a.x, b.x) c from rw a join rw b on a.d = b.d and a.id <> b.id group by 1, 2 having count(*) >= 5),
 re as (select src, dst, weight from (select *, row_number() over (partition by src order by weight desc, dst) k from (select src, dst, round(c, 7) weight from rp where isfinite(c)) where weight > 0.2) where k <= 5)"""


def residual_edges(s, d):
    res = ft.residual_returns(rets(s, d).where("d <= '1997-12-31'"), "ret", 0.5, 30, "res").withColumn("res", F.round("res", 12))
    return gr.rolling_correlation_edges(res, "res", 120, 0.2, 5, 5)


@query("k05_residual_edges", sql("", "rets").rstrip() + f", {RESIDUAL} select src, dst, round(weight, 6) weight from re")
def _(s, d):
    return residual_edges(s, d).select("src", "dst", r("weight"))


@query("k07_refreshed_layer", sql("", "rets", "cat").rstrip() + f""", {RESIDUAL}, ck as (select id, category, row_number() over (partition by category order by coalesce(size_v, 0) desc, id) r, count(*) over (partition by category) n from cat), cw as (select *, greatest(1, least(r - 2, n - 4)) lo from ck)
 select distinct a.id src, b.id dst, 1.0::double weight, 'category' kind from cw a join cw b on a.category = b.category and a.id <> b.id and (b.r <= 2 or b.r between a.lo and least(a.n, a.lo + 4)) union all select src, dst, round(weight, 6), 'correlation' from re""")
def _(s, d):
    kept = gr.category_peers(fx.categories(s, d), "category", "size_v", 2, 4, 1.0).withColumn("kind", F.lit("category"))
    old = kept.unionByName(kept.select("src", "dst", F.lit(0.0).alias("weight"), F.lit("correlation").alias("kind")))
    return gr.refresh_layer(old, residual_edges(s, d), "correlation").select("src", "dst", r("weight"), "kind")


# --- L, M: scores, exits, sizes and the ridge's grid
BASE = "(c1::int * 30 + c2::int * 25 + c4::int * 25 + c3::int * 20)"
MET = "array_to_string(list_filter([case when c1 then 'rank' end, case when c2 then 'sure' end, case when c4 then 'traded' end, case when c3 then 'low' end], lambda z: z is not null), ',')"


def conditions():
    return {"rank": (F.col("c1"), 30), "sure": (F.col("c2"), 25), "traded": (F.col("c4"), 25), "low": (F.col("c3"), 20)}


@query("l01_entry_score", sql("", "scores").rstrip() + f""", {FLAGS}, b as (select *, {BASE} base, case when volume > 20 then least(100, floor(volume)) end pat from fm), t as (select *, base + case when pat >= 90 then 40 when pat >= 75 then 30 when pat >= 60 then 20 else 0 end + case when pat >= 60 and k <= 5 then 10 else 0 end score_ from b)
 select id, d, base, score_ score, {MET} met, case when score_ >= case when d < date '1995-01-01' then 90 else 70 end then 'BUY' when base > 0 then 'WATCH' end verdict from t""")
def _(s, d):
    p = flagged(s, d).withColumn("pat", F.when(F.col("volume") > 20, F.least(F.lit(100), F.floor("volume"))))
    threshold = F.when(F.col("d") < F.lit("1995-01-01").cast("date"), 90).otherwise(70)
    out = sg.entry_scores(p, conditions(), threshold, F.col("pat"), TIERS, F.col("k") <= 5)
    return out.select("id", "d", "base", "score", F.array_join("met", ",").alias("met"), "verdict")


@query("l02_full_scan", sql("", "scores").rstrip() + f", {FLAGS} select id, d, k, {BASE} as score, {MET} met, case when {BASE} >= 70 then 'BUY' else 'WATCH' end verdict from fm where k <= 50 and {BASE} > 0")
def _(s, d):
    out = sg.entry_scores(flagged(s, d).where("k <= 50"), conditions(), F.lit(70)).where("verdict is not null")
    return out.select("id", "d", F.col("k").cast("long").alias("k"), "score", F.array_join("met", ",").alias("met"), "verdict")


STOP = "case when best >= 0.15 then 0.1 when best >= 0.1 then 0.06 when best >= 0.05 then 0.02 else -0.05 end"
POSITION = f"""ps as (select id, d, k, unc, close, hold, round(close / first_value(close) over h - 1, 9) gain, round(max(close) over h / first_value(close) over h - 1, 9) best, first_value(unc) over h unc0, unc < lag(unc) over h falling
 from (select *, ((row_number() {W} - 1) // 35) cohort, ((row_number() {W} - 1) % 35)::int hold from (select *, row_number() over (partition by d order by score desc, id) k from scores)) window h as (partition by id, cohort order by d))"""


@query("l03_exit_rules", sql("", "scores").rstrip() + f""", {POSITION}, f as (select *, list_filter([case when gain <= {STOP} then 'stop' end, case when hold >= 30 then 'time' end], lambda z: z is not null) l1, list_filter([case when unc0 > 0 and unc > 2 * unc0 then 'unsure' end], lambda z: z is not null) l2,
 list_filter([case when gain >= 0.2 then 'gain' end, case when falling and gain > 0.1 then 'calm' end], lambda z: z is not null) l3, list_filter([case when k > 20 then 'rank' end], lambda z: z is not null) l4 from ps)
 select id, d, case when len(l1) > 0 then 1 when len(l2) > 0 then 2 when len(l3) > 0 then 3 when len(l4) > 0 then 4 end layer, case when len(l1) > 0 or len(l2) > 0 then 'full' when len(l3) > 0 then 'half' when len(l4) > 0 then 'switch' end as action,
 array_to_string(case when len(l1) > 0 then l1 when len(l2) > 0 then l2 when len(l3) > 0 then l3 when len(l4) > 0 then l4 end, ',') reasons from f""")
def _(s, d):
    n = F.row_number().over(PANEL.series()) - 1
    p = xs.unique_rank(S(s, d), "score", "k").withColumns({"cohort": F.floor(n / 35), "hold": n % 35})
    w = Window.partitionBy("id", "cohort").orderBy("d")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("close").over(so_far)
    p = p.withColumns({
        "gain": F.round(F.col("close") / first - 1, 9), "best": F.round(F.max("close").over(so_far) / first - 1, 9),
        "unc0": F.first("unc").over(so_far), "falling": F.col("unc") < F.lag("unc").over(w),
    })
    stop = F.when(F.col("best") >= 0.15, 0.1).when(F.col("best") >= 0.1, 0.06).when(F.col("best") >= 0.05, 0.02).otherwise(-0.05)
    layers = [
        ("full", {"stop": F.col("gain") <= stop, "time": F.col("hold") >= 30}), ("full", {"unsure": (F.col("unc0") > 0) & (F.col("unc") > 2 * F.col("unc0"))}),
        ("half", {"gain": F.col("gain") >= 0.2, "calm": F.col("falling") & (F.col("gain") > 0.1)}), ("switch", {"rank": F.col("k") > 20}),
    ]
    return sg.exit_rules(p, layers).select("id", "d", "layer", "action", F.array_join("reasons", ",").alias("reasons"))


@query("l04_exit_metrics", sql("", "scores").rstrip() + f", k as (select id, d, row_number() over (partition by d order by score desc, id) k, count(*) over (partition by d) n from scores), s as (select *, sum(case when k > 20 then 0 else 1 end) {W} island from k) select id, d, k, round((k - 1) / n::double, 6) pct, sum((k > 20)::int) over (partition by id, island order by d)::bigint out_streak from s qualify k <= 300")
def _(s, d):
    p = xs.unique_rank(S(s, d), "score", "k").withColumn("n", F.count(F.lit(1)).over(PANEL.day()))
    p = ts.streak(p, F.col("k") > 20, "out_streak").where("k <= 300")
    return p.select("id", "d", F.col("k").cast("long").alias("k"), F.round((F.col("k") - 1) / F.col("n"), 6).alias("pct"), "out_streak")


YEARS = [f"{y}-12-31" for y in range(1993, 1999)]


def patterns(s, d):
    """The shapes at each entity's last row of every year so far; rank by score on that row."""
    p = P(s, d).join(xs.unique_rank(S(s, d), "score", "k").select("id", "d", "k"), ["id", "d"], "left")
    ends = F.array(*[F.lit(y).cast("date") for y in YEARS])
    p = p.withColumn("at", F.explode(F.filter(ends, lambda y: y >= F.col("d")))).withColumn("key", F.struct("id", "at"))
    return pt.scan(p, "k", spec=PanelSpec("key"))


@query("l05_pattern_scan", None)
def _(s, d):
    return patterns(s, d).select("key.id", "key.at", *pt.COLUMNS)


@query("l05_pattern_signals", None)
def _(s, d):
    return pt.signals(patterns(s, d), spec=PanelSpec("key")).select("key.id", "key.at", *pt.COLUMNS)


@query("l01_pattern_entry", None)
def _(s, d):
    """Entry scores with the best rising shape of the last scan, valid for a year."""
    best = patterns(s, d).where("side = 'bull'").groupBy("key").agg(F.max("score").alias("pat")).select("key.id", F.col("key.at").alias("d"), "pat")
    p = pit.as_of(flagged(s, d), best, "d", ["pat"], tolerance=365)
    threshold = F.when(F.col("d") < F.lit("1995-01-01").cast("date"), 90).otherwise(70)
    out = sg.entry_scores(p, conditions(), threshold, F.col("pat"), TIERS, F.col("k") <= pt.CONFIRMED)
    return out.select("id", "d", "pat", "base", "score", F.array_join("met", ",").alias("met"), "verdict")


@query("l04_pattern_stop", None)
def _(s, d):
    """The closest failure level of the last scan's rising shapes, and whether the close has fallen under it."""
    stop = pt.signals(patterns(s, d), spec=PanelSpec("key")).where("side = 'bull'").groupBy("key").agg(F.max("failure").alias("stop")).select("key.id", F.col("key.at").alias("d"), "stop")
    p = pit.as_of(S(s, d), stop, "d", ["stop"], tolerance=365).where("stop is not null")
    return p.select("id", "d", r("close"), "stop", (F.col("close") < F.col("stop")).alias("broken"))


@query("l06_trend_lines", None)
def _(s, d):
    """Support and resistance of every window at the panel's end, and how often they were touched."""
    rows = pt.prepared(pt.windows(P(s, d))).withColumn("t", pt.trend_lines()).where("t is not null")
    return rows.select("id", "frame", F.round("t.r.slope", 6).alias("resistance"), F.round("t.s.slope", 6).alias("support"), F.col("t.touches").alias("touches"))


@query("l06_pattern_helpers", sql(f"""select id, d, round(coalesce(volume / nullif(case when n >= 5 then av end, 0), 1), 6) ratio, case when fall > 0.7 then 20 when fall > 0.5 then 15 when fall > 0.3 then 10 else 0 end points, case when close > lo and hi > close then printf('1:%.1f', (hi - close) / (close - lo)) else 'N/A' end reward from (
 select id, d, close, volume, count(*) over b n, avg(volume) over b av, max(close) over c hi, min(close) over c lo, (max(close) over c - min(close) over c) / max(close) over c fall from panel window b as (partition by id order by d rows between 5 preceding and 1 preceding), c as (partition by id order by d rows between 59 preceding and current row))""", "panel"))
def _(s, d):
    w = PANEL.series(60)
    p = sg.volume_ratio(P(s, d), "volume", "ratio").withColumns({"hi": F.max("close").over(w), "lo": F.min("close").over(w)})
    points, reward = sg.drawdown_points(F.col("hi"), F.col("lo"), FALLS), sg.risk_reward(F.col("hi"), F.col("close"), F.col("lo"))
    return p.select("id", "d", r("ratio"), points.alias("points"), reward.alias("reward"))


@query("l08_position_sizes", sql("", "scores", "cat").rstrip() + """, b as (select * from (select s.id, d, category, score, row_number() over (partition by d order by score desc, s.id) k from scores s join cat using (id) where score > 0) where k <= 40), w as (select *, greatest(0.03, least(0.15, score / sum(score) over (partition by d) * 0.95)) w from b),
 g as (select *, round(case when t > 0.4 then w * 0.4 / t else w end, 9) v from (select *, sum(w) over (partition by d, category) t from w)), n as (select *, row_number() over (partition by d order by v desc, k) j from g), o as (select id, d, round(v / sum(v) over (partition by d) * 0.95, 4) weight from n where j <= 20) select * from o where weight >= 0.03""")
def _(s, d):
    p = S(s, d).join(fx.categories(s, d).select("id", "category"), "id")
    return sg.position_sizes(p, "score", "category", "weight").select("id", "d", "weight")


GRID = """t as (select count(*)::double n, avg(score) mx, avg(unc) mz, stddev_pop(score) sx, stddev_pop(unc) sz, corr(score, unc) rho, covar_pop(score, label) / stddev_pop(score) gx, covar_pop(unc, label) / stddev_pop(unc) gz from scores where d < date '1996-01-01' and score is not null and unc is not null and label is not null),
 b as (select al, mx, mz, ((1 + al / n) * gx - rho * gz) / ((1 + al / n) * (1 + al / n) - rho * rho) / sx bx, ((1 + al / n) * gz - rho * gx) / ((1 + al / n) * (1 + al / n) - rho * rho) / sz bz from t, (values (1.0::double), (1000.0), (100000.0)) v(al)),
 l as (select d, label, al, round(bx * (coalesce(score, 0) - mx) + bz * (coalesce(unc, 0) - mz), 10) s from scores, b where d >= date '1996-01-01')"""


@query("m02_ridge_grid", sql("", "scores").rstrip() + f", {GRID} select al alpha, round(avg(ic), 3) ic from ({IC.format('l', 'd, al', 's', 'label', 10)}) group by 1")
def _(s, d):
    p = S(s, d)
    grid = sg.ridge_grid(p.where("d < '1996-01-01'"), p.where("d >= '1996-01-01'"), ["score", "unc"], "label", [1.0, 1000.0, 100000.0], 10)
    return grid.select("alpha", r("ic", 3))

