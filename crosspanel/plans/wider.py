"""Registered queries of user functions, memberships, theoretical values, and further variants of indicators and checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import callables as cb
from ..operators import evaluate as ev
from ..operators import graph as gr
from ..operators import pit
from ..operators import quality as dq
from ..operators import strategy as st
from ..operators import timeseries as ts
from ..sources import files
from ..sources import fixtures as fx
from ..spec import PANEL
from .catalog import P, RSV, S, W, W_, bench, ewm_sql, ics, query, r, rets, sql
from .more import FOLDS, cal


# --- O: user functions over blocks of 50 rows, so that every entity is cut
def span(table: pa.Table) -> pa.Table:
    """Largest less smallest close of the last ten rows."""
    c = table.column("close").to_numpy()
    wide = np.array([c[max(0, i - 9) : i + 1].max() - c[max(0, i - 9) : i + 1].min() for i in range(len(c))])
    return table.select(["id", "d"]).append_column("span", pa.array(wide))


@query("o01_group_transform", sql(f"select id, d, round(max(close) {W_(10)} - min(close) {W_(10)}, 6) span from panel", "panel"))
def _(s, d):
    p = P(s, d).select("id", "d", "close")
    return cb.transform_groups(p, ["id"], ["d"], span, "id long, d date, span double", context=9, block_rows=50).select("id", "d", r("span"))


def product_sums(table: pa.Table) -> pa.Table:
    x, y = (table.column(c).to_numpy() for c in ("score", "label"))
    known = ~(np.isnan(x) | np.isnan(y))
    x, y = x[known], y[known]
    sums = {"n": float(len(x)), "x": x.sum(), "y": y.sum(), "xx": (x * x).sum(), "yy": (y * y).sum(), "xy": (x * y).sum()}
    return pa.table({"d": table.column("d").slice(0, 1), **{k: pa.array([v], pa.float64()) for k, v in sums.items()}})


def correlation(table: pa.Table) -> pa.Table:
    n, x, y, xx, yy, xy = (table.column(c).to_numpy().sum() for c in ("n", "x", "y", "xx", "yy", "xy"))
    with np.errstate(all="ignore"):
        c = (xy - x * y / n) / np.sqrt((xx - x * x / n) * (yy - y * y / n)) if n else np.nan
    return pa.table({"d": table.column("d").slice(0, 1), "ic": pa.array([float(c) if n >= 10 and np.isfinite(c) else None], pa.float64()), "n": pa.array([int(n)], pa.int64())})


@query("o02_date_reducer", sql("select d, round(case when count(*) filter (label is not null) >= 10 then corr(score, label) end, 6) ic, count(*) filter (label is not null) n from scores group by d", "scores"))
def _(s, d):
    p = S(s, d).select("d", "score", "label")
    return cb.reduce_groups(p, ["d"], product_sums, correlation, "d date, n double, x double, y double, xx double, yy double, xy double", "d date, ic double, n long").select("d", r("ic"), "n")


def jumps(table: pa.Table) -> pa.Table:
    c = table.column("close").to_numpy()
    at = 1 + np.flatnonzero(np.abs(c[1:] / c[:-1] - 1) > 0.5)
    return table.select(["id", "d"]).take(pa.array(at)).append_column("value", pa.array(c[at] / c[at - 1] - 1))


def tops(table: pa.Table) -> pa.Table:
    c = table.column("close").to_numpy()
    at = np.array([i for i in range(19, len(c)) if c[i] == c[i - 19 : i + 1].max()], np.int64)
    return table.select(["id", "d"]).take(pa.array(at)).append_column("value", pa.array(c[at]))


@query("o03_detectors", sql(f"""select id, d, 'jump' detector, round(ret, 6) as value from rets where abs(ret) > 0.5 union all
 select id, d, 'top', round(close, 6) from (select *, max(close) {W_(20)} m, row_number() {W} n from panel) where n >= 20 and close = m""", "rets"))
def _(s, d):
    found = cb.detect(P(s, d).select("id", "d", "close"), "id", "d", {"jump": jumps, "top": tops}, "id long, d date, value double", context=19, block_rows=50)
    return found.select("id", "d", "detector", r("value"))


@query("o04_fold_scores", sql("", "scores", "cal").rstrip() + f""", {FOLDS}, p as (select s.*, idx from scores s join cal using (d) where label is not null), t as (select fold, covar_pop(score, label) / var_pop(score) b, avg(score) mx, avg(label) my from p join folds on idx between train_from and train_to group by fold)
 select fold, id, d, round(my + b * (score - mx), 6) pred from p join folds on idx between test_from and test_to join t using (fold)""")
def _(s, d):
    days = files.written(cal(s, d))
    p = S(s, d).where("label is not null").join(F.broadcast(days), "d").select("id", "d", "idx", "score", "label")

    def fit(rows):
        return rows.agg(F.expr("covar_pop(score, label) / var_pop(score)").alias("b"), F.avg("score").alias("x"), F.avg("label").alias("y")).first()

    def score(rows, m):
        return rows.select("id", "d", (F.lit(m.y) + F.lit(m.b) * (F.col("score") - F.lit(m.x))).alias("pred"))

    return cb.fold_scores(p, st.purged_folds(days, 104, 26, 26, 5, 2), "idx", fit, score).select("fold", "id", "d", r("pred"))


# --- K: memberships (of the months and flags of an entity's largest lines)
MEMBERS = "mb as (select distinct l_suppkey id, strftime(l_shipdate, '%Y-%m') || ':' || l_returnflag grp from lineitem where l_quantity >= 49)"
UNIVERSE = "un as (select s_suppkey id from supplier where s_acctbal > 0)"


def memberships(s, d):
    line = fx.read(s, d, "lineitem").where("l_quantity >= 49")
    members = line.select(F.col("l_suppkey").alias("id"), F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit(":"), F.col("l_returnflag")).alias("grp")).distinct()
    return members, fx.read(s, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))


@query("k02_membership_edges", f"with {MEMBERS}, {UNIVERSE} select id src, grp dst, 0.8::double weight from (select *, count(*) over (partition by grp) n from mb semi join un using (id)) where n > 1")
def _(s, d):
    members, universe = memberships(s, d)
    return gr.membership_edges(members, "grp", universe, 0.8)


@query("k02_members_outside", f"with {MEMBERS}, {UNIVERSE} select id, grp from mb anti join un using (id)")
def _(s, d):
    members, universe = memberships(s, d)
    return gr.members_outside(members, "grp", universe)


@query("k02_group_neighbours", f"with {MEMBERS}, {UNIVERSE}, k as (select * from mb semi join un using (id)) select src, dst, shared from (select a.id src, b.id dst, count(*) shared, row_number() over (partition by a.id order by count(*) desc, b.id) j from k a join k b on a.grp = b.grp and a.id <> b.id group by 1, 2) where j <= 10")
def _(s, d):
    members, universe = memberships(s, d)
    edges = gr.membership_edges(members, "grp", universe)
    return gr.group_neighbours(edges, edges.select(F.col("src").alias("id")).distinct(), 10)


# --- D25: theoretical values; an event's parts come on two dates, its rate in per cent
EVENTS = """e as (select l_suppkey id, cast(l_shipdate as date) cash_d, case when l_linenumber % 2 = 0 then cast(l_shipdate as date) else cast(l_shipdate as date) + 10 end stock_d, l_discount * 100 cash, l_tax stock, l_tax * 100 rate from lineitem where l_returnflag = 'R' and l_discount > 0),
 pa as (select id, d, sum(cash) cash, sum(stock) stock, sum(rate) rate from (select id, cash_d d, cash, 0.0 stock, 0.0 rate from e union all select id, stock_d, 0.0, stock, rate from e) group by 1, 2),
 of as (select pa.id, pa.d, case when id % 2 = 0 then 'a' else 'b' end kind, 1000.0::double bef, (1000.0 - cash + 10.0 * rate / 100) / (1 + stock + rate / 100) * (1 + (id % 7) * 0.0003) official from pa),
 ra as (select kind, unit, (bef - cash + 10.0 * rate / unit) / (1 + stock + rate / unit) / official x from of join pa using (id, d), (values (1.0::double), (100.0), (1000.0)) v(unit))"""


@query("d25_reference_check", f"""with {EVENTS} select kind, unit, count(*) n, round(avg((abs(x - 1) <= 0.0005)::int), 6) w0, round(avg((abs(x - 1) <= 0.001)::int), 6) w1, round(avg((abs(x - 1) <= 0.01)::int), 6) w2, round(quantile_cont(x, 0.5), 6) as median,
 unit = (select unit from ra group by unit order by avg((abs(x - 1) <= 0.001)::int) desc, unit limit 1) chosen from ra group by 1, 2""")
def _(s, d):
    line = fx.read(s, d, "lineitem").where("l_returnflag = 'R' and l_discount > 0")
    ship = F.to_date("l_shipdate")
    raw = line.select(F.col("l_suppkey").alias("id"), ship.alias("cash_d"), F.when(F.col("l_linenumber") % 2 == 0, ship).otherwise(F.date_add(ship, 10)).alias("stock_d"), (F.col("l_discount") * 100).alias("cash"), F.col("l_tax").alias("stock"), (F.col("l_tax") * 100).alias("rate"))
    parts = dq.event_parts(raw, {"cash_d": ["cash"], "stock_d": ["stock", "rate"]}, ["cash", "stock", "rate"]).withColumn("price", F.lit(10.0))
    value = dq.reference_value(F.lit(1000.0), F.col("cash"), F.col("stock"), F.col("rate") / 100, F.col("price")) * (1 + (F.col("id") % 7) * 0.0003)
    official = parts.select("id", "d", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("kind"), F.lit(1000.0).alias("bef"), value.alias("official"))
    out = dq.reference_check(official, parts, "official", "bef", [1.0, 100.0, 1000.0], [0.0005, 0.001, 0.01], ["kind"])
    return out.select("kind", "unit", "n", *[F.round(f"within_{k}", 6).alias(f"w{k}") for k in range(3)], r("median"), "chosen")


# --- F: further variants
MOVES = "(select id, d, case when x is not null then greatest({} x, 0.0) end {} from (select id, d, close - lag(close) over (partition by id order by d) x from panel))"


@query("f05_rsi_adjusted", sql(f"select u.id, u.d, round(100 - 100 / (1 + u.value / nullif(v.value, 0)), 5) rsi, round(100 - 100 / (1 + u.value / case when v.value = 0 then 1e-10 else v.value end), 5) floored from ({ewm_sql('up', 1 / 14, True, MOVES.format('', 'up'))}) u join ({ewm_sql('down', 1 / 14, True, MOVES.format('-', 'down'))}) v on u.id = v.id and u.d = v.d where u.seen >= 14", "panel"))
def _(s, d):
    p = ts.rsi(ts.rsi(P(s, d), "close", "rsi", 1 / 14, True), "close", "floored", 1 / 14, True, floor=1e-10)
    return p.withColumn("k", F.count("close").over(PANEL.past())).where("k >= 15").select("id", "d", r("rsi", 5), r("floored", 5))


@query("f05_rsi_window", sql(f"""select id, d, round(case when n < 16 then 50 else 100 - 100 / (1 + g / (l + 1e-10)) end, 5) rsi from (select id, d, n, list_reduce(list_prepend(list_avg(m[1:14]), list_transform(m[15:], lambda x: x)), lambda a, x: (a * 13 + x) / 14) g, list_reduce(list_prepend(list_avg(k[1:14]), k[15:]), lambda a, x: (a * 13 + x) / 14) l, 
 from (select id, d, len(c) n, list_transform(range(2, len(c) + 1), lambda i: greatest(c[i] - c[i - 1], 0.0)) m, list_transform(range(2, len(c) + 1), lambda i: greatest(c[i - 1] - c[i], 0.0)) k from (select id, d, list(close) {W_(60)} c from panel)))""", "panel"))
def _(s, d):
    return ts.rsi_window(P(s, d), "close", "rsi", 60).select("id", "d", r("rsi", 5))


@query("f07_stochastic_d", sql(f"select id, d, round(value, 5) as d_line from ({ewm_sql('k', 1 / 3, False, '(select id, d, value k from (' + ewm_sql('rsv', 1 / 3, False, RSV) + ') where seen > 0)')})", "panel"))
def _(s, d):
    p = ts.rolling(ts.rolling(P(s, d), "low", "min", 9, 5, "lo"), "high", "max", 9, 5, "hi")
    p = ts.ewm(p.withColumn("rsv", F.expr("100 * (close - lo) / (hi - lo + 1e-9)")), "rsv", 1 / 3, False, "k").withColumn("c", F.count("rsv").over(PANEL.past())).where("c > 0")
    return ts.ewm(p, "k", 1 / 3, False, "d_line").select("id", "d", r("d_line", 5))


MACD = f"(select a.id, a.d, a.value - b.value macd from ({ewm_sql('close', 2 / 13, False, 'panel')}) a join ({ewm_sql('close', 2 / 27, False, 'panel')}) b on a.id = b.id and a.d = b.d)"


@query("f09_macd_signal", sql(f"select m.id, m.d, round(s.value, 4) as signal, round(m.macd - s.value, 4) histogram from {MACD} m join ({ewm_sql('macd', 2 / 10, False, MACD)}) s on m.id = s.id and m.d = s.d", "panel"))
def _(s, d):
    p = ts.ewm(ts.ewm(P(s, d), "close", 2 / 13, False, "fast"), "close", 2 / 27, False, "slow").withColumn("macd", F.expr("fast - slow"))
    return ts.ewm(p, "macd", 2 / 10, False, "signal").select("id", "d", r("signal", 4), F.round(F.expr("macd - signal"), 4).alias("histogram"))


@query("f10_band_width", sql(f"select id, d, round(4 * s / nullif(m, 0), 6) width, round(volume / nullif(v, 0), 6) volume_ratio from (select *, avg(close) {W_(20)} m, stddev_samp(close) {W_(20)} s, count(close) {W_(20)} c, avg(volume) {W_(20)} v from panel) where c >= 20", "panel"))
def _(s, d):
    p = ts.rolling(ts.rolling(ts.rolling(P(s, d), "close", "avg", 20, 20, "m"), "close", "stddev_samp", 20, 20, "s"), "volume", "avg", 20, 20, "v").where("m is not null")
    return p.select("id", "d", F.round(F.expr("4 * s / nullif(m, 0)"), 6).alias("width"), F.round(F.expr("volume / nullif(v, 0)"), 6).alias("volume_ratio"))


@query("f20_relative_returns", sql(f"""select id, d, {', '.join(f'round(lead(close, {n}) {W} / close - 1, 6) f{n}, round(lead(close, {n}) {W} / close - 1 - (lead(lvl, {n}) {W} / lvl - 1), 6) r{n}' for n in (5, 10, 20, 60))} from panel left join (select d, exp(sum(ln(1 + ret)) over (order by d)) lvl from bench) using (d)""", "bench"))
def _(s, d):
    level = bench(s, d).select("d", F.exp(F.sum(F.log1p("ret")).over(Window.orderBy("d"))).alias("lvl"))  # one row a date
    p = P(s, d).join(F.broadcast(level), "d", "left")
    for n in (5, 10, 20, 60):
        p = ts.forward_return(ts.forward_return(p, "close", n, f"f{n}"), "lvl", n, f"b{n}").withColumn(f"r{n}", F.col(f"f{n}") - F.col(f"b{n}"))
    return p.select("id", "d", *[r(f"{x}{n}") for n in (5, 10, 20, 60) for x in "fr"])


@query("f21_realised_volatility", sql(f"select id, d, round(case when count(x) {W_(10)} >= 10 then stddev_samp(x) {W_(10)} * sqrt(52.0) * 100 end, 4) vol from (select id, d, ln(close / lag(close) {W}) x from panel)", "panel"))
def _(s, d):
    p = P(s, d).withColumn("x", F.log(F.col("close") / F.lag("close").over(PANEL.series())))
    return ts.rolling(p, "x", "stddev_samp", 10, 10, "vol").select("id", "d", F.round(F.col("vol") * F.sqrt(F.lit(52.0)) * 100, 4).alias("vol"))


# --- B, C, E: guards, colliding columns, adjusted prices, health of a signal, segments
@query("b14_stale_regime", sql("""select d, case when seen is null or d - seen > 10 then 90 when lvl >= mean then 70 else 90 end threshold from (select d, b.d seen, lvl, mean from (select distinct d from panel) p asof left join
 (select d, lvl, avg(lvl) over (order by d rows between 59 preceding and current row) mean from (select d, round(avg(close), 9) lvl from panel where month(d) <> 8 group by d)) b on p.d >= b.d)""".replace("select d, b.d seen", "select p.d, b.d seen"), "panel"))
def _(s, d):
    level = P(s, d).where(F.month("d") != 8).groupBy("d").agg(F.round(F.avg("close"), 9).alias("lvl"))
    level = level.select("d", F.col("d").alias("seen"), (F.col("lvl") >= F.avg("lvl").over(Window.orderBy("d").rowsBetween(-59, 0))).alias("up"))  # one row a date
    days = pit.market_as_of(P(s, d).select("d").distinct(), level, "d", ["seen", "up"])
    fresh = F.datediff("d", "seen") <= 10
    return days.select("d", F.when(fresh & F.col("up"), 70).otherwise(90).alias("threshold"))


@query("c01_side_join", sql(f"""select id, d, round(coalesce(p.close, n.close), 6) as close, coalesce(last_value(n.flow ignore nulls) over (partition by id order by d rows between unbounded preceding and current row), 0) flow
 from (select id, d, case when id % 4 <> 0 then close end as close from panel) p left join (select id, d, close + 1 as close, volume flow from panel where id % 3 <> 0 and month(d) % 2 = 0) n using (id, d)""", "panel"))
def _(s, d):
    base = P(s, d).select("id", "d", F.when(F.col("id") % 4 != 0, F.col("close")).alias("close"))
    side = P(s, d).where("id % 3 <> 0 and month(d) % 2 = 0").select("id", "d", (F.col("close") + 1).alias("px"), F.col("volume").alias("vol"))
    out = pit.side_join(base, side, {"px": "close", "vol": "flow"}, {"flow": F.lit(0.0)})
    return out.select("id", "d", r("close"), "flow")


@query("c13_adjusted_prices", sql("""select id, d, round(close * m, 5) as close, round(high * m, 5) high, round(low * m, 5) low, round(open * m, 5) as open, round(close, 5) back from (select p.*, coalesce((select product(adj_factor) from ex where ex.id = p.id and ex.d > p.d), 1) m from panel p)""", "panel", "ex"))
def _(s, d):
    cols = ["open", "high", "low", "close"]
    out = pit.adjust_prices(P(s, d).withColumn("raw", F.col("close")), fx.adjustments(s, d), "adj_factor", cols)
    back = pit.adjust_prices(out.withColumn("back", F.col("close")), fx.adjustments(s, d), "adj_factor", ["back"], invert=True)
    return back.select("id", "d", *[r(c, 5) for c in cols], r("back", 5))


@query("e08_signal_health", sql("""select era, round(avg(ic), 6) mean, count(m60) n, round(avg((m60 < 0)::int), 6) negative, coalesce(max(run), 0)::bigint longest from (select *, case when m60 < 0 then count(*) over (partition by era, grp, m60 < 0 order by d) end run from (
 select *, sum(case when m60 < 0 then 0 else 1 end) over (partition by era order by d) grp from (select year(d)::bigint era, d, ic, case when count(ic) over w >= 60 then round(avg(ic) over w, 9) end m60 from ics window w as (order by d rows between 59 preceding and current row)))) group by era""", "ics"))
def _(s, d):
    return ev.signal_health(ics(s, d), "ic", 60).select("era", r("mean"), "n", r("negative"), "longest")


@query("e25_segment_returns", sql("", "scores", "bench").rstrip() + """, sg as (select d, case when n >= 20 then case when x >= 0 then 'up' else 'down' end end seg from (select d, count(ret) over w n, exp(sum(ln(1 + ret)) over w) - 1 x from bench window w as (order by d rows between 19 preceding and current row))),
 ps as (select d, avg(label) ret from (select *, row_number() over (partition by d order by score desc, id) k from scores where label is not null) where k <= 10 group by d)
 select seg, count(*) n, round(avg(ret), 6) mean, round(exp(avg(ln(1 + ret)) * 52.0 / 5) - 1, 5) annual, round(avg((ret > 0)::int), 6) hit from ps join sg using (d) where seg is not null group by seg""")
def _(s, d):
    from ..operators import crosssection as xs

    top = xs.top_n(S(s, d).where("label is not null"), "score", 10).groupBy("d").agg(F.avg("label").alias("ret"))
    seg = ev.segment_by_trend(bench(s, d), "ret", 20, "seg").select("d", "seg")
    return ev.segment_performance(top, seg, "ret", 52.0 / 5).select("seg", "n", r("mean"), r("annual", 5), r("hit"))
