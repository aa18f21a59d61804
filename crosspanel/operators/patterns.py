"""Chart patterns: seven shapes over windows of each entity's last rows, in array functions only.

An entity's last rows become arrays of at most ``max(rows)`` numbers, one row for each window, so nothing grows with the history.
A window's swing points (places of local lows and highs) are found once; a shape is an array of candidates over neighbouring swing
points, each null unless all of its rules hold, and the best candidate is the window's. Windows run side by side; the only shuffle
is the one that brings an entity's rows together.

Defined results: rows with a null entity or time, or without a close, take no part; an entity with fewer rows than a window has no
row for it; high, low and volume may be null, and a rule that needs one does not hold; of equal scores the earliest candidate counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..spec import PANEL, PanelSpec

# Windows (name, rows, rows on either side of a swing point), least score, ranks and their bonus
FRAMES = (("short", 30, 3), ("medium", 60, 8), ("long", 120, 15), ("season", 180, 30))
LEAST, CONFIRMED, BONUS = 60, 200, ((200, 10), (300, 5))
FALLS = ((0.7, 20), (0.5, 15), (0.3, 10))
EPS = 1e-10
BEARISH_FROM = 60

Found = Callable[[Column], Column]


def let(value: Column, body: Found) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(first: Column | int, end: Column | int) -> Column:
    """The places first, ..., end - 1; none if there are none."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (first, end))
    a, b = a.cast("int"), b.cast("int")
    return F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))


def part(values: Column, first: Column | int, end: Column | int) -> Column:
    """values[first], ..., values[end - 1]."""
    a, b = (F.lit(x) if isinstance(x, int) else x for x in (first, end))
    return F.slice(values, a.cast("int") + 1, F.greatest(b.cast("int") - a.cast("int"), F.lit(0)))


def mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def windows(panel: DataFrame, frames=FRAMES, spec: PanelSpec = PANEL, close: str = "close", high: str = "high", low: str = "low", volume: str = "volume") -> DataFrame:
    """entity, frame, rows, order, c, h, l, v: the last rows of each entity, oldest first, for each window it has enough rows for."""
    most = max(rows for _, rows, _ in frames)
    last = Window.partitionBy(spec.entity).orderBy(F.col(spec.date).desc())
    bars = [F.col(x).cast("double").alias(y) for x, y in ((close, "c"), (high, "h"), (low, "l"), (volume, "v"))]
    rows = panel.where(F.col(spec.entity).isNotNull() & F.col(spec.date).isNotNull() & F.col(close).isNotNull())
    rows = rows.withColumn("_k", F.row_number().over(last)).where(F.col("_k") <= most)
    kept = rows.groupBy(spec.entity).agg(F.array_sort(F.collect_list(F.struct((-F.col("_k")).alias("k"), *bars))).alias("bars"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("frame"), F.lit(n).alias("rows"), F.lit(order).alias("order")) for name, n, order in frames]))
    out = kept.select(spec.entity, "bars", each.alias("x")).select(spec.entity, "bars", "x.*").where(F.size("bars") >= F.col("rows"))
    out = out.withColumn("bars", F.slice("bars", -F.col("rows"), F.col("rows")))
    return out.select(spec.entity, "frame", "rows", "order", *[F.col(f"bars.{x}").alias(x) for x in "chlv"])


def swings(values: Column, order: Column, high: bool) -> Column:
    """Places whose value is the largest (or smallest) among ``order`` rows on either side; of neighbouring such places the first."""
    extreme = F.array_max if high else F.array_min
    is_one = lambda i: F.get(values, i) == extreme(part(values, i - order, i + order + 1))
    flags = F.transform(upto(order, F.size(values) - order), lambda i: F.struct(i.alias("i"), F.coalesce(is_one(i), F.lit(False)).alias("on")))
    first = let(flags, lambda f: F.filter(f, lambda x, k: x["on"] & ((k == 0) | ~F.get(f, k - 1)["on"])))
    return F.transform(first, lambda x: x["i"])


def relative_strength(c: Column, period: int = 14) -> Column:
    """The last value of the smoothed index of gains over losses; 50 with fewer than ``period + 2`` rows."""
    steps = F.transform(upto(1, F.size(c)), lambda i: F.get(c, i) - F.get(c, i - 1))

    def smooth(s: Column, sign: int) -> Column:
        moves = F.transform(s, lambda x: F.greatest(x * sign, F.lit(0.0)))
        return let(moves, lambda m: F.aggregate(part(m, period, F.size(m)), mean(part(m, 0, period)), lambda a, x: (a * (period - 1) + x) / period))

    index = let(steps, lambda s: 100 - 100 / (1 + smooth(s, 1) / (smooth(s, -1) + EPS)))
    return F.when(F.size(c) >= period + 2, index).otherwise(50.0)


def prepared(rows: DataFrame) -> DataFrame:
    """The windows with last close, peak, index and swing points."""
    rows = rows.withColumns({"last": F.element_at("c", -1), "peak": F.array_max("c"), "rsi": relative_strength(F.col("c"))})
    of = {"low_c": ("c", False), "high_c": ("c", True), "low_l": ("l", False), "high_h": ("h", True)}
    return rows.withColumns({name: swings(F.col(x), F.col("order"), high) for name, (x, high) in of.items()})


def _tiers(value: Column, tiers, otherwise: int, below: bool = False) -> Column:
    """Points of the first tier whose bound the value reaches (or stays below)."""
    return F.coalesce(*[F.when((value < bound) if below else (value >= bound), F.lit(points)) for bound, points in tiers], F.lit(otherwise))


def _fall(low: Column) -> Column:
    fall = F.when((F.col("peak") > 0) & (low > 0), (F.col("peak") - low) / F.col("peak"))
    return F.coalesce(*[F.when(fall > more, F.lit(points)) for more, points in FALLS], F.lit(0))


def _form(share: Column) -> Column:
    return F.floor(40 * F.greatest(F.lit(0.0), 1 - share)).cast("int")


def _surge(at: Column) -> Column:
    """Volume at a place over the mean of the five before; 1 where there are none."""
    before = mean(part(F.col("v"), at - 5, at))
    return F.when(at >= 5, F.coalesce(F.when(before > 0, F.get(F.col("v"), at) / (before + EPS)), F.lit(1.0))).otherwise(1.0)


def _points(value: Column) -> Column:
    return F.least(F.lit(30), F.floor(value).cast("int"))


def _result(score: Column, bonus: Column | int, key: Column, target: Column, stop: Column, failure: Column) -> Column:
    bonus = F.lit(bonus) if isinstance(bonus, int) else bonus
    return F.struct(
        score.cast("int").alias("score"), bonus.cast("int").alias("bonus"), key.alias("key"), target.alias("target"), stop.alias("stop"), failure.alias("failure")
    )


def _best(candidates: Column) -> Column:
    """The candidate of the highest score, the first of equals; candidates that are null are none."""
    numbered = F.transform(candidates, lambda x, i: F.when(x.isNotNull(), F.struct(x["score"].alias("score"), (-i).alias("k"), x.alias("x"))))
    return F.array_max(numbered)["x"]


def _between(places: Column, a: Column, b: Column) -> Column:
    return F.filter(places, lambda i: (i > a) & (i < b))


def _values(places: Column) -> Column:
    return F.transform(places, lambda i: F.get(F.col("c"), i))


def _neck(swing: str, a: Column, b: Column, highest: bool) -> Column:
    """The outermost close at the swing points between two places, or of all rows from one to the other."""
    pick = F.array_max if highest else F.array_min
    return F.coalesce(pick(_values(_between(F.col(swing), a, b))), pick(part(F.col("c"), a, b + 1)))


def _pairs(swing: str, body: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """``body`` (two places and their closes) of neighbouring swing points."""
    p = F.col(swing)
    at = lambda i: F.get(F.col("c"), i)
    one = lambda i: let(F.struct(F.get(p, i).alias("a"), F.get(p, i + 1).alias("b")), lambda x: body(x["a"], x["b"], at(x["a"]), at(x["b"])))
    return _best(F.transform(upto(0, F.size(p) - 1), one))


def double_bottom() -> Column:
    """Two lows within 5 %, a neck 3 % above them, and a close near or over it."""

    def body(a: Column, b: Column, x: Column, y: Column) -> Column:
        low, middle, spread = F.least(x, y), (x + y) / 2, F.abs(x - y) / F.greatest(x, y)
        score = _form(spread / 0.05) + _points(30 * F.least(_surge(b) / 1.5, F.lit(1.0))) + _fall(low) + _tiers(F.col("rsi"), ((50, 10), (45, 7)), 3)
        made = lambda neck: F.when(
            (spread <= 0.05) & ((neck - middle) / middle >= 0.03) & (F.col("last") >= neck * 0.95),
            _result(score, F.when(spread < 0.02, 10).otherwise(0), neck, neck + (neck - middle), low * 0.97, low),
        )
        return let(_neck("high_c", a, b, True), made)

    return _pairs("low_c", body)


def spring() -> Column:
    """A second low 0.5 to 3 % under the first, 5 to 40 rows later, from which the close came back over the first."""

    def body(a: Column, b: Column, x: Column, y: Column) -> Column:
        dip, after = (x - y) / x, part(F.col("c"), b, F.col("rows"))
        back = F.exists(part(F.col("c"), b + 1, F.least(b + 3, F.col("rows"))), lambda z: z > x)  # within two rows
        score = _form(F.least(F.abs(dip - 0.012) / 0.012, F.lit(1.0))) + _points(30 * F.least(_surge(b) / 2.0, F.lit(1.0))) + _fall(y) + _tiers(F.col("rsi"), ((50, 10), (45, 7)), 3)
        made = lambda neck: F.when(
            dip.between(0.005, 0.03) & (b - a).between(5, 40) & (F.size(after) >= 3) & (F.array_max(after) > x) & ((neck - x) / x >= 0.02) & (F.col("last") >= neck * 0.94),
            _result(score, F.when((dip < 0.015) & back, 15).otherwise(0), neck, neck + (neck - y), y * 0.97, y),
        )
        return let(_neck("high_c", a, b, True), made)

    return _pairs("low_c", body)


def head_and_shoulders() -> Column:
    """Three lows, the middle one 3 % under the outer ones, which differ by 10 % at most; the close near or over the line of the two highs between."""
    p, at = F.col("low_c"), lambda i: F.get(F.col("c"), i)

    def body(x: Column) -> Column:
        left, head, right = at(x["a"]), at(x["b"]), at(x["e"])
        uneven, shoulder = F.abs(left - right) / F.greatest(left, right), (left + right) / 2
        neck = (F.array_max(_values(_between(F.col("high_c"), x["a"], x["b"]))) + F.array_max(_values(_between(F.col("high_c"), x["b"], x["e"])))) / 2
        score = _form(uneven / 0.1) + _points(30 * (1.5 - F.least(_surge(x["e"]), F.lit(1.5)))) + _fall(head) + _tiers(F.col("rsi"), ((48, 10), (42, 6)), 2)
        bonus = F.when(uneven < 0.05, 10).otherwise(0) + F.when(x["e"] - x["a"] < F.col("rows") * 0.6, 5).otherwise(0)
        made = lambda n: F.when(
            (head < left) & (head < right) & (uneven <= 0.1) & ((shoulder - head) / shoulder >= 0.03) & (F.col("last") >= n * 0.94),
            _result(score, bonus, n, n + (n - head), right * 0.97, right),
        )
        return let(neck, made)

    three = lambda i: F.struct(F.get(p, i).alias("a"), F.get(p, i + 1).alias("b"), F.get(p, i + 2).alias("e"))
    return _best(F.transform(upto(0, F.size(p) - 2), lambda i: let(three(i), body)))


def line_touches(values: Column, slope: Column, at_0: Column, first: Column, end: Column, within: float = 0.015) -> Column:
    """Rows from ``first`` to ``end`` (inclusive) whose value lies within a share of a line's."""

    def near(i: Column) -> Column:
        return let(slope * i + at_0, lambda y: (y > 0) & (F.abs(F.get(values, i) - y) / y <= within))

    return F.size(F.filter(upto(first, F.least(end + 1, F.size(values))), near))


def trend_lines(points: int = 4) -> Column:
    """Support and resistance through the first and last of the last swing points of low and high.

    Null unless the highs fall and the lows rise all along: slopes, values at row 0, first row, last low and touches.
    """
    steady = lambda values, rising: F.forall(upto(1, F.size(values)), lambda i: (F.get(values, i) > F.get(values, i - 1)) if rising else (F.get(values, i) < F.get(values, i - 1)))

    def line(places: Column, values: Column) -> Column:
        slope = (F.element_at(values, -1) - F.get(values, F.lit(0))) / (F.element_at(places, -1) - F.get(places, F.lit(0)))
        return F.struct(slope.alias("slope"), (F.get(values, F.lit(0)) - slope * F.get(places, F.lit(0))).alias("at"), F.get(places, F.lit(0)).alias("first"), F.element_at(values, -1).alias("end"))

    def of(swing: str, column: str, rising: bool) -> Column:
        places = part(F.col(swing), F.greatest(F.size(swing) - points, F.lit(0)), F.size(swing))
        fitted = let(places, lambda p: let(F.transform(p, lambda i: F.get(F.col(column), i)), lambda v: F.when(steady(v, rising), line(p, v))))
        return F.when(F.size(swing) >= 2, fitted)

    def both(r: Column, s: Column) -> Column:
        first, end = F.least(r["first"], s["first"]), F.col("rows") - 1
        touches = line_touches(F.col("h"), r["slope"], r["at"], first, end) + line_touches(F.col("l"), s["slope"], s["at"], first, end)
        return F.struct(r.alias("r"), s.alias("s"), first.alias("first"), touches.alias("touches"))

    return let(of("high_h", "h", False), lambda r: let(of("low_l", "l", True), lambda s: F.when(r.isNotNull() & s.isNotNull(), both(r, s))))


def triangle() -> Column:
    """Falling highs and rising lows; the close between their lines, half to nine tenths of the way to their crossing."""

    def body(t: Column) -> Column:
        n = F.col("rows") - 1
        r, s, first = t["r"], t["s"], t["first"]
        top, base = r["slope"] * n + r["at"], s["slope"] * n + s["at"]
        apex, width = (s["at"] - r["at"]) / (r["slope"] - s["slope"]), (top - base) / F.greatest(base, F.lit(1.0))
        way, half = (n - first) / F.greatest(apex - first, F.lit(1.0)), F.floor(F.col("rows") / 2)
        calm = mean(part(F.col("v"), half, F.col("rows"))) / (mean(part(F.col("v"), F.lit(0), half)) + EPS)
        score = _form(width / 0.2) + _tiers(calm, ((0.7, 30), (0.9, 22), (1.1, 14)), 6, below=True) + _fall(s["end"]) + _tiers(F.col("rsi"), ((45, 10), (40, 6)), 2)
        bonus = F.when(t["touches"] >= 6, 10).otherwise(0) + F.when(way.between(0.5, 0.67), 5).otherwise(0)
        holds = (top > base) & F.col("last").between(base * 0.98, top * 1.03) & (width <= 0.25) & way.between(0.5, 0.9)
        return F.when(holds, _result(score, bonus, top, top + (top - base), base * 0.97, base))

    return let(F.col("lines"), lambda t: F.when(t.isNotNull(), body(t)))


def flag() -> Column:
    """A rise of 15 % within 15 rows, then 5 to 25 rows that drift by less than three fifths of it, without new highs."""
    rows, h, low, c, v = F.col("rows"), F.col("h"), F.col("l"), F.col("c"), F.col("v")

    def body(k: Column) -> Column:
        pole, begin = rows - k - 1, F.greatest(F.lit(0), rows - k - 16)
        third = F.greatest(F.lit(1), F.floor(k / 3).cast("int"))

        def rules(x: Column) -> Column:
            rise, swing = (x["top"] - x["base"]) / F.greatest(x["base"], F.lit(EPS)), (x["high"] - x["low"]) / x["high"]
            edge = x["late"] + (x["late"] - x["early"]) / F.greatest(k - F.floor(k / 3), F.lit(1))
            before = mean(part(v, begin, rows - k))
            ratio = F.when(before > 0, mean(part(v, rows - k, rows)) / before).otherwise(1.0)
            score = _form(swing / (rise * 0.6)) + _tiers(ratio, ((0.4, 30), (0.6, 22), (0.8, 14)), 6, below=True) + _fall(x["base"]) + _tiers(F.col("rsi"), ((50, 10), (45, 7)), 3)
            holds = (
                (pole - begin >= 4) & (rise >= 0.15) & (x["high"] > 0) & (x["high"] <= x["top"] * 1.03) & (swing <= rise * 0.6)
                & (x["second"] <= x["first"] * 1.02) & F.col("last").between(edge * 0.93, edge * 1.04)
            )
            return F.when(holds, _result(score, F.when(swing < rise / 3, 10).otherwise(0), edge, x["top"] + (x["top"] - x["base"]), x["low"] * 0.97, x["low"]))

        half = rows - k + F.floor(k / 2).cast("int")
        facts = F.struct(
            F.get(h, pole).alias("top"), F.array_min(part(c, begin, pole + 1)).alias("base"), F.array_max(part(h, rows - k, rows)).alias("high"),
            F.array_min(part(low, rows - k, rows)).alias("low"), F.array_max(part(h, rows - k, half)).alias("first"), F.array_max(part(h, half, rows)).alias("second"),
            F.array_max(part(h, rows - k, rows - k + third)).alias("early"), F.array_max(part(h, rows - third, rows)).alias("late"),
        )
        return let(facts, rules)

    return _best(F.transform(upto(F.lit(5), F.least(F.lit(26), rows - 10)), body))


def double_top() -> Column:
    """Two highs within 5 %, a neck 3 % under them, and a close under it."""

    def body(a: Column, b: Column, x: Column, y: Column) -> Column:
        spread, middle = F.abs(x - y) / F.greatest(x, y), (x + y) / 2
        score = _form(spread / 0.05) + _points(30 * F.greatest(F.lit(0.0), 1.5 - F.least(_surge(b), F.lit(1.5))))
        made = lambda neck: F.when(
            (spread <= 0.05) & ((middle - neck) / middle >= 0.03) & (F.col("last") < neck), _result(score, 0, neck, neck - (middle - neck), middle, middle)
        )
        return let(_neck("low_c", a, b, False), made)

    return _pairs("high_c", body)


def false_breakout() -> Column:
    """A close over the highest swing high of the last 30 rows within the last five rows, and now under it again."""
    rows = F.col("rows")
    level = F.array_max(_values(F.filter("high_c", lambda i: (i < rows - 3) & (i >= F.greatest(F.lit(0), rows - 30)))))

    def body(x: Column) -> Column:
        over = F.array_min(F.filter(upto(rows - 5, rows - 1), lambda i: F.get(F.col("c"), i) > x))
        top = F.array_max(part(F.col("h"), rows - 5, rows))
        score = F.greatest(F.lit(40), 75 - 10 * (rows - 1 - over))
        return F.when((x > 0) & over.isNotNull() & (F.col("last") < x), _result(score, 0, x, x - (top - x) * 2, top * 1.02, top * 1.02))

    return let(level, body)


BULLISH = {"w_bottom": double_bottom, "spring_w": spring, "hs_bottom": head_and_shoulders, "triangle": triangle, "flag": flag}
BEARISH = {"m_top": double_top, "false_breakout": false_breakout}


COLUMNS = ["frame", "pattern", "side", "score", "raw", "bonus", "key_price", "target", "stop", "failure", "reward", "dual"]


def reward(target: Column, last: Column, stop: Column) -> Column:
    """The reward for one unit of risk, as text."""
    return F.when((last > stop) & (target > last), F.format_string("1:%.1f", (target - last) / (last - stop))).otherwise("N/A")


def scan(panel: DataFrame, rank: str | None = None, frames=FRAMES, spec: PanelSpec = PANEL, least: int = LEAST) -> DataFrame:
    """entity, frame, pattern, side, score, raw, bonus, key_price, target, stop, failure, reward, dual: every shape found at each entity's end.

    ``rank`` names a column of whole numbers, the entity's rank at its last row: the better ones get a bonus, and ``dual``.
    """
    rows = prepared(windows(panel, frames, spec)).withColumn("lines", trend_lines())
    found = [F.struct(F.lit(name).alias("pattern"), F.lit("bull").alias("side"), f().alias("x")) for name, f in BULLISH.items()]
    found += [F.struct(F.lit(name).alias("pattern"), F.lit("bear").alias("side"), F.when(F.col("rows") >= BEARISH_FROM, f()).alias("x")) for name, f in BEARISH.items()]
    each = rows.select(spec.entity, "frame", "last", F.explode(F.array(*found)).alias("f")).select(spec.entity, "frame", "last", "f.pattern", "f.side", F.col("f.x.key").alias("f_key"), *[f"f.x.{x}" for x in ("score", "bonus", "target", "stop", "failure")]).where("score is not null")
    if rank is None:
        each = each.withColumn("_rank", F.lit(None).cast("int"))
    else:
        at_end = panel.where(F.col(spec.entity).isNotNull() & F.col("close").isNotNull()).groupBy(spec.entity).agg(F.max_by(rank, spec.date).alias("_rank"))
        each = each.join(at_end, spec.entity, "left")
    bull = F.col("side") == "bull"
    extra = F.when(bull, F.coalesce(*[F.when(F.col("_rank") <= most, F.lit(points)) for most, points in BONUS], F.lit(0))).otherwise(0)
    score = F.when(bull, F.least(F.lit(100), F.col("score") + F.col("bonus") + extra)).otherwise(F.col("score"))
    risk = F.when(bull, reward(F.col("target"), F.col("last"), F.col("stop"))).otherwise("N/A")
    return each.where(~bull | (F.col("score") >= least)).select(
        spec.entity, "frame", "pattern", "side", score.cast("int").alias("score"), F.col("score").alias("raw"), "bonus",
        F.round("f_key", 2).alias("key_price"), *[F.round(x, 2).alias(x) for x in ("target", "stop", "failure")], risk.alias("reward"), F.coalesce(F.col("_rank") <= CONFIRMED, F.lit(False)).alias("dual"),
    )


def signals(found: DataFrame, frames=FRAMES, spec: PanelSpec = PANEL, bulls: int = 2, bears: int = 1) -> DataFrame:
    """The strongest shapes of each entity: confirmed ones first, then by score, then by window and shape in their order."""
    place = lambda column, names: reduce(lambda a, x: F.when(F.col(column) == x[1], x[0]).otherwise(a), enumerate(names), F.lit(len(names)))
    order = Window.partitionBy(spec.entity, "side").orderBy(
        (F.col("dual") & (F.col("side") == "bull")).desc(), F.col("score").desc(), place("frame", [f[0] for f in frames]), place("pattern", [*BULLISH, *BEARISH])
    )
    ranked = found.withColumn("_k", F.row_number().over(order))
    return ranked.where(F.col("_k") <= F.when(F.col("side") == "bull", bulls).otherwise(bears)).drop("_k")
