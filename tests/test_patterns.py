"""Chart patterns against plain Python over each window's rows."""

import datetime
import math
import random

import pytest

from crosspanel.operators import patterns

DAY = datetime.date(2020, 1, 1)


def turning(x, order, high):
    best = max if high else min
    on = [order <= i < len(x) - order and x[i] == best(x[i - order : i + order + 1]) for i in range(len(x))]
    return [i for i in range(len(x)) if on[i] and not (i > order and on[i - 1])]


def rsi(c):
    if len(c) < 16:
        return 50.0
    moves = [b - a for a, b in zip(c, c[1:])]
    up, down = [max(m, 0.0) for m in moves], [max(-m, 0.0) for m in moves]
    a, b = sum(up[:14]) / 14, sum(down[:14]) / 14
    for u, d in zip(up[14:], down[14:]):
        a, b = (13 * a + u) / 14, (13 * b + d) / 14
    return 100 - 100 / (1 + a / (b + 1e-10))


def step(x, *tiers, rest):
    return next((p for t, p in tiers if x >= t), rest)


def mean(x):
    return sum(x) / len(x)


class Bars:
    def __init__(self, c, h, low, v, order):
        self.c, self.h, self.l, self.v, self.n = c, h, low, v, len(c)
        self.lows, self.highs = turning(c, order, False), turning(c, order, True)
        self.low_l, self.high_h = turning(low, order, False), turning(h, order, True)
        self.rsi, self.last = rsi(c), c[-1]

    def surge(self, i):
        before = mean(self.v[i - 5 : i]) if i >= 5 else 0
        return self.v[i] / (before + 1e-10) if before > 0 else 1.0

    def fall(self, low):
        d = (max(self.c) - low) / max(self.c)
        return 20 if d > 0.7 else 15 if d > 0.5 else 10 if d > 0.3 else 0

    def neck(self, a, b, places, best):
        inner = [self.c[i] for i in places if a < i < b]
        return best(inner or self.c[a : b + 1])

    def w_bottom(self):
        for a, b in zip(self.lows, self.lows[1:]):
            x, y = self.c[a], self.c[b]
            gap, mid, neck = abs(x - y) / max(x, y), (x + y) / 2, self.neck(a, b, self.highs, max)
            if gap <= 0.05 and (neck - mid) / mid >= 0.03 and self.last >= neck * 0.95:
                score = int(40 * max(0, 1 - gap / 0.05)) + min(30, int(30 * min(self.surge(b) / 1.5, 1))) + self.fall(min(x, y)) + step(self.rsi, (50, 10), (45, 7), rest=3)
                yield score, 10 * (gap < 0.02), neck, 2 * neck - mid, min(x, y) * 0.97, min(x, y)

    def spring_w(self):
        for a, b in zip(self.lows, self.lows[1:]):
            x, y = self.c[a], self.c[b]
            dip, neck, after = (x - y) / x, self.neck(a, b, self.highs, max), self.c[b:]
            if 0.005 <= dip <= 0.03 and 5 <= b - a <= 40 and len(after) >= 3 and max(after) > x and (neck - x) / x >= 0.02 and self.last >= neck * 0.94:
                score = int(40 * max(0, 1 - min(abs(dip - 0.012) / 0.012, 1))) + min(30, int(30 * min(self.surge(b) / 2, 1))) + self.fall(y) + step(self.rsi, (50, 10), (45, 7), rest=3)
                yield score, 15 * (dip < 0.015 and any(z > x for z in after[1:3])), neck, 2 * neck - y, y * 0.97, y

    def hs_bottom(self):
        for a, b, e in zip(self.lows, self.lows[1:], self.lows[2:]):
            x, y, z = self.c[a], self.c[b], self.c[e]
            left, right = [[self.c[i] for i in self.highs if p < i < q] for p, q in ((a, b), (b, e))]
            uneven, level = abs(x - z) / max(x, z), (x + z) / 2
            if left and right and y < min(x, z) and uneven <= 0.1 and (level - y) / level >= 0.03 and self.last >= (max(left) + max(right)) / 2 * 0.94:
                neck = (max(left) + max(right)) / 2
                score = int(40 * max(0, 1 - uneven / 0.1)) + min(30, int(30 * (1.5 - min(self.surge(e), 1.5)))) + self.fall(y) + step(self.rsi, (48, 10), (42, 6), rest=2)
                yield score, 10 * (uneven < 0.05) + 5 * (e - a < self.n * 0.6), neck, 2 * neck - y, z * 0.97, z

    def triangle(self):
        hi, lo = self.high_h[-4:], self.low_l[-4:]
        top, base = [self.h[i] for i in hi], [self.l[i] for i in lo]
        if len(hi) < 2 or len(lo) < 2 or any(q >= p for p, q in zip(top, top[1:])) or any(q <= p for p, q in zip(base, base[1:])):
            return
        line = lambda i, v: ((v[-1] - v[0]) / (i[-1] - i[0]), v[0] - (v[-1] - v[0]) / (i[-1] - i[0]) * i[0])
        (rs, r0), (ss, s0), n, first = line(hi, top), line(lo, base), self.n - 1, min(hi[0], lo[0])
        r, s, apex = rs * n + r0, ss * n + s0, (s0 - r0) / (rs - ss)
        if not (r > s and s * 0.98 <= self.last <= r * 1.03):
            return
        width, way = (r - s) / max(s, 1), (n - first) / max(apex - first, 1)
        if width > 0.25 or not 0.5 <= way <= 0.9:
            return
        calm = mean(self.v[self.n // 2 :]) / (mean(self.v[: self.n // 2]) + 1e-10)
        score = int(40 * max(0, 1 - width / 0.2)) + (30 if calm < 0.7 else 22 if calm < 0.9 else 14 if calm < 1.1 else 6) + self.fall(base[-1]) + step(self.rsi, (45, 10), (40, 6), rest=2)
        near = lambda x, y: y > 0 and abs(x - y) / y <= 0.015
        touches = sum(near(self.h[i], rs * i + r0) + near(self.l[i], ss * i + s0) for i in range(first, self.n))
        yield score, 10 * (touches >= 6) + 5 * (0.5 <= way <= 0.67), r, 2 * r - s, s * 0.97, s

    def flag(self):
        for k in range(5, min(26, self.n - 10)):
            pole, begin = self.n - k - 1, max(0, self.n - k - 16)
            top, base = self.h[pole], min(self.c[begin : pole + 1])
            fh, fl = self.h[-k:], self.l[-k:]
            rise, swing, third = (top - base) / base, (max(fh) - min(fl)) / max(fh), max(1, k // 3)
            early, late = max(fh[:third]), max(fh[-third:])
            edge = late + (late - early) / max(k - k // 3, 1)
            if pole - begin < 4 or rise < 0.15 or max(fh) > top * 1.03 or swing > rise * 0.6 or max(fh[k // 2 :]) > max(fh[: k // 2]) * 1.02 or not edge * 0.93 <= self.last <= edge * 1.04:
                continue
            ratio = mean(self.v[-k:]) / mean(self.v[begin : self.n - k])
            score = int(40 * max(0, 1 - swing / (rise * 0.6))) + (30 if ratio < 0.4 else 22 if ratio < 0.6 else 14 if ratio < 0.8 else 6) + self.fall(base) + step(self.rsi, (50, 10), (45, 7), rest=3)
            yield score, 10 * (swing < rise / 3), edge, 2 * top - base, min(fl) * 0.97, min(fl)

    def m_top(self):
        for a, b in zip(self.highs, self.highs[1:]):
            x, y = self.c[a], self.c[b]
            gap, mid, neck = abs(x - y) / max(x, y), (x + y) / 2, self.neck(a, b, self.lows, min)
            if gap <= 0.05 and (mid - neck) / mid >= 0.03 and self.last < neck:
                yield int(40 * max(0, 1 - gap / 0.05)) + min(30, int(30 * max(0, 1.5 - min(self.surge(b), 1.5)))), 0, neck, 2 * neck - mid, mid, mid

    def false_breakout(self):
        levels = [self.c[i] for i in self.highs if max(0, self.n - 30) <= i < self.n - 3]
        over = [j for j in range(self.n - 5, self.n - 1) if levels and self.c[j] > max(levels)]
        if over and self.last < max(levels):
            top = max(self.h[-5:])
            yield max(40, 75 - 10 * (self.n - 1 - over[0])), 0, max(levels), max(levels) - 2 * (top - max(levels)), top * 1.02, top * 1.02


def expected(series, rank):
    out = []
    for frame, rows, order in patterns.FRAMES:
        if len(series) < rows:
            continue
        bars = Bars(*map(list, zip(*series[-rows:])), order)
        for name in [*patterns.BULLISH, *patterns.BEARISH]:
            bull = name in patterns.BULLISH
            if not bull and rows < 60:
                continue
            best = max(getattr(bars, name)(), key=lambda x: x[0], default=None)
            if best is None or (bull and best[0] < 60):
                continue
            raw, bonus, *levels = best
            score = min(100, raw + bonus + (10 if rank <= 200 else 5 if rank <= 300 else 0)) if bull else raw
            out.append((frame, name, score, raw, bonus, *levels))
    return out


def walk(r, kind):
    """A random series that is likely to hold the shape."""
    n, x, out = r.randrange(150, 230), 100.0, []
    for i in range(n):
        if kind == "flat":
            x = 100 + 8 * math.sin(i / r.choice([5, 6, 7])) + r.gauss(0, 0.6)
        elif kind == "narrow":
            x = 100 + 14 * (1 - i / (n * 1.6)) * math.sin(i / 5) + r.gauss(0, 0.15)
        elif kind == "flag":
            x *= 1.02 if i % 40 < 12 else 0.9985 + r.gauss(0, 0.002)
        else:
            x *= 1 + r.gauss(0.0005, 0.03)
        out.append((x, x * (1 + abs(r.gauss(0, 0.004))), x * (1 - abs(r.gauss(0, 0.004))), r.choice([50.0, 100.0, 200.0]) * (0.5 if kind in ("narrow", "flag") and i > n * 0.7 else 1)))
    return out[: r.randrange(20, n)] if r.random() < 0.7 else out


@pytest.fixture(scope="module")
def market():
    r = random.Random(6)
    return {i: walk(r, ["flat", "narrow", "flag", "wild", "flat", "wild"][i % 6]) for i in range(240)}


def test_shapes_equal_plain_python(spark, market):
    rows = [(i, DAY + datetime.timedelta(days=k), *bar, i) for i, series in market.items() for k, bar in enumerate(series)]
    panel = spark.createDataFrame(rows, "id long, d date, close double, high double, low double, volume double, k int").repartition(7)
    got = {}
    for x in patterns.scan(panel, "k").collect():
        got.setdefault(x.id, []).append((x.frame, x.pattern, x.score, x.raw, x.bonus, x.key_price, x.target, x.stop, x.failure))
        assert x.dual == (x.id <= 200) and x.side == ("bull" if x.pattern in patterns.BULLISH else "bear")
    seen = set()
    for i, series in market.items():
        ours, theirs = sorted(got.get(i, [])), sorted(expected(series, i))
        assert [o[:5] for o in ours] == [t[:5] for t in theirs], i
        assert all(abs(a - b) < 0.0051 for o, t in zip(ours, theirs, strict=True) for a, b in zip(o[5:], t[5:], strict=True)), i
        seen |= {o[1] for o in ours}
    assert seen == {*patterns.BULLISH, *patterns.BEARISH}


def test_signals_and_edges(spark):
    kind = "id long, frame string, pattern string, side string, score int, dual boolean"
    rows = [(1, "short", "flag", "bull", 90, False), (1, "long", "w_bottom", "bull", 70, True), (1, "short", "w_bottom", "bull", 70, True), (1, "long", "m_top", "bear", 50, True), (1, "medium", "m_top", "bear", 50, False)]
    kept = sorted((x.frame, x.pattern) for x in patterns.signals(spark.createDataFrame(rows, kind)).collect())
    assert kept == [("long", "w_bottom"), ("medium", "m_top"), ("short", "w_bottom")]
    empty = spark.createDataFrame([(None, DAY, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0, 1.0), (1, DAY, None, 1.0, 1.0, 1.0)], "id long, d date, close double, high double, low double, volume double")
    assert patterns.scan(empty).count() == 0
    bare = [(1, DAY + datetime.timedelta(days=k), 100 + 8 * math.sin(k / 6), None, None, None) for k in range(200)]
    found = patterns.scan(spark.createDataFrame(bare, empty.schema)).collect()
    assert not {x.pattern for x in found} & {"triangle", "flag", "false_breakout"}
