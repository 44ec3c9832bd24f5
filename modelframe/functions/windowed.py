"""Indicators that look back a fixed number of bars: window expressions over (keys, order).

All take a window specification without a frame; several in one select share its one shuffle and sort. A value is null
until its window is full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def full(w: WindowSpec, n: int, value: Column, of: Column | None = None) -> Column:
    """value where n bars (of a column without nulls) are there."""
    seen = F.count(F.lit(1) if of is None else of).over(w.rowsBetween(-(n - 1), 0))
    return F.when(seen == n, value)


def _over(f: Callable[[Column], Column], c: Column, w: WindowSpec, n: int) -> Column:
    return full(w, n, f(c).over(w.rowsBetween(-(n - 1), 0)), c)


def sma(c: Column, w: WindowSpec, n: int) -> Column:
    return _over(F.avg, c, w, n)


def wma(c: Column, w: WindowSpec, n: int) -> Column:
    terms = sum(((n - k) * F.lag(c, k).over(w) for k in range(1, n)), n * c)
    return terms / (n * (n + 1) / 2)


def stddev(c: Column, w: WindowSpec, n: int) -> Column:
    return _over(F.stddev_pop, c, w, n)


def bbands(c: Column, w: WindowSpec, n: int = 5, up: float = 2.0, down: float = 2.0) -> tuple[Column, Column, Column]:
    mid, sd = sma(c, w, n), stddev(c, w, n)
    return mid + up * sd, mid, mid - down * sd


def bbands_width(upper: Column, middle: Column, lower: Column) -> Column:
    return F.try_divide(upper - lower, middle)


def trima_lengths(n: int) -> tuple[int, int]:
    """The two averages whose succession weighs a window of n as a triangle."""
    return ((n + 1) // 2, (n + 1) // 2) if n % 2 else (n // 2, n // 2 + 1)


def midprice(h: Column, low: Column, w: WindowSpec, n: int = 14) -> Column:
    return (_over(F.max, h, w, n) + _over(F.min, low, w, n)) / 2


def apo(c: Column, w: WindowSpec, fast: int = 12, slow: int = 26) -> Column:
    return sma(c, w, fast) - sma(c, w, slow)


def ppo(c: Column, w: WindowSpec, fast: int = 12, slow: int = 26) -> Column:
    return 100 * F.try_divide(sma(c, w, fast) - sma(c, w, slow), sma(c, w, slow))


def _bars_since(best: Column, c: Column, at: Column, w: WindowSpec, n: int) -> Column:
    """Bars since the last extreme of n + 1 bars."""
    del c
    return full(w, n + 1, at - best.over(w.rowsBetween(-n, 0)))


def aroon(h: Column, low: Column, at: Column, w: WindowSpec, n: int = 14) -> tuple[Column, Column]:
    """(down, up); at numbers the bars. Of equal extremes the latest counts."""
    down = _bars_since(F.max_by(at, F.struct(-low, at)), low, at, w, n)
    up = _bars_since(F.max_by(at, F.struct(h, at)), h, at, w, n)
    return 100.0 * (n - down) / n, 100.0 * (n - up) / n


def bop(o: Column, h: Column, low: Column, c: Column) -> Column:
    return F.when(h == low, 0.0).otherwise(F.try_divide(c - o, h - low))


def cci(typical: Column, w: WindowSpec, n: int = 14) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    mean, values = F.avg(typical).over(frame), F.collect_list(typical).over(frame)
    deviation = F.aggregate(values, F.lit(0.0), lambda a, v: a + F.abs(v - mean)) / n
    return full(w, n, F.coalesce(F.try_divide(typical - mean, 0.015 * deviation), F.lit(0.0)))


def money_flow(typical: Column, volume: Column, w: WindowSpec) -> Column:
    """Signed flow of each bar; null for the first."""
    before = F.lag(typical).over(w)
    return F.when(typical > before, typical * volume).when(typical < before, -typical * volume).when(before.isNotNull(), 0.0)


def mfi(flow: Column, w: WindowSpec, n: int = 14) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    up, every = F.sum(F.greatest(flow, F.lit(0.0))).over(frame), F.sum(F.abs(flow)).over(frame)
    return full(w, n, F.coalesce(100 * F.try_divide(up, every), F.lit(0.0)), flow)


def mom(c: Column, w: WindowSpec, n: int = 10) -> Column:
    return c - F.lag(c, n).over(w)


def rocr(c: Column, w: WindowSpec, n: int = 10) -> Column:
    return F.try_divide(c, F.lag(c, n).over(w))


def rocp(c: Column, w: WindowSpec, n: int = 10) -> Column:
    return rocr(c, w, n) - 1


def roc(c: Column, w: WindowSpec, n: int = 10) -> Column:
    return 100 * rocp(c, w, n)


def fast_k(h: Column, low: Column, c: Column, w: WindowSpec, n: int = 5) -> Column:
    top, bottom = _over(F.max, h, w, n), _over(F.min, low, w, n)
    return F.when(top.isNotNull(), F.coalesce(100 * F.try_divide(c - bottom, top - bottom), F.lit(0.0)))


def willr(h: Column, low: Column, c: Column, w: WindowSpec, n: int = 14) -> Column:
    top, bottom = _over(F.max, h, w, n), _over(F.min, low, w, n)
    return F.when(top.isNotNull(), F.coalesce(100 * F.try_divide(c - top, top - bottom), F.lit(0.0)))


def true_range(h: Column, low: Column, c: Column, w: WindowSpec) -> Column:
    """Null for the first bar."""
    before = F.lag(c).over(w)
    return F.when(before.isNotNull(), F.greatest(h, before) - F.least(low, before))


def buying_pressure(low: Column, c: Column, w: WindowSpec) -> Column:
    before = F.lag(c).over(w)
    return F.when(before.isNotNull(), c - F.least(low, before))


def ultosc(bp: Column, tr: Column, w: WindowSpec, spans: tuple[int, int, int] = (7, 14, 28)) -> Column:
    def part(n: int) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        return F.coalesce(F.try_divide(F.sum(bp).over(frame), F.sum(tr).over(frame)), F.lit(0.0))

    a, b, c = map(part, spans)
    return full(w, max(spans), 100 * (4 * a + 2 * b + c) / 7, tr)


def squeeze(width: Column, price: Column, upper: Column, lower: Column, w: WindowSpec, n: int = 180) -> Column:
    """Where the band is as narrow as ever in n bars: bullish above it, bearish below it, other inside."""
    narrow = width <= _over(F.min, width, w, n)
    return F.when(narrow, F.when(price > upper, "bullish").when(price < lower, "bearish").otherwise("other"))


def rsi_strength(rsi: Column) -> Column:
    """-3 to 3: how far overbought (negative) or oversold (positive) a relative strength index says a price is."""
    over = F.when(rsi >= 80, -3).when(rsi >= 75, -2).when(rsi >= 70, -1)
    return over.when(rsi <= 20, 3).when(rsi <= 25, 2).when(rsi <= 30, 1).when(rsi.isNotNull(), 0)
