"""Technical indicators over hourly bars of the events. Windowed ones have SQL; folds are held by list folds in SQL where
that is readable and by plain loops in the tests otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from modelframe.functions import hilbert
from modelframe.functions import recursive as rec
from modelframe.functions import windowed as win
from modelframe.functions.custom import Indicator
from modelframe.plans.timeseries import HOURLY, hourly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PLACES = 6

# made when asked for: SQL and names are there without a session
def W() -> WindowSpec:
    return Window.partitionBy("event_type").orderBy("bucket")


def O() -> Column:  # noqa: E743
    return F.col("open")


def H() -> Column:
    return F.col("high")


def L() -> Column:
    return F.col("low")


def C() -> Column:
    return F.col("close")


def V() -> Column:
    return F.col("volume")


SMA_PERIODS = (9, 20, 26, 30, 50, 52, 60, 120, 200)

_OVER = "(PARTITION BY event_type ORDER BY bucket)"


def _frame(n: int) -> str:
    return f"(PARTITION BY event_type ORDER BY bucket ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, x: str, of: str = "close") -> str:
    return f"CASE WHEN count({of}) OVER {_frame(n)} = {n} THEN {x} END"


def _sma(n: int, c: str = "close") -> str:
    return _full(n, f"avg({c}) OVER {_frame(n)}", c)


def _sql(source: str = HOURLY, **columns: str) -> str:
    found = ", ".join(f"round({x}, {PLACES}) AS {name}" for name, x in columns.items())
    return f"SELECT event_type, bucket, {found} FROM {source}"


def rounded(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("event_type", "bucket", *(F.round(c, PLACES).alias(n) for n, c in columns.items()))


def register(name: str, sql: str | None, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, d: f(hourly(spark, d))
    if sql:
        SQL[name] = sql


def windowed(name: str, sql: dict[str, str], columns: Callable[[], dict[str, Column]], source: str = HOURLY) -> None:
    register(name, _sql(source, **sql), lambda df: rounded(df, **columns()))


# -- fixed look-back

windowed("ind_sma", {"sma": _sma(9)}, lambda: {"sma": win.sma(C(), W(), 9)})
windowed("sma_all_periods", {f"sma_{n}": _sma(n) for n in SMA_PERIODS}, lambda: {f"sma_{n}": win.sma(C(), W(), n) for n in SMA_PERIODS})
windowed(
    "ind_wma",
    {"wma": "(" + " + ".join(f"{30 - k} * lag(close, {k}) OVER {_OVER}" for k in range(30)) + ") / 465"},
    lambda: {"wma": win.wma(C(), W(), 30)},
)
_SD = _full(5, f"stddev_pop(close) OVER {_frame(5)}")
_BANDS = {"upper": f"{_sma(5)} + 2 * {_SD}", "middle": _sma(5), "lower": f"{_sma(5)} - 2 * {_SD}"}
windowed("ind_bbands", _BANDS, lambda: dict(zip(("upper", "middle", "lower"), win.bbands(C(), W()))))
_WIDTH = f"(4 * {_SD}) / {_sma(5)}"
windowed("bbands_width", {"width": _WIDTH}, lambda: {"width": win.bbands_width(*win.bbands(C(), W()))})


def _trima(df: DataFrame) -> DataFrame:
    a, b = win.trima_lengths(30)
    return rounded(df.withColumn("first", win.sma(C(), W(), a)), trima=win.sma(F.col("first"), W(), b))


register("ind_trima", _sql(f"(SELECT *, {_sma(15)} AS first FROM {HOURLY})", trima=_sma(16, "first")), _trima)
windowed(
    "ind_midprice",
    {"midprice": _full(14, f"(max(high) OVER {_frame(14)} + min(low) OVER {_frame(14)}) / 2")},
    lambda: {"midprice": win.midprice(H(), L(), W())},
)
windowed("ind_apo", {"apo": f"{_sma(12)} - {_sma(26)}"}, lambda: {"apo": win.apo(C(), W())})
windowed("ind_ppo", {"ppo": f"100 * ({_sma(12)} - {_sma(26)}) / {_sma(26)}"}, lambda: {"ppo": win.ppo(C(), W())})
_NUMBERED = f"(SELECT *, row_number() OVER {_OVER} AS bar_no FROM {HOURLY})"
_DOWN = _full(15, f"100.0::DOUBLE * (14 - (bar_no - arg_max(bar_no, (-low, bar_no)) OVER {_frame(15)})) / 14", "bar_no")
_UP = _full(15, f"100.0::DOUBLE * (14 - (bar_no - arg_max(bar_no, (high, bar_no)) OVER {_frame(15)})) / 14", "bar_no")


def _aroon(df: DataFrame) -> DataFrame:
    df = df.withColumn("at", F.row_number().over(W()))
    down, up = win.aroon(H(), L(), F.col("at"), W())
    return df.withColumns({"down": down, "up": up})


register("ind_aroon", _sql(_NUMBERED, down=_DOWN, up=_UP), lambda df: rounded(_aroon(df), down=F.col("down"), up=F.col("up")))
register("ind_aroonosc", _sql(_NUMBERED, aroonosc=f"({_UP}) - ({_DOWN})"), lambda df: rounded(_aroon(df), aroonosc=F.col("up") - F.col("down")))
windowed("ind_bop", {"bop": "CASE WHEN high = low THEN 0.0::DOUBLE ELSE (close - open) / (high - low) END"}, lambda: {"bop": win.bop(O(), H(), L(), C())})
_TYPICAL = f"(SELECT *, (high + low + close) / 3 AS tp FROM {HOURLY})"
_CCI = (
    f"(SELECT event_type, bucket, tp, avg(tp) OVER {_frame(14)} AS m, list(tp) OVER {_frame(14)} AS l FROM {_TYPICAL})"
)
register(
    "ind_cci",
    _sql(_CCI, cci="CASE WHEN len(l) = 14 THEN coalesce((tp - m) / nullif(0.015::DOUBLE * list_sum(list_transform(l, lambda x: abs(x - m))) / 14, 0), 0) END"),
    lambda df: rounded(df.withColumn("tp", (H() + L() + C()) / 3), cci=win.cci(F.col("tp"), W())),
)
_FLOW = (
    f"(SELECT *, CASE WHEN tp > p THEN tp * volume WHEN tp < p THEN -tp * volume WHEN p IS NOT NULL THEN 0.0::DOUBLE END AS flow FROM "
    f"(SELECT *, lag(tp) OVER {_OVER} AS p FROM {_TYPICAL}))"
)


def _mfi(df: DataFrame) -> DataFrame:
    df = df.withColumn("tp", (H() + L() + C()) / 3)
    return rounded(df.withColumn("flow", win.money_flow(F.col("tp"), V(), W())), mfi=win.mfi(F.col("flow"), W()))


register(
    "ind_mfi",
    _sql(_FLOW, mfi=_full(14, f"coalesce(100 * sum(greatest(flow, 0)) OVER {_frame(14)} / nullif(sum(abs(flow)) OVER {_frame(14)}, 0), 0)", "flow")),
    _mfi,
)
_LAG = f"lag(close, 10) OVER {_OVER}"
windowed("ind_mom", {"mom": f"close - {_LAG}"}, lambda: {"mom": win.mom(C(), W())})
windowed("ind_roc", {"roc": f"100 * (close / {_LAG} - 1)"}, lambda: {"roc": win.roc(C(), W())})
windowed("ind_rocp", {"rocp": f"close / {_LAG} - 1"}, lambda: {"rocp": win.rocp(C(), W())})
windowed("ind_rocr", {"rocr": f"close / {_LAG}"}, lambda: {"rocr": win.rocr(C(), W())})
_K = (
    f"(SELECT *, {_full(5, f'coalesce(100 * (close - min(low) OVER {_frame(5)}) / nullif(max(high) OVER {_frame(5)} - min(low) OVER {_frame(5)}, 0), 0)')} AS k FROM {HOURLY})"
)


def _stoch(df: DataFrame) -> DataFrame:
    df = df.withColumn("k", win.fast_k(H(), L(), C(), W())).withColumn("slow_k", win.sma(F.col("k"), W(), 3))
    return rounded(df, slow_k=F.col("slow_k"), slow_d=win.sma(F.col("slow_k"), W(), 3))


register("ind_stoch", _sql(f"(SELECT *, {_sma(3, 'k')} AS sk FROM {_K})", slow_k="sk", slow_d=_sma(3, "sk")), _stoch)
register(
    "ind_stochf",
    _sql(_K, fast_k="k", fast_d=_sma(3, "k")),
    lambda df: (lambda f: rounded(f, fast_k=F.col("k"), fast_d=win.sma(F.col("k"), W(), 3)))(df.withColumn("k", win.fast_k(H(), L(), C(), W()))),
)
windowed(
    "ind_willr",
    {"willr": _full(14, f"coalesce(100 * (close - max(high) OVER {_frame(14)}) / nullif(max(high) OVER {_frame(14)} - min(low) OVER {_frame(14)}, 0), 0)")},
    lambda: {"willr": win.willr(H(), L(), C(), W())},
)
_RANGES = (
    f"(SELECT *, CASE WHEN p IS NOT NULL THEN close - least(low, p) END AS bp, CASE WHEN p IS NOT NULL THEN greatest(high, p) - least(low, p) END AS tr "
    f"FROM (SELECT *, lag(close) OVER {_OVER} AS p FROM {HOURLY}))"
)
_AVG = {n: f"coalesce(sum(bp) OVER {_frame(n)} / nullif(sum(tr) OVER {_frame(n)}, 0), 0)" for n in (7, 14, 28)}


def _ultosc(df: DataFrame) -> DataFrame:
    df = df.withColumns({"bp": win.buying_pressure(L(), C(), W()), "tr": win.true_range(H(), L(), C(), W())})
    return rounded(df, ultosc=win.ultosc(F.col("bp"), F.col("tr"), W()))


register("ind_ultosc", _sql(_RANGES, ultosc=_full(28, f"100 * (4 * {_AVG[7]} + 2 * {_AVG[14]} + {_AVG[28]}) / 7", "tr")), _ultosc)


def _squeeze(df: DataFrame) -> DataFrame:
    upper, middle, lower = win.bbands(C(), W())
    df = df.withColumns({"upper": upper, "lower": lower, "width": F.round(win.bbands_width(upper, middle, lower), PLACES)})
    return df.select("event_type", "bucket", win.squeeze(F.col("width"), C(), F.col("upper"), F.col("lower"), W()).alias("trend"))


register(
    "sig_bbands_squeeze",
    f"SELECT event_type, bucket, CASE WHEN width <= {_full(180, f'min(width) OVER {_frame(180)}', 'width')} THEN CASE WHEN close > upper THEN 'bullish' "
    f"WHEN close < lower THEN 'bearish' ELSE 'other' END END AS trend FROM (SELECT *, {_BANDS['upper']} AS upper, {_BANDS['lower']} AS lower, round({_WIDTH}, {PLACES}) AS width FROM {HOURLY})",
    _squeeze,
)

# -- unlimited memory: folds

_LISTED = f"(SELECT event_type, list(bucket ORDER BY bucket) AS b, list(close ORDER BY bucket) AS c FROM {HOURLY} GROUP BY 1)"


def _ema_sql(a: str, n: int, gain: str | None = None) -> str:
    """A list fold: the mean of the first n, then one step a value."""
    step = f"s[-1] + (x - s[-1]) * {gain or f'{2.0 / (n + 1)!r}::DOUBLE'}"
    return (
        f"CASE WHEN len({a}) >= {n} THEN list_reduce(list_transform({a}[{n + 1}:], lambda v: [v]), lambda s, y: list_append(s, "
        f"{step.replace('x', 'y[1]')}), [list_sum({a}[1:{n}]) / {n}]) ELSE []::DOUBLE[] END"
    )


def _unlist(inner: str, **columns: str) -> str:
    """Back to a row a bar; lists line up with the last bars."""
    found = ", ".join(f"round({c}[i - (len(b) - len({c}))], {PLACES}) AS {name}" for name, c in columns.items())
    guard = found
    for name, c in columns.items():
        guard = guard.replace(f"round({c}[i - (len(b) - len({c}))], {PLACES})", f"CASE WHEN i > len(b) - len({c}) THEN round({c}[i - (len(b) - len({c}))], {PLACES}) END")
        del name
    return f"SELECT event_type, b[i] AS bucket, {guard} FROM (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM {inner})"


def folded(name: str, sql: str | None, made: dict[str, Callable[[], Column]], results: tuple[str, ...]) -> None:
    def run(df: DataFrame) -> DataFrame:
        out = rec.series(df, ["event_type"], "bucket", "open", "high", "low", "close")
        out = rec.steps(
            out, h=F.transform("bars", lambda b: b["high"]), l=F.transform("bars", lambda b: b["low"]), c=F.transform("bars", lambda b: b["close"])
        )
        for column, f in made.items():
            out = out.withColumn(column, f())
        bars = rec.per_bar(out, ["event_type"], "bucket", **{r: r for r in results})
        return bars.select("event_type", "bucket", *(F.round(r, PLACES).alias(r) for r in results))

    register(name, sql, run)


c = F.col
_E1 = f"(SELECT *, {_ema_sql('c', 30)} AS e1 FROM {_LISTED})"
_E2 = f"(SELECT *, {_ema_sql('e1', 30)} AS e2 FROM {_E1})"
_E3 = f"(SELECT *, {_ema_sql('e2', 30)} AS e3 FROM {_E2})"


def _tail(a: str, size: str) -> str:
    return f"{a}[len({a}) - {size} + 1:]"


_EMAS = {"e1": lambda: rec.ema(c("c"), 30), "e2": lambda: rec.ema(c("e1"), 30), "e3": lambda: rec.ema(c("e2"), 30)}
_SMOOTHED = {
    "d": lambda: rec.differences(c("c")),
    "up": lambda: rec.wilder(rec.gains(c("d")), 14),
    "down": lambda: rec.wilder(rec.losses(c("d")), 14),
}
folded("ind_ema", _unlist(_E1, ema="e1"), {"ema": lambda: rec.ema(c("c"), 30)}, ("ema",))
_DEMA = f"(SELECT *, list_transform(list_zip({_tail('e1', 'len(e2)')}, e2), lambda z: 2 * z[1] - z[2]) AS r FROM {_E2})"
folded("ind_dema", _unlist(_DEMA, dema="r"), _EMAS | {"dema": lambda: rec.dema_of(c("e1"), c("e2"))}, ("dema",))
_TEMA = f"(SELECT *, list_transform(list_zip({_tail('e1', 'len(e3)')}, {_tail('e2', 'len(e3)')}, e3), lambda z: 3 * z[1] - 3 * z[2] + z[3]) AS r FROM {_E3})"
folded("ind_tema", _unlist(_TEMA, tema="r"), _EMAS | {"tema": lambda: rec.tema_of(c("e1"), c("e2"), c("e3"))}, ("tema",))
_TRIX = f"(SELECT *, list_transform(list_zip(e3[2:], e3[1:len(e3) - 1]), lambda z: 100 * (z[1] - z[2]) / z[2]) AS r FROM {_E3})"
folded("ind_trix", _unlist(_TRIX, trix="r"), _EMAS | {"trix": lambda: rec.trix_of(c("e3"))}, ("trix",))
_DIFF = f"(SELECT *, list_transform(list_zip(c[2:], c[1:len(c) - 1]), lambda z: z[1] - z[2]) AS dd FROM {_LISTED})"
_UPDOWN = f"(SELECT *, list_transform(dd, lambda q: greatest(q, 0.0::DOUBLE)) AS u, list_transform(dd, lambda q: greatest(-q, 0.0::DOUBLE)) AS w FROM {_DIFF})"
_WILDER = f"(SELECT *, {_ema_sql('u', 14, '(1.0::DOUBLE / 14)')} AS su, {_ema_sql('w', 14, '(1.0::DOUBLE / 14)')} AS sw FROM {_UPDOWN})"
_RSI = f"(SELECT *, list_transform(list_zip(su, sw), lambda z: coalesce(100 * z[1] / nullif(z[1] + z[2], 0), 0)) AS r FROM {_WILDER})"
folded("ind_rsi", _unlist(_RSI, rsi="r"), _SMOOTHED | {"rsi": lambda: rec.rsi_of(c("up"), c("down"))}, ("rsi",))
_CMO = f"(SELECT *, list_transform(list_zip(su, sw), lambda z: coalesce(100 * (z[1] - z[2]) / nullif(z[1] + z[2], 0), 0)) AS r FROM {_WILDER})"
folded("ind_cmo", _unlist(_CMO, cmo="r"), _SMOOTHED | {"cmo": lambda: rec.cmo_of(c("up"), c("down"))}, ("cmo",))
_MACD1 = f"(SELECT *, c[15:] AS late FROM {_LISTED})"
_MACD2 = f"(SELECT *, line[len(line) - greatest(len(c) - 25, 0) + 1:] AS m FROM (SELECT *, list_transform(list_zip({_tail('ef', 'len(es)')}, es), lambda z: z[1] - z[2]) AS line FROM (SELECT *, {_ema_sql('late', 12)} AS ef, {_ema_sql('c', 26)} AS es FROM {_MACD1})))"
_MACD3 = f"(SELECT *, {_ema_sql('m', 9)} AS sig FROM {_MACD2})"
_MACD4 = f"(SELECT *, list_transform(list_zip({_tail('m', 'len(sig)')}, sig), lambda z: z[1] - z[2]) AS hist FROM {_MACD3})"
folded(
    "ind_macd",
    _unlist(_MACD4, macd="m", signal="sig", hist="hist"),
    {
        "fast": lambda: rec.ema(rec.later(c("c"), 26 - 12), 12),  # begins with the slow one
        "slow": lambda: rec.ema(c("c"), 26),
        "macd": lambda: rec.difference_of(c("fast"), c("slow")),
        "signal": lambda: rec.ema(c("macd"), 9),
        "hist": lambda: rec.difference_of(c("macd"), c("signal")),
    },
    ("macd", "signal", "hist"),
)


def _stepped(first: str, step: str, result: str, name: str, begins: int, moves: str) -> str:
    """SQL of a fold as a recursion over the bars' numbers k: first at bar `begins`, then a step from f to the next of moves."""
    return (
        f"WITH RECURSIVE bars AS (SELECT *, row_number() OVER {_OVER} AS k FROM {HOURLY}), moves AS ({moves}), "
        f"f AS (SELECT event_type, {begins} AS k, {first} GROUP BY event_type HAVING count(*) > 0 UNION ALL "
        f"SELECT f.event_type, f.k + 1, {step} FROM f JOIN moves m ON m.event_type = f.event_type AND m.k = f.k + 1) "
        f"SELECT bars.event_type, bars.bucket, round({result}, {PLACES}) AS {name} FROM bars LEFT JOIN f ON f.event_type = bars.event_type AND f.k = bars.k"
    )


_OF_KAMA = (
    f"SELECT event_type, k, close, coalesce(abs(close - lag(close, 30) OVER {_OVER}) / nullif(sum(abs(moved)) OVER {_frame(30)}, 0), 1) AS ratio "
    f"FROM (SELECT *, close - lag(close) OVER {_OVER} AS moved FROM bars)"
)
_GAIN = "pow(m.ratio * (2.0::DOUBLE / 3 - 2.0::DOUBLE / 31) + 2.0::DOUBLE / 31, 2)"
_KAMA = _stepped("max(close) AS y FROM moves WHERE k = 30", f"f.y + {_GAIN} * (m.close - f.y)", "CASE WHEN f.k > 30 THEN f.y END", "kama", 30, _OF_KAMA)
_OF_DX = (
    "SELECT event_type, k, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS n "
    f"FROM (SELECT *, high - lag(high) OVER {_OVER} AS up, lag(low) OVER {_OVER} - low AS down FROM bars) WHERE k > 1"
)
_DX_OF = "coalesce(100 * abs({p} - {n}) / nullif({p} + {n}, 0), 0)"
_NEXT = {c: f"(f.s{c} - f.s{c} / 14 + m.{c})" for c in "pn"}
_NEW_DX = _DX_OF.format(**_NEXT)
_SEED = "sum(p) AS sp, sum(n) AS sn"
_DX = _stepped(f"{_SEED} FROM moves WHERE k <= 14", f"{_NEXT['p']}, {_NEXT['n']}", f"CASE WHEN f.k > 14 THEN {_DX_OF.format(p='f.sp', n='f.sn')} END", "dx", 14, _OF_DX)
# the directional index is summed up to bar 28, where the average begins
_AVERAGED = (
    f"CASE WHEN f.k + 1 < 28 THEN f.a + {_NEW_DX} WHEN f.k + 1 = 28 THEN (f.a + {_NEW_DX}) / 14 ELSE (f.a * 13 + {_NEW_DX}) / 14 END"
)
_ADX_SQL = _stepped(f"{_SEED}, 0.0::DOUBLE AS a FROM moves WHERE k <= 14", f"{_NEXT['p']}, {_NEXT['n']}, {_AVERAGED}", "CASE WHEN f.k >= 28 THEN f.a END", "adx", 14, _OF_DX)
_RATED = f"(CASE WHEN f.k >= 28 THEN f.a END + lag(CASE WHEN f.k >= 28 THEN f.a END, 13) OVER (PARTITION BY bars.event_type ORDER BY bars.bucket)) / 2"
_ADXR_SQL = _ADX_SQL.replace(f"round(CASE WHEN f.k >= 28 THEN f.a END, {PLACES}) AS adx", f"round({_RATED}, {PLACES}) AS adxr")
folded("ind_kama", _KAMA, {"moves": lambda: F.transform(rec.differences(c("c")), lambda x: F.abs(x)), "kama": lambda: rec.kama_of(c("c"), c("moves"), 30)}, ("kama",))
_DIRECTIONAL = {
    "plus": lambda: rec.wilder_sum(rec.directional(c("h"), c("l"), c("c"))[0], 14),
    "minus": lambda: rec.wilder_sum(rec.directional(c("h"), c("l"), c("c"))[1], 14),
    "dx": lambda: rec.dx_of(c("plus"), c("minus")),
}
folded("ind_dx", _DX, _DIRECTIONAL, ("dx",))
_ADX = _DIRECTIONAL | {"adx": lambda: rec.wilder(c("dx"), 14)}
folded("ind_adx", _ADX_SQL, _ADX, ("adx",))
folded("ind_adxr", _ADXR_SQL, _ADX | {"adxr": lambda: rec.adxr_of(c("adx"), 14)}, ("adxr",))


def _rsi_bars(df: DataFrame) -> DataFrame:
    out = rec.series(df, ["event_type"], "bucket", "close").withColumn("c", F.transform("bars", lambda b: b["close"]))
    out = rec.steps(out, **{n: f() for n, f in _SMOOTHED.items()}, rsi=rec.rsi_of(c("up"), c("down")))
    return rec.per_bar(out, ["event_type"], "bucket", rsi="rsi")


def _stochrsi(df: DataFrame) -> DataFrame:
    r = F.col("rsi")
    bars = _rsi_bars(df).withColumn("k", win.fast_k(r, r, r, W(), 5))
    return rounded(bars, fast_k=F.col("k"), fast_d=win.sma(F.col("k"), W(), 3))


_RSI_ROWS = f"({_unlist(_RSI, rsi='r').replace(f', {PLACES}) END', ', 15) END')})"
_SK = _full(5, f"coalesce(100 * (rsi - min(rsi) OVER {_frame(5)}) / nullif(max(rsi) OVER {_frame(5)} - min(rsi) OVER {_frame(5)}, 0), 0)", "rsi")
register("ind_stochrsi", _sql(f"(SELECT *, {_SK} AS k FROM {_RSI_ROWS})", fast_k="k", fast_d=_sma(3, "k")), _stochrsi)
register("ind_ht_trendline", None, lambda df: hilbert.ht_trendline(df, ["event_type"], "bucket", "close"))


def _strength(df: DataFrame) -> DataFrame:
    bars = _rsi_bars(df).where("rsi IS NOT NULL")
    return bars.select("event_type", "bucket", win.rsi_strength(F.round("rsi", PLACES)).alias("strength"))


register(
    "sig_rsi_strength",
    f"SELECT event_type, bucket, CASE WHEN rsi >= 80 THEN -3 WHEN rsi >= 75 THEN -2 WHEN rsi >= 70 THEN -1 WHEN rsi <= 20 THEN 3 WHEN rsi <= 25 THEN 2 "
    f"WHEN rsi <= 30 THEN 1 ELSE 0 END AS strength FROM ({_unlist(_RSI, rsi='r')}) WHERE rsi IS NOT NULL",
    _strength,
)


# -- own indicators


class RangePlace(Indicator):
    """Where the close lies between the extremes of its last n bars; at an edge it is a signal."""

    name, periods = "range_place", (14, 50)

    def value(self, w, n):
        low, high = (f("close").over(w.rowsBetween(-(n - 1), 0)) for f in (F.min, F.max))
        return win.full(w, n, F.try_divide(C() - low, high - low))

    def trend(self, value, n):
        return F.when(value >= 0.95, "bullish").when(value <= 0.05, "bearish")


_PLACE = {n: _full(n, f"round((close - min(close) OVER {_frame(n)}) / nullif(max(close) OVER {_frame(n)} - min(close) OVER {_frame(n)}, 0), {PLACES})") for n in RangePlace.periods}
register(
    "ind_custom",
    " UNION ALL ".join(f"SELECT * FROM (SELECT event_type, bucket, {n} AS periods, {x} AS value FROM {HOURLY}) WHERE value IS NOT NULL" for n, x in _PLACE.items()),
    lambda df: RangePlace().computed(df, ["event_type"], "bucket", places=PLACES),
)
register(
    "sig_custom",
    " UNION ALL ".join(
        f"SELECT event_type, bucket, periods, value, CASE WHEN value >= 0.95 THEN 'bullish' ELSE 'bearish' END AS trend FROM "
        f"(SELECT event_type, bucket, {n} AS periods, {x} AS value FROM {HOURLY}) WHERE value >= 0.95 OR value <= 0.05"
        for n, x in _PLACE.items()
    ),
    lambda df: RangePlace().signals(df, ["event_type"], "bucket", places=PLACES),
)
