"""Indicators with unlimited memory: folds over each series' values in order, inside the JVM.

A series is collected as an array of values (nulls aside) once; every recursion is a fold that carries its state and
appends to its result, and results line up with the bars from the end. Seeds are simple means of the first n. Appending
copies, so a fold goes through the values in runs of RUN and appends whole runs to a list of runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "array<double>"
#: Values that are folded before they are appended as a whole.
RUN = 64


def _slice(a: Column, first: int | Column, size: Column) -> Column:
    return F.slice(a, first, F.greatest(size, F.lit(0)))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _folded(inputs: Column, first: Column, step: Callable[[Column, Column], Column]) -> Column:
    """first, then step(last, value) for each of the inputs."""

    def run(values: Column, last: Column) -> Column:
        found = F.aggregate(values, F.array(last), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))
        return F.slice(found, 2, RUN)

    def runs(values: Column) -> Column:
        count = F.greatest(F.ceil(F.size(values) / RUN), F.lit(1)).cast("int")
        return F.aggregate(
            F.sequence(F.lit(0), count - 1),
            F.array(F.array(first.cast("double"))),
            lambda out, i: F.concat(out, F.array(run(F.slice(values, i * RUN + 1, RUN), F.element_at(F.element_at(out, -1), -1)))),
        )

    return F.flatten(_let(inputs, runs))


def smoothed(a: Column, n: int, step: Callable[[Column, Column], Column], seed: Column | None = None) -> Column:
    """The mean of the first n values, then step(last, value) for each further value; empty if there are fewer than n."""
    first = seed if seed is not None else _sum(_slice(a, 1, F.lit(n))) / n
    folded = _folded(_slice(a, n + 1, F.size(a) - n), first, step)
    return F.when(F.size(a) >= n, folded).otherwise(F.array().cast(EMPTY))


def ema(a: Column, n: int) -> Column:
    k = 2.0 / (n + 1)
    return smoothed(a, n, lambda last, x: last + (x - last) * k)


def wilder(a: Column, n: int) -> Column:
    return smoothed(a, n, lambda last, x: (last * (n - 1) + x) / n)


def wilder_sum(a: Column, n: int) -> Column:
    """A running sum that loses an n-th of itself each bar; begins as the sum of n - 1 values, gains the next at once."""
    begun = smoothed(a, n - 1, lambda last, x: last - last / n + x, _sum(_slice(a, 1, F.lit(n - 1))))
    return _slice(begun, 2, F.size(begun) - 1)


def aligned(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f of both from the first bar that both have; they end together."""
    size = F.least(F.size(a), F.size(b))
    return F.zip_with(_slice(a, F.size(a) - size + 1, size), _slice(b, F.size(b) - size + 1, size), f)


def differences(a: Column) -> Column:
    return aligned(a, _slice(a, 1, F.size(a) - 1), lambda x, y: x - y)


# what follows takes columns that stand on their own, so that each fold runs once


def dema_of(e1: Column, e2: Column) -> Column:
    return aligned(e1, e2, lambda x, y: 2 * x - y)


def tema_of(e1: Column, e2: Column, e3: Column) -> Column:
    return aligned(aligned(e1, e2, lambda x, y: 3 * x - 3 * y), e3, lambda x, y: x + y)


def trix_of(e3: Column) -> Column:
    return aligned(e3, _slice(e3, 1, F.size(e3) - 1), lambda x, y: 100 * F.try_divide(x - y, y))


def kama_of(a: Column, steps_: Column, n: int, fast: int = 2, slow: int = 30) -> Column:
    """From values and their absolute differences; begins at the value before the first full window."""
    f, s = 2.0 / (fast + 1), 2.0 / (slow + 1)
    count = F.size(a) - n
    ratio = lambda d, i: F.coalesce(
        F.try_divide(F.abs(F.try_element_at(a, i + n) - F.try_element_at(a, i)), _sum(F.slice(d, i, n))), F.lit(1.0)
    )
    every = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    ratios = _let(steps_, lambda d: F.transform(every, lambda i: F.when(count > 0, ratio(d, i))))
    inputs = F.zip_with(ratios, _slice(a, n + 1, count), lambda r, x: F.struct(F.pow(r * (f - s) + s, F.lit(2.0)).alias("c"), x.alias("x")))
    folded = _folded(inputs, F.try_element_at(a, F.lit(n)), lambda last, v: last + v["c"] * (v["x"] - last))
    return F.when(count > 0, _slice(folded, 2, count)).otherwise(F.array().cast(EMPTY))


def gains(d: Column) -> Column:
    return F.transform(d, lambda x: F.greatest(x, F.lit(0.0)))


def losses(d: Column) -> Column:
    return F.transform(d, lambda x: F.greatest(-x, F.lit(0.0)))


def rsi_of(up: Column, down: Column) -> Column:
    """From smoothed gains and losses."""
    return aligned(up, down, lambda u, d: F.coalesce(100 * F.try_divide(u, u + d), F.lit(0.0)))


def cmo_of(up: Column, down: Column) -> Column:
    return aligned(up, down, lambda u, d: F.coalesce(100 * F.try_divide(u - d, u + d), F.lit(0.0)))


def later(a: Column, n: int) -> Column:
    """Without the first n."""
    return _slice(a, n + 1, F.size(a) - n)


def difference_of(a: Column, b: Column) -> Column:
    return aligned(a, b, lambda x, y: x - y)


def directional(h: Column, low: Column, c: Column) -> tuple[Column, Column, Column]:
    """(+DM, -DM, true range) of each bar after the first."""
    up, down = differences(h), F.transform(differences(low), lambda x: -x)
    plus = F.zip_with(up, down, lambda u, d: F.when((u > d) & (u > 0), u).otherwise(0.0))
    minus = F.zip_with(up, down, lambda u, d: F.when((d > u) & (d > 0), d).otherwise(0.0))
    before = _slice(c, 1, F.size(c) - 1)
    high = F.zip_with(_slice(h, 2, F.size(h) - 1), before, lambda x, y: F.greatest(x, y))
    ranges = F.zip_with(high, F.zip_with(_slice(low, 2, F.size(low) - 1), before, lambda x, y: F.least(x, y)), lambda x, y: x - y)
    return plus, minus, ranges


def dx_of(plus: Column, minus: Column) -> Column:
    """From smoothed directional movement; the ranges that divide both cancel out."""
    return aligned(plus, minus, lambda p, m: F.coalesce(100 * F.try_divide(F.abs(p - m), p + m), F.lit(0.0)))


def adxr_of(adx: Column, n: int) -> Column:
    return aligned(adx, _slice(adx, 1, F.size(adx) - (n - 1)), lambda x, y: (x + y) / 2)


def series(df: DataFrame, keys: list[str], order: str, *columns: str) -> DataFrame:
    """One row a series: bars array<struct<order, columns>> in order. A series has to fit a task's memory."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("bars"))


def steps(df: DataFrame, **made: Column) -> DataFrame:
    """Adds columns one after the other, each evaluated once."""
    for name, column in made.items():
        df = df.withColumn(name, column)
    return df


def per_bar(df: DataFrame, keys: list[str], order: str, **results: str) -> DataFrame:
    """Back to a row a bar: each result column's array lines up with the last bars; null before it begins."""
    n = F.size("bars")
    rows = F.transform(
        F.col("bars"),
        lambda bar, i: F.struct(
            bar[order].alias(order),
            *(
                F.when(i >= n - F.size(c), F.try_element_at(F.col(c), (i - (n - F.size(c)) + 1).cast("int"))).alias(name)
                for name, c in results.items()
            ),
        ),
    )
    return df.select(*keys, F.inline(rows))
