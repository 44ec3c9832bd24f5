"""Own indicators: a class says what a value is and when it is a signal; all periods are computed and saved at once."""

from __future__ import annotations

from typing import ClassVar

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


class Indicator:
    """Subclass with a name, periods and `value`; override `trend` for signals."""

    name: ClassVar[str] = ""
    periods: ClassVar[tuple[int, ...]] = ()

    def value(self, w: WindowSpec, n: int) -> Column:
        """The value at a bar from the bars of w up to it; null where there are too few."""
        raise NotImplementedError

    def trend(self, value: Column, n: int) -> Column:
        """What a value signals; null for nothing."""
        return F.lit(None).cast("string")

    def computed(self, bars: DataFrame, keys: list[str], order: str, places: int | None = None) -> DataFrame:
        """Rows (keys, order, periods, value) for all periods, one shuffle for all; no row where there is no value."""
        w = Window.partitionBy(*keys).orderBy(order)
        columns = {f"_{n}": self.value(w, n) for n in self.periods}
        wide = bars.select(*keys, order, *(c.alias(name) for name, c in columns.items()))
        each = F.array(*(F.struct(F.lit(n).alias("periods"), F.col(f"_{n}").cast("double").alias("value")) for n in self.periods))
        long = wide.select(*keys, order, F.inline(each)).where("value IS NOT NULL")
        return long if places is None else long.withColumn("value", F.round("value", places))

    def signals(self, bars: DataFrame, keys: list[str], order: str, places: int | None = None) -> DataFrame:
        """The computed rows with a trend."""
        trend = F.lit(None).cast("string")
        for n in self.periods:
            trend = F.when(F.col("periods") == n, self.trend(F.col("value"), n)).otherwise(trend)
        return self.computed(bars, keys, order, places).withColumn("trend", trend).where("trend IS NOT NULL")
