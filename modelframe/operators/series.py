"""Time series: ranges, buckets, bars, the daily OHLCV frame, gaps and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Periods (of 5 minutes) of a day.
DAY = 288


def series_range(df: DataFrame, at: int, periods: float, tolerance: float = 0.5, score: str = "score") -> DataFrame:
    """Points whose score lies within `periods` before `at`, with a tolerance at both ends."""
    s = F.col(score)
    return df.where((s >= at - periods - tolerance) & (s <= at + tolerance))


def latest_value(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def bars(df: DataFrame, keys: list[str], bucket: Column, price: str, volume: Column | None, *order: str) -> DataFrame:
    """open, high, low, close (and volume) of each bucket; one shuffle, combined before it."""
    when = F.struct(*order)
    aggs = [
        F.min_by(price, when).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, when).alias("close"),
    ]
    if volume is not None:
        aggs.append(F.sum(volume).alias("volume"))
    return df.groupBy(*keys, bucket.alias("bucket")).agg(*aggs)


def resample_last(df: DataFrame, keys: list[str], bucket: Column, value: str, *order: str) -> DataFrame:
    return df.groupBy(*keys, bucket.alias("bucket")).agg(F.max_by(value, F.struct(*order)).alias(value))


def resample_lookback(df: DataFrame, keys: list[str], ts: str, value: str, *order: str) -> DataFrame:
    """The last value in the 300 s before each 5-minute mark and the 45 s after it (half-open)."""
    w = F.window(F.col(ts), "345 seconds", "300 seconds").alias("w")
    label = (F.col("w.start") + F.expr("INTERVAL 300 SECONDS")).alias("bucket")
    return df.groupBy(*keys, w).agg(F.max_by(value, F.struct(*order)).alias(value)).select(*keys, label, value)


def daily_frame(bars_: DataFrame, keys: list[str], first: Column, last: Column) -> DataFrame:
    """Bars of (keys, bucket date) on a spine of days from first to before last, gaps filled.

    Close is carried forward; open, high and low of an empty day are its close, its volume 0; days before the first
    close stay out. Rows outside the spine survive, as a full join keeps them.
    """
    spine = bars_.select(*keys).distinct().select(*keys, F.explode(F.sequence(first, F.date_sub(last, 1))).alias("bucket"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    close = F.last("close", ignorenulls=True).over(w)
    filled = spine.join(bars_, [*keys, "bucket"], "full").withColumn("close", close).where("close IS NOT NULL")
    return filled.select(
        *keys,
        "bucket",
        *(F.coalesce(c, "close").alias(c) for c in ("open", "high", "low")),
        "close",
        F.coalesce("volume", F.lit(0).cast("long")).alias("volume"),
    )


def to_points(bars_: DataFrame, keys: list[str]) -> DataFrame:
    """Bars as narrow points (keys, bucket, index, value)."""
    names = ("open", "high", "low", "close", "volume")
    return bars_.unpivot([*keys, "bucket"], [F.col(c).cast("double").alias(f"{c}_{'price' if c != 'volume' else 'value'}") for c in names], "index", "value")


def derived_indexes(df: DataFrame, keys: list[str], bucket: Column, price: str) -> DataFrame:
    """Midpoint, mean and population variance of each bucket."""
    return df.groupBy(*keys, bucket.alias("bucket")).agg(
        ((F.max(price) + F.min(price)) / 2).alias("midpoint_price"),
        F.avg(price).alias("mean_price"),
        F.var_pop(price).alias("price_variance"),
    )


def sliding_windows(df: DataFrame, keys: list[str], value: str, n: int, *order: str) -> DataFrame:
    """Each full window of n consecutive values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    run = F.collect_list(value).over(w.rowsBetween(-(n - 1), 0))
    return df.withColumn("window", run).where(F.size("window") == n)


def missing_between(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Integers missing between consecutive values of each key."""
    w = Window.partitionBy(*keys).orderBy(value)
    found = df.select(*keys, value).distinct().withColumn("_next", F.lead(value).over(w))
    gap = F.when(F.col("_next") - F.col(value) > 1, F.sequence(F.col(value) + 1, F.col("_next") - 1))
    return found.select(*keys, F.explode(gap).alias("missing"))


def forward_filled(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.last(value, ignorenulls=True).over(w))


def read_through(computed: DataFrame, stored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The stored value where there is one, else the computed one."""
    there = stored.select(*keys, F.col(value).alias("_stored"))
    return computed.join(there, keys, "left").withColumn(value, F.coalesce("_stored", value)).drop("_stored")
