"""Queries over the events as time series: ranges, buckets, bars, the daily frame, gaps, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelframe.functions import scalar
from modelframe.operators import series
from modelframe.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return read(spark, d, "events").withColumn("k", k).withColumn("t", scalar.unix_seconds(F.col("ts")))


_E = "(SELECT *, json_extract_string(props, '$.k')::BIGINT AS k, epoch_us(ts) // 1000000 AS t FROM events)"
HOURLY = f"""(SELECT event_type, date_trunc('hour', ts) AS bucket, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (ts, event_id)) AS close, sum(k)::BIGINT AS volume FROM {_E} GROUP BY 1, 2)"""


def hour(ts: str = "ts"):
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return series.bars(events(spark, d), ["event_type"], hour(), "value", F.col("k"), "ts", "event_id")


_SCORED = f"(SELECT *, (t - 1483228800) / 300.0::DOUBLE AS score FROM {_E})"


@query(f"SELECT event_id, score, value FROM {_SCORED} WHERE event_type = 'click' AND score >= 738500 - 2016 - 0.5 AND score <= 738500 + 0.5")
def series_range(spark, d):
    df = events(spark, d).withColumn("score", scalar.score_from_ts(F.col("t"))).where("event_type = 'click'")
    return series.series_range(df, 738_500, 2016).select("event_id", "score", "value")


@query(f"SELECT event_id, value FROM {_SCORED} WHERE user_id = 17 AND score >= 738500 - 4032 - 0.5 AND score <= 738500 + 0.5")
def series_by_id(spark, d):
    df = events(spark, d).withColumn("score", scalar.score_from_ts(F.col("t"))).where("user_id = 17")
    return series.series_range(df, 738_500, 4032).select("event_id", "value")


@query("SELECT event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def latest_value(spark, d):
    return series.latest_value(events(spark, d), ["event_type"], "value", "ts", "event_id")


@query(
    "SELECT user_id, unnest(range(event_id + 1, nxt)) AS missing FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt "
    "FROM events WHERE user_id < 5) WHERE nxt - event_id > 1"
)
def missing_elements(spark, d):
    return series.missing_between(read(spark, d, "events").where("user_id < 5"), ["user_id"], "event_id")


@query(
    "SELECT conv_id, turn, array_to_string(w, ',') AS turns FROM (SELECT conv_id, turn, list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w "
    "FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE len(w) = 3"
)
def sliding_window(spark, d):
    df = read(spark, d, "conversations").select("conv_id", "turn").distinct()
    return series.sliding_windows(df, ["conv_id"], "turn", 3, "turn").select(
        "conv_id", "turn", F.array_join(F.transform("window", lambda x: x.cast("string")), ",").alias("turns")
    )


@query(f"SELECT event_type, ((t + 45) // 300) * 300 AS bucket, arg_max(value, (ts, event_id)) AS value FROM {_E} WHERE (t + 45) % 300 < 90 GROUP BY 1, 2")
def resample_price(spark, d):
    df = events(spark, d).where(scalar.is_near_5min(F.col("t")))
    return series.resample_last(df, ["event_type"], scalar.nearest_5min(F.col("t")), "value", "ts", "event_id")


@query(
    f"SELECT event_type, make_timestamp(b * 300 * 1000000) AS bucket, arg_max(value, (ts, event_id)) AS value FROM "
    f"(SELECT *, unnest(range((epoch_us(ts) - 45000000) // 300000000 + 1, epoch_us(ts) // 300000000 + 2)) AS b FROM {_E}) "
    f"WHERE epoch_us(ts) >= b * 300000000 - 300000000 AND epoch_us(ts) < b * 300000000 + 45000000 GROUP BY 1, 2"
)
def resample_volume(spark, d):
    df = events(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    out = series.resample_lookback(df, ["event_type"], "at", "value", "ts", "event_id")
    return out.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(f"SELECT event_type, bucket, open, high, low, close, volume FROM {HOURLY}")
def resample_ohlc(spark, d):
    return hourly(spark, d)


@query(
    "SELECT event_type, date_trunc('hour', ts) AS bucket, round((max(value) + min(value)) / 2, 6) AS midpoint_price, round(avg(value), 6) AS mean_price, "
    "round(var_pop(value), 6) AS price_variance FROM events GROUP BY 1, 2"
)
def derived_price_indexes(spark, d):
    out = series.derived_indexes(events(spark, d), ["event_type"], hour(), "value")
    return out.select("event_type", "bucket", *(F.round(c, 6).alias(c) for c in ("midpoint_price", "mean_price", "price_variance")))


@query(
    " UNION ALL ".join(
        f"SELECT event_type, bucket, '{c}_{'price' if c != 'volume' else 'value'}' AS index, {c}::DOUBLE AS value FROM {HOURLY}" for c in ("open", "high", "low", "close", "volume")
    )
)
def ohlc_unpivot(spark, d):
    return series.to_points(hourly(spark, d), ["event_type"])


_DAY = "make_date(1970, 1, 1) + (((t + 21600) // 86400)::INTEGER)"
_DAILY = f"""(SELECT event_type, {_DAY} AS bucket, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (ts, event_id)) AS close, sum(k)::BIGINT AS volume FROM {_E} WHERE user_id % 40 = 3 GROUP BY 1, 2)"""


@query(
    f"""WITH b AS {_DAILY}, spine AS (SELECT event_type, unnest(range(TIMESTAMP '2023-12-30', TIMESTAMP '2024-02-03', INTERVAL 1 DAY))::DATE AS bucket
 FROM (SELECT DISTINCT event_type FROM b)), j AS (SELECT event_type, bucket, open, high, low, close AS c, volume FROM spine FULL JOIN b USING (event_type, bucket)),
 f AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bucket) AS close FROM j)
 SELECT event_type, bucket::VARCHAR AS bucket, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(volume, 0) AS volume
 FROM f WHERE close IS NOT NULL"""
)
def ohlcv_daily(spark, d):
    """Days as the nearest-day rule rounds them; a thinned series, so that some days have to be filled."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), (scalar.nearest_day(F.col("t")) / 86_400).cast("int"))
    df = events(spark, d).where("user_id % 40 = 3")
    bars = series.bars(df, ["event_type"], day, "value", F.col("k"), "ts", "event_id")
    frame = series.daily_frame(bars, ["event_type"], F.lit("2023-12-30").cast("date"), F.lit("2024-02-03").cast("date"))
    return frame.withColumn("bucket", F.col("bucket").cast("string"))


@query(
    f"SELECT event_type, bucket, round(CASE WHEN hour(bucket) % 2 = 0 THEN close ELSE (high + low) / 2 END, 6) AS value FROM {HOURLY}"
)
def indicator_readthrough(spark, d):
    bars = hourly(spark, d)
    computed = bars.select("event_type", "bucket", ((F.col("high") + F.col("low")) / 2).alias("value"))
    stored = bars.where(F.hour("bucket") % 2 == 0).select("event_type", "bucket", F.col("close").alias("value"))
    out = series.read_through(computed, stored, ["event_type", "bucket"], "value")
    return out.select("event_type", "bucket", F.round("value", 6).alias("value"))


@query(
    f"SELECT event_type, bucket, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bucket) AS value FROM "
    f"(SELECT event_type, bucket, CASE WHEN hour(bucket) % 3 = 0 THEN close END AS v FROM {HOURLY})"
)
def forward_fill(spark, d):
    gaps = hourly(spark, d).select("event_type", "bucket", F.when(F.hour("bucket") % 3 == 0, F.col("close")).alias("value"))
    return series.forward_filled(gaps, ["event_type"], "value", "bucket")
