"""Streaming queries: events staged as messages, drained once, the result read as a table."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelframe.sources.tables import read, shared_folder
from modelframe.streaming import pubsub

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Messages of a file; one file is one task's work to parse.
FILE = 250_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A fresh one."""
    return f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"


def _published(spark: SparkSession, d: str, payload: DataFrame | None = None) -> str:
    path = f"{_folder(spark)}/topic"
    rows = payload if payload is not None else read(spark, d, "events").select("event_id", "ts", "event_type", "value")
    pubsub.Publisher(path, "events").publish(rows, "ts")
    return path


def _closed(spark: SparkSession, path: str) -> str:
    """Messages of a time long after all others close what waits for them."""
    pubsub.Publisher(path, "events").heartbeat(spark, dt.datetime(2100, 1, 1))
    return path


class Events(pubsub.Subscriber):
    channels = ("events",)
    schema = "event_id long, event_type string, value double"


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def stream_publish(spark, d):
    sent = spark.read.parquet(_published(spark, d))
    return sent.agg(F.count("*").alias("n"), F.count_distinct(F.get_json_object("payload", "$.event_id")).alias("ids"))


@query("SELECT event_id, event_type, value FROM events")
def stream_subscribe(spark, d):
    s = Events(spark, _published(spark, d))
    return pubsub.drained(s.parsed(s.stream()), _folder(spark)).select("event_id", "event_type", "value")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value > 100 GROUP BY 1")
def stream_handle(spark, d):
    path = _published(spark, d)
    out = f"{_folder(spark)}/handled"

    class Totals(Events):
        def pre_handle(self, rows):
            return rows.where("value > 100")

        def handle(self, rows, batch_id):
            rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("append").parquet(out)

    Totals(spark, path).drain(f"{_folder(spark)}/checkpoint").awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("SELECT event_id, value FROM events WHERE event_id % 50 <> 0")
def stream_bad_messages(spark, d):
    path = f"{_folder(spark)}/topic"
    good = pubsub.Publisher(path, "events").messages(read(spark, d, "events").select("event_id", "ts", "event_type", "value"), "ts")
    broken = F.get_json_object("payload", "$.event_id").cast("long") % 50 == 0
    good.withColumn("payload", F.when(broken, F.expr("left(payload, length(payload) - 3)")).otherwise(F.col("payload"))).write.parquet(path)
    s = Events(spark, path)
    return pubsub.drained(s.parsed(s.stream()), _folder(spark)).select("event_id", "value")


@query(
    "SELECT upper(event_type) || '_USD' AS ticker, 'sim' AS publisher, 'PriceStorage' AS storage, 'close_price' AS index, value, event_id AS score FROM events WHERE event_id % 3 <> 0"
)
def parse_ticker_event(spark, d):
    e = read(spark, d, "events")
    score = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).otherwise(F.col("event_id").cast("string"))
    raw = e.select(
        F.concat(F.upper("event_type"), F.lit("_USD:sim:PriceStorage:close_price")).alias("key"),
        F.concat(F.col("value").cast("string"), F.lit(":"), score).alias("name"),
        score.alias("score"),
    )
    return pubsub.ticker_events(raw)


@query(
    "SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, arg_min(value, (ts, value)) AS open, max(value) AS high, min(value) AS low, "
    "arg_max(value, (ts, value)) AS close FROM events GROUP BY 1, 2"
)
def stream_resample(spark, d):
    s = Events(spark, _closed(spark, _published(spark, d)))
    out = pubsub.drained(pubsub.resampled(s.parsed(s.stream()), ["event_type"], "ts", "value", late="40 days"), _folder(spark))
    return out.where("event_type IS NOT NULL").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(
    "SELECT event_type, ts, value, round(CASE WHEN count(value) OVER a = 5 THEN avg(value) OVER a END, 6) AS sma_5, "
    "round(CASE WHEN count(value) OVER b = 9 THEN avg(value) OVER b END, 6) AS sma_9 FROM events "
    "WINDOW a AS (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), "
    "b AS (PARTITION BY event_type ORDER BY ts, value ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)"
)
def stream_indicator_sma(spark, d):
    """All periods, from files in an order that isn't that of time, a quarter of them in each micro-batch."""
    path = f"{_folder(spark)}/topic"
    rows = read(spark, d, "events").select("event_id", "ts", "event_type", "value")
    quarter = max(1, -(-rows.count() // (4 * FILE)))
    pubsub.Publisher(path, "events").publish(rows.repartition(4 * quarter, F.xxhash64("event_id")), "ts")
    s = Events(spark, path)
    folder = _folder(spark)
    means = lambda: pubsub.running_means(s.parsed(s.stream(files_at_once=quarter)), "event_type", "ts", "value", (5, 9), late="40 days")
    pubsub.drained(means(), folder)
    out = pubsub.drained(_after(spark, path, means), folder)
    return out.select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", *(F.round(c, 6).alias(c) for c in ("sma_5", "sma_9")))


def _after(spark: SparkSession, path: str, stream: Callable[[], DataFrame]) -> DataFrame:
    """The same stream again once its topic is closed: it goes on where its checkpoint stands."""
    _closed(spark, path)
    return stream()


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def stream_channels(spark, d):
    """Subscribed to two of the channels that are published, one for each event type."""
    path = f"{_folder(spark)}/topic"
    rows = read(spark, d, "events").select("event_id", "ts", "event_type", "value")
    for kind in ("click", "purchase", "view"):
        pubsub.Publisher(path, kind).publish(rows.where(F.col("event_type") == kind), "ts")

    class Two(Events):
        channels = ("click", "view")

    s = Two(spark, path)
    return pubsub.drained(s.parsed(s.stream()), _folder(spark)).groupBy(F.col("channel").alias("event_type")).agg(F.count("*").alias("n"))


@query("SELECT event_type, min(event_id) AS event_id FROM events GROUP BY 1")
def stream_throttle(spark, d):
    """Throttled for longer than all events last: the first of each type comes through."""
    s = Events(spark, _published(spark, d))
    out = pubsub.drained(pubsub.throttled(s.parsed(s.stream()), ["event_type"], "ts", "60 days", "event_id"), _folder(spark))
    return out.groupBy("event_type").agg(F.min("event_id").alias("event_id"))


@query(
    "SELECT event_type, ts, value, CASE WHEN value > 1.5 * m THEN 'bullish' ELSE 'bearish' END AS trend, 2 AS strength FROM "
    "(SELECT *, round(avg(value) OVER w, 6) AS m, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, value "
    "ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)) WHERE n = 9 AND (value > 1.5 * m OR value < 0.5 * m)"
)
def stream_signals(spark, d):
    """Signals of an indicator, appended to a table as the stream runs."""
    s = Events(spark, _closed(spark, _published(spark, d)))
    means = pubsub.running_means(s.parsed(s.stream()), "event_type", "ts", "value", (9,), late="40 days")
    trend = F.when(F.col("value") > 1.5 * F.col("m"), "bullish").when(F.col("value") < 0.5 * F.col("m"), "bearish")
    found = means.then(lambda rows: pubsub.signals(rows.withColumn("m", F.round("sma_9", 6)), trend, F.lit(2)))
    out = pubsub.drained(found, _folder(spark))
    return out.select("event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "value", "trend", "strength")
