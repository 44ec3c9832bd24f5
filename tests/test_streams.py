"""Streams over several micro-batches, on small tables with small bounds."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from modelframe.functions import windowed
from modelframe.sources.tables import shared_folder
from modelframe.streaming import pubsub


def _topic(spark, schema, *parts):
    """A topic of one file for each part, and a subscriber to it."""

    class Values(pubsub.Subscriber):
        channels = ("v",)

    Values.schema = schema
    topic = f"{shared_folder(spark)}/topic-{uuid.uuid4().hex}"
    for part in parts:
        rows = spark.createDataFrame(part, f"{schema}, ts timestamp").coalesce(1)
        pubsub.Publisher(topic, "v").publish(rows, "ts")
    return topic, Values(spark, topic)


def test_running_windows_hold_no_key_whole(spark):
    """A key is cut into chunks, whose windows reach into those before and into earlier micro-batches; nothing goes through Python state."""
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i // 2)
    rows = [(k, float(i * i % 97), at(i)) for k in ("a", "b") for i in range(120)]
    topic, s = _topic(spark, "key string, value double", *(rows[i::3] for i in range(3)))
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    compute = lambda c, w: {"sma_9": windowed.sma(c, w, 9), "top": F.max(c).over(w.rowsBetween(-4, 0))}
    whole = pubsub.running(s.parsed(s.stream(files_at_once=1)), "key", "ts", "value", 9, compute, late="40 days", chunk=7)
    assert "InPandas" not in whole.stream._jdf.queryExecution().toString()
    assert pubsub.drained(whole, folder).count() == 0
    pubsub.Publisher(topic, "v").heartbeat(spark, dt.datetime(2030, 1, 1))
    found = pubsub.drained(whole, folder).collect()
    kept = spark.read.parquet(f"{folder}/kept/due/*")
    assert kept.select("key", "chunk").distinct().count() > 20 and kept.groupBy("key", "chunk").count().agg(F.max("count")).first()[0] < 40
    for k in ("a", "b"):
        own = [v for _, _, v in sorted((t, v, v) for key, v, t in rows if key == k)]
        wanted = [(v, None if i < 8 else round(sum(own[i - 8 : i + 1]) / 9, 6), max(own[max(0, i - 4) : i + 1])) for i, v in enumerate(own)]
        ours = [(r["value"], None if r["sma_9"] is None else round(r["sma_9"], 6), r["top"]) for r in found if r["key"] == k]
        assert sorted(map(str, ours)) == sorted(map(str, wanted))


def test_running_windows_go_on_after_each_watermark(spark):
    """Rows come out in several micro-batches, late ones are dropped, windows reach back over all of them."""
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    part = lambda *i: [("a", float(x), at(x)) for x in i]
    topic, s = _topic(spark, "key string, value double", part(1, 0), part(200), part(5, 201, 300), part(290, 500))
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    stream = lambda: pubsub.running_means(s.parsed(s.stream(files_at_once=1)), "key", "ts", "value", (3,), late="1 hour")
    pubsub.drained(stream(), folder)
    pubsub.Publisher(topic, "v").heartbeat(spark, dt.datetime(2030, 1, 1))
    rows = pubsub.drained(stream(), folder).orderBy("ts").collect()
    # 5 came after the watermark had reached minute 140
    assert [r["value"] for r in rows] == [0.0, 1.0, 200.0, 201.0, 290.0, 300.0, 500.0]
    values = [r["value"] for r in rows]
    assert [r["sma_3"] for r in rows] == [None, None, *(sum(values[i - 2 : i + 1]) / 3 for i in range(2, 7))]


def test_throttle_lets_the_first_of_any_file_through(spark):
    """The first by the order asked for, not by file; the state of a key ends when the watermark has passed its time."""
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    part = lambda *rows: [(k, n, at(i)) for k, n, i in rows]
    parts = [part(("a", 9, 1), ("b", 4, 2), (None, 8, 3)), part(("a", 3, 5), ("b", 7, 1), (None, 6, 3))]
    topic, s = _topic(spark, "key string, n long", *parts)
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    stream = lambda: pubsub.throttled(s.parsed(s.stream()), ["key"], "ts", "10 minutes", "n")
    numbers = lambda: sorted((r["key"] or "", r["n"]) for r in pubsub.drained(stream(), folder).collect())
    first = [("", 6), ("a", 3), ("b", 4)]
    assert numbers() == first
    more = lambda *rows: pubsub.Publisher(topic, "v").publish(spark.createDataFrame(part(*rows), "key string, n long, ts timestamp"), "ts")
    more(("a", 1, 6), ("c", 30, 30))
    assert numbers() == [*first, ("c", 30)]
    # b and the null key opened at minutes 12 and 13, a at 15, the watermark stands at 20; what is older is late
    more(("a", 2, 10), ("a", 40, 31), ("b", 41, 31), ("c", 42, 32))
    assert numbers() == [("", 6), ("a", 3), ("a", 40), ("b", 4), ("b", 41), ("c", 30)]
