"""Publish and subscribe over Structured Streaming: channels, handlers, tickers, resampling, stateful indicators."""

from __future__ import annotations

import copy
import datetime as dt
import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from modelframe.errors import PublishError, SubscribeError
from modelframe.functions import windowed

#: Rows of a chunk of a running window, on average.
CHUNK = 500_000
MESSAGE = T.StructType(
    [T.StructField("channel", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("payload", T.StringType())]
)


class Publisher:
    """Writes rows as messages of a channel; the channel is the class's name unless another is given."""

    channel: str | None = None

    def __init__(self, path: str, channel: str | None = None):
        self.path = path
        self.channel = channel or self.channel or type(self).__name__
        if not self.channel or self.channel == "Publisher":
            raise PublishError("a publisher needs a channel")

    def messages(self, df: DataFrame, ts: str | Column | None = None) -> DataFrame:
        """Rows (channel, ts, payload JSON); rows with nothing but nulls are no messages."""
        cols = [c for c in df.columns if c != ts]
        some = F.coalesce(*(F.col(c).cast("string") for c in cols)).isNotNull()
        when = F.current_timestamp() if ts is None else (F.col(ts) if isinstance(ts, str) else ts)
        return df.where(some).select(
            F.lit(self.channel).alias("channel"), when.cast("timestamp").alias("ts"), F.to_json(F.struct(*cols)).alias("payload")
        )

    def publish(self, df: DataFrame, ts: str | Column | None = None) -> int:
        """Writes the rows' messages; how many, counted as they are written."""
        seen = Observation()
        self.messages(df, ts).observe(seen, F.count("*").alias("n")).write.mode("append").parquet(self.path)
        return seen.get["n"]

    def heartbeat(self, spark: SparkSession, ts: dt.datetime) -> None:
        """A message without values: nothing to handle, but the watermark follows it, so what waited for its time comes out."""
        row = spark.createDataFrame([(self.channel, ts, "{}")], MESSAGE)
        row.write.mode("append").parquet(self.path)


class Subscriber:
    """Reads the messages of its channels; override `handle` (and `pre_handle`) for each batch of parsed rows."""

    channels: tuple[str, ...] = ()
    schema: str | T.StructType = "key string, value string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def stream(self, files_at_once: int | None = None) -> DataFrame:
        """The channels' messages; so many files at most in a micro-batch."""
        reader = self.spark.readStream.schema(MESSAGE)
        if files_at_once:
            reader = reader.option("maxFilesPerTrigger", files_at_once)
        return reader.parquet(self.path).where(F.col("channel").isin(list(self.channels)))

    def parsed(self, messages: DataFrame) -> DataFrame:
        """Payloads by the schema; messages that don't parse are dropped."""
        return parsed(messages, self.schema)

    def pre_handle(self, rows: DataFrame) -> DataFrame:
        return rows

    def handle(self, rows: DataFrame, batch_id: int) -> None:
        raise NotImplementedError

    def drain(self, checkpoint: str) -> StreamingQuery:
        """Handles all that is there, once, and stops."""

        def each(batch: DataFrame, batch_id: int) -> None:
            try:
                self.handle(self.pre_handle(self.parsed(batch)), batch_id)
            except Exception as e:
                raise SubscribeError(f"{type(self).__name__} failed on batch {batch_id}") from e

        return self.stream().writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parsed(messages: DataFrame, schema: str | T.StructType) -> DataFrame:
    """(channel, ts, *fields) of messages whose payload is JSON of the schema."""
    text = schema if isinstance(schema, str) else schema.simpleString()
    row = F.from_json("payload", text, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    whole = F.try_parse_json("payload")
    return messages.withColumn("_row", F.when(whole.isNotNull(), row)).where("_row IS NOT NULL").select("channel", "ts", "_row.*")


def ticker_events(df: DataFrame, key: str = "key", name: str = "name", score: str = "score") -> DataFrame:
    """key TICKER:publisher:Class:index and name value:score apart; only whole scores are kept."""
    k, v, s = F.split(key, ":"), F.split(name, ":"), F.col(score).try_cast("double")
    ok = (F.size(k) == 4) & (F.size(v) == 2) & s.isNotNull() & (s == F.floor(s)) & (F.instr(F.element_at(k, 1), "_") > 1)
    return df.where(ok).select(
        k[0].alias("ticker"), k[1].alias("publisher"), k[2].alias("storage"), k[3].alias("index"),
        v[0].try_cast("double").alias("value"), s.cast("long").alias("score"),
    )


def resampled(df: DataFrame, keys: list[str], ts: str, value: str, every: str = "5 minutes", late: str = "1 day") -> DataFrame:
    """Open, high, low and close of each tumbling window; state older than the watermark goes. Also for batches."""
    when = F.struct(ts, value)
    return (
        df.withWatermark(ts, late)
        .groupBy(*keys, F.window(ts, every).alias("w"))
        .agg(F.min_by(value, when).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, when).alias("close"))
        .select(*keys, F.col("w.start").alias("bucket"), "open", "high", "low", "close")
    )


class Kept:
    """A stream whose micro-batches are worked on as batch frames, with tables kept beside the checkpoint; `drained` runs it.

    each gives the rows that a micro-batch adds to the result, as the schema says. It gets what came in and the Shelf of
    the micro-batch; done again after a failure it writes the same places.
    """

    def __init__(self, stream: DataFrame, schema: T.StructType, each: Callable[[DataFrame, Shelf], DataFrame], *then: Callable[[DataFrame], DataFrame]):
        self.stream, self.each, self.steps = stream, each, then
        self.schema = self._through(stream.sparkSession.createDataFrame([], schema)).schema

    def then(self, f: Callable[[DataFrame], DataFrame]) -> Kept:
        """With f of the result rows, which sees those of one micro-batch at a time."""
        kept = copy.copy(self)
        kept.steps = (*self.steps, f)
        kept.schema = f(self.stream.sparkSession.createDataFrame([], self.schema)).schema
        return kept

    def _through(self, rows: DataFrame) -> DataFrame:
        return functools.reduce(lambda df, f: f(df), self.steps, rows)

    def run(self, folder: str, out: str) -> StreamingQuery:
        """Over all that is there now; results of a micro-batch in a directory of its own."""

        def each(rows: DataFrame, batch_id: int) -> None:
            found = self.each(rows, Shelf(rows.sparkSession, f"{folder}/kept", batch_id))
            self._through(found).write.mode("overwrite").parquet(f"{out}/b{batch_id}")

        return self.stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


class Shelf:
    """Tables of one micro-batch, and those of earlier ones by its number."""

    def __init__(self, spark: SparkSession, folder: str, batch_id: int):
        self.spark, self.folder, self.batch_id = spark, folder, batch_id

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/b{self.batch_id}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def get(self, name: str, schema: str | T.StructType, *batches: int) -> DataFrame:
        """Of these micro-batches, else of the one before; without rows for the first."""
        numbers = batches or ([self.batch_id - 1] if self.batch_id else [])
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{name}/b{n}" for n in numbers))


def _watermark(seen: int | None, late: str, before: int | None) -> int | None:
    """Microseconds (whole milliseconds) that lie late behind the latest time seen, never going back."""
    found = [] if seen is None else [(seen - pd.Timedelta(late).value // 1000) // 1000 * 1000]
    return max([*found, *([] if before is None else [before])], default=None)


def _time(micros: int) -> Column:
    return F.timestamp_micros(F.lit(micros))


def running(df: DataFrame, key: str, ts: str, value: str, most: int, compute: Callable[[Column, WindowSpec], dict[str, Column]], late: str = "1 day", chunk: int = CHUNK) -> Kept:
    """Rows (key, ts, value, results) in the order of (ts, value), whatever micro-batches they came in.

    Rows wait in files until the watermark passes them. compute gives the results by name, as windows of at most `most` rows
    over the value; the last `most - 1` rows of each key are kept for the next ones. Those due are cut into chunks of about so
    many rows along (key, ts, value), each with the rows before it that its windows need, so a key of any size is spread and
    nothing grows with it. Rows without a value are passed over.
    """
    source = df.select(F.col(key).cast("string").alias(key), ts, F.col(value).cast("double").alias(value))
    columns, keep = [key, ts, value], max(most - 1, 1)
    some = F.col(value).isNotNull() & ~F.isnan(value)
    fresh = F.lit(True).alias("fresh")
    #: The watermark, the latest time of each micro-batch whose rows still wait, and the one that wrote the kept rows last.
    note = "watermark long, live map<long, long>, tails long"
    row = T.StructType([source.schema[ts], source.schema[value]])
    tail_schema = T.StructType([source.schema[key], T.StructField("tail", T.ArrayType(row))])

    def computed(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(key, *by).orderBy("fresh", ts, value)
        return rows.withColumns(compute(F.col(value), w)).where("fresh").drop("fresh", *by)

    schema = computed(df.sparkSession.createDataFrame([], source.schema).select("*", fresh)).schema

    def each(rows: DataFrame, shelf: Shelf) -> DataFrame:
        past = shelf.get("note", note).first()
        old, live, tails_of = past if past else (None, {}, None)
        seen = Observation()
        timed = rows.observe(seen, F.unix_micros(F.max(ts)).alias("latest"))
        in_time = F.lit(True) if old is None else F.col(ts).isNull() | (F.col(ts) > _time(old))
        came = shelf.put("rows", timed.where(some & in_time).sortWithinPartitions(ts))
        latest = seen.get["latest"]
        new = _watermark(latest, late, old)
        if latest is not None:
            live = live | {shelf.batch_id: latest}
        # without a time there is nothing to wait for
        due = came.where(F.col(ts).isNull())
        if new is not None and new != old:
            passed = (F.col(ts) <= _time(new)) & (F.lit(True) if old is None else F.col(ts) > _time(old))
            due = due.unionByName(shelf.get("rows", source.schema, *live).where(passed))
        live = {n: t for n, t in live.items() if t > new}
        count = due.count()
        found = shelf.spark.createDataFrame([], schema)
        if count:
            found = computed(windows(due, -(-count // chunk), shelf, tails_of), "chunk")
            tails_of = shelf.batch_id
        shelf.put("note", shelf.spark.createDataFrame([(new, live, tails_of)], note))
        return found

    def windows(due: DataFrame, chunks: int, shelf: Shelf, tails_of: int | None) -> DataFrame:
        """The due rows by chunk, behind those of before (not fresh) that their windows need; keeps each key's last ones."""
        cut = due.repartitionByRange(chunks, *columns) if chunks > 1 else due.coalesce(1)
        due = shelf.put("due", cut.withColumn("chunk", F.spark_partition_id()))
        backwards = Window.partitionBy(key, "chunk").orderBy(F.desc(ts), F.desc(value))
        last = due.withColumn("back", F.row_number().over(backwards)).where(F.col("back") <= keep)
        tails = last.groupBy(key, "chunk").agg(F.sort_array(F.collect_list(F.struct(ts, value))).alias("tail"))
        if tails_of is not None:
            tails = tails.unionByName(shelf.get("tails", tail_schema, tails_of).withColumn("chunk", F.lit(-1)))
        along = Window.partitionBy(key).orderBy("chunk")
        # a chunk has a row at least, so no more chunks than rows are asked for
        ends = lambda last: _last(F.flatten(F.collect_list("tail").over(along.rowsBetween(-keep, last))), keep)
        ended = shelf.put("ends", tails.select(key, "chunk", ends(-1).alias("before"), ends(0).alias("tail")))
        shelf.put("tails", ended.groupBy(key).agg(F.max_by("tail", "chunk").alias("tail")))
        before = ended.where("chunk >= 0").select(key, "chunk", F.inline("before")).withColumn("fresh", F.lit(False))
        return due.select("*", fresh).unionByName(before).repartition(chunks, key, "chunk")

    return Kept(source, schema, each)


def _last(values: Column, n: int) -> Column:
    """The last n of an array, or all."""
    return F.slice(values, F.greatest(F.size(values) - n + 1, F.lit(1)), n)


def running_means(df: DataFrame, key: str, ts: str, value: str, periods: tuple[int, ...], late: str = "1 day") -> Kept:
    """Simple moving averages of all periods, one column sma_n each, null until n values are there."""
    means = lambda c, w: {f"sma_{n}": windowed.sma(c, w, n) for n in periods}
    return running(df, key, ts, value, max(periods), means, late)


def throttled(df: DataFrame, keys: list[str], ts: str, every: str = "20 seconds", order: str | None = None) -> Kept:
    """The first message of each key, and no other until the watermark has passed its time and `every` more.

    Of those that come in one micro-batch the first by order (ts unless given) goes through, whatever files they are in.
    Late messages are dropped. Only the keys that are shut are kept, with the time they open again.
    """
    by = order or ts
    note = "watermark long"
    shut_schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("_until", T.LongType())])

    def same(a: DataFrame, b: DataFrame, *columns: str) -> Column:
        return functools.reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[f"_{c}"]) for c in columns))

    def renamed(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(*(F.col(c).alias(f"_{c}") for c in columns))

    def each(rows: DataFrame, shelf: Shelf) -> DataFrame:
        past = shelf.get("note", note).first()
        old = past["watermark"] if past else None
        shut = shelf.get("shut", shut_schema)
        if old is not None:
            rows = rows.where(F.col(ts).isNull() | (F.col(ts) > _time(old)))
            shut = shut.where(F.col("_until") > old)
        # a minimum combines before the shuffle; whole messages only follow for those that are first
        seen = rows.groupBy(*keys).agg(F.min(by).alias(by), F.unix_micros(F.max(ts)).alias("_latest"))
        seen = shelf.put("seen", seen)
        latest = seen.agg(F.max("_latest")).first()[0]
        closed = renamed(shut, *keys)
        firsts = renamed(seen.join(closed, same(seen, closed, *keys), "left_anti"), *dict.fromkeys([*keys, by]))
        found = rows.join(firsts, same(rows, firsts, *dict.fromkeys([*keys, by])), "left_semi").dropDuplicates(keys)
        found = shelf.put("first", found)
        until = F.unix_micros(ts) + pd.Timedelta(every).value // 1000
        shelf.put("shut", shut.unionByName(found.select(*keys, until.alias("_until"))))
        shelf.put("note", shelf.spark.createDataFrame([(_watermark(latest, every, old),)], note))
        return found

    return Kept(df, df.schema, each)


def signals(df: DataFrame, trend: Column, strength: Column | None = None, **values: Column) -> DataFrame:
    """Rows of df with a trend, as signals: their columns, trend, strength (1 unless given) and further values."""
    named = {"trend": trend, "strength": F.lit(1) if strength is None else strength} | values
    return df.withColumns(named).where(F.col("trend").isNotNull())


def drained(df: DataFrame | Kept, folder: str, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over all that is there now, into Parquet files in a shared folder; the result as a batch frame."""
    out = f"{folder}/out"
    if isinstance(df, Kept):
        df.run(folder, out).awaitTermination()
        spark = df.stream.sparkSession
        return spark.read.schema(df.schema).option("recursiveFileLookup", True).parquet(out) if _exists(spark, out) else spark.createDataFrame([], df.schema)
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def _exists(spark: SparkSession, path: str) -> bool:
    """False only where no micro-batch has run."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(found)
