"""Saves, types, key texts and publishing: the semantics on small tables."""

import datetime as dt
import uuid
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from modelframe import fields as f
from modelframe.errors import ModelError, QueryError
from modelframe.functions import scalar
from modelframe.model import Model
from modelframe.operators import mutate, related
from modelframe.sources.tables import Snapshots, shared_folder
from modelframe.streaming import pubsub


class Every(Model):
    name = f.UniqueKeyField()
    int_val = f.IntField()
    float_val = f.FloatField()
    decimal_val = f.DecimalField()
    string_val = f.StringField()
    boolean_val = f.BooleanField()
    bytes_val = f.BytesField()
    list_val = f.ListField()
    dict_val = f.DictField()
    set_val = f.SetField()
    date_val = f.DateField()
    datetime_val = f.DatetimeField()
    time_val = f.TimeField()
    frame_val = f.FrameField(columns="Brand string, Price long, Year long")


def fresh(spark):
    return Snapshots(spark, f"{shared_folder(spark)}/t-{uuid.uuid4().hex}")


def test_all_types(spark):
    table = fresh(spark)
    full = {
        "name": "full", "int_val": 1, "float_val": 1.0, "decimal_val": Decimal("1.5"), "string_val": "one", "boolean_val": True, "bytes_val": bytearray(b"1"),
        "list_val": [1, 2], "dict_val": {"one": 1}, "set_val": [3, 1, 3], "date_val": dt.date(2020, 1, 1), "datetime_val": dt.datetime(2020, 1, 1, 13, 11),
        "time_val": 4_261_000_111, "frame_val": [("a", 1, 2000), ("b", 2, 2001)],
    }
    rejected = Every.create(table, spark, full, {"name": "nulls"}, {"int_val": 3})
    assert [r["_problems"] for r in rejected.collect()] == [["name:null"]]
    rows = {r["name"]: r.asDict(recursive=True) for r in table.read().collect()}
    assert set(rows) == {"full", "nulls"} and all(v is None for k, v in rows["nulls"].items() if k != "name")
    want = full | {"set_val": [1, 3], "frame_val": [{"Brand": b, "Price": p, "Year": y} for b, p, y in full["frame_val"]]}
    assert rows["full"] == want
    assert Every.schema()["frame_val"].dataType.simpleString() == "array<struct<Brand:string,Price:bigint,Year:bigint>>"
    with pytest.raises(ModelError):
        f.FrameField()


def test_times(spark):
    class Lap(Model):
        who = f.KeyField()
        lap = f.SortedField(type=dt.time)

    micros = [3_661_000_111, 3_661_000_112, 7_200_000_000]
    q = Lap.on(spark.createDataFrame([(f"r{i}", m) for i, m in enumerate(micros)], "who string, lap long"))
    who = lambda **k: sorted(r["who"] for r in q.filter(**k).collect())
    assert who(lap=dt.time(1, 1, 1, 111)) == ["r0"]
    assert who(lap__gt=dt.time(1, 1, 1, 111)) == ["r1", "r2"] and who(lap__lte="02:00:00") == ["r0", "r1", "r2"]


def test_literals(spark):
    class Dated(Model):
        day = f.KeyField(type=dt.date)

    class Item(Model):
        a = f.KeyField(type=int)
        of = f.Relationship(model=Dated)

    days = spark.createDataFrame([(dt.date(2020, 1, 1),), (dt.date(2020, 1, 2),)], "day date")
    q = Item.on(spark.createDataFrame([(1, dt.date(2020, 1, 1)), (2, None)], "a long, of date"), {Dated: days})
    assert [r["a"] for r in q.filter(of=dt.date(2020, 1, 1)).collect()] == [1]
    assert [r["a"] for r in q.filter(of=None).collect()] == [2]
    assert [r["a"] for r in q.filter(of=days.first()).collect()] == [1]
    assert q.count(a="2") == 1
    for wrong in ({"a": "abc"}, {"a": [1]}, {"of": "yesterday"}, {"of": [1]}):
        with pytest.raises(QueryError):
            q.filter(**wrong)
    for order in ("--a", "-", ""):
        with pytest.raises(QueryError):
            q.all(order_by=order)


def test_key_texts(spark):
    class Two(Model):
        a = f.KeyField()
        b = f.KeyField(type=int)

    awkward = ["x:y", "it's [a-z]?", "a/b", "{", "*^", None]
    df = spark.createDataFrame([(a, i) for i, a in enumerate(awkward)], "a string, b long")
    text = scalar.composite_key("Two", F.col("a"), F.col("b"))
    rows = df.select("a", "b", text.alias("key"), scalar.key_parts(text).alias("parts")).collect()
    assert all(r["parts"] == ["Two", r["a"], str(r["b"])] == scalar.key_text_parts(r["key"]) for r in rows)
    q = Two.on(df)
    assert [r["b"] for r in q.by_key_text(*(r["key"] for r in rows)).orderBy("b").collect()] == list(range(6))
    assert q.by_key_text().count() == 0
    for wrong in ("Two:a", "Three:a:1", "Two:a:b"):
        with pytest.raises(QueryError):
            q.by_key_text(wrong)


def test_saving_publishes_changes(spark):
    class Pair(Model):
        key = f.UniqueKeyField()
        value = f.StringField()
        at = f.DatetimeField(auto_now_add=True)

    class Pairs(pubsub.Subscriber):
        channels = ("pairs",)
        schema = "key string, value string, change string"

    table, topic = fresh(spark), f"{shared_folder(spark)}/topic-{uuid.uuid4().hex}"
    publisher = pubsub.Publisher(topic, "pairs")
    when = dt.datetime(2020, 1, 1)
    Pair.create(table, spark, {"key": "a", "value": "1", "at": when}, {"key": "b", "value": "1", "at": when}, publisher=publisher)
    Pair.create(table, spark, {"key": "b", "value": "2", "at": when}, {"key": "c", "value": "3"}, publisher=publisher)
    rows = {r["key"]: r for r in table.read().collect()}
    assert {k: r["value"] for k, r in rows.items()} == {"a": "1", "b": "2", "c": "3"}
    assert rows["a"]["at"] == when and rows["c"]["at"] > when
    s = Pairs(spark, topic)
    sent = sorted((r["key"], r["value"], r["change"]) for r in s.parsed(spark.read.parquet(topic)).collect())
    assert sent == [("a", "1", "insert"), ("b", "1", "insert"), ("b", "2", "update"), ("c", "3", "insert")]
    assert publisher.publish(spark.createDataFrame([("x", "y"), (None, None)], "key string, value string")) == 1


def test_snapshots_are_not_overwritten(spark):
    table = fresh(spark)
    assert not table
    assert table.write(spark.range(3)) == 1 and table.write(spark.range(4)) == 2
    table._versions = lambda whole=True: [1]  # as another writer saw it
    with pytest.raises(Exception, match="exists"):
        table.write(spark.range(5))
    del table._versions
    assert table.read().count() == 4 and table.read(1).count() == 3


def test_deletes_and_compaction(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "k string, v long")
    assert [r["v"] for r in mutate.delete_keys(df, df.where("v < 3"), ["k"]).collect()] == [3]
    points = spark.createDataFrame([("x", i, i // 5) for i in range(20)], "k string, at long, mark long")
    out = mutate.compacted(points, ["k"], F.col("mark"), F.col("at") < 10, F.col("at"))
    assert sorted(r["at"] for r in out.collect()) == [4, 9, *range(10, 20)] and out.columns == points.columns


def test_expanding_keeps_rows(spark):
    """A related table whose key column repeats gives each row one related row."""

    class Band(Model):
        name = f.KeyField()
        role = f.KeyField()

    class Fan(Model):
        who = f.KeyField()
        of = f.Relationship(model=Band, key="name")

    bands = spark.createDataFrame([("m", "singer"), ("m", "rapper")], "name string, role string")
    fans = spark.createDataFrame([("a", "m"), ("b", "n")], "who string, of string")
    assert related.expanded(Fan, fans, {Band: bands}).count() == 2


def test_running_mean_over_micro_batches(spark):
    """Files that arrive in the wrong order of time, one in each micro-batch; late rows beyond the watermark are dropped."""

    class Values(pubsub.Subscriber):
        channels = ("v",)
        schema = "key string, value double"

    topic, folder = (f"{shared_folder(spark)}/{n}-{uuid.uuid4().hex}" for n in ("topic", "run"))
    p = pubsub.Publisher(topic, "v")
    at = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i)
    for part in ([3, 4, 5], [0, 1, 2], [8, 6, 7]):
        p.publish(spark.createDataFrame([("a", float(i), at(i)) for i in part], "key string, value double, ts timestamp"), "ts")
    s = Values(spark, topic)
    stream = lambda: pubsub.running_means(s.parsed(s.stream(files_at_once=1)), "key", "ts", "value", (2, 3), late="1 hour")
    pubsub.drained(stream(), folder)
    p.heartbeat(spark, dt.datetime(2030, 1, 1))
    rows = pubsub.drained(stream(), folder).orderBy("ts").collect()
    assert [r["value"] for r in rows] == [float(i) for i in range(9)]
    assert [r["sma_3"] for r in rows] == [None, None, *(float(i - 1) for i in range(2, 9))]
    assert [r["sma_2"] for r in rows] == [None, *(i - 0.5 for i in range(1, 9))]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session)


def test_partitioned_layout_is_pruned(spark):
    """A lookup with the partition's value reads that directory's files and no others, and pushes the range down."""
    from modelframe.plans.records import Saved
    from modelframe.sources.tables import write_sorted

    path = f"{shared_folder(spark)}/sorted-{uuid.uuid4().hex}"
    rows = spark.range(3000).select(F.col("id").alias("o_orderkey"), F.element_at(F.array(*map(F.lit, "FOP")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"), (F.col("id") * 1.0).alias("o_totalprice"))
    write_sorted(Saved, rows, path)
    q = Saved.on(spark.read.parquet(path))
    found = q.filter(o_orderstatus="F", o_totalprice__gte=1500)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(o_orderstatus" in plan and "GreaterThanOrEqual(o_totalprice,1500.0)" in plan
    scan = next(line for line in found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).splitlines() if "PartitionFilters" in line)
    assert "= F" in scan and found.count() == 500


def test_destroy_and_append_only(spark):
    class Kept(Model, append_only=True):
        k = f.UniqueKeyField(type=int)

    class Gone(Model):
        k = f.UniqueKeyField(type=int)

    table = fresh(spark)
    Gone.create(table, spark, *({"k": i} for i in range(4)))
    assert Kept.destroy(table, k=1) == 0 and Gone.destroy(table, k__in=[1, 2]) == 2 and Gone.destroy(table, k=9) == 0
    assert sorted(r["k"] for r in table.read().collect()) == [0, 3] and table._versions() == [1, 2]


def test_session(spark):
    from modelframe.session import info, session

    assert session(spark__sql__shuffle__partitions="4") is not None
    named = {r["name"]: r["value"] for r in info(spark).collect()}
    assert named["spark.sql.adaptive.enabled"] == "true" and named["spark.sql.shuffle.partitions"] == "4" and named["master"].startswith("local")
