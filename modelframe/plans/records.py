"""Queries over records: scans, lookups, ordering, relationships, saves, scalar functions. Each stands with its SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelframe.fields import (
    AutoKeyField,
    FloatField,
    FrameField,
    GeoField,
    KeyField,
    Relationship,
    SortedField,
    SortedKeyField,
    StringField,
    UniqueKeyField,
)
from modelframe.functions import scalar
from modelframe.functions.geo import haversine
from modelframe.model import Model
from modelframe.operators import mutate, related
from modelframe.sources.tables import Snapshots, decoded, encoded, read, shared_folder, write_sorted

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Region(Model):
    r_regionkey = KeyField(type=int)
    r_name = KeyField()


class Nation(Model):
    n_nationkey = KeyField(type=int)
    n_name = KeyField()
    n_regionkey = Relationship(model=Region, key="r_regionkey")


class Customer(Model):
    c_custkey = KeyField(type=int)
    c_name = StringField()
    c_nationkey = Relationship(model=Nation, key="n_nationkey")
    c_acctbal = SortedField(type=float)
    c_mktsegment = KeyField()


class Part(Model):
    p_partkey = UniqueKeyField(type=int)
    p_name = StringField()
    p_brand = KeyField()
    p_type = KeyField()
    p_size = SortedField(type=int)
    p_retailprice = SortedField(type=float)


class Order(Model):
    o_orderkey = UniqueKeyField(type=int)
    o_custkey = Relationship(model=Customer, key="c_custkey")
    o_orderstatus = KeyField()
    o_totalprice = SortedField(type=float)
    o_orderdate = SortedField(type=dt.datetime, partition_by=("o_orderstatus",))
    o_orderpriority = KeyField()


class DatedOrder(Model):
    o_orderkey = UniqueKeyField(type=int)
    o_orderdate = SortedKeyField(type=dt.datetime)
    o_totalprice = FloatField()


class Supplier(Model):
    s_suppkey = UniqueKeyField(type=int)
    s_name = KeyField()
    s_nationkey = Relationship(model=Nation, key="n_nationkey")
    s_acctbal = SortedField(type=float)
    place = GeoField()


class AutoPart(Model):
    auto_id = AutoKeyField(length=12)
    p_name = StringField()


def customers(spark: SparkSession, d: str):
    there = {Nation: read(spark, d, "nation"), Region: read(spark, d, "region")}
    return Customer.on(read(spark, d, "customer"), there)


def nullable_customers(spark: SparkSession, d: str):
    return Customer.on(read(spark, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("FURNITURE"))))


def orders(spark: SparkSession, d: str):
    return Order.on(read(spark, d, "orders"), {Customer: read(spark, d, "customer")})


def parts(spark: SparkSession, d: str):
    return Part.on(read(spark, d, "part"))


def suppliers(spark: SparkSession, d: str):
    k = F.col("s_suppkey")
    here = F.struct(
        (F.pmod(k * 37, F.lit(1700)) / 10 - 85).alias("latitude"), (F.pmod(k * 53, F.lit(3600)) / 10 - 180).alias("longitude")
    )
    nowhere = F.lit(None).cast("struct<latitude: double, longitude: double>")
    return Supplier.on(read(spark, d, "supplier").withColumn("place", F.when(k % 17 == 0, nowhere).otherwise(here)), {Nation: read(spark, d, "nation")})


_NULLABLE = "(SELECT * REPLACE (nullif(c_mktsegment, 'FURNITURE') AS c_mktsegment) FROM customer)"
_PLACES = """(SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 17 <> 0 THEN (s_suppkey * 37 % 1700)::DOUBLE / 10 - 85 END AS lat,
 CASE WHEN s_suppkey % 17 <> 0 THEN (s_suppkey * 53 % 3600)::DOUBLE / 10 - 180 END AS lon FROM supplier)"""


def _distance(lat0: str, lon0: str, lat: str = "lat", lon: str = "lon") -> str:
    return (
        f"2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians({lat} - {lat0}) / 2), 2) + cos(radians({lat0})) * "
        f"cos(radians({lat})) * pow(sin(radians({lon} - {lon0}) / 2), 2))))"
    )


# -- scans and gets


@query("SELECT * FROM customer")
def scan_all(spark, d):
    return customers(spark, d).all()


@query("SELECT * FROM customer WHERE c_custkey = 42")
def get_by_key(spark, d):
    return customers(spark, d).filter(c_custkey=42)


@query("SELECT * FROM nation WHERE n_nationkey = 7")
def get_unique(spark, d):
    return Nation.on(read(spark, d, "nation")).filter(n_nationkey=7, limit=2)


@query("SELECT * FROM customer WHERE c_acctbal < -500")
def multi_get(spark, d):
    q = customers(spark, d)
    return q.get_many(q.filter(c_acctbal__lt=-500, values=("c_custkey", "c_mktsegment")))


@query("SELECT c_custkey, c_mktsegment FROM customer")
def key_list(spark, d):
    return customers(spark, d).keys()


@query("SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 42")
def key_exists(spark, d):
    return customers(spark, d).filter(c_custkey=42, limit=1).agg((F.count("*") > 0).alias("found"))


@query(
    "SELECT c_custkey, 'Customer:' || c_custkey || ':' || replace(regexp_replace(replace(c_mktsegment, '/', '//'), '([''?*^\\[\\]-])', '/\\1', 'g'), ':', '{&#58;}') "
    "AS key_text, c_mktsegment AS segment_back FROM customer"
)
def composite_key_string(spark, d):
    key = scalar.composite_key("Customer", F.col("c_custkey"), F.col("c_mktsegment"))
    back = scalar.unescape_key(scalar.escape_key(F.col("c_mktsegment")))
    return read(spark, d, "customer").select("c_custkey", key.alias("key_text"), back.alias("segment_back"))


# -- projection


@query("SELECT c_name, c_acctbal FROM customer")
def values_projection(spark, d):
    return customers(spark, d).all(values=("c_name", "c_acctbal"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def values_keys_only(spark, d):
    return customers(spark, d).filter(c_mktsegment="BUILDING", values=("c_custkey", "c_mktsegment"))


@query(
    "SELECT c_custkey, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey "
    "LEFT JOIN region ON n_regionkey = r_regionkey"
)
def expand_related(spark, d):
    q = customers(spark, d)
    whole = related.expanded(Customer, q.df, q.related)
    return whole.select("c_custkey", F.col("c_nationkey.n_name").alias("nation"), F.col("c_nationkey.n_regionkey.r_name").alias("region"))


@query("SELECT c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def rel_traverse(spark, d):
    q = orders(spark, d)
    return related.traverse(q.filter(o_totalprice__gt=300000), "o_custkey", q.related[Customer], "c_custkey", "c_custkey", "c_name")


# -- key lookups


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def key_exact(spark, d):
    return customers(spark, d).filter(c_mktsegment="BUILDING")


@query("SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def key_in(spark, d):
    return customers(spark, d).filter(c_mktsegment__in=["BUILDING", "MACHINERY"])


@query(f"SELECT * FROM {_NULLABLE} WHERE c_mktsegment IS NULL")
def key_isnull(spark, d):
    return nullable_customers(spark, d).filter(c_mktsegment__isnull=True)


@query(f"SELECT * FROM {_NULLABLE} WHERE c_mktsegment IS NOT NULL")
def key_isnotnull(spark, d):
    return nullable_customers(spark, d).filter(c_mktsegment__isnull=False)


@query("SELECT * FROM customer WHERE starts_with(c_mktsegment, 'BUI')")
def key_startswith(spark, d):
    return customers(spark, d).filter(c_mktsegment__startswith="BUI")


@query("SELECT * FROM customer WHERE suffix(c_mktsegment, 'ING')")
def key_endswith(spark, d):
    return customers(spark, d).filter(c_mktsegment__endswith="ING")


@query("SELECT * FROM part WHERE contains(p_type, 'E')")
def key_contains(spark, d):
    return parts(spark, d).filter(p_type__contains="E")


@query("SELECT p_partkey, p_name FROM part WHERE substr(md5(p_partkey::VARCHAR), 1, 12) = substr(md5('77'), 1, 12)")
def auto_key_exact(spark, d):
    given = read(spark, d, "part").withColumn("auto_id", F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 12))
    wanted = "28dd2c7955ce"  # of 77
    return AutoPart.on(given).filter(auto_id=wanted).select("p_partkey", "p_name")


# -- sorted lookups


@query("SELECT * FROM customer WHERE c_acctbal > 5000")
def sorted_gt(spark, d):
    return customers(spark, d).filter(c_acctbal__gt=5000)


@query("SELECT * FROM part WHERE p_size >= 25")
def sorted_gte(spark, d):
    return parts(spark, d).filter(p_size__gte=25)


@query("SELECT * FROM customer WHERE c_acctbal < 0")
def sorted_lt(spark, d):
    return customers(spark, d).filter(c_acctbal__lt=0)


@query("SELECT * FROM part WHERE p_size <= 5")
def sorted_lte(spark, d):
    return parts(spark, d).filter(p_size__lte=5)


@query("SELECT * FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000")
def sorted_range(spark, d):
    return orders(spark, d).filter(o_totalprice__gte=100000, o_totalprice__lt=200000)


@query("SELECT * FROM part WHERE p_size = 10")
def sorted_exact(spark, d):
    return parts(spark, d).filter(p_size=10)


@query("SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
def sorted_partitioned_range(spark, d):
    return orders(spark, d).filter(o_orderstatus="O", o_orderdate__gte=dt.datetime(1997, 1, 1), o_orderdate__lt=dt.datetime(1998, 1, 1))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderdate IN (TIMESTAMP '1997-03-01', TIMESTAMP '1998-05-05')")
def sortedkey_in(spark, d):
    q = DatedOrder.on(read(spark, d, "orders"))
    return q.filter(o_orderdate__in=[dt.datetime(1997, 3, 1), dt.datetime(1998, 5, 5)], values=("o_orderkey", "o_orderdate", "o_totalprice"))


# -- geo

_SUPPLIER = ["s_suppkey", "s_name"]


@query(f"SELECT s_suppkey, s_name FROM {_PLACES} WHERE {_distance('-75.0', '-150.0')} <= 6000000")
def geo_radius(spark, d):
    return suppliers(spark, d).filter(place=(-75.0, -150.0), place_radius=6000, place_radius_unit="km").select(*_SUPPLIER)


@query(f"SELECT s_suppkey, s_name FROM {_PLACES} WHERE {_distance('-80.0', '170.0')} <= 2500000")
def geo_radius_parts(spark, d):
    q = suppliers(spark, d)
    return q.filter(place_latitude=-80.0, place_longitude=170.0, place_radius=2_500_000).select(*_SUPPLIER)


@query(
    " UNION ALL ".join(
        f"SELECT '{u}' AS unit, s_suppkey FROM {_PLACES} WHERE {_distance('0.0', '0.0')} <= {r} * {m}"
        for u, r, m in (("m", 4000000, 1), ("km", 4000, 1000), ("ft", 9000000, 0.3048), ("mi", 2000, 1609.344))
    )
)
def geo_radius_units(spark, d):
    q = suppliers(spark, d)
    found = [
        q.filter(place=(0.0, 0.0), place_radius=r, place_radius_unit=u).select(F.lit(u).alias("unit"), "s_suppkey")
        for u, r in (("m", 4000000), ("km", 4000), ("ft", 9000000), ("mi", 2000))
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(
    f"SELECT b.s_suppkey, b.s_name FROM {_PLACES} a, {_PLACES} b WHERE a.s_suppkey = 5 AND {_distance('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 4000000"
)
def geo_near_member(spark, d):
    return related.near_member(suppliers(spark, d).df, "place", F.col("s_suppkey") == 5, 4_000_000).select(*_SUPPLIER)


@query(f"SELECT s_suppkey, s_name FROM {_PLACES} WHERE lat IS NULL")
def geo_isnull(spark, d):
    return suppliers(spark, d).filter(place__isnull=True).select(*_SUPPLIER)


@query(f"SELECT s_suppkey, round({_distance('48.85', '2.35')} / 1000, 3) AS km FROM {_PLACES}")
def geo_distance(spark, d):
    p = F.col("place")
    km = haversine(F.lit(48.85), F.lit(2.35), p["latitude"], p["longitude"]) / 1000
    return suppliers(spark, d).df.select("s_suppkey", F.round(km, 3).alias("km"))


# -- relationships


@query("SELECT * FROM orders WHERE o_custkey = 10")
def rel_exact(spark, d):
    return orders(spark, d).filter(o_custkey=10)


@query("SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE ends_with(n_name, '1'))")
def rel_related_lookup(spark, d):
    return customers(spark, d).filter(c_nationkey__n_name__endswith="1")


@query("SELECT doc_id + 700 AS doc_id, quality FROM labels WHERE doc_id + 700 NOT IN (SELECT doc_id FROM documents)")
def orphan_refs(spark, d):
    moved = read(spark, d, "labels").select((F.col("doc_id") + 700).alias("doc_id"), "quality")
    return related.orphans(moved, "doc_id", read(spark, d, "documents"), "doc_id")


# -- combined


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_acctbal <= 4000 AND c_nationkey = 3")
def multi_filter(spark, d):
    return customers(spark, d).filter(c_mktsegment="BUILDING", c_acctbal__gt=0, c_acctbal__lte=4000, c_nationkey=3)


@query("SELECT * FROM region")
def filter_no_lookup(spark, d):
    return Region.on(read(spark, d, "region")).filter()


@query(
    f"SELECT s.s_suppkey, s.s_name, s_acctbal FROM supplier s JOIN {_PLACES} p USING (s_suppkey) WHERE starts_with(s.s_name, 'S') AND s_acctbal > 0 AND s_acctbal < 9000 "
    f"AND {_distance('0.0', '0.0')} <= 9000000 ORDER BY s_acctbal DESC, s_suppkey LIMIT 20"
)
def kitchen_sink(spark, d):
    q = suppliers(spark, d)
    return q.filter(
        s_name__startswith="S", s_acctbal__gt=0, s_acctbal__lt=9000, place=(0.0, 0.0), place_radius=9000, place_radius_unit="km",
        order_by="-s_acctbal", limit=20, values=("s_suppkey", "s_name", "s_acctbal"),
    )


@query("SELECT count(*) AS n FROM lineitem")
def count_all(spark, d):
    return Order.on(read(spark, d, "lineitem")).count_frame()


@query("SELECT count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 50000")
def count_filtered(spark, d):
    return orders(spark, d).count_frame(o_orderpriority="1-URGENT", o_totalprice__gt=50000)


# -- order and limit


@query(f"SELECT * FROM {_NULLABLE} ORDER BY coalesce(c_mktsegment, ''), c_custkey LIMIT 400")
def order_by_asc(spark, d):
    return nullable_customers(spark, d).all(order_by="c_mktsegment", limit=400)


@query("SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey, c_mktsegment LIMIT 300")
def order_by_desc(spark, d):
    return customers(spark, d).all(order_by="-c_acctbal", limit=300)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 100")
def order_by_values(spark, d):
    return Part.on(read(spark, d, "part").select("p_partkey", "p_retailprice")).all(order_by="p_retailprice", values=("p_partkey", "p_retailprice"), limit=100)


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def topk(spark, d):
    return orders(spark, d).all(order_by="-o_totalprice", limit=50)


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 25")
def topk_key(spark, d):
    return orders(spark, d).filter(o_orderstatus="F", order_by="-o_orderkey", limit=25)


@query()
def limit_only(spark, d):
    return customers(spark, d).all(limit=10)


# -- set operations


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_orderkey FROM orders WHERE o_totalprice > 150000")
def setop_intersect_keys(spark, d):
    q = orders(spark, d)
    return q.filter(o_orderstatus="F", values=("o_orderkey",)).intersect(q.filter(o_totalprice__gt=150000, values=("o_orderkey",)))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def setop_union_keys(spark, d):
    q = orders(spark, d)
    return q.filter(o_orderstatus="P", values=("o_orderkey",)).union(q.filter(o_totalprice__gt=300000, values=("o_orderkey",))).distinct()


# -- saves and deletes

_LINE = ["l_orderkey", "l_linenumber"]
_LATEST = (
    "SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, "
    "l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1"
)


def _latest_lines(df: DataFrame) -> DataFrame:
    version = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return mutate.latest(df, _LINE, *(F.col(c) for c in version))


@query(_LATEST)
def upsert_latest(spark, d):
    return _latest_lines(read(spark, d, "lineitem"))


class Saved(Model):
    o_orderkey = UniqueKeyField(type=int)
    o_orderstatus = KeyField()
    o_totalprice = SortedField(type=float, partition_by=("o_orderstatus",))


_SAVED = (
    "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 5 = 0"
)


def _saved(spark, d) -> Snapshots:
    """Two saves into a partitioned table: orders, then some of them again, changed, new or not valid."""
    table = Snapshots(spark, f"{shared_folder(spark)}/saved-{uuid.uuid4().hex}")
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    again = rows.where("o_orderkey % 5 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    wrong = rows.where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.lit(None).cast("double"))
    Saved.save(table, rows.where("o_orderkey % 11 <> 0"), partition_by=("o_orderstatus",))
    Saved.save(table, again.unionByName(wrong), partition_by=("o_orderstatus",))
    return table


@query(_SAVED)
def save_upsert(spark, d):
    return _saved(spark, d).read().select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"SELECT * FROM ({_SAVED}) WHERE NOT (o_orderstatus = 'O' AND o_totalprice < 150000)")
def destroy(spark, d):
    """Saved rows without those that lookups find; a second model over the same rows lets nothing be deleted."""

    class History(Saved, append_only=True):
        o_orderkey = UniqueKeyField(type=int)
        o_orderstatus = KeyField()

    table = _saved(spark, d)
    Saved.destroy(table, o_orderstatus="O", o_totalprice__lt=150000, partition_by=("o_orderstatus",))
    History.destroy(table, o_orderstatus="F")
    return table.read().select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"SELECT * FROM ({_SAVED}) WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def partitioned_scan(spark, d):
    """A range in one partition of a table whose layout has directories by partition."""
    path = f"{shared_folder(spark)}/sorted-{uuid.uuid4().hex}"
    write_sorted(Saved, _saved(spark, d).read(), path)
    return Saved.on(spark.read.parquet(path)).filter(o_orderstatus="F", o_totalprice__gte=100000).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "SELECT event_type, (epoch_us(ts) // 3600000000) AS hour, max(event_id) AS event_id FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1, 2 "
    "UNION ALL SELECT event_type, (epoch_us(ts) // 3600000000), event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15'"
)
def history_compaction(spark, d):
    e = _t(spark, d).select("event_id", "event_type", "ts", F.floor(F.col("t") / 3600).alias("hour"))
    out = mutate.compacted(e, ["event_type"], F.col("hour"), F.col("ts") < F.lit(dt.datetime(2024, 1, 15)).cast("timestamp_ntz"), F.col("event_id"))
    return out.select("event_type", "hour", "event_id")


@query("SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0 OR doc_id % 2 <> 0")
def delete_by_keys(spark, d):
    df = read(spark, d, "labels").select("doc_id", "quality")
    return mutate.delete_keys(df, df.where("doc_id % 6 = 0"), ["doc_id"])


@query("SELECT o_orderkey, o_totalprice AS price, 'x' AS tag FROM orders")
def migration(spark, d):
    return mutate.migrated(read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), {"o_totalprice": "price"}, {"tag": F.lit("x")}, ("o_orderstatus",))


@query("SELECT event_id FROM events WHERE event_id % 4 = 0 OR ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-20'")
def expiry(spark, d):
    expires = F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.expr("INTERVAL 5 DAYS"))
    df = read(spark, d, "events").withColumn("expires", expires)
    return mutate.alive(df, "expires", F.lit(dt.datetime(2024, 1, 20)).cast("timestamp_ntz")).select("event_id")


class Lap(Model):
    event_id = UniqueKeyField(type=int)
    at = SortedField(type=dt.time)


@query("SELECT event_id, epoch_us(ts) % 86400000000 AS at FROM events WHERE ts::TIME >= TIME '09:30:00' AND ts::TIME < TIME '11:00:00.5'")
def time_range(spark, d):
    at = F.pmod(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(86_400_000_000))
    q = Lap.on(read(spark, d, "events").select("event_id", at.alias("at")))
    return q.filter(at__gte=dt.time(9, 30), at__lt=dt.time(11, 0, 0, 500_000))


class Frames(Model):
    conv_id = UniqueKeyField(type=int)
    turns = FrameField(columns="turn long, role string")


@query("SELECT DISTINCT conv_id, turn, role FROM conversations")
def frame_roundtrip(spark, d):
    """Small tables in cells, saved, read and taken apart again."""
    rows = read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.struct("turn", "role"))).alias("turns"))
    table = Snapshots(spark, f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}")
    Frames.save(table, rows)
    return table.read().select("conv_id", F.inline("turns"))


@query("SELECT c_custkey, c_mktsegment || ':' || c_name AS name FROM customer")
def key_parse(spark, d):
    """Composite key texts of awkward parts, taken apart again."""
    awkward = F.concat_ws(":", "c_mktsegment", "c_name")
    text = scalar.composite_key("Customer", F.col("c_custkey"), awkward)
    parts = read(spark, d, "customer").select(scalar.key_parts(text).alias("parts"))
    return parts.select(F.col("parts")[1].cast("long").alias("c_custkey"), F.col("parts")[2].alias("name"))


@query("SELECT * FROM part WHERE p_partkey IN (3, 5)")
def by_key_text(spark, d):
    class Keyed(Model):
        p_partkey = UniqueKeyField(type=int)
        p_name = StringField()

    return Keyed.on(read(spark, d, "part")).by_key_text("Keyed:3", "Keyed:5")


@query(
    "SELECT CASE WHEN n_nationkey < 5 THEN n_nationkey + 20 ELSE n_nationkey END::INTEGER AS n_nationkey, n_name, n_regionkey FROM nation "
    "WHERE n_nationkey < 20"
)
def rekey(spark, d):
    df = read(spark, d, "nation")
    return mutate.rekey(df, F.col("n_nationkey") < 5, n_nationkey=(F.col("n_nationkey") + 20).cast("int"))


@query("SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000)")
def delete_by_filter(spark, d):
    q = orders(spark, d)
    return mutate.delete(q.df, q.predicate(o_orderstatus="F", o_totalprice__lt=100000))


@query("SELECT event_type || ':' || (epoch_us(ts) // 1000000) AS uid, event_type, value FROM events")
def derived_key_on_save(spark, d):
    class Point(Model):
        uid = UniqueKeyField()
        event_type = KeyField()
        value = FloatField()

        @classmethod
        def derive(cls, df):
            return df.withColumn("uid", F.concat_ws(":", "event_type", scalar.unix_seconds(F.col("ts"))))

    return Point.prepared(read(spark, d, "events"))


@query(
    "SELECT event_id, event_type, printf('%.5e', value)::DOUBLE AS value FROM events WHERE event_type IN ('click', 'purchase', 'view') AND value <= 400"
)
def validated_points(spark, d):
    class Point(Model):
        event_id = UniqueKeyField(type=int)
        event_type = KeyField()
        value = FloatField(null=False)

        @classmethod
        def derive(cls, df):
            ok = F.col("event_type").isin("click", "purchase", "view") & (F.col("value") <= 400)
            return df.withColumn("value", F.when(ok, scalar.significant(F.col("value"))))

    good, _ = Point.split_valid(read(spark, d, "events"))
    return good


@query(
    "SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'delete' ELSE 'update' END AS change "
    "FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice - CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END ELSE o_totalprice END AS o_totalprice FROM orders) WHERE o_orderkey % 7 = 0 OR o_orderkey % 10 = 0"
)
def change_feed(spark, d):
    before = read(spark, d, "orders").select("o_orderkey", "o_totalprice")
    changed = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    after = before.where(F.col("o_orderkey") % 7 != 0).withColumn("o_totalprice", changed)
    return mutate.change_feed(before, after, ["o_orderkey"])


# -- encoding and scalar functions


@query("SELECT * FROM customer")
def encode_decode_roundtrip(spark, d):
    df = read(spark, d, "customer")
    return decoded(encoded(df), df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query(
    "SELECT o_orderkey, epoch_us(o_orderdate) / 1e6 AS ts_score, (date_diff('day', DATE '0001-01-01', o_orderdate::DATE) + 1)::DOUBLE AS day_score, o_totalprice AS price_score FROM orders"
)
def numeric_score(spark, d):
    ts, price = F.col("o_orderdate"), F.col("o_totalprice").cast("decimal(18,6)")
    return read(spark, d, "orders").select(
        "o_orderkey",
        scalar.numeric_score(ts, T.TimestampNTZType()).alias("ts_score"),
        scalar.numeric_score(ts.cast("date"), T.DateType()).alias("day_score"),
        scalar.numeric_score(price, T.DecimalType(18, 6)).alias("price_score"),
    )


@query()
def auto_key(spark, d):
    return AutoPart.prepared(read(spark, d, "part").select("p_name"))


def _t(spark, d):
    return read(spark, d, "events").withColumn("t", scalar.unix_seconds(F.col("ts")))


_T = "(SELECT *, epoch_us(ts) // 1000000 AS t FROM events)"


@query(f"SELECT event_id, (t - 1483228800) / 300.0::DOUBLE AS score FROM {_T}")
def score_from_ts(spark, d):
    return _t(spark, d).select("event_id", scalar.score_from_ts(F.col("t")).alias("score"))


_S = f"(SELECT *, (t - 1483228800) // 300 AS s FROM {_T})"


def _s(spark, d):
    return _t(spark, d).withColumn("s", F.floor(scalar.score_from_ts(F.col("t"))))


@query(f"SELECT event_id, ((t + 21600) // 86400) * 86400 AS day, ((s + 72) // 288) * 288 AS day_score FROM {_S}")
def bucket_1day(spark, d):
    return _s(spark, d).select("event_id", scalar.nearest_day(F.col("t")).alias("day"), scalar.nearest_day_score(F.col("s")).alias("day_score"))


@query(f"SELECT event_id, ((t + 150) // 3600) * 3600 AS hour, ((s + 3) // 12) * 12 AS hour_score FROM {_S}")
def bucket_1hr(spark, d):
    return _s(spark, d).select("event_id", scalar.nearest_hour(F.col("t")).alias("hour"), scalar.nearest_hour_score(F.col("s")).alias("hour_score"))


@query(f"SELECT event_id, ((t + 45) // 300) * 300 AS mark, round_even((t - 1483228800) / 300.0::DOUBLE, 0)::BIGINT AS mark_score FROM {_T}")
def bucket_5min(spark, d):
    score = scalar.score_from_ts(F.col("t"))
    return _t(spark, d).select("event_id", scalar.nearest_5min(F.col("t")).alias("mark"), scalar.nearest_5min_score(score).alias("mark_score"))


@query(f"SELECT event_id, (t + 150) % 3600 < 300 AS near, s % 12 < 3 OR s % 12 > 9 AS near_score FROM {_S}")
def near_1hr(spark, d):
    return _s(spark, d).select("event_id", scalar.is_near_hour(F.col("t")).alias("near"), scalar.is_near_hour_score(F.col("s")).alias("near_score"))


@query(f"SELECT event_id, (t + 45) % 300 < 90 AS near FROM {_T}")
def near_5min(spark, d):
    return _t(spark, d).select("event_id", scalar.is_near_5min(F.col("t")).alias("near"))


@query(f"SELECT event_id, abs(s - round_even(s, 0)) < 0.15 AS near FROM (SELECT event_id, (t - 1483228800) / 300.0::DOUBLE AS s FROM {_T})")
def near_5min_score(spark, d):
    return _t(spark, d).select("event_id", scalar.is_near_5min_score(scalar.score_from_ts(F.col("t"))).alias("near"))


@query(f"SELECT event_id, ((t + 45) // 300) * 300 AS mark, ((t + 150) // 3600) * 3600 AS hour, (t + 45) % 300 < 90 AS near FROM {_T}")
def sql_functions(spark, d):
    """The functions called from SQL text."""
    scalar.register_functions(spark)
    return _t(spark, d).selectExpr("event_id", "nearest_5min(t) AS mark", "nearest_1hr(t) AS hour", "is_near_5min(t) AS near")


@query("SELECT event_id, printf('%.5e', value * 1.2345678)::DOUBLE AS v FROM events")
def sigfig6(spark, d):
    return read(spark, d, "events").select("event_id", scalar.significant(F.col("value") * 1.2345678).alias("v"))


@query(
    "SELECT event_id, sign(v) * floor(abs(v) * k + 0.5) / k AS r FROM (SELECT event_id, v, pow(10.0, (4 - length((trunc(abs(v))::BIGINT)::VARCHAR))::DOUBLE) AS k "
    "FROM (SELECT event_id, value - 200 AS v FROM events))"
)
def round_sig_figs(spark, d):
    return read(spark, d, "events").select("event_id", scalar.round_to_figures(F.col("value") - 200, 4).alias("r"))


@query(
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'traffic' WHEN event_type IN ('purchase', 'signup') THEN 'conversion' ELSE 'other' END AS asset_class FROM events"
)
def asset_class(spark, d):
    classes = {"traffic": ["click", "view"], "conversion": ["purchase", "signup"]}
    return read(spark, d, "events").select("event_id", scalar.asset_class(F.col("event_type"), classes).alias("asset_class"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('RE')) ORDER BY p_name, p_partkey LIMIT 1")
def name_icontains(spark, d):
    return parts(spark, d).df.where(F.contains(F.lower("p_name"), F.lower(F.lit("RE")))).orderBy("p_name", "p_partkey").select("p_partkey", "p_name").limit(1)


@query()
def model_info(spark, d):
    return Customer.info(spark).unionByName(Supplier.info(spark)).unionByName(Order.info(spark))


@query("SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_violations(spark, d):
    class Line(Model):
        l_orderkey = KeyField(type=int)
        l_linenumber = KeyField(type=int)

    return Line.duplicates(read(spark, d, "lineitem")).select("l_orderkey", "l_linenumber", "rows")
