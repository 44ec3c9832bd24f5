"""Lookups, nulls, ordering, errors, saves: the semantics on small tables."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modelframe.errors import ModelError, QueryError
from modelframe.fields import AutoKeyField, FloatField, GeoField, KeyField, Relationship, SortedField, StringField, UniqueKeyField
from modelframe.functions import recursive, scalar
from modelframe.model import Model
from modelframe.operators import mutate, series
from modelframe.sources.tables import Snapshots


class Thing(Model):
    int_key = KeyField(type=int)
    str_key = KeyField()
    float_value = FloatField()
    str_value = StringField()


@pytest.fixture(scope="module")
def things(spark):
    data = [(1, "1", 1.1, "1.1"), (2, "2", 2.2, "2.2"), (0, "0", None, None), (5, "1", 1.123, "1.123")]
    return Thing.on(spark.createDataFrame(data, "int_key long, str_key string, float_value double, str_value string"))


def keys(df):
    return [r["int_key"] for r in df.collect()]


def test_order_and_limit(things):
    assert keys(things.all(order_by="float_value")) == [0, 1, 5, 2]
    assert keys(things.all(order_by="float_value", limit=3))[-1] == 5
    assert keys(things.filter(int_key__in=[1, 5], order_by="-int_key", limit=1)) == [5]
    assert keys(things.filter(str_key__startswith="1", order_by="int_key", limit=1)) == [1]
    assert things.filter(limit=2).count() == 2


def test_a_number_matches_text_as_text(things):
    assert sorted(keys(things.filter(str_key=1))) == [1, 5]


def test_empty_in_and_missing(things):
    assert things.count(int_key__in=[]) == 0
    assert things.get(int_key=77) is None
    assert things.get(int_key=2)["str_value"] == "2.2"
    assert things.count() == 4 and things.exists(int_key=1)


@pytest.mark.parametrize(
    "lookups", [{"nothing": 1}, {"float_value": 1.0}, {"str_key__isnull": "yes"}, {"int_key__gt": 1}, {"str_key__startswit": "1"}]
)
def test_wrong_lookups(things, lookups):
    with pytest.raises(QueryError):
        things.filter(**lookups)


def test_wrong_shapes(things):
    for wrong in ({"order_by": "none"}, {"order_by": 3}, {"values": ["int_key"]}, {"values": ("no",)}, {"order_by": "int_key", "values": ("str_key",)}):
        with pytest.raises(QueryError):
            things.all(**wrong)
    with pytest.raises(QueryError):
        things.get(str_key="1")


def test_model_errors():
    with pytest.raises(ModelError):
        KeyField(type=list)
    with pytest.raises(ModelError):
        AutoKeyField(null=True)
    with pytest.raises(ModelError):
        SortedField(type=str)
    with pytest.raises(ModelError):
        type("Bad", (Model,), {"Upper": StringField()})
    with pytest.raises(ModelError):
        type("Bad", (Model,), {"limit": StringField()})


def test_partition_is_needed(spark):
    class Asset(Model):
        uid = UniqueKeyField()
        market = KeyField()
        at = SortedField(type=dt.datetime, partition_by=("market",))

    q = Asset.on(spark.createDataFrame([("a", "m", dt.datetime(2021, 1, 1))], "uid string, market string, at timestamp_ntz"))
    with pytest.raises(QueryError):
        q.filter(at__gte=dt.datetime(2020, 1, 1))
    assert q.filter(at__gte=dt.datetime(2020, 1, 1), market="m").count() == 1


def test_geo(spark):
    class Geo(Model):
        key = KeyField()
        coordinates = GeoField()

    data = [("Rome", (41.902782, 12.496366)), ("Vatican", (41.904755, 12.454628)), ("Area 51", (None, None)), ("Null", (0.0, 0.0)), ("Fiji", (-17.8, 179.9))]
    q = Geo.on(spark.createDataFrame(data, "key string, coordinates struct<latitude: double, longitude: double>"))
    found = lambda **k: sorted(r["key"] for r in q.filter(**k).collect())
    rome = q.get(key="Rome")
    assert found(coordinates=(41.902782, 12.496366)) == ["Rome"]
    assert found(coordinates_member=rome, coordinates_radius=5, coordinates_radius_unit="km") == ["Rome", "Vatican"]
    assert found(coordinates=(0.0, 0.0)) == ["Null"]
    assert found(coordinates=(-17.8, -179.9), coordinates_radius=50, coordinates_radius_unit="km") == ["Fiji"]
    assert found(coordinates__isnull=True) == ["Area 51"]
    with pytest.raises(QueryError):
        q.filter(coordinates=(0, 0), coordinates_radius_unit="au")
    with pytest.raises(QueryError):
        q.filter(coordinates_radius=3)


def test_relationships(spark):
    class Sign(Model):
        name = KeyField()

    class Person(Model):
        who = KeyField()
        sign = Relationship(model=Sign)

    signs = spark.createDataFrame([("Leo",), ("Virgo",)], "name string")
    people = Person.on(spark.createDataFrame([("a", "Leo"), ("b", "Virgo"), ("c", None)], "who string, sign string"), {Sign: signs})
    assert people.filter(sign="Leo").count() == 1
    assert people.filter(sign=signs.where("name = 'Leo'").first()).count() == 1
    assert people.filter(sign__name__in=["Leo", "Virgo"]).count() == 2
    assert people.filter(sign=None).count() == 1
    with pytest.raises(QueryError):
        people.filter(sign=[1])


def test_saves(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    after = mutate.upsert(old, new, ["k"], F.col("at"))
    assert sorted(map(tuple, after.collect())) == [(1, "a", 1), (2, "d", 3), (3, "e", 1)]
    feed = mutate.change_feed(old, after, ["k"])
    assert sorted((r["k"], r["change"]) for r in feed.collect()) == [(2, "update"), (3, "insert")]
    moved = mutate.rekey(old, F.col("k") == 1, k=F.lit(2))
    assert [tuple(r) for r in moved.collect()] == [(2, "a", 1)]
    assert mutate.delete(old, F.col("v") == "a").count() == 1


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, f"file://{tmp_path}/t")
    s.write(spark.range(3).toDF("id"))
    s.write(s.read().where("id > 0"))
    assert s.read().count() == 2 and s.read(1).count() == 3


def test_rejects(spark):
    class P(Model):
        uid = UniqueKeyField(max_length=3)
        n = FloatField(null=False)

    good, bad = P.split_valid(spark.createDataFrame([("a", "1"), (None, "2"), ("long", "3"), ("b", "x")], "uid string, n string"))
    assert [tuple(r) for r in good.collect()] == [("a", 1.0)]
    assert sorted(p for r in bad.collect() for p in r["_problems"]) == ["n:type", "uid:max_length", "uid:null"]


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab/:?*^[]-'{}&#;58", max_size=8), min_size=1, max_size=20))
def test_key_text_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts if "{&#58;}" not in t] or [("",)], "t string")
    back = scalar.unescape_key(scalar.escape_key(F.col("t")))
    assert df.where(~back.eqNullSafe(F.col("t"))).count() == 0


def test_gaps(spark):
    df = spark.createDataFrame([(1, 2), (1, 5), (1, 6), (2, 9), (1, 2)], "g int, n int")
    assert sorted(map(tuple, series.missing_between(df, ["g"], "n").collect())) == [(1, 3), (1, 4)]


def plain_wilder_dx(h, l, c, n):
    plus = minus = 0.0
    out = [None] * len(c)
    for t in range(1, len(c)):
        up, down = h[t] - h[t - 1], l[t - 1] - l[t]
        p, m = (up if up > down and up > 0 else 0.0), (down if down > up and down > 0 else 0.0)
        if t < n:
            plus, minus = plus + p, minus + m
        else:
            plus, minus = plus - plus / n + p, minus - minus / n + m
            out[t] = 100 * abs(plus - minus) / (plus + minus) if plus + minus else 0.0
    return out


def plain_kama(c, n):
    out, last = [None] * len(c), None
    for t in range(n, len(c)):
        moved = sum(abs(c[i] - c[i - 1]) for i in range(t - n + 1, t + 1))
        ratio = abs(c[t] - c[t - n]) / moved if moved else 1.0
        k = (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        last = (c[n - 1] if last is None else last)
        last += k * (c[t] - last)
        out[t] = last
    return out


def plain_adx(dx, n):
    """The mean of the first n, then an n-th of each further one; and its mean with the one n - 1 bars before."""
    out, first = [None] * len(dx), next(t for t, x in enumerate(dx) if x is not None)
    out[first + n - 1] = sum(dx[first : first + n]) / n
    for t in range(first + n, len(dx)):
        out[t] = (out[t - 1] * (n - 1) + dx[t]) / n
    rated = [(x + out[t - n + 1]) / 2 if x is not None and t >= n - 1 and out[t - n + 1] is not None else None for t, x in enumerate(out)]
    return out, rated


def test_trendline():
    """What the method says of any series: constants stay, scales and levels carry over, a cycle is averaged out."""
    import numpy as np

    from modelframe.functions.hilbert import WARM_UP, trendline

    r = np.random.default_rng(5)
    price = 100 + r.standard_normal(300).cumsum()
    line = trendline(price)
    assert np.isnan(line[:WARM_UP]).all() and not np.isnan(line[WARM_UP:]).any()
    assert np.allclose(trendline(np.full(120, 7.0))[WARM_UP:], 7.0)
    assert np.allclose(trendline(price * 3)[WARM_UP:], 3 * line[WARM_UP:])
    wave = 50 + np.sin(2 * np.pi * np.arange(400) / 20)
    assert np.abs(trendline(wave)[200:] - 50).max() < 0.1
    # within the values it averages, at most 50 and three bars more
    assert all(price[t - 53 if t > 53 else 0 : t + 1].min() <= line[t] <= price[t - 53 if t > 53 else 0 : t + 1].max() for t in range(WARM_UP, 300))


def test_folds_against_loops(spark):
    import random

    r = random.Random(3)
    c = [100.0]
    for _ in range(120):
        c.append(c[-1] + r.uniform(-2, 2))
    h, l = [x + r.uniform(0, 1) for x in c], [x - r.uniform(0, 1) for x in c]
    df = spark.createDataFrame([("s", i, *x) for i, x in enumerate(zip(h, l, c))], "g string, i int, high double, low double, close double")
    out = recursive.series(df, ["g"], "i", "high", "low", "close")
    out = recursive.steps(out, h=F.transform("bars", lambda b: b["high"]), l=F.transform("bars", lambda b: b["low"]), c=F.transform("bars", lambda b: b["close"]))
    of = F.col
    out = recursive.steps(
        out,
        plus=recursive.wilder_sum(recursive.directional(of("h"), of("l"), of("c"))[0], 14),
        minus=recursive.wilder_sum(recursive.directional(of("h"), of("l"), of("c"))[1], 14),
        dx=recursive.dx_of(of("plus"), of("minus")),
        moves=F.transform(recursive.differences(of("c")), lambda x: F.abs(x)),
        kama=recursive.kama_of(of("c"), of("moves"), 30),
        adx=recursive.wilder(of("dx"), 14),
        adxr=recursive.adxr_of(of("adx"), 14),
    )
    rows = recursive.per_bar(out, ["g"], "i", dx="dx", kama="kama", adx="adx", adxr="adxr").orderBy("i").collect()
    dx = plain_wilder_dx(h, l, c, 14)
    adx, adxr = plain_adx(dx, 14)
    for name, plain in (("dx", dx), ("kama", plain_kama(c, 30)), ("adx", adx), ("adxr", adxr)):
        for row, want in zip(rows, plain):
            assert (row[name] is None) == (want is None) and (want is None or abs(row[name] - want) < 1e-9)
