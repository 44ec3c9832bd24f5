"""Relationships as joins: eager expansion, traversal, orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelframe.errors import QueryError
from modelframe.fields import Relationship
from modelframe.functions.geo import haversine


def expanded(model: type, df: DataFrame, related: dict[type, DataFrame], _seen: frozenset = frozenset()) -> DataFrame:
    """Each relationship column replaced by the related row as a struct (null if there is none), at every level.

    A (model, field) is expanded once along a chain, so cycles end. One left join each: Catalyst broadcasts small sides.
    """
    for name, field in model.fields.items():
        if not isinstance(field, Relationship) or (model, name) in _seen or name not in df.columns:
            continue
        if field.model not in related:
            raise QueryError(f"no table of {field.model.__name__} is bound")
        key = field.key_name
        there = related[field.model]
        if field.model.key_names() != [key]:  # a part of a key may repeat; a row has one related row
            there = there.dropDuplicates([key])
        there = expanded(field.model, there, related, _seen | {(model, name)})
        side = there.select(F.col(key).alias("__key"), F.struct(*there.columns).alias("__row"))
        order = df.columns
        df = df.join(side, F.col(name) == F.col("__key"), "left").drop(name, "__key").withColumnRenamed("__row", name).select(*order)
    return df


def traverse(df: DataFrame, name: str, there: DataFrame, key: str, *columns: str) -> DataFrame:
    """The related rows' columns, one row for each row of df that has a related one."""
    return df.join(there, df[name] == there[key]).select(*(there[c] for c in columns))


def orphans(df: DataFrame, name: str, there: DataFrame, key: str) -> DataFrame:
    """Rows of df whose reference names no row there."""
    return df.where(F.col(name).isNotNull()).join(there.select(F.col(key).alias("__key")), F.col(name) == F.col("__key"), "left_anti")


def near_member(df: DataFrame, place: str, member: Column, radius_m: float) -> DataFrame:
    """Rows within a radius of the one row that `member` names, rows without coordinates aside.

    The member is one row, so the box around it is a join of one row with a bounded side.
    """
    center = df.where(member).select(F.col(f"{place}.latitude").alias("__lat"), F.col(f"{place}.longitude").alias("__lon")).limit(1)
    lat, lon = F.col(f"{place}.latitude"), F.col(f"{place}.longitude")
    near = haversine(F.col("__lat"), F.col("__lon"), lat, lon) <= radius_m
    return df.join(F.broadcast(center), near).drop("__lat", "__lon")
