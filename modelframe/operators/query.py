"""Keyword lookups compiled to one conjunctive predicate over a DataFrame."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelframe.errors import QueryError
from modelframe.fields import KEY_TYPES, Field, GeoField, Relationship, SortedField
from modelframe.functions import geo, scalar

_GEO_PARTS = ("latitude", "longitude", "radius", "radius_unit", "member")


def plain(field: Field, value: Any) -> Any:
    """The value as the column holds it, or QueryError: times are microseconds of the day, text reads as the column's type."""
    kind = field.data_type
    if value is None:
        return None
    try:
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else str(value)
        if field.type is dt.time and not isinstance(value, int):
            t = dt.time.fromisoformat(value) if isinstance(value, str) else value
            return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond
        if isinstance(kind, T.NumericType):
            return Decimal(value) if isinstance(value, str) else value + 0
        if isinstance(kind, T.DateType):
            return dt.date.fromisoformat(value) if isinstance(value, str) else dt.date(value.year, value.month, value.day)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            when = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
            return when if isinstance(when, dt.datetime) else dt.datetime(when.year, when.month, when.day)
    except (TypeError, ValueError, AttributeError, InvalidOperation) as e:
        raise QueryError(f"{field.name} can't be compared with {value!r}") from e
    return value


def literal(field: Field, value: Any) -> Column:
    """The value in the column's type; a string column compares with the value's text, never as a number."""
    return F.lit(plain(field, value)).cast(field.data_type)


def compare(field: Field, column: Column, op: str, value: Any) -> Column:
    """The predicate of one lookup."""
    if op == "isnull" or (op == "" and value is None):
        if op == "isnull" and value not in (True, False):
            raise QueryError(f"{field.name}__isnull takes True or False")
        return column.isNull() if value in (True, None) else column.isNotNull()
    if op == "in":
        # an empty list matches nothing
        return column.isin([literal(field, v) for v in value]) if len(value) else F.lit(False)
    if op in ("startswith", "endswith", "contains"):
        return getattr(column.cast("string"), op)(str(value))
    right = literal(field, value)
    return {"": column == right, "gt": column > right, "gte": column >= right, "lt": column < right, "lte": column <= right}[op]


def zero_first(field: Field, column: Column) -> Column:
    """The ordering key: null sorts with the type's zero value, or first for dates and times."""
    kind = field.data_type
    if isinstance(kind, T.NumericType):
        return F.coalesce(column, F.lit(0).cast(kind))
    if isinstance(kind, T.StringType):
        return F.coalesce(column, F.lit(""))
    return F.coalesce(column, F.lit(False)) if isinstance(kind, T.BooleanType) else column


class Query:
    """Queries of a model bound to a table. All return DataFrames but count, get and exists."""

    def __init__(self, model: type, df: DataFrame, related: dict[type, DataFrame]):
        self.model, self.df, self.related = model, df, related

    # -- lookups

    def _parse(self, lookups: dict[str, Any]) -> tuple[dict[str, list[tuple[str, Any]]], dict[str, dict], dict[str, list[tuple[str, Any]]]]:
        """By field: plain lookups, parts of geo searches, lookups on related models. Names are taken whole."""
        plain: dict[str, list] = {}
        places: dict[str, dict] = {}
        beyond: dict[str, list] = {}
        wrong = []
        for name, value in lookups.items():
            head, _, op = name.partition("__")
            field = self.model.fields.get(head)
            if isinstance(field, GeoField) and op in ("", "isnull"):
                places.setdefault(head, {})["isnull" if op else "center"] = value
            elif isinstance(field, Relationship):
                beyond.setdefault(head, []).append((op, value))
            elif field is not None and op in field.lookups:
                plain.setdefault(head, []).append((op, value))
            else:
                geo_field, _, part = name.rpartition("_")
                if name.endswith("_radius_unit"):
                    geo_field, part = name.removesuffix("_radius_unit"), "radius_unit"
                if isinstance(self.model.fields.get(geo_field), GeoField) and part in _GEO_PARTS:
                    places.setdefault(geo_field, {})[part] = value
                else:
                    wrong.append(name)
        if wrong:
            raise QueryError(f"{self.model.__name__} has no lookups {', '.join(sorted(wrong))}")
        return plain, places, beyond

    def predicate(self, **lookups: Any) -> Column:
        """The conjunction of all lookups but those on related models."""
        plain, places, _ = self._parse(lookups)
        terms = []
        for name, found in plain.items():
            field = self.model.fields[name]
            if isinstance(field, SortedField):
                self._need_partitions(field, plain)
            terms += [compare(field, F.col(name), op, value) for op, value in found]
        terms += [self._near(name, parts) for name, parts in places.items()]
        return reduce(lambda a, b: a & b, terms, F.lit(True))

    @staticmethod
    def _need_partitions(field: SortedField, plain: dict[str, list]) -> None:
        for p in field.partition_by:
            if not any(op == "" for op, _ in plain.get(p, ())):
                raise QueryError(f"a lookup on {field.name} needs {p}= as well, its partition")

    def _near(self, name: str, parts: dict[str, Any]) -> Column:
        column = F.col(name)
        if "isnull" in parts:
            here = column["latitude"].isNull() | column["longitude"].isNull()
            return here if parts["isnull"] else ~here
        if "member" in parts:
            place = parts["member"][name]
            center = (place["latitude"], place["longitude"]) if place is not None else (None, None)
        elif "center" in parts:
            center = tuple(parts["center"])
        else:
            center = (parts.get("latitude"), parts.get("longitude"))
        if center[0] is None or center[1] is None:
            raise QueryError(f"{name} needs a latitude and a longitude")
        radius = geo.metres(parts.get("radius", 1), parts.get("radius_unit", "m"))
        return geo.within(column["latitude"], column["longitude"], center, radius)

    def _beyond(self, df: DataFrame, beyond: dict[str, list[tuple[str, Any]]]) -> DataFrame:
        for name, found in beyond.items():
            field = self.model.fields[name]
            key = field.key_name
            through = {}
            for path, value in found:
                if path:
                    through[path] = value
                    continue
                if isinstance(value, Row):
                    value = value[key]
                elif value is not None and not isinstance(value, KEY_TYPES):
                    raise QueryError(f"{name} takes a row of {field.model.__name__} or its key")
                there = F.lit(None) if value is None else literal(field.model.fields[key], value)
                df = df.where(F.col(name).eqNullSafe(there))
            if through:
                if field.model not in self.related:
                    raise QueryError(f"no table of {field.model.__name__} is bound")
                # any related row that matches will do: a semi join, one level deep
                there = Query(field.model, self.related[field.model], {}).filter(**through)
                df = df.join(there.select(F.col(key).alias(f"__{key}")), F.col(name) == F.col(f"__{key}"), "left_semi")
        return df

    # -- queries

    def filter(self, order_by: str | None = None, limit: int | None = None, values: tuple[str, ...] | None = None, **lookups: Any) -> DataFrame:
        """Rows that match all lookups; all rows without any."""
        *_, beyond = self._parse(lookups)
        df = self._beyond(self.df.where(self.predicate(**lookups)), beyond) if lookups else self.df
        return self.shaped(df, order_by, limit, values)

    def all(self, order_by: str | None = None, limit: int | None = None, values: tuple[str, ...] | None = None) -> DataFrame:
        return self.shaped(self.df, order_by, limit, values)

    def shaped(self, df: DataFrame, order_by: str | None = None, limit: int | None = None, values: tuple[str, ...] | None = None) -> DataFrame:
        """Ordered (key columns break ties), cut and projected."""
        if values is not None:
            if not isinstance(values, tuple):
                raise QueryError("values takes a tuple of column names")
            if unknown := [v for v in values if v not in self.model.fields]:
                raise QueryError(f"no fields {', '.join(unknown)}")
        if order_by is not None:
            name = order_by.removeprefix("-") if isinstance(order_by, str) else None
            if name not in self.model.fields:
                raise QueryError(f"can't order by {order_by!r}")
            if values is not None and name not in values:
                raise QueryError("the column to order by must be among values")
            key = zero_first(self.model.fields[name], F.col(name))
            ties = [F.col(k).asc() for k in self.model.key_names() if k != name and k in df.columns]
            df = df.orderBy(key.desc_nulls_last() if order_by[0] == "-" else key.asc_nulls_first(), *ties)
        if limit is not None:
            df = df.limit(limit)
        return df.select(*values) if values is not None else df

    def get(self, **lookups: Any) -> Row | None:
        """The one row that matches, None if none does."""
        rows = self.filter(**lookups).limit(2).collect()
        if len(rows) > 1:
            raise QueryError("more than one row matches")
        return rows[0] if rows else None

    def by_key_text(self, *texts: str) -> DataFrame:
        """The rows whose composite keys read so, one filter on the key columns."""
        names, rows = self.model.key_names(), []
        for text in texts:
            model, *parts = scalar.key_text_parts(text)
            if model != self.model.__name__ or len(parts) != len(names):
                raise QueryError(f"{text!r} is no key of {self.model.__name__}")
            same = [F.col(n).isNull() if p is None else F.col(n) == literal(self.model.fields[n], p) for n, p in zip(names, parts)]
            rows.append(reduce(lambda a, b: a & b, same))
        return self.df.where(reduce(lambda a, b: a | b, rows, F.lit(False)))

    def count_frame(self, **lookups: Any) -> DataFrame:
        limit = lookups.pop("limit", None)
        return self.filter(limit=limit, **lookups).agg(F.count("*").alias("n"))

    def count(self, **lookups: Any) -> int:
        return self.count_frame(**lookups).first()["n"]

    def keys(self) -> DataFrame:
        return self.df.select(*self.model.key_names())

    def exists(self, **key: Any) -> bool:
        return bool(self.filter(limit=1, **key).count())

    def get_many(self, keys: DataFrame, order_by: str | None = None, limit: int | None = None, values: tuple[str, ...] | None = None) -> DataFrame:
        """Rows whose key is among keys."""
        names = self.model.key_names()
        return self.shaped(self.df.join(keys.select(*names).distinct(), names, "left_semi"), order_by, limit, values)
