"""Column roles of a model: what type a column has, how it is validated, and which lookups it answers."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelframe.errors import ModelError

SQL_TYPES: dict[Any, T.DataType] = {
    int: T.LongType(),
    float: T.DoubleType(),
    Decimal: T.DecimalType(38, 18),
    str: T.StringType(),
    bool: T.BooleanType(),
    bytes: T.BinaryType(),
    list: T.ArrayType(T.LongType()),
    dict: T.MapType(T.StringType(), T.LongType()),
    set: T.ArrayType(T.LongType()),
    tuple: T.ArrayType(T.LongType()),
    dt.date: T.DateType(),
    dt.datetime: T.TimestampNTZType(),
    dt.time: T.LongType(),  # microseconds of the day: TIME can't be written to Parquet
}
KEY_TYPES = (int, float, Decimal, str, bool, dt.date, dt.datetime, dt.time)
SORTED_TYPES = (int, float, Decimal, dt.date, dt.datetime, dt.time)
KEY_LOOKUPS = ("", "in", "isnull", "startswith", "endswith", "contains")
SORTED_LOOKUPS = ("", "gt", "gte", "lt", "lte")


@dataclass(frozen=True)
class Field:
    """A plain column; not filterable."""

    type: Any = str
    null: bool = True
    default: Any = None
    max_length: int = 1024
    sql_type: T.DataType | None = None
    name: str = ""
    lookups: tuple[str, ...] = field(default=(), init=False)

    def __post_init__(self) -> None:
        if self.type not in SQL_TYPES and self.sql_type is None:
            raise ModelError(f"no column type for {self.type!r}")

    @property
    def data_type(self) -> T.DataType:
        return self.sql_type or SQL_TYPES[self.type]

    def named(self, name: str) -> Field:
        return replace(self, name=name)

    def formatted(self, column: Column) -> Column:
        """The column's value before it is saved: cast where that can be done, with the default for null."""
        kind = self.data_type
        out = column.try_cast(kind) if isinstance(kind, T.AtomicType) else column
        if self.type is set and isinstance(kind, T.ArrayType):
            out = F.array_sort(F.array_distinct(out))
        return out if self.default is None else F.coalesce(out, F.lit(self.default).cast(kind))

    def violations(self, column: Column) -> list[tuple[str, Column]]:
        """What makes a value of the column, as given, not valid."""
        kind, found = self.data_type, []
        if isinstance(kind, T.AtomicType):
            found.append(("type", column.isNotNull() & column.try_cast(kind).isNull()))
        if not self.null and self.default is None:
            found.append(("null", column.isNull()))
        if self.type is str and self.max_length:
            found.append(("max_length", F.length(column.cast("string")) > self.max_length))
        return found


@dataclass(frozen=True)
class KeyField(Field):
    """Part of a row's key; answers equality, membership and text lookups."""

    max_length: int = 128

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.type not in KEY_TYPES:
            raise ModelError(f"a key can't be of type {self.type!r}")
        object.__setattr__(self, "lookups", KEY_LOOKUPS)


@dataclass(frozen=True)
class UniqueKeyField(KeyField):
    null: bool = False

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.null:
            raise ModelError("a unique key can't be null")


@dataclass(frozen=True)
class AutoKeyField(UniqueKeyField):
    """A key of random hexadecimal digits for rows that bring none."""

    length: int = 32

    def formatted(self, column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, self.length))

    def violations(self, column: Column) -> list[tuple[str, Column]]:
        return []


@dataclass(frozen=True)
class SortedField(Field):
    """Answers equality and ranges; with partition columns, each query names a value of every one of them."""

    type: Any = float
    null: bool = False
    partition_by: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.type not in SORTED_TYPES:
            raise ModelError(f"a sorted column can't be of type {self.type!r}")
        object.__setattr__(self, "lookups", SORTED_LOOKUPS)


@dataclass(frozen=True)
class SortedKeyField(SortedField):
    def __post_init__(self) -> None:
        super().__post_init__()
        object.__setattr__(self, "lookups", tuple(dict.fromkeys(SORTED_LOOKUPS + KEY_LOOKUPS)))


@dataclass(frozen=True)
class GeoField(Field):
    """struct<latitude, longitude>; answers radius searches."""

    type: Any = tuple

    @property
    def data_type(self) -> T.DataType:
        return T.StructType([T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType())])

    def violations(self, column: Column) -> list[tuple[str, Column]]:
        lat, lon = column["latitude"], column["longitude"]
        bad = (lat.isNull() != lon.isNull()) | (F.abs(lat) > 90) | (F.abs(lon) > 180)
        return [("coordinates", F.coalesce(bad, F.lit(False)))] + ([] if self.null else [("null", lat.isNull())])


@dataclass(frozen=True)
class Relationship(Field):
    """A foreign key to a key column of another model, its first unless named."""

    model: Any = None
    key: str = ""

    def __post_init__(self) -> None:
        if self.model is None:
            raise ModelError("a relationship needs a model")

    @property
    def data_type(self) -> T.DataType:
        return self.model.fields[self.key_name].data_type

    @property
    def key_name(self) -> str:
        return self.key or self.model.key_names()[0]


@dataclass(frozen=True)
class DatetimeField(Field):
    """auto_now: the time of every save; auto_now_add: of the first."""

    type: Any = dt.datetime
    auto_now: bool = False
    auto_now_add: bool = False

    def formatted(self, column: Column) -> Column:
        if self.auto_now:
            return F.localtimestamp()
        out = super().formatted(column)
        return F.coalesce(out, F.localtimestamp()) if self.auto_now_add else out


@dataclass(frozen=True)
class FrameField(Field):
    """A small table in one cell: array<struct> of the columns named as in SQL, `Brand string, Price long`."""

    type: Any = list
    columns: str = ""

    def __post_init__(self) -> None:
        super().__post_init__()
        if not self.columns:
            raise ModelError("a frame needs its columns")

    @property
    def data_type(self) -> T.DataType:
        return T.ArrayType(T._parse_datatype_string(self.columns))


def _of(kind: Any):
    def make(**options: Any) -> Field:
        return Field(type=kind, **options)

    return make


IntField, FloatField, DecimalField, StringField = _of(int), _of(float), _of(Decimal), _of(str)
BooleanField, BytesField, ListField, DictField = _of(bool), _of(bytes), _of(list), _of(dict)
SetField, TupleField, DateField, TimeField = _of(set), _of(tuple), _of(dt.date), _of(dt.time)
