"""Declared models: a class body of fields compiles to a schema and a registry of roles; `on` binds it to a DataFrame."""

from __future__ import annotations

from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelframe.errors import ModelError
from modelframe.fields import AutoKeyField, Field, GeoField, KeyField, Relationship, SortedKeyField

RESERVED = ("limit", "order_by", "values")


class Model:
    """Subclass with fields as class attributes. Without a key field a model has a hidden key, `_auto_key`."""

    fields: ClassVar[dict[str, Field]] = {}

    #: Rows of such a model are never deleted.
    append_only: ClassVar[bool] = False

    def __init_subclass__(cls, append_only: bool = False, **options: Any) -> None:
        super().__init_subclass__(**options)
        found: dict[str, Field] = {}
        for name, value in list(vars(cls).items()):
            if isinstance(value, Field):
                if name in RESERVED or not (name[0].islower() or name[0] == "_"):
                    raise ModelError(f"{name!r} can't name a field")
                found[name] = value.named(name)
            elif not name.startswith("_") and not callable(value) and not isinstance(value, (classmethod, staticmethod, property)):
                raise ModelError(f"{name!r} is not a field")
        if not any(isinstance(f, (KeyField, SortedKeyField)) for f in found.values()):
            found["_auto_key"] = AutoKeyField().named("_auto_key")
        for f in found.values():
            for p in getattr(f, "partition_by", ()):
                if p not in found:
                    raise ModelError(f"{f.name} is partitioned by {p}, which is no field")
        cls.fields, cls.append_only = found, append_only

    @classmethod
    def key_fields(cls) -> list[Field]:
        """In the order of the composite key: by name."""
        return [cls.fields[n] for n in sorted(cls.fields) if isinstance(cls.fields[n], (KeyField, SortedKeyField))]

    @classmethod
    def key_names(cls) -> list[str]:
        return [f.name for f in cls.key_fields()]

    @classmethod
    def schema(cls) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.data_type, f.null) for f in cls.fields.values()])

    @classmethod
    def on(cls, df: DataFrame, related: dict[type, DataFrame] | None = None):
        """Queries of this model over df; related: the tables of the models it refers to."""
        from modelframe.operators.query import Query

        return Query(cls, df, related or {})

    @classmethod
    def info(cls, spark: SparkSession) -> DataFrame:
        """One row for each field: model, field, role, type, null, lookups."""
        rows = []
        for f in cls.fields.values():
            lookups = [f.name + (f"__{op}" if op else "") for op in f.lookups]
            if isinstance(f, GeoField):
                lookups = [f.name, *(f"{f.name}_{p}" for p in ("latitude", "longitude", "radius", "radius_unit", "member")), f"{f.name}__isnull"]
            elif isinstance(f, Relationship):
                lookups = [f.name] + [f"{f.name}__{g.name}" + (f"__{op}" if op else "") for g in f.model.fields.values() for op in g.lookups]
            rows.append((cls.__name__, f.name, type(f).__name__, f.data_type.simpleString(), f.null, lookups))
        return spark.createDataFrame(rows, "model string, field string, role string, type string, nullable boolean, lookups array<string>")

    @classmethod
    def derive(cls, df: DataFrame) -> DataFrame:
        """Hook before each save; override to derive columns."""
        return df

    @classmethod
    def prepared(cls, df: DataFrame) -> DataFrame:
        """df with every field as it is saved: derived, cast, defaults and automatic values filled."""
        df = cls.derive(df)
        of = {n: F.col(n) if n in df.columns else F.lit(None) for n in cls.fields}
        return df.select(*(f.formatted(of[n]).alias(n) for n, f in cls.fields.items()))

    @classmethod
    def problems(cls, df: DataFrame) -> Column:
        """array<string> of what is wrong with a row as given, `field:problem` each; empty if it is valid."""
        found = []
        for n, f in cls.fields.items():
            column = F.col(n) if n in df.columns else F.lit(None)
            if n not in df.columns and not isinstance(f, AutoKeyField):
                found += [F.lit(f"{n}:null")] if not f.null and f.default is None else []
                continue
            found += [F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{n}:{why}")) for why, bad in f.violations(column)]
        return F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")

    @classmethod
    def split_valid(cls, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(valid rows as they are saved, rejected rows as given with their problems)."""
        checked = cls.derive(df)
        checked = checked.withColumn("_problems", cls.problems(checked))
        good = checked.where(F.size("_problems") == 0).drop("_problems")
        of = {n: F.col(n) if n in good.columns else F.lit(None) for n in cls.fields}
        return good.select(*(f.formatted(of[n]).alias(n) for n, f in cls.fields.items())), checked.where(F.size("_problems") > 0)

    @classmethod
    def duplicates(cls, df: DataFrame) -> DataFrame:
        """Keys that more than one row has, with the number of rows."""
        keys = cls.key_names()
        return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")

    @classmethod
    def save(cls, table: Any, df: DataFrame, *version: Column, publisher: Any = None, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Saves rows into a `Snapshots` table: derived, checked, formatted, upserted by key, published. Returns rejected rows.

        Of several incoming rows of a key the one of the greatest version stays. The publisher gets the keys that changed,
        with the new values and what happened to them.
        """
        from modelframe.operators import mutate

        good, rejected = cls.split_valid(df)
        keys, before = cls.key_names(), table.read() if table else good.where("false")
        number = table.write(mutate.upsert(before, good, keys, *version), partition_by)
        if publisher is not None:
            publisher.publish(mutate.change_feed(before, table.read(number), keys))
        return rejected

    @classmethod
    def create(cls, table: Any, spark: SparkSession, *rows: dict[str, Any], publisher: Any = None) -> DataFrame:
        """Constructs rows from dicts of field values and saves them; returns rejected rows."""
        given = [{n: r.get(n, f.default) for n, f in cls.fields.items()} for r in rows]
        schema = T.StructType([T.StructField(n, f.data_type) for n, f in cls.fields.items()])
        return cls.save(table, spark.createDataFrame([tuple(r.values()) for r in given], schema), publisher=publisher)

    @classmethod
    def destroy(cls, table: Any, *, publisher: Any = None, partition_by: tuple[str, ...] = (), **lookups: Any) -> int:
        """Deletes the rows that match all lookups from a `Snapshots` table; how many. None of an append-only model."""
        from modelframe.operators import mutate

        before = table.read()
        query = cls.on(before)
        gone = 0 if cls.append_only else query.count(**lookups)
        if gone:
            after = mutate.delete_keys(before, query.filter(**lookups), cls.key_names())
            number = table.write(after, partition_by)
            if publisher is not None:
                publisher.publish(mutate.change_feed(before, table.read(number), cls.key_names()))
        return gone
