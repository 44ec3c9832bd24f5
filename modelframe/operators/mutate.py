"""Saves and deletes as new snapshots: upsert, re-key, delete, change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *version: Column) -> DataFrame:
    """The row with the greatest version of each key.

    An aggregation of structs combines before it shuffles, so a key with many versions is no hot task.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(*(v.alias(f"_v{i}") for i, v in enumerate(version)), *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*(F.col(c) if c in keys else F.col(f"_best.{c}").alias(c) for c in df.columns))


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], *version: Column) -> DataFrame:
    """The table after incoming rows are saved: they replace rows of equal keys; of several the greatest version stays."""
    new = latest(incoming, keys, *version) if version else incoming.dropDuplicates(keys)
    same = [existing[k].eqNullSafe(new[k]) for k in keys]
    return existing.join(new, same, "left_anti").unionByName(new)


def rekey(df: DataFrame, matching: Column, **new: Column) -> DataFrame:
    """The table after the key columns of matching rows change: old keys go, and so does what held the new ones."""
    moved = df.where(matching).withColumns(new)
    left = df.where(~F.coalesce(matching, F.lit(False)))
    same = [left[k].eqNullSafe(moved[k]) for k in new]
    return left.join(moved, same, "left_anti").unionByName(moved)


def delete(df: DataFrame, matching: Column) -> DataFrame:
    """The table without matching rows; null doesn't match."""
    return df.where(~F.coalesce(matching, F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The table without the rows whose key is among keys; null keys match null keys."""
    gone = keys.select(*names).distinct()
    return df.join(gone, [df[k].eqNullSafe(gone[k]) for k in names], "left_anti")


def compacted(df: DataFrame, keys: list[str], bucket: Column, before: Column, *order: Column) -> DataFrame:
    """History after resampling: of rows that `before` holds for, the last one of each key and bucket stays."""
    old = df.where(before).withColumn("_bucket", bucket)
    return df.where(~F.coalesce(before, F.lit(False))).unionByName(latest(old, [*keys, "_bucket"], *order).drop("_bucket"))


def alive(df: DataFrame, expires: str, now: Column | None = None) -> DataFrame:
    """Rows that haven't expired; null never does."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > (F.localtimestamp() if now is None else now)))


def migrated(df: DataFrame, renamed: dict[str, str] | None = None, added: dict[str, Column] | None = None, dropped: tuple[str, ...] = ()) -> DataFrame:
    """A table as a changed model has it: columns renamed, dropped and added, all rows kept."""
    return df.withColumnsRenamed(renamed or {}).drop(*dropped).withColumns(added or {})


def change_feed(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key that differs: its columns, and change: insert, update or delete (with the old values)."""
    rest = [c for c in after.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("_old"), F.lit(True).alias("_was"))
    b = after.select(*keys, F.struct(*rest).alias("_new"), F.lit(True).alias("_is"))
    both = a.join(b, keys, "full")
    change = F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "delete").when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    now = F.coalesce("_new", "_old")
    return both.withColumn("change", change).where("change IS NOT NULL").select(*keys, *(now[c].alias(c) for c in rest), "change")
