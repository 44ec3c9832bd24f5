"""Parquet tables and snapshot directories."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modelframe.fields import SortedField


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local one only where none is named in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = f"file://{tempfile.gettempdir()}"
    return named.rstrip("/")


def write_sorted(model: type, df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Laid out for the model's sorted columns: directories by partition column, rows in order of the sorted one.

    Range partitioning keeps a partition value of any size in several files with tight bounds, so scans skip row groups.
    """
    fields = [f for f in model.fields.values() if isinstance(f, SortedField)]
    by = list(fields[0].partition_by) if fields else []
    order = [*by, *(f.name for f in fields[:1])]
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    writer = out.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


class Snapshots:
    """Versions of a table in numbered directories; a reader sees the last one that was written whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self, whole: bool = True) -> list[int]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        top = hadoop.Path(self.path)
        fs = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and (not whole or fs.exists(hadoop.Path(p, "_SUCCESS"))))

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self._versions()[-1] if version is None else version}")

    def write(self, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """df may read the last version: a new directory is written, none is changed. Of two writers of one version the second fails."""
        version = (self._versions(whole=False) or [0])[-1] + 1
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{self.path}/v{version}")
        return version

    def __bool__(self) -> bool:
        """Whether there is a version."""
        return bool(self._versions())


def encoded(df: DataFrame, name: str = "payload") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def decoded(df: DataFrame, schema: str, name: str = "payload") -> DataFrame:
    return df.select(F.from_json(name, schema).alias("_row")).select("_row.*")
