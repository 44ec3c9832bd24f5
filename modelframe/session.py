"""Sessions with the settings that the engine wants on a cluster, and what a session is set to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings, unless others are given: plans adapt to sizes as they run, skewed joins are split, times are UTC.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "modelframe", shared: str | None = None, **settings: str) -> SparkSession:
    """A session, a new one or the current one; shared: the folder all executors share, for checkpoints and snapshots.

    Settings are written with two underscores for each dot, `spark__sql__shuffle__partitions="2000"`.
    """
    named = {k.replace("__", "."): v for k, v in settings.items()}
    if shared:
        named["spark.checkpoint.dir"] = shared
    return SparkSession.builder.appName(app).config(map=SETTINGS | named).getOrCreate()


def info(spark: SparkSession) -> DataFrame:
    """Rows (name, value): where the session runs, and the settings above as they stand."""
    names = [*SETTINGS, "spark.checkpoint.dir", "spark.sql.shuffle.partitions"]
    rows = [("master", spark.sparkContext.master), ("version", spark.version)]
    return spark.createDataFrame(rows + [(n, spark.conf.get(n, None)) for n in names], "name string, value string")
