"""Connected components of a link table by alternating large and small stars.

Every round is two aggregations and two equi-joins, so nothing of the graph reaches the driver but two numbers,
and a hub of any degree is only ever an aggregation key or one side of a join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelframe.llm.common import Stored


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Rows (node, root) for each node that has a link to another one; root is the smallest node reachable.

    Self links, repeated links and nulls are ignored; an empty table gives no rows. Nodes are LONG.
    """
    u, v = F.col(left), F.col(right)
    held = Stored(
        links.where(u.isNotNull() & v.isNotNull() & (u != v))
        .select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
        .distinct()
    )
    seen = _digest(held.df)
    while seen[0]:
        edges = held.df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("m"))
        large = (
            both.where("v > u").join(near, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(down.select("u", F.col("m").alias("v")))
            .distinct()
        )
        new = Stored(small)
        now = _digest(new.df)
        held.drop()
        held = new
        if now == seen:
            break
        seen = now
    edges = held.df
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
