"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, groups of equal texts kept together.

Groups go, largest first, to the shard where the dot product of the group's vector with the residual capacity is
highest (both in shares of the total). No task sees all groups: they are dealt to cells of a bounded size, each cell
packs its groups into as many bins as there are shards, and those bins are the next level's groups, until one cell
is left, whose bins are the shards. A group beyond a small share of the whole or more rows than a cell is first split
into parts, so a text that holds a third of all rows spreads like any other; the join that tells rows their parts sends
the list of such groups to all only up to a counted number of them. Places (slot) are sums of a group's offsets within its bins, so no shard is ever gathered in one task.

Edge cases: null texts form one group of size 0 (plus the fixed 16 bytes a row); repeated rows are placed each;
a null doc_id is a row like any other; an empty table gives no rows; extra columns are ignored; a single text
larger than a shard's share fills that shard alone as far as the other groups allow.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelframe.llm.common import Stored

#: Groups in a cell, on average.
CELL = 20_000
#: A group with more than 1 / (shards * SPLIT) of the bytes or rows is split.
SPLIT = 4
DIMS = ("bytes", "tokens", "n")
#: Groups to split that are broadcast at most; more go through a shuffle.
BROADCAST = 100_000
#: Bytes are the law, tokens and rows follow as far as they can.
WEIGHTS = np.array([4.0, 1.0, 1.0])
#: Exchanges that even out the bytes stop at this share of a bin, or after so many.
EVEN, EXCHANGES = 5e-4, 4000


def place(vectors: np.ndarray, bins: int) -> np.ndarray:
    """The bin of each row of (bytes, tokens, rows), largest share first, by dot product with the residual capacity."""
    share = vectors / np.maximum(vectors.sum(axis=0), 1)
    residual = np.full((bins, share.shape[1]), 1.0 / bins)
    out = np.empty(len(share), np.int32)
    for i in np.argsort(-share.max(axis=1), kind="stable").tolist():
        v = share[i]
        b = int(np.argmax(residual @ (WEIGHTS * v)))
        out[i] = b
        residual[b] -= v
    return _evened(out, vectors[:, 0], bins)


def _evened(out: np.ndarray, size: np.ndarray, bins: int) -> np.ndarray:
    """Moves or exchanges items between the fullest and the emptiest bin while that brings their bytes closer."""
    order = np.argsort(size, kind="stable")
    held = [list(order[out[order] == b]) for b in range(bins)]
    load = np.bincount(out, weights=size, minlength=bins)
    for _ in range(EXCHANGES):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        if gap <= EVEN * load.mean() or not held[hi]:
            break
        a = size[held[hi]]
        b = np.append(0.0, size[held[lo]])  # 0: a move without a return
        # for each item of the full bin, the return that leaves the two bins closest
        want = a - gap / 2
        near = np.clip(np.searchsorted(b, want), 1, len(b) - 1) if len(b) > 1 else np.zeros(len(a), int)
        near = np.where(np.abs(b[near - 1] - want) <= np.abs(b[near] - want), near - 1, near) if len(b) > 1 else near
        left = np.abs(gap - 2 * (a - b[near]))
        x = int(left.argmin())
        if left[x] >= gap * 0.999:
            break
        y, i = int(near[x]) - 1, held[hi].pop(x)
        moves = [(i, lo)] + ([(held[lo].pop(y), hi)] if y >= 0 else [])
        for j, to in moves:
            at = int(np.searchsorted(size[held[to]], size[j])) if held[to] else 0
            held[to].insert(at, j)
            out[j] = to
            load[to] += size[j]
            load[lo + hi - to] -= size[j]
    return out


def _level(items: DataFrame, cells: int, bins: int) -> DataFrame:
    """Rows (item, cell, bin, at): at is the number of rows before this item in its bin."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", ignore_index=True)
        found = place(rows[list(DIMS)].to_numpy(np.float64), bins)
        at = rows["n"].groupby(found).cumsum() - rows["n"]
        return pd.DataFrame({"item": rows["item"], "cell": rows["cell"], "bin": found, "at": at}).join(rows[list(DIMS)])

    return (
        items.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(cells)), F.lit(cells)).cast("long"))
        .groupBy("cell")
        .applyInPandas(run, "item long, cell long, bin int, at long, bytes long, tokens long, n long")
    )


def sharded(docs: DataFrame, shards: int = 40, cell: int = CELL) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    base = Stored(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.size(F.split(text, "[\\t-\\r ]+")).cast("long").alias("tokens"),
            F.xxhash64("text", F.lit(7)).alias("text_hash"),
        )
    ).df
    grouped = base.groupBy("text_hash").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")
    )
    total = base.agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).first()
    most = shards * SPLIT
    part = F.ceil(F.greatest(F.col("bytes") * F.lit(most) / F.lit(total["bytes"] or 1), F.col("n") * F.lit(most) / F.lit(total["n"] or 1)))
    part = F.greatest(part, F.ceil(F.col("n") / F.lit(cell)))
    large = Stored(grouped.where((part > 1) & (F.col("n") > 1)).select("text_hash", F.least(part, F.col("n")).alias("parts"))).df
    if large.count() <= BROADCAST:
        large = F.broadcast(large)
    held = Stored(
        base.withColumn("uid", F.monotonically_increasing_id())
        .join(large, "text_hash", "left")
        .withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id", "uid"), F.col("parts")), F.lit(0).cast("long")))
        .withColumn("item", F.xxhash64("text_hash", "part"))
        .drop("parts", "text_hash", "part")
    ).df
    # level 0 packs the rows themselves: a cell holds its groups' rows, each group at most a small share
    cells = max(1, -(-(total["n"] or 0) // cell))

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["item", "uid"], ignore_index=True)
        items = rows.assign(n=1).groupby("item", sort=True)[["size", "tokens", "n"]].sum()
        found = place(items.to_numpy(np.float64), shards)
        rows["bin"] = pd.Series(found, index=items.index).reindex(rows["item"]).to_numpy()
        rows["at"] = rows.groupby("bin").cumcount().astype("int64")
        return rows[["doc_id", "size", "text_crc32", "tokens", "cell", "bin", "at"]]

    placed = Stored(
        held.withColumn("cell", F.pmod(F.xxhash64("item", F.lit(cells)), F.lit(cells)).cast("long"))
        .groupBy("cell")
        .applyInPandas(first, "doc_id long, size long, text_crc32 long, tokens long, cell long, bin int, at long")
    ).df
    rows = placed.withColumn("item", F.col("cell") * shards + F.col("bin"))
    level = rows.groupBy("item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    rows = rows.select("doc_id", "size", "text_crc32", "item", "at")
    while cells > 1:
        cells = -(-cells * shards // cell)
        packed = Stored(_level(level, cells, shards)).df
        parent = (F.col("cell") * shards + F.col("bin")).alias("parent")
        rows = rows.join(packed.select("item", parent, F.col("at").alias("before")), "item").select(
            "doc_id", "size", "text_crc32", F.col("parent").alias("item"), (F.col("at") + F.col("before")).alias("at")
        )
        level = packed.groupBy(parent.alias("item")).agg(*(F.sum(c).alias(c) for c in DIMS))
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("item").cast("int").alias("shard"),
        F.col("at").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
