"""SimHash near-duplicate classes by meet-in-the-middle ball hashing.

Two fingerprints at most `radius` bits apart (radius even) have a common word at most radius/2 bits from each.
So each distinct fingerprint emits every word in its ball of half the radius, and equal words meet in a shuffle.
All fingerprints that meet at one word lie within `radius` of each other, hence linking neighbours in sorted order
keeps every class whole without emitting all pairs; each link is verified by its bit count.

Edge cases: a null or empty text has no words and fingerprint 0, which links like any other; a text with fewer
words than the shingle width is one shingle; rows with equal text share a fingerprint and so a class; a null
doc_id never names a class unless all its members have none; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modelframe.llm.common import Stored, ascii_words, map_in_arrow
from modelframe.llm.components import connected_components

SEED = 42
_CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, width: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of `width` words joined by a space, repeats included."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - width]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[width - 1 :])], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the hashes; 0 of none."""
    if not len(hashes):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """Rows (doc_id, fp LONG) of (doc_id, text); fp holds the unsigned fingerprint's bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            out = np.array([fingerprint(shingle_hashes(t.as_py(), width)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(out.view(np.int64))], ["doc_id", "fp"]
            )

    return map_in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long")


def ball(half: int, bits: int = 64) -> list[int]:
    """Masks of up to `half` set bits, as signed longs; 65 for half 1, 2,081 for half 2."""
    masks = [sum(1 << i for i in chosen) for k in range(half + 1) for chosen in combinations(range(bits), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct_fps: DataFrame, radius: int = 2) -> DataFrame:
    """Verified links (fp, other) that connect all fingerprints within `radius` bits of each other."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius must be 0, 2 or 4: balls of half an odd radius don't meet in the middle")
    masks = F.lit(ball(radius // 2))
    by_word = Window.partitionBy("word").orderBy("fp")
    return (
        distinct_fps.select("fp", F.explode(masks).alias("mask"))
        .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"))
        .withColumn("other", F.lag("fp").over(by_word))
        .where(F.col("other").isNotNull())
        .select("fp", "other")
        .distinct()
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)
    )


def near_duplicate_classes(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Rows (doc_id, fingerprint of 16 hex digits, component_id), one for each row of docs."""
    rows = Stored(fingerprints(docs, width)).df
    distinct_fps = Stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))).df
    roots = Stored(connected_components(links(distinct_fps.select("fp"), radius), "fp", "other")).df
    of_fp = distinct_fps.join(roots, distinct_fps.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    of_root = of_fp.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = of_fp.join(of_root, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
