"""One document of each group of near duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

Candidates come from SimHash ball hashing and, since two bits of 64 reach only a few of the pairs at a similarity of
0.8, from bands of min-wise hashes as well (README has the figures). A band's documents are first each paired with the
band's first and last one; every pair is verified on the whole sets of shingles, and verified links make groups by
connected components. Where a band's other documents then still belong to several groups, they meet with their whole
texts in tiles of bounded size, are verified there, and only links that join two groups leave the task, fewer than the
tile has groups: first each document in one tile of its band, then, where a band fills several tiles, those outside
its largest group in tiles with all others. The row with the smallest doc_id of a group stays.

Texts of equal words are one document from the start (told apart by 64 bits of XXH64), so large groups of copies cost
no pairs. Edge cases: null, empty and blank texts have no words and are copies of each other; a text of fewer than
five words is one shingle; of equal rows one stays; a null doc_id is last in its group; ties go to the smaller hash of
the text; an empty table gives no rows; all columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelframe.llm.common import Stored, ascii_words, free_name, map_in_arrow, portions, trimmed
from modelframe.llm.components import connected_components
from modelframe.llm.simhash import fingerprint, links, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: A pair of this similarity shares one of BANDS bands of ROWS hashes with probability 1 - (1 - 0.8**8)**40 = 0.999.
BANDS, ROWS = 40, 8
#: About so many documents of a band, and bytes of their texts, on each side of a tile.
TILE, TILE_BYTES = 512, 4 << 20


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(41))
    a = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The BANDS * ROWS min-wise hashes of a set of shingle hashes."""
    a, b = _factors()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        part = hashes[at : at + 1024]
        np.minimum(least, (part[:, None] * a + b).min(axis=0), out=least)
    return least


def bands(hashes: np.ndarray) -> np.ndarray:
    """The BANDS keys of a set of shingle hashes."""
    rows = minima(hashes).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ rows[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key


def sketches(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key_text, node, fp, bands): node tells apart sequences of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in portions(b)):
            nodes, fps, keys = [], [], []
            for t in batch.column("text").cast(pa.binary()):
                text = t.as_py()
                hashes = shingle_hashes(text, WIDTH)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(ascii_words(text)), 5))
                fps.append(fingerprint(hashes))
                keys.append(bands(np.unique(hashes)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key_text"),
                    pa.array(np.array(nodes, np.uint64).view(np.int64)),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "key_text", "node", "fp", "bands"],
            )

    given = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text", F.lit(11)).alias("key_text"), "text")
    return map_in_arrow(given, run, "doc_id long, key_text long, node long, fp long, bands array<long>")


def met_in_bands(nodes: DataFrame) -> DataFrame:
    """Rows (band, node, low, high, n) of the bands that n > 1 nodes share; low and high are the band's first and last."""
    in_band = nodes.select(F.explode("bands").alias("band"), "node")
    ends = in_band.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n"))
    return in_band.join(ends.where("low != high"), "band")


def candidates(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes (node, fp, bands) to verify first, met being those of met_in_bands."""
    by_fp = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    of_fp = Stored(by_fp).df
    near = links(of_fp.select("fp"))
    other = of_fp.select(F.col("fp").alias("other"), F.col("first").alias("b"))
    pairs = (
        met.select(F.col("node").alias("a"), F.col("low").alias("b"))
        .unionByName(met.select(F.col("node").alias("a"), F.col("high").alias("b")))
        .unionByName(nodes.join(of_fp, "fp").select(F.col("node").alias("a"), F.col("first").alias("b")))
        .unionByName(near.join(of_fp, "fp").join(other, "other").select(F.col("first").alias("a"), "b"))
    )
    return pairs.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def others(met: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (band, node, size) of those that met_in_bands but are neither first nor last, which met all others before."""
    sizes = texts.select("node", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    return met.where("n > 3 AND node NOT IN (low, high)").join(sizes, "node").select("band", "node", "size")


def joining(tile: pa.Table, similarity: float = SIMILARITY) -> pa.Table:
    """Links (a, b) that join all groups of a tile (node, root, left, right, text) that a near pair of left and right does."""
    left, right = (tile.column(c).to_numpy().astype(bool) for c in ("left", "right"))
    node, root = tile.column("node").to_numpy(), tile.column("root").to_numpy()
    sets = [np.unique(shingle_hashes(t.as_py(), WIDTH)) for t in tile.column("text").cast(pa.binary())]
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    known, number = np.unique(np.concatenate(sets), return_inverse=True)
    del sets
    group = np.unique(root, return_inverse=True)[1]
    own, both = np.zeros(len(known), np.int64), np.zeros(len(number) + 1, np.int64)
    links = []
    for i in np.flatnonzero(left):
        apart = right & (group != group[i])
        if not apart.any():
            continue
        mine = number[ends[i] - size[i] : ends[i]]
        own[mine] = 1
        np.cumsum(own[number], out=both[1:])
        own[mine] = 0
        equal = both[ends] - both[ends - size]
        for j in np.flatnonzero(apart & (equal >= similarity * (size + size[i] - equal))):
            if group[j] != group[i]:
                links.append((max(node[i], node[j]), min(node[i], node[j])))
                group[group == group[j]] = group[i]
    if tile.nbytes > 1 << 20:
        trimmed()
    a, b = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"a": a, "b": b})


def links_left(others: DataFrame, roots: DataFrame, texts: DataFrame, across: bool, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) that join different groups of roots (node, root) in a band of others (band, node, size).

    Without across, each document is in one tile of its band, so a band that fits one tile is done. With it, of bands that
    don't, those outside the band's largest group are dealt to left sides of tiles, all to right sides: every pair of
    different groups meets, and no task has more than about TILE documents or TILE_BYTES on each side.
    """
    held = Stored(
        others.join(roots, "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    ).df
    tiles = lambda n, size: F.ceil(F.greatest(n / TILE, size / TILE_BYTES))
    of_band = (
        held.groupBy("band", "root")
        .agg(F.count("*").alias("n"), F.sum("size").alias("size"))
        .groupBy("band")
        .agg(F.max(F.struct("n", "size", "root")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
        .where("main.n < n")
        .select(
            "band",
            F.col("main.root").alias("main"),
            tiles(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("lefts"),
            tiles(F.col("n"), F.col("size")).alias("rights"),
        )
    )
    mixed = held.join(of_band, "band")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.col(n))
    outside, yes, no = F.col("root") != F.col("main"), F.lit(True), F.lit(False)
    if across:
        mixed = Stored(mixed.where("rights > 1")).df
        sides = (
            mixed.where(outside)
            .select("band", one("lefts").alias("l"), every("rights").alias("r"), "node", "root", yes.alias("left"), no.alias("right"))
            .unionByName(
                mixed.select("band", every("lefts").alias("l"), one("rights").alias("r"), "node", "root", no.alias("left"), yes.alias("right"))
            )
        )
    else:
        sides = mixed.select("band", F.lit(0).alias("l"), one("rights").alias("r"), "node", "root", outside.alias("left"), yes.alias("right"))
    return (
        sides.join(texts, "node")
        .groupBy("band", "l", "r")
        .applyInArrow(lambda tile: joining(tile, similarity), "a long, b long")
        .distinct()
    )


@lru_cache(maxsize=256)
def _shingles(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode("utf-8", "replace"), WIDTH))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are at least this similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column("text_a"), batch.column("text_b")):
                sa, sb = _shingles(ta.as_py()), _shingles(tb.as_py())
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(both >= similarity * (len(sa) + len(sb) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            _shingles.cache_clear()
            trimmed()

    of_a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return map_in_arrow(pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "text_a", "text_b"), run, "a long, b long")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    held = Stored(sketches(docs)).df
    # the first row of each node; nulls last
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_text")).alias("first")
    nodes = Stored(
        held.groupBy("node").agg(first, F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    ).df
    met = Stored(met_in_bands(nodes.select("node", "bands"))).df
    pairs = Stored(candidates(nodes.select("node", "fp", "bands"), met)).df
    wanted = (
        pairs.select(F.col("a").alias("node"))
        .unionByName(pairs.select(F.col("b").alias("node")))
        .distinct()
        .join(nodes, "node")
        .select("node", F.col("first.doc_id").alias("id"), F.col("first.key_text").alias("key"))
    )
    here = F.xxhash64(docs["text"], F.lit(11))
    same = lambda w: docs["doc_id"].cast("long").eqNullSafe(w["id"]) & (here == w["key"])
    given = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text", F.lit(11)).alias("key"), "text").alias("g")
    of_node = given.join(wanted.alias("w"), F.col("g.id").eqNullSafe(F.col("w.id")) & (F.col("g.key") == F.col("w.key")))
    texts = Stored(of_node.select("node", "text").groupBy("node").agg(F.any_value("text").alias("text"))).df
    found = Stored(verified(pairs, texts, similarity)).df
    roots = Stored(connected_components(found, "a", "b")).df
    inner = Stored(others(met, texts)).df
    for across in (False, True):
        further = Stored(links_left(inner, roots, texts, across, similarity)).df
        if not further.isEmpty():
            found = found.unionByName(further)
            roots = Stored(connected_components(found, "a", "b")).df
    chosen = Stored(
        nodes.select("node", "first")
        .join(roots, "node", "left")
        .groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("id"), F.col("first.key_text").alias("key"))
    ).df
    kept = docs.join(chosen, same(chosen), "left_semi")
    repeated = held.groupBy("doc_id", "key_text").count().where("count > 1").limit(1).count()
    if repeated:  # equal rows: one stays
        mark = free_name(docs, "hash_of_text")
        kept = kept.withColumn(mark, F.xxhash64("text", F.lit(11))).dropDuplicates(["doc_id", mark]).drop(mark)
    return kept
