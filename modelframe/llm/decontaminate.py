"""Benchmark decontamination by spaced-seed hashing.

A fixed mask names which of a window's tokens count; the others may differ, so windows that agree but for ignored
positions hash alike. Test and training windows meet in a join on these hashes. Around each hit the two token
sequences are compared along the hit's diagonal: the best segment, one up for an equal token and one down for a
substituted one, has to hold enough equal tokens. Training windows first pass a bitmap of the test hashes (fixed
size, no false negatives), which keeps the join's input near the size of its result; a saturated bitmap costs time only.

The masks leave no overlap out that the comparison accepts. Such a segment has at least MATCHED equal tokens, or SHARE
of a shorter item, and its sum is 2 or more (a sum of 1 is reached at its first token); a pattern that no mask hits has
less, whatever its length (the test counts the most for each length). What is compared are the tokens up to BESIDE
beside a hit, so this holds without restriction for items of up to BESIDE + 1 tokens.

Tokens are runs of word characters, lower-cased, so marks and white space don't matter.

Edge cases: null and empty texts have no tokens and stay clean; test items with fewer than 4 tokens are too short
for evidence and never match; items of equal tokens count as one, named by the smallest item_id; rows with equal
doc_id and text share a verdict; an empty benchmark leaves all clean; an empty table gives no rows; extra columns
are ignored by `contamination` and kept by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modelframe.llm.common import Stored, distinct_chunks, map_in_arrow, portions, spread

#: 1: the token counts. Found by greedy search over all patterns of 5 to 24 tokens that have to be hit.
MASKS = (
    "1111", "11101", "11011", "10111", "1010011", "1100011", "100001011", "100100101", "1001000101", "1100010001", "101000000011", "110000010001",
)
#: For items of 4 tokens, where 3 equal ones do.
SHORT = ("111", "1011")
#: Items of fewer tokens are no evidence.
FEWEST = 4
#: Equal tokens a match needs: so many, or this share of a shorter item.
MATCHED, SHARE = 13, 0.75
#: Tokens kept beside a hit, and bits of the bitmap (a power of 2).
BESIDE, BITS = 32, 26
_LONGEST = max(map(len, MASKS))
_WORDS = re.compile(r"\w+").findall


def tokens(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of each text's tokens; every distinct chunk between white space is cut and hashed once."""
    starts, numbers, chunks = distinct_chunks(texts)
    digest = xxhash.xxh3_64_intdigest
    found = [[digest(w) for w in _WORDS(c.lower())] for c in chunks]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    values = np.fromiter((h for own in found for h in own), np.uint64, int(sizes.sum()))
    flat, begins = spread(starts, numbers, values, sizes)
    return np.split(flat, begins[1:-1]) if len(texts) else []


@lru_cache(maxsize=1)
def _factors() -> tuple[np.ndarray, np.ndarray]:
    """A factor for each place among the tokens that count, and a summand for each mask."""
    rng = np.random.Generator(np.random.PCG64(2026))
    some = rng.integers(1, 2**63, size=max(map(len, MASKS)) + len(MASKS) + len(SHORT), dtype=np.uint64) | np.uint64(1)
    return some[: max(map(len, MASKS))], some[max(map(len, MASKS)) :]


def seeds(t: np.ndarray, masks: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The hashes at each window of these masks, by mask; the last numbers are the short ones'."""
    factors, summands = _factors()
    products: list[np.ndarray] = []
    for mask_no in masks:
        mask = (*MASKS, *SHORT)[mask_no]
        size = len(t) - len(mask) + 1
        if size <= 0:
            continue
        h = np.full(size, summands[mask_no], np.uint64)
        for k, place in enumerate(i for i, c in enumerate(mask) if c == "1"):
            if k == len(products):
                products.append(t * factors[k])
            h += products[k][place : place + size]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        yield mask_no, h


def _of_item(n: int) -> list[int]:
    """The masks an item of n tokens is hashed by."""
    if n > FEWEST:
        return list(range(len(MASKS)))
    return list(range(len(MASKS), len(MASKS) + len(SHORT))) if n == FEWEST else []


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return h & low, (h >> np.uint64(64 - bits)) & low


def test_items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows (item_id, tokens) of distinct items, and (hash, item_id, at) of their windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t.view(np.int64) for t in tokens(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").cast(pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["item_id", "tokens"]
            )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ids, at = [np.empty(0, np.uint64)], [], [np.empty(0, np.int32)]
            for i, t in zip(batch.column("item_id").to_pylist(), batch.column("tokens").to_pylist()):
                t = np.array(t, np.int64).view(np.uint64)
                for _, h in seeds(t, _of_item(len(t))):
                    hs.append(h)
                    ids += [i] * len(h)
                    at.append(np.arange(len(h), dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hs).view(np.int64)), pa.array(ids, pa.int64()), pa.array(np.concatenate(at))],
                ["hash", "item_id", "at"],
            )

    items = Stored(
        map_in_arrow(benchmark.select(F.col("item_id").cast("long"), "text"), cut, "item_id long, tokens array<long>")
        .where(F.size("tokens") >= FEWEST)
        .groupBy("tokens")
        .agg(F.min("item_id").alias("item_id"))
        .where(F.col("item_id").isNotNull())
        .select("item_id", "tokens")
    ).df
    return items, Stored(map_in_arrow(items, windows, "hash long, item_id long, at int")).df


def bitmap(hashes: DataFrame, bits: int = BITS) -> bytes:
    """The bitmap of all hashes: 2**bits bits whatever their number, put together in slices on the executors."""
    slice_bits = min(bits, 16)
    low = F.lit((1 << bits) - 1)
    both = F.explode(F.array(F.col("hash").bitwiseAND(low), F.shiftrightunsigned("hash", 64 - bits).bitwiseAND(low)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << slice_bits, np.uint8)
        own[rows["bit"].to_numpy() & ((1 << slice_bits) - 1)] = 1
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "own": [np.packbits(own).tobytes()]})

    parts = (
        hashes.select(both.alias("bit"))
        .distinct()
        .withColumn("part", F.shiftright("bit", slice_bits))
        .groupBy("part")
        .applyInPandas(run, "part long, own binary")
        .collect()
    )
    size = 1 << (slice_bits - 3)
    whole = bytearray(1 << (bits - 3))
    for row in parts:
        whole[row["part"] * size : (row["part"] + 1) * size] = row["own"]
    return bytes(whole)


def _row_key(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.cast("long").alias("key_id"), F.xxhash64(text, F.lit(11)).alias("key_text")]


def regions(docs: DataFrame, of_tests: bytes, short_items: bool, bits: int = BITS, beside: int = BESIDE) -> DataFrame:
    """Rows (key_id, key_text, first, tokens, hashes, places) of the stretches of texts with hits in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(of_tests)
    used = _of_item(FEWEST + 1) + _of_item(FEWEST) * short_items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.frombuffer(shared.value, np.uint8)

        def marked(h: np.ndarray) -> np.ndarray:
            a, _ = _places(h, bits)
            hit = np.flatnonzero(flat[a >> np.uint64(3)] >> (np.uint8(7) - (a & np.uint64(7)).astype(np.uint8)) & 1)
            _, b = _places(h[hit], bits)
            return hit[(flat[b >> np.uint64(3)] >> (np.uint8(7) - (b & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]

        for batch in (p for b in batches for p in portions(b, most=2 << 20)):
            rows = []
            texts = tokens(batch.column("text"))
            begins = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            # all texts at once; windows that reach into the next one don't count
            places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for m, h in seeds(np.concatenate(texts) if texts else np.empty(0, np.uint64), used):
                hit = marked(h)
                hit = hit[hit + len((*MASKS, *SHORT)[m]) <= begins[np.searchsorted(begins, hit, "right")]]
                places.append(hit)
                hashes.append(h[hit])
            all_at, all_h = np.concatenate(places), np.concatenate(hashes)
            order = np.argsort(all_at, kind="stable")
            all_at, all_h = all_at[order], all_h[order]
            bounds = np.searchsorted(all_at, begins)
            keys_id, keys_text = batch.column("key_id"), batch.column("key_text")
            for i in np.flatnonzero(np.diff(bounds)):
                key_id, key_text, t = keys_id[i].as_py(), keys_text[i].as_py(), texts[i]
                at, h = all_at[bounds[i] : bounds[i + 1]] - begins[i], all_h[bounds[i] : bounds[i + 1]]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * beside) + 1):
                    first = max(0, int(at[part[0]]) - beside)
                    last = int(at[part[-1]]) + _LONGEST + beside
                    rows.append((key_id, key_text, first, t[first:last].view(np.int64), h[part].view(np.int64), at[part] - first))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["key_id", "key_text", "first", "tokens", "hashes", "places"])

    return map_in_arrow(
        docs.select(*_row_key(F.col("doc_id"), F.col("text")), "text"),
        run,
        "key_id long, key_text long, first long, tokens array<long>, hashes array<long>, places array<long>",
    )


def best_segment(equal: np.ndarray) -> tuple[int, int, int]:
    """(equal tokens, begin, end) of the segment with the largest sum of +1 and -1, first of several."""
    if not len(equal):
        return 0, 0, 0
    run = np.concatenate([[0], np.cumsum(np.where(equal, 1, -1))])
    low = np.minimum.accumulate(run)
    end = int((run - low).argmax())
    begin = int(run[: end + 1].argmin())
    return int(equal[begin:end].sum()), begin, end


def overlaps(docs: DataFrame, benchmark: DataFrame, matched: int = MATCHED, share: float = SHARE) -> DataFrame:
    """Stored rows (key_id, key_text, item_id, matched, begin, end): verified overlaps, in tokens of the text."""
    items, windows = test_items(benchmark)
    short_items = bool(items.where(F.size("tokens") == FEWEST).limit(1).count())
    held = Stored(
        regions(docs, bitmap(windows.select("hash")), short_items).withColumn("region", F.monotonically_increasing_id())
    ).df
    hits = held.select("region", F.explode(F.arrays_zip("hashes", "places")).alias("hit")).select(
        "region", F.col("hit.hashes").alias("hash"), F.col("hit.places").alias("place")
    )
    pairs = (
        hits.join(windows, "hash").select("region", "item_id", (F.col("place") - F.col("at")).alias("shift")).distinct()
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                own, item = np.asarray(r.tokens), np.asarray(r.item_tokens)
                a, b = max(0, r.shift), max(0, -r.shift)
                size = min(len(own) - a, len(item) - b)
                equal = own[a : a + size] == item[b : b + size]
                n, begin, end = best_segment(equal)
                if n >= min(matched, int(np.ceil(share * len(item)))):
                    out.append((r.key_id, r.key_text, r.item_id, n, r.first + a + begin, r.first + a + end))
            yield pd.DataFrame(out, columns=["key_id", "key_text", "item_id", "matched", "begin", "end"]).astype(
                {"key_id": "Int64"}
            )

    return Stored(
        pairs.join(held.select("region", "key_id", "key_text", "first", "tokens"), "region")
        .join(items.withColumnRenamed("tokens", "item_tokens"), "item_id")
        .select("key_id", "key_text", "item_id", "shift", "first", "tokens", "item_tokens")
        .mapInPandas(verify, "key_id long, key_text long, item_id long, matched long, begin long, end long")
        .distinct()
    ).df


def _by_text(found: DataFrame) -> DataFrame:
    """One row for each (doc_id, text): the best item of each, in order of item."""
    one = found.groupBy("key_id", "key_text", "item_id").agg(
        F.max(F.struct("matched", (-F.col("begin")).alias("first"), "end")).alias("m")
    )
    return one.groupBy("key_id", "key_text").agg(
        F.count("*").alias("n_items"),
        F.max("m.matched").alias("most"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("item_id", (-F.col("m.first")).alias("begin"), F.col("m.end").alias("end")))),
                lambda x: F.concat_ws(":", x["item_id"], x["begin"], x["end"]),
            ),
            ",",
        ).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, contaminated, n_items, matched, items), one for each row of docs.

    items: item:begin:end by item, comma-joined, the token span of the text that overlaps it best.
    """
    found = _by_text(overlaps(docs, benchmark))
    key_id, key_text = _row_key(F.col("doc_id"), F.col("text"))
    rows = docs.select(key_id, key_text).alias("d")
    same = F.col("d.key_id").eqNullSafe(F.col("f.key_id")) & (F.col("d.key_text") == F.col("f.key_text"))
    return rows.join(found.alias("f"), same, "left").select(
        F.col("d.key_id").alias("doc_id"),
        F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("most", F.lit(0).cast("long")).alias("matched"),
        F.coalesce("items", F.lit("")).alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a verified overlap, with all their columns."""
    found = overlaps(docs, benchmark).select("key_id", "key_text").distinct()
    key_id, key_text = _row_key(docs["doc_id"], docs["text"])
    return docs.join(found, key_id.eqNullSafe(found["key_id"]) & (key_text == found["key_text"]), "left_anti")
