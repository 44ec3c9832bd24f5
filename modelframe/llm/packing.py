"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Documents become token ids and one end id; only those longer than a sequence are cut. Pieces are dealt to cells of
a bounded size, each packed alone: best fit in falling length, then exchanges between underfull bins (move one,
one for one, two for one), each raising the sum of squared fills, until bins empty or none helps. A cell stops at once
when it needs no more bins than its tokens fill. What is left in underfull bins is dealt anew and packed once more.

Edge cases: a null text is empty and has the end id alone; rows with equal doc_id or text are packed each; an empty
table gives no rows; extra columns are ignored; a very long text becomes many pieces, dealt to cells one by one.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from modelframe.llm.common import Stored, distinct_chunks, map_in_arrow, portions, spread

#: Parts longer than this are not remembered, and a worker remembers so many.
LONGEST_KEPT, MOST_KEPT = 32, 200_000
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]", "[!-&(-@\\[-`{-~]"
#: A run of letters before white space, a mark or the end; a run of marks before white space, a letter or the end; else all.
_PARTS = rf"{_LETTERS}+(?=[\t-\r !-&(-@\[-`{{-~]|\Z)|{_MARKS}+(?=[\t-\r A-Za-zÀ-ÖØ-öø-ÿ]|\Z)|[^\t-\r ]+"
#: Pieces in a cell, on average.
CELL = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The byte-level alphabet: bytes that aren't printable in Latin-1 stand 256 and more characters on, in order.
_BYTES = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173])}
del _BYTES[32]  # parts the words


class ChunkTokenizer:
    """Ids as the tokenizer gives them for whole texts, by chunks that it splits anyway, remembered.

    Lower-case byte-level models with marked word ends. Chunks end at ASCII white space, and between a run of plain letters and a run of ASCII marks or digits; all that
    stands next to an apostrophe, a character beyond Latin-1 or in a text with the opening of a special string is
    left whole. Right for tokenizers that drop white space, split letters from marks and mark the ends of words.
    """

    def __init__(self, path: str, end_of_word: str = "</w>"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are what runs in parallel
        self.model = Tokenizer.from_file(path)
        self.kept: dict[str, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith(end_of_word)]] = True
        self.parts, self.parts_and_ends = re.compile(_PARTS).findall, re.compile(f"{_PARTS}|\n").findall
        # plain words need no normalising but lower case, and are words already: the model alone gives their ids
        self.bare = Tokenizer(self.model.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.plain = re.compile(f"{_LETTERS}+").fullmatch

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in order, and where each text's begin (and the end)."""
        starts, numbers, chunks = distinct_chunks(texts)
        kept = self.kept
        found = list(map(kept.get, chunks))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            flat, ends = self._cut([chunks[k] for k in missing])
            for k, a, b in zip(missing, [0, *ends], ends, strict=False):
                found[k] = flat[a:b]
            for k in np.array(missing)[np.bincount(numbers, minlength=len(chunks))[missing] > 1].tolist():
                self._keep(chunks[k], found[k])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return spread(starts, numbers, np.frombuffer(b"".join(found), "<u4"), sizes)

    def _cut(self, chunks: list[str]) -> tuple[bytes, list[int]]:
        """The ids of chunks by their distinct parts, in order, and where each chunk's end."""
        if any("<|" in c for c in chunks):
            cut = [[c] if "<|" in c else self.parts(c) for c in chunks]
            parts, ends = [p for own in cut for p in own], np.cumsum([len(own) for own in cut])
        else:
            # a chunk ends where white space stands in the text, so all are cut at once
            parts = self.parts_and_ends("\n".join(chunks))
            ends = None
        coded = pa.array(parts, pa.large_string()).dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ids = list(map(self.kept.get, distinct))
        if ends is None:
            stop = distinct.index("\n") if len(chunks) > 1 else -1
            if len(chunks) > 1:
                ids[stop] = b""
            ends = np.append(np.flatnonzero(codes == stop), len(codes))
        new = [k for k, own in enumerate(ids) if own is None]
        for k, own in zip(new, self._new([distinct[k] for k in new])):
            ids[k] = own
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values, at = spread(np.append(0, ends), codes, np.frombuffer(b"".join(ids), "<u4"), sizes)
        return values.tobytes(), (4 * at[1:]).tolist()

    def _new(self, parts: list[str]) -> list[bytes]:
        plain = [k for k, c in enumerate(parts) if c.isalpha() and c.isascii()]
        beyond = [k for k, c in enumerate(parts) if not c.isascii() and self.plain(c)]
        new: list[bytes | None] = [None] * len(parts)
        for numbers in (plain, beyond):
            if not numbers:
                continue
            # each is one word to the tokenizer, so their ids part where a word ends
            joined = " ".join([parts[k] for k in numbers]).lower()
            if not joined.isascii():
                joined = joined.encode().decode("latin-1").translate(_BYTES)
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
            flat = ids.tobytes()
            for k, a, b in zip(numbers, [0, *ends], ends, strict=False):
                new[k] = flat[a:b]
            if len(ends) != len(numbers):
                raise ValueError("this tokenizer doesn't mark the ends of words")
        for k, own in enumerate(new):
            if own is None:
                new[k] = np.array(self.model.encode(parts[k], add_special_tokens=False).ids, "<u4").tobytes()
        return new

    def _keep(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= LONGEST_KEPT and len(self.kept) < MOST_KEPT:
            self.kept[chunk] = ids


@lru_cache(maxsize=2)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_tokenizer(tokenizer_path).encode
        for batch in (p for b in batches for p in portions(b, most=8 << 20)):
            ids, ends = encode(batch.column("text"))
            flat = np.insert(ids, ends[1:], end_id)  # one more after each text
            ends = (ends + np.arange(len(ends))).tolist()
            rows = [
                (k, at - a, min(capacity, b - at), zlib.crc32(flat[at : min(at + capacity, b)]), n)
                for n, a, b in zip(range(len(batch)), ends, ends[1:])
                for k, at in enumerate(range(a, b, capacity))
            ]
            piece, start, length, crc, row = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(piece, pa.int32()),
                    *(pa.array(c, pa.int64()) for c in (start, length, crc)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return map_in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: each piece, longest first, goes to the bin with the least room that holds it."""
    bins: list[list[int]] = []
    with_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set while some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            with_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


class Exchange:
    """Moves and exchanges between underfull bins, each raising the sum of squared fills, until bins empty or none helps.

    A piece leaves its bin for another: alone, for one smaller piece, or for two. What is tried in vain is remembered by
    the piece's size and its bin's fill until something moves, so equal pieces cost one scan.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int):
        self.capacity, self.bins = capacity, [list(b) for b in bins]
        self.size = np.asarray(lengths, np.int64)
        self.fill = np.array([int(self.size[b].sum()) for b in self.bins], np.int64)
        #: Full bins stay as they are.
        self.open = np.flatnonzero(self.fill < capacity)
        self.piece = np.array([i for b in self.open for i in self.bins[b]], np.int64)
        self.bin_of = np.full(len(self.size), -1, np.int64)
        for b in self.open:
            self.bin_of[self.bins[b]] = b
        #: The sums of a bin's two smallest and of its two largest pieces; no pair where there are fewer than two.
        self.low, self.high = np.full(len(self.bins), 2 * capacity + 1, np.int64), np.full(len(self.bins), -1, np.int64)
        for b in self.open:
            self._ends(b)

    def _ends(self, b: int) -> None:
        own = np.sort(self.size[self.bins[b]])
        self.low[b], self.high[b] = (own[0] + own[1], own[-1] + own[-2]) if len(own) > 1 else (2 * self.capacity + 1, -1)

    def _one(self, a: int, s: int) -> tuple[int, tuple[int, ...]] | None:
        """The fullest bin that takes a piece of size s from bin a, alone; else the piece that best comes back for it."""
        f = self.fill[self.open]
        fits = (f + s <= self.capacity) & (f + s > self.fill[a]) & (f > 0) & (self.open != a)
        if fits.any():
            return int(self.open[np.where(fits, f, -1).argmax()]), ()
        there = self.bin_of[self.piece]
        net, f = s - self.size[self.piece], self.fill[there]
        gain = np.where((net > 0) & (f + net <= self.capacity) & (there != a), net * (f - self.fill[a] + net), 0)
        k = int(gain.argmax()) if len(gain) else 0
        return (int(there[k]), (int(self.piece[k]),)) if len(gain) and gain[k] > 0 else None

    def _two(self, a: int, s: int) -> tuple[int, tuple[int, ...]] | None:
        """A bin, fullest first, two of whose pieces come back for one of size s."""
        f = self.fill[self.open]
        maybe = (self.low[self.open] < s) & (self.high[self.open] >= s - (self.capacity - f)) & (f + s - self.low[self.open] > self.fill[a]) & (self.open != a)
        found = self.open[maybe]
        for b in found[np.argsort(-self.fill[found], kind="stable")].tolist():
            own = sorted(self.bins[b], key=lambda j: self.size[j])
            sizes, least, best = self.size[own].tolist(), s - (self.capacity - int(self.fill[b])), None
            low, high = 0, len(own) - 1
            while low < high:
                both = sizes[low] + sizes[high]
                if both < least:
                    low += 1
                else:
                    if both < s and self.fill[b] + s - both > self.fill[a] and (best is None or both < best[0]):
                        best = (both, own[low], own[high])
                    high -= 1
            if best:
                return b, best[1:]
        return None

    def run(self) -> list[list[int]]:
        least = -(-int(self.size.sum()) // self.capacity)
        live = sum(1 for b in self.bins if b)
        vain: set[tuple[int, int]] = set()
        moved = True
        while moved and live > least:
            moved = False
            for a in self.open[np.argsort(self.fill[self.open], kind="stable")].tolist():
                for i in sorted(self.bins[a], key=lambda j: -self.size[j]):
                    key = (int(self.size[i]), int(self.fill[a]))
                    if key in vain:
                        continue
                    found = self._one(a, key[0]) or self._two(a, key[0])
                    if found is None:
                        vain.add(key)
                        continue
                    b, back = found
                    vain.clear()
                    moved = True
                    self.bins[a].remove(i)
                    self.bins[b].append(i)
                    self.bin_of[i] = b
                    for j in back:
                        self.bins[b].remove(j)
                        self.bins[a].append(j)
                        self.bin_of[j] = a
                    net = key[0] - int(self.size[list(back)].sum())
                    self.fill[a] -= net
                    self.fill[b] += net
                    self._ends(a)
                    self._ends(b)
                    live -= not self.bins[a]
                if live <= least:
                    break
        return [b for b in self.bins if b]


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    return Exchange(bins, lengths, capacity).run()


def pack(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    full = lengths >= capacity
    rest = np.flatnonzero(~full)
    bins = local_search(best_fit(lengths[rest], capacity), lengths[rest], capacity)
    return [[int(i)] for i in np.flatnonzero(full)] + [[int(rest[i]) for i in b] for b in bins]


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, cell: int = CELL) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset), one for each piece."""
    held = Stored(pieces(docs, tokenizer_path, capacity, end_id)).df

    def packed_once(rows: DataFrame, level: int) -> DataFrame:
        """Rows with sequence_id, offset and the sequence's fill."""
        cells = max(1, -(-rows.count() // cell))

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            # one order whatever order the shuffle brought
            rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable", na_position="first", ignore_index=True)
            lengths = rows["length"].to_numpy(np.int64)
            sequence, offset, fill = (np.empty(len(rows), np.int64) for _ in range(3))
            for k, bin_ in enumerate(pack(lengths, capacity)):
                sequence[bin_] = k
                offset[bin_] = np.cumsum(lengths[bin_]) - lengths[bin_]
                fill[bin_] = lengths[bin_].sum()
            ids = (np.int64(level) << 62) | (rows["cell"].to_numpy(np.int64) << 32) | sequence
            return rows.assign(sequence_id=ids, offset=offset, fill=fill).drop(columns="cell")

        row_no = F.monotonically_increasing_id()
        return (
            rows.withColumn("cell", F.pmod(row_no + F.shiftright(row_no, 33), F.lit(cells)))
            .groupBy("cell")
            .applyInPandas(run, f"{PIECES}, sequence_id long, offset long, fill long")
        )

    once = Stored(packed_once(held, 0)).df
    columns = [*held.columns, "sequence_id", "offset"]
    # the underfull bins of all cells once more, in another order
    again = packed_once(once.where(F.col("fill") < capacity).select(*held.columns), 1)
    return once.where(F.col("fill") == capacity).select(*columns).unionByName(again.select(*columns))
