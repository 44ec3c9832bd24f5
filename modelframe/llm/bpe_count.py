"""Token counts by heap-and-linked-list byte-pair merging, without emitting identifiers.

The adjacent pairs of a unit's symbols wait in a heap by rank; the lowest is popped and merged in a doubly linked
list, its neighbours' new pairs join the heap, stale ones are skipped. Each merge removes one symbol, so the count
is the initial symbols less the merges. A character outside the vocabulary starts as its UTF-8 bytes, which no
merge joins. Where no piece has a space mark after another character, a text falls apart into units (marks, then
other characters) that no merge can cross, and each worker remembers the counts of units it has met, within a bound.

Edge cases: a null text counts as empty, an empty text has no tokens; a very long unit is merged like any other
(n log n) but not remembered; an empty table gives no rows; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelframe.llm.common import map_in_arrow

MARK = "▁"
#: Units longer than this are not remembered, and a worker forgets all units once it holds so many.
LONGEST_KEPT, MOST_KEPT = 48, 200_000


class PieceCounter:
    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        normal = [
            i
            for i in range(model.vocab_size())
            if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
        ]
        if any(model.is_unused(i) for i in range(model.vocab_size())):
            raise ValueError("models with unused pieces are not supported")
        pieces = {model.id_to_piece(i): model.get_score(i) for i in normal}
        #: Lower is merged sooner.
        self.rank = {p: -s for p, s in pieces.items()}
        longer = [p for p in pieces if len(p) > 1]
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in longer))
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in longer)
        self.unit = re.compile(rf"(?s).+" if crossing else f"[{re.escape(alone)}]|{MARK}+[^{MARK}{re.escape(alone)}]*|[^{MARK}{re.escape(alone)}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.kept: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        kept, total = self.kept, 0
        for unit in self.unit.findall(MARK + text.replace(" ", MARK)):
            n = kept.get(unit)
            if n is None:
                n = self.merge(unit)
                if len(unit) <= LONGEST_KEPT:
                    if len(kept) >= MOST_KEPT:
                        kept.clear()
                    kept[unit] = n
            total += n
        return total

    def merge(self, unit: str) -> int:
        """Initial symbols less merges."""
        rank = self.rank
        symbols: list[str | None] = list(unit)
        size = len(symbols)
        count = sum(1 if c in rank else len(c.encode("utf-8", "replace")) for c in unit)
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = []
        for i in range(size - 1):
            joined = unit[i : i + 2]
            if joined in rank:
                heap.append((rank[joined], i, i + 1, joined))
        heapify(heap)
        while heap:
            _, i, j, joined = heappop(heap)
            left, right = symbols[i], symbols[j]
            if left is None or right is None or after[i] != j or len(left) + len(right) != len(joined):
                continue
            symbols[i], symbols[j] = joined, None
            count -= 1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                wider = joined + symbols[k]
                if wider in rank:
                    heappush(heap, (rank[wider], i, k, wider))
            h = before[i]
            if h >= 0:
                wider = symbols[h] + joined
                if wider in rank:
                    heappush(heap, (rank[wider], h, i, wider))
        return count


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    """One for each Python worker."""
    return PieceCounter(model_path)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for batch in batches:
            found = pa.array([count(t.as_py()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("n_bytes"), found], ["doc_id", "n_bytes", "n_tokens"]
            )

    n_bytes = F.coalesce(F.octet_length("text").cast("long"), F.lit(0).cast("long")).alias("n_bytes")
    given = docs.select(F.col("doc_id").cast("long"), "text", n_bytes)
    return map_in_arrow(given, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
