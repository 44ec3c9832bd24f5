"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams (1 to 3 letters, word ends marked) over all training texts, by
rank. A document's own most frequent n-grams are compared to each profile by the out-of-place distance: how far
each n-gram's rank is from its rank in the profile, the full length for one the profile lacks. The least distance
wins; ties go to the language first in order. score is 1 less the distance's share of the largest possible one.

Edge cases: a null text or one without a letter is `und` with score 0; so is every text if nothing was learned;
a text of one word is ranked like any other; very long texts are ranked whole; rows with a null label don't teach;
a null doc_id counts as remainder 0; repeated rows count each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modelframe.llm.common import free_name, map_in_arrow, small_batches

#: Longest n-gram, ranks in a language's profile, ranks taken from a document.
NGRAM, PROFILE, TAKEN = 3, 400, 300
UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Codes gathered before they are counted, in training.
_GATHER = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def ngrams(text: str | None, longest: int = NGRAM) -> np.ndarray:
    """Codes of the n-grams within words, each word between two marks; none without a letter."""
    if not text:
        return np.empty(0, np.uint64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    # one mark for each run of other characters, and one at both ends
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    s = np.where(letter, points, 0)[keep].astype(np.uint64)
    if not len(s) or not letter.any():
        return np.empty(0, np.uint64)
    s = np.concatenate([np.zeros(int(s[0] != 0), np.uint64), s, np.zeros(int(s[-1] != 0), np.uint64)])
    inside = s != 0
    out = []
    code = s.copy()
    for n in range(1, longest + 1):
        if n > 1:
            if len(s) < n:
                break
            code = code[:-1] * _MIX + s[n - 1 :]
        size = len(code)
        ok = inside if n == 1 else np.ones(size, bool)
        for k in range(1, n - 1):
            ok = ok & inside[k : k + size]
        out.append(code[ok] * _MIX ^ np.uint64(n))
    return np.concatenate(out)


def ranked(codes: np.ndarray, most: int = TAKEN) -> np.ndarray:
    """The most frequent codes, most frequent first, ties by code."""
    found, n = np.unique(codes, return_counts=True)
    return found[np.argsort(-n, kind="stable")[:most]]


def profiles(docs: DataFrame, most: int = PROFILE, longest: int = NGRAM) -> dict[str, np.ndarray]:
    """Language -> codes by rank, from all rows (text, lang) with a label; at most `most` a language reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[str, list[np.ndarray]] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            parts = [(lang, *np.unique(np.concatenate(a), return_counts=True)) for lang, a in gathered.items()]
            gathered.clear()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([lang for lang, c, _ in parts for _ in range(len(c))], pa.string()),
                    pa.array(np.concatenate([c for _, c, _ in parts]).view(np.int64)),
                    pa.array(np.concatenate([n for _, _, n in parts]).astype(np.int64)),
                ],
                ["lang", "code", "n"],
            )

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                codes = ngrams(text.as_py(), longest)
                if len(codes):
                    gathered.setdefault(lang, []).append(codes)
                    held += len(codes)
                    if held >= _GATHER:
                        yield flush()
                        held = 0
        if gathered:
            yield flush()

    given = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    counts = (
        map_in_arrow(given, run, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).toPandas()
    return {
        lang: own.sort_values("r")["code"].to_numpy(np.int64).view(np.uint64) for lang, own in sorted(top.groupby("lang"))
    }


class Ranker:
    def __init__(self, learned: dict[str, np.ndarray], most: int = PROFILE, taken: int = TAKEN):
        self.langs, self.most, self.taken = sorted(learned), most, taken
        codes = np.unique(np.concatenate([learned[k] for k in self.langs])) if learned else np.empty(0, np.uint64)
        #: Of each code known to any language, its rank in each; `most` where it has none.
        self.codes = codes
        self.rank = np.full((len(self.langs), len(codes) + 1), most, np.int64)
        for k, lang in enumerate(self.langs):
            self.rank[k, np.searchsorted(codes, learned[lang])] = np.arange(len(learned[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = ngrams(text)
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(codes, self.taken)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == own
        place = self.rank[:, np.where(known, at, len(self.codes))]
        apart = np.where(place == self.most, self.most, np.abs(place - np.arange(len(own))))
        distance = apart.sum(axis=1)
        k = int(distance.argmin())
        return self.langs[k], 1.0 - float(distance[k]) / (self.most * len(own))


def predicted(text: Column, learned: dict[str, np.ndarray]) -> Column:
    """struct<lang string, score double> of each text."""
    ranker = Ranker(learned)

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ranker.predict(t) for t in texts], columns=["lang", "score"])

    return run(text)


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo; 0 of null."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def identified(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one for each row of docs; learns from rows not held out."""
    fold = remainder(F.col("doc_id"), modulus)
    small_batches(docs.sparkSession)
    learned = profiles(docs.where(fold != held_out))
    return docs.select(
        F.col("doc_id").cast("long"), (fold == held_out).alias("held_out"), predicted(F.col("text"), learned).alias("found")
    ).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score")


def kept_languages(docs: DataFrame, least_score: float = 0.02) -> DataFrame:
    """The rows of docs whose text has a language: some letter, and ranks that some profile shares."""
    small_batches(docs.sparkSession)
    learned = profiles(docs)
    mark = free_name(docs, "language_of_text")
    return docs.withColumn(mark, predicted(F.col("text"), learned)).where(
        (F.col(f"{mark}.lang") != UNKNOWN) & (F.col(f"{mark}.score") >= least_score)
    ).drop(mark)
