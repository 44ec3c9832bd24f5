"""Shared plumbing of the corpus operators: tables, cut lineage, hashing helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Bytes of a batch that goes to a Python worker.
BATCH = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a fresh local one only where none is named in local mode (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        named = f"file://{tempfile.mkdtemp(prefix='modelframe-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Stored:
    """A DataFrame written as Parquet to the shared folder: a short lineage that outlives lost executors."""

    def __init__(self, df: DataFrame, compression: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{work_dir(self.spark)}/stored-{uuid.uuid4().hex}"
        df.write.parquet(self.path, compression=compression)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        """Frees the files; only once nothing unevaluated reads them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    return Stored(df).df


def ascii_words(text: bytes | None) -> list[bytes]:
    """Lower-cases A-Z and splits at space and \\t \\n \\v \\f \\r, as bytes.lower and bytes.split do."""
    return (text or b"").lower().split()


def small_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python of this session hold BATCH bytes at most, or one row; all but small ones cost memory only."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def trimmed() -> None:
    """Gives freed memory back to the system: a worker stays beside others of its executor when its task is done."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def portions(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `most` bytes of text each, so that memory doesn't follow the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        past = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most))
        n = max(1, past - at)
        yield batch.slice(at, n)
        at += n
    trimmed()


def distinct_chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Chunks between ASCII white space: where each text's begin (and the end), the number of each, the distinct ones."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    coded = lists.flatten().dictionary_encode()
    starts = lists.offsets.to_numpy()
    return starts - starts[0], coded.indices.to_numpy(), coded.dictionary.to_pylist()


def spread(starts: np.ndarray, numbers: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts each chunk's values in its place: all values in order, and where each text's begin (and the end).

    values holds those of chunk 0, then of chunk 1 and so on, sizes how many each has.
    """
    first = np.cumsum(sizes) - sizes
    each = sizes[numbers]
    ends = np.concatenate([[0], np.cumsum(each)])
    where = np.repeat(first[numbers] - ends[:-1], each) + np.arange(ends[-1])
    return values[where], ends[starts]
