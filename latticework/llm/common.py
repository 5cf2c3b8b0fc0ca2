"""What the operators share: text buffers in numpy, hashing, working folders."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
#: Odd multiplier of the polynomial hash; 1 - BASE has one factor of two only.
BASE = 0x9E3779B97F4A7C17 | 3
INVERSE = pow(BASE, -1, 1 << 64)
#: A random 64-bit value for each byte.
BYTE_VALUE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Texts handled by one round of numpy, in bytes; a longer text is a round of its own.
ROUND_BYTES = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values; distinct values stay distinct."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, ROUND_BYTES + 64)
            up, down = np.full(size, BASE, U64), np.full(size, INVERSE, U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


POWERS = Powers()


class SpanHash:
    """Hashes of arbitrary spans of one sequence, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, values: np.ndarray) -> None:
        up, self.down = POWERS.upto(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a column of strings and where each begins (one more for the end); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def rounds(at: np.ndarray, limit: int = ROUND_BYTES):
    """Runs of whole texts of at most `limit` bytes together, or of one longer text: pairs of first row, row after the last."""
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def per_text(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Totals by text from inclusive sums by byte or word."""
    total = np.concatenate([[0], sums])
    return total[at[1:]] - total[at[:-1]]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    top = checkpoint_dir(spark)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Bytes that Spark hands to Python at a time, where the session allows more: a worker holds several copies of them.
BATCH_BYTES = 4 << 20


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow, from now on in the session's batches of about BATCH_BYTES at most. When a task ends, its worker,
    which Spark keeps for later tasks, gives what it no longer needs back to the system.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def whole(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, one of our own if all tasks run on this machine, as in
    tests; on a cluster that is an error, as the executors would each write to a disk of their own.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"/tmp/checkpoints/{uuid.uuid4().hex[:12]}"
        spark.sparkContext.setCheckpointDir(top)
        top = spark.sparkContext.getCheckpointDir()
    return top


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, read again."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(id_col: str = "doc_id"):
    """Rows from which nothing is learnt: crc32 of the id as text leaves 2 when divided by 4. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
