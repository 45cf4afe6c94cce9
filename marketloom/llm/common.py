"""Arrow text buffers, vectorised words and hashes, and shared-folder tables.

Words are runs of bytes other than space and 0x09-0x0D.  UTF-8 keeps those
bytes for themselves, so words of the bytes are words of the text.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
#: What a side may have at most to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 24 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20_240_229)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of a batch that Python gets, unless the session names a size of its own.
BATCH_BYTES, _BATCH_KEY, _BATCH_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def trim() -> None:
    """Freed memory goes back to the system, so that reused Python workers stay small (glibc only)."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        grown = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            grown.append(np.multiply.accumulate(steps))
        _powers = grown[0], grown[1]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many: less memory at a time where texts are built."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes (a longer text stands alone)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some texts: starts, ends (bytes) and, for text i, words bounds[i]:bounds[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        self.data = LOWER[data] if lower else data
        n = len(data)
        inner = ~space[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        first, last = inner.copy(), inner.copy()
        if n:
            first[1:] &= ~inner[:-1] | cut[1:-1]
            last[:-1] &= ~inner[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        pw, inv = powers(len(self.data) + 1)
        self.sums = sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[self.data] * pw[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inv[self.starts] + (self.ends - self.starts).astype(np.uint64))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive items: len(hashes) - k + 1 of them."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    pw, inv = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * pw[:n], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inv[: n - k + 1] + np.uint64(k))


def batches_of_words(column: pa.Array, lower: bool = False, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for slices of a text column."""
    data, offsets = text_buffer(column)
    for i, j in slices(offsets, most):
        part = offsets[i : j + 1]
        yield i, j, Words(data[part[0] : part[-1]], part - part[0], lower)
    trim()


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with batches for Python bounded by bytes rather than rows, where the session has Spark's own bound."""
    size = str(spark.conf.get(_BATCH_KEY)).lower()
    if size in (str(_BATCH_DEFAULT), f"{_BATCH_DEFAULT}b", "64m", "64mb"):
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder."""
    return bounded(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine only where all of Spark runs on it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            place = known.get()
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            place = f"{tempfile.gettempdir()}/marketloom-checkpoints"
        else:
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    return place.rstrip("/")


class Shared:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        bounded(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/marketloom-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, and return the written table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a written table that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark delete the shuffles of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()


def sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its measured rows and bytes are few enough."""
    loose = [F.octet_length(f.name) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    width = sum(loose, F.lit(16 * len(df.columns)))
    rows, size = df.agg(F.count("*"), F.sum(F.coalesce(width, F.lit(64)))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def crc_remainder(id_col, modulus: int):
    """crc32 of an id as text, modulo the modulus."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)
