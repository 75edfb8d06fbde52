"""Helpers that the corpus operators share: table access, shared storage, Arrow plumbing."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

#: Bytes of text handed to a native kernel at once; bounds what a Python worker holds beside its Arrow batch.
KERNEL_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder serves, but only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return own


#: Folders of the tables that ``written`` has made in this process and nothing has removed yet.
_made: dict[str, SparkSession] = {}


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back: cuts lineage, survives lost executors.

    The folder stays until ``discard`` or ``release`` removes it. ``by`` names a column to partition the files by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._textloom_path = path
    _made[path] = spark
    return back


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _made.pop(path, None)


def discard(df: DataFrame) -> None:
    """Removes a table made by ``written`` that nothing will read again."""
    path = getattr(df, "_textloom_path", None)
    if path:
        remove(df.sparkSession, path)


def tables_made() -> frozenset[str]:
    """The tables that stand now; what ``release`` is told to leave alone."""
    return frozenset(_made)


def release(spark: SparkSession, before: frozenset[str], *kept: DataFrame) -> None:
    """Removes what ``written`` has made since ``before`` was taken, but for ``kept``: once its result is written itself."""
    spared = {getattr(df, "_textloom_path", None) for df in kept}
    for path in [x for x, session in _made.items() if x not in before and x not in spared and session is spark]:
        remove(spark, path)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; a null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: Sequence[int], most: int = KERNEL_BYTES) -> Iterator[slice]:
    """Consecutive runs of items of at most ``most`` bytes together; a larger item is a run of its own."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield slice(begin, i)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def list_array(parts: Sequence[np.ndarray], kind=pa.int32()) -> pa.ListArray:
    """A list column from one numpy array per row."""
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=ends[1:])
    values = np.concatenate(parts) if len(parts) else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def small(batch: pa.RecordBatch, most: int = KERNEL_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose strings take at most ``most`` bytes together (one row may take more)."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            sizes += 4 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for run in slices(sizes.tolist(), most):
        yield batch.slice(run.start, run.stop - run.start)


class Sieve:
    """A Bloom filter over 64-bit hashes: three places of each in a table of bits, of a size that is a power of two."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
        x = hashes.view(np.uint64)
        return [((x >> np.uint64(shift)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64) for shift in (0, 17, 31)]

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be among those of the filter; no hash of it is ever denied."""
        found = np.ones(len(hashes), dtype=bool)
        for at in self.places(hashes, self.bits):
            found &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
        return found


#: A filter has 16 bits for each of its keys, but 2 ** SIEVE_BITS (16 MB) at most; with more keys it lets more pass.
SIEVE_BITS = 27


def sieve(keys: DataFrame, column: str) -> Sieve:
    """The Bloom filter of a column of 64-bit hashes: places are put together by word before the driver gets them."""
    count = keys.count()
    bits = min(SIEVE_BITS, max(16, int(16 * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(Sieve.places(batch.column(0).to_numpy(), bits))
            word, masks = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            order = np.argsort(word, kind="stable")
            names, begins = np.unique(word[order], return_index=True)
            if len(names):
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bitwise_or.reduceat(masks[order], begins).view(np.int64))], ["word", "mask"])

    found = keys.select(column).mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return Sieve(bits, words)


def sieved(df: DataFrame, held: Sieve, column: str) -> DataFrame:
    """``df`` with ``__may``: whether the filter may hold the row's hash in ``column``. A map; all other columns pass through."""
    shared = df.sparkSession.sparkContext.broadcast(held)
    schema = StructType([*df.schema.fields, StructField("__may", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = shared.value.holds(batch.column(batch.schema.get_field_index(column)).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mask)], [*batch.schema.names, "__may"])

    return df.mapInArrow(run, schema)


def among(df: DataFrame, held: Sieve, column: str) -> DataFrame:
    """The rows of ``df`` whose hash in ``column`` the filter may hold."""
    shared = df.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(batch.column(batch.schema.get_field_index(column)).to_numpy())))

    return df.mapInArrow(run, df.schema)


def give_back() -> None:
    """Returns freed memory to the system: workers are used again, and what one stage kept would add to the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, columns: Sequence[str], schema, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> DataFrame:
    """``mapInArrow`` over the named columns only; anything else the input has never leaves the JVM.

    The kernel gets runs of rows of bounded size, so a worker's memory does not follow the size of Arrow's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                if (out := kernel(part)) is not None:
                    yield out
        give_back()

    return df.select(*columns).mapInArrow(run, schema)
