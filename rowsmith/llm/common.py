"""What the operators share: shared-folder tables, Arrow batches cut by bytes, words of a text."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsmith.session import scratch_dir

#: Rows to an Arrow batch: with texts of up to about 100 kB each batch stays in the tens of MB.
BATCH_ROWS = 256
#: Python works on slices of a batch of about this many bytes of text.
SLICE_BYTES = 2_000_000
BITS = 25  # of a bitmap's size
HOT_ROWS = 100_000


def tune(spark: SparkSession) -> None:
    """Small Arrow batches, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Paths that `write_table` has made and nothing has dropped, in order.
_made: list[str] = []


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which outlives any executor. The tables of one
    application stand in one folder below it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """How many tables stand now, for `drop_since`."""
    return len(_made)


def drop_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Deletes the tables made since `mark` other than those that `keep` read. Only for tables that no result
    still to be computed reads."""
    wanted = [f for df in keep for f in df.inputFiles()]
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in _made[mark:]:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in wanted):
            at = fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _made.remove(path)


def raw(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def trim() -> None:
    """Gives freed memory back to the system, so that a worker doesn't keep the most that any task took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


_libc = ctypes.CDLL(None)


def freed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function, with a `trim` at the end of each task."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return trimmed


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text each, one row at least."""
    sizes = pc.binary_length(batch.column(column).cast(pa.binary())).fill_null(0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total + n > limit and i > at:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of about `limit` bytes, from smaller ones."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= limit:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def bounds(joined: bytes) -> tuple[list[int], list[int]]:
    """Starts and ends of the words of a text whose words are joined by one space."""
    if not joined:
        return [], []
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    return [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]


def mark(n: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of n positions are covered by [start, start + width) of any start."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:n]) > 0


def join_copies(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the values of their key, inner; `values` has one row for each key, and in `copies` how many rows
    share it. Keys of over HOT_ROWS rows, of which there are few, are broadcast, so their rows stay where they are."""
    hot = F.col("copies") > HOT_ROWS
    few, others = values.filter(hot).drop("copies"), values.filter(~hot).drop("copies")
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(others, keys)
    return rows.join(F.broadcast(few), keys).unionByName(rest)


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


class Bitmap:
    """Which of 64-bit hashes may be among some, in 2**BITS bits whatever their number; each task sends one."""

    def __init__(self, df: DataFrame, column: str) -> None:
        size = BITS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            has = np.zeros(1 << size, bool)
            for b in batches:
                has[b.column("h").to_numpy().view(np.uint64) >> np.uint64(64 - size)] = True
            yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(np.packbits(has, bitorder="little").tobytes())], pa.binary())], names=["has"])

        self.size, self.bits = size, np.zeros(1 << size - 3, np.uint8)
        for r in df.select(F.col(column).alias("h")).coalesce(4).mapInArrow(freed(run), "has binary").toLocalIterator():
            self.bits |= np.frombuffer(zstandard.decompress(bytes(r.has)), np.uint8)

    def __getstate__(self) -> tuple[int, bytes]:
        return self.size, zstandard.compress(self.bits.tobytes())

    def __setstate__(self, state: tuple[int, bytes]) -> None:
        self.size, self.bits = state[0], np.frombuffer(zstandard.decompress(state[1]), np.uint8)

    def may(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.size)
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
