"""Pieces the operators share: Arrow row streams, words, block counts, reliable scratch tables."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.scale import scratch_path

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<binary>": pa.list_(pa.binary()),
}
#: An output batch is closed at so many rows or bytes.
OUT_ROWS = 4096
OUT_BYTES = 8 << 20


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (part.split() for part in ddl.split(","))])


def batches_of(rows: Iterable[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    schema = arrow_schema(ddl)
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes, list)))
        if len(out) >= OUT_ROWS or size >= OUT_BYTES:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def give_back() -> None:
    """Hands what this worker has freed back to the system: Spark keeps workers for later stages, of other shapes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim:
        trim(0)


def in_task(fn, source, ddl: str) -> Iterator[pa.RecordBatch]:
    """The batches of one task; memory of the task before it, and its own, goes back."""
    give_back()
    yield from batches_of(fn(source), ddl)
    give_back()


def map_rows(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterable[tuple]], ddl: str) -> DataFrame:
    """``fn`` over the rows of each partition, as a stream of Arrow batches both ways."""

    return df.mapInArrow(lambda batches: in_task(fn, rows_of(batches), ddl), ddl)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]], ddl: str) -> DataFrame:
    """As ``map_rows``, for functions that look at whole batches."""
    return df.mapInArrow(lambda batches: in_task(fn, batches, ddl), ddl)


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8")


def words_of(data: bytes) -> list[bytes]:
    """Runs of anything but ASCII white space (space and 0x09-0x0D); bytes.split() splits at exactly these."""
    return data.split()


#: From here on the planner does not know a size and says so by a huge one.
UNKNOWN_BYTES = 1 << 55


def estimated_bytes(df: DataFrame) -> int:
    """The planner's size of ``df``; only where it knows none are the texts measured by a job."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size < UNKNOWN_BYTES:
        return size
    return df.select(F.sum(F.octet_length("text"))).first()[0] or 0


def block_count(df: DataFrame, block_bytes: int) -> int:
    """How many hash blocks keep each near ``block_bytes`` of input; grows with the input, at least the shuffle partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-estimated_bytes(df) // block_bytes))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    # shuffle files of a finished job go when the driver finds out that nobody refers to them
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Vectors are summed in slices, each first within so many groups of tasks.
SLICE_BYTES = 1 << 16
TASK_GROUPS = 64


def summed(df: DataFrame, fn, length: int, dtype: str = "int64"):
    """``summed_batches`` for a function of rows."""
    return summed_batches(df, lambda batches: fn(rows_of(batches)), length, dtype)


def summed_batches(df: DataFrame, fn, length: int, dtype: str = "int64"):
    """Element-wise sum over all partitions of the vector that ``fn(batches)`` makes of one, as a numpy array.

    A vector of fixed ``length`` is cut into slices, which are summed in two rounds on the executors;
    only ``length`` numbers reach the driver, however many partitions there are.
    """
    import numpy as np

    step = SLICE_BYTES // 8

    def packed(values):
        return zlib.compress(values.tobytes(), 1)

    def parts(batches):
        from pyspark import TaskContext

        total = np.asarray(fn(batches), dtype)
        group = TaskContext.get().partitionId() % TASK_GROUPS
        pieces = ((k, total[k * step:(k + 1) * step]) for k in range(-(-length // step)))
        yield from batches_of(((group, k, packed(piece)) for k, piece in pieces if piece.any()), ddl)

    def add(table):
        total = sum(np.frombuffer(zlib.decompress(v.as_py()), dtype) for v in table.column("v"))
        row = (table.column("g")[0].as_py(), table.column("k")[0].as_py(), packed(total))
        return pa.Table.from_batches(list(batches_of([row], ddl)))

    ddl = "g int,k int,v binary"
    within = df.mapInArrow(parts, ddl).groupBy("g", "k").applyInArrow(add, ddl)
    out = np.zeros(length, dtype)
    for row in within.groupBy("k").applyInArrow(add, ddl).collect():
        piece = np.frombuffer(zlib.decompress(bytes(row["v"])), dtype)
        out[row["k"] * step:row["k"] * step + len(piece)] = piece
    return out
