"""Helpers shared by the operators to keep plans safe on large inputs."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest side (rows) that is broadcast, and largest value list turned into an IN-set.
BROADCAST_ROWS = 200_000
LITERAL_VALUES = 20_000
#: Above this k Spark no longer limits each group before the shuffle.
GROUP_LIMIT = 1_000
SALTS = 64
#: Rows that one task of an aggregation holds at once.
TASK_ROWS = 500_000
#: A key with more than one in so many rows is frequent.
FREQUENT = 1_000
#: Inputs up to this estimated size are spread over all cores before text analysis.
SPREAD_BYTES = 1 << 30


def is_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than one row beyond."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a side proven small, otherwise the plain frame.

    Beyond the bound the join runs as a shuffled join, where adaptive execution splits hot keys.
    Meant for request-sized inputs (query terms, name tables) that are cheap to count.
    """
    return F.broadcast(df) if is_bounded(df, max_rows) else df


@dataclass(frozen=True)
class Request:
    """What one cheap job found out about a request-sized table."""

    values: list | None
    bounded: bool

    def test(self, value: str) -> str:
        """SQL condition that ``value`` is one of the strings asked for; true when they are too many.

        Thousands of literals reach Spark far faster as one expression text than one by one.
        """
        if self.values is None:
            return "true"
        quoted = ["'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in self.values]
        return f"{value} in ({', '.join(quoted)})" if quoted else "false"

    def hint(self, df: DataFrame) -> DataFrame:
        """Broadcast a frame no larger than the request (times fields and languages), if bounded."""
        return F.broadcast(df) if self.bounded else df


def measure_request(df: DataFrame, column: str) -> Request:
    """Distinct values of ``column`` when they are few, and whether the whole table may be broadcast."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).limit(LITERAL_VALUES + 1).collect()
    if len(counts) > LITERAL_VALUES:
        return Request(None, is_bounded(df))
    values = sorted(r[0] for r in counts if r[0] is not None)
    return Request(values, sum(r["n"] for r in counts) <= BROADCAST_ROWS)


def spread_small(df: DataFrame, max_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Spread the rows of a small input over all cores before work that costs much per row.

    A small file is often one row group and so one task. Larger inputs have splits enough and are
    processed where they are read. The size is the planner's estimate; no job runs.
    """
    if df.isStreaming:
        return df
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= max_bytes else df


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few request values as a table, built in the JVM from literals."""
    columns = [part.strip().split(" ", 1) for part in schema.split(",")]
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, columns)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions that grow with the rows, so that what one task holds does not."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def literal_codes(spark: SparkSession, values: list[str]) -> DataFrame:
    """``(term, code)``: the places of a request's words in a list of them."""
    return spark.createDataFrame(pa.table({"term": pa.array(values, pa.string()), "code": pa.array(range(len(values)), pa.int32())}))


def topk_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank_col: str = "rank"
) -> DataFrame:
    """First ``k`` rows of each group with their rank.

    Spark keeps only k rows per group and partition before the shuffle while k is small; for a larger
    k the groups are salted first, so that no task ever sorts a whole hot group.
    """
    if k > GROUP_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
        inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_pre", F.row_number().over(inner)).where(F.col("_pre") <= k)
        df = df.drop("_salt", "_pre")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).where(F.col(rank_col) <= k)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    return tempfile.mkdtemp(prefix="facetspark-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so that iterative jobs survive the loss of executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)
