"""Change streams: catch-up, continuous updates and their state."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from facetspark.operators.normalize import FOUND, REMOVED, RETRY, SKIP
from facetspark.operators.upsert import latest_per_key, resolve_changes
from facetspark.sources.versions import merge_into_current

#: An event: ``event_id`` is ``"milliseconds-sequence"`` as change logs number their entries.
EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("action", T.StringType()),
])


def read_change_files(
    spark: SparkSession, path: str, schema: T.StructType = EVENT_SCHEMA, format: str = "json",
    max_files: int | None = None, **options,
) -> DataFrame:
    """A stream of event files appearing in a directory."""
    reader = spark.readStream.schema(schema).format(format).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_change_topic(
    spark: SparkSession, servers: str, topics: str, schema: T.StructType = EVENT_SCHEMA,
    max_offsets: int | None = None, starting: str = "latest",
) -> DataFrame:
    """A stream of JSON events from Kafka topics (needs Spark's Kafka package on the class path)."""
    reader = (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics).option("startingOffsets", starting)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.from_json(F.col("value").cast("string"), schema).alias("e"), F.col("topic").alias("stream")
    ).select("e.*", "stream")


def combine_streams(streams: Mapping[str, DataFrame], ids: Mapping[str, str] | None = None) -> DataFrame:
    """Several streams as one with a ``stream`` column; ``ids`` names each one's id column."""
    result = None
    for name, df in streams.items():
        key = (ids or {}).get(name, "id")
        part = df.withColumnRenamed(key, "id").withColumn("stream", F.lit(name))
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result


def route_streams(events: DataFrame, targets: Mapping[str, str], only: str | None = None) -> DataFrame:
    """Events with the ``dataset`` their stream feeds; ``only`` keeps those of one dataset."""
    pairs = F.create_map(*[F.lit(x) for pair in targets.items() for x in pair])
    routed = events.withColumn("dataset", pairs[F.col("stream")]).where("dataset is not null")
    return routed.where(F.col("dataset") == only) if only else routed


def event_millis(event_id: Column) -> Column:
    return F.split_part(event_id, F.lit("-"), F.lit(1)).cast("long")


def event_order(event_id: Column) -> tuple[Column, Column]:
    """Log order: time, then sequence number within it."""
    return event_millis(event_id), F.coalesce(F.split_part(event_id, F.lit("-"), F.lit(2)).try_cast("long"), F.lit(0))


def resume_point(docs: DataFrame, last_modified: str) -> int:
    """Milliseconds of the newest document, from which the log is read again."""
    newest = docs.agg(F.max(last_modified)).first()[0]
    return int(newest or 0) * 1000


def replay_changes(events: DataFrame, since_millis: int) -> DataFrame:
    """The newest event per id of the log from a point in time on (batch or bounded)."""
    due = events.where(event_millis(F.col("event_id")) >= since_millis)
    return latest_per_key(due, ["id"], event_order(F.col("event_id")))


@dataclass
class ApplyChanges:
    """Micro-batch function that brings a published dataset up to date.

    ``snapshot()`` gives the documents as they are now (the fetch); ``prepare`` turns fetched
    documents into rows of the dataset, and may return a ``status`` column to delete, skip or retry.
    Rows to retry are appended to ``retry_path``. Applying a batch twice changes nothing.
    """

    base: str
    alias: str
    key: str
    last_modified: str
    snapshot: Callable[[], DataFrame]
    prepare: Callable[[DataFrame], DataFrame] | None = None
    denied: frozenset[str] = frozenset()
    retry_path: str | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        events = latest_per_key(batch, ["id"], event_order(F.col("event_id")))
        if self.denied:
            events = events.where(~F.col("id").isin(sorted(self.denied)))
        docs = self.snapshot()
        ids = events.select(F.col("id").cast(docs.schema[self.key].dataType).alias(self.key), "action")
        resolved = resolve_changes(ids, docs, self.key).persist()
        try:
            found = resolved.where(F.col("status") == FOUND).select("doc.*")
            removed = resolved.where(F.col("status") == REMOVED).select(self.key)
            if self.prepare:
                found = self.prepare(found)
            if "status" in found.columns:
                status = F.coalesce(F.upper("status"), F.lit(FOUND))
                removed = removed.unionByName(found.where(status == REMOVED).select(self.key))
                if self.retry_path:
                    found.where(status == RETRY).select(self.key).withColumn("batch_id", F.lit(batch_id)).write.mode(
                        "append"
                    ).json(self.retry_path)
                found = found.where(status == FOUND).drop("status")
            merge_into_current(spark, self.base, self.alias, found, self.key, self.last_modified, deleted=removed)
        finally:
            resolved.unpersist()


def run_changes(
    stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, forever: bool = False,
    every: str = "10 seconds", output_mode: str = "append",
) -> StreamingQuery:
    """Start applying a stream; the checkpoint is the point to resume from.

    Not ``forever``: everything available is applied and the query ends, which is the catch-up. A log
    whose files may arrive out of order goes through :func:`newest_per_id` first, with output mode
    ``update``, so that a late event is answered by the newest one known.
    """
    writer = stream.writeStream.outputMode(output_mode).foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if forever else writer.trigger(availableNow=True)
    return writer.start()


def applied_rows(query: StreamingQuery) -> int:
    """Events that a running query has read since it was started, by the progress it reports."""
    return sum(p["numInputRows"] for p in query.recentProgress)


def wait_until_applied(query: StreamingQuery, rows: int, seconds: float = 300.0) -> None:
    """Block until a running query has read ``rows`` events and is idle; fails if the query does or time runs out."""
    end = time.monotonic() + seconds
    while applied_rows(query) < rows or query.status["isTriggerActive"]:
        if query.exception():
            raise query.exception()
        if not query.isActive or time.monotonic() > end:
            raise TimeoutError(f"{applied_rows(query)} of {rows} events applied")
        time.sleep(0.1)


def newest_per_id(events: DataFrame) -> DataFrame:
    """Newest event per id as a stream (update mode); an id comes out again whenever a newer event arrives.

    Late events count like any other and are never dropped. The state is one event an id ever met; it is kept
    in the checkpoint folder's state store.
    """
    whole = F.struct(*[F.col(c) for c in events.columns])
    newest = F.max_by(whole, F.struct(*event_order(F.col("event_id")))).alias("_row")
    return events.groupBy("id").agg(newest).select("_row.*")
