"""Versioned datasets: dated directories and a log of which one an alias points to.

Layout below a base path: ``<alias>-<version>/`` with Parquet data; ``_layouts/`` with one JSON row per
version: its schema, the key and number of its buckets, and the folder of each bucket, which may lie in
an older version; and ``_aliases/`` with one JSON row per switch, appended. The newest row of an alias is
its current version. Data of a published version are never changed.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from facetspark.operators.upsert import upsert_documents

ALIAS_SCHEMA = "alias string, version string, switched_at timestamp"
LAYOUT_SCHEMA = "version string, key string, buckets int, schema string, parts array<struct<bucket: int, path: string>>"
BUCKET = "_bucket"


def version_name(alias: str, at: datetime | None = None) -> str:
    return f"{alias}-{(at or datetime.now(timezone.utc)).strftime('%Y-%m-%dT%H-%M-%S-%f')}"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def publish_version(
    df: DataFrame, base: str, alias: str, key: str | None = None, buckets: int | None = None, version: str | None = None
) -> str:
    """Write a new version in full, then switch the alias to it; returns the version's name.

    With ``key`` and ``buckets`` the rows are laid out by a hash of the id, so that later updates
    rewrite only the buckets they touch. Rebalancing lets adaptive execution write a large bucket
    with several tasks and small ones together.
    """
    version = version or version_name(alias)
    parts = _write_parts(df, f"{base}/{version}", key, buckets)
    _write_layout(df.sparkSession, base, version, key if buckets else None, buckets if key else None, df.schema, parts)
    switch_alias(df.sparkSession, base, alias, version)
    return version


def _write_parts(df: DataFrame, path: str, key: str | None, buckets: int | None) -> dict[int, str]:
    """Write the rows and return the folder of each bucket; without buckets all rows are part -1."""
    if not (key and buckets):
        df.write.mode("errorifexists").parquet(path)
        return {-1: path}
    dealt = df.withColumn(BUCKET, bucket_of(key, buckets)).hint("rebalance", BUCKET)
    dealt.write.mode("errorifexists").partitionBy(BUCKET).parquet(path)
    written = df.sparkSession.read.schema(f"{BUCKET} int").parquet(path).select(BUCKET).distinct().collect()  # at most ``buckets`` rows
    return {r[0]: f"{path}/{BUCKET}={r[0]}" for r in written}


def _write_layout(spark, base, version, key, buckets, schema: StructType, parts: dict[int, str]) -> None:
    row = (version, key, buckets, schema.json(), sorted(parts.items()))
    spark.createDataFrame([row], LAYOUT_SCHEMA).coalesce(1).write.mode("append").json(f"{base}/_layouts")


def layouts(spark: SparkSession, base: str) -> DataFrame:
    """The layout of every version."""
    return spark.read.schema(LAYOUT_SCHEMA).json(f"{base}/_layouts")


def layout(spark: SparkSession, base: str, version: str) -> Row:
    found = layouts(spark, base).where(F.col("version") == version).first()
    if found is None:
        raise LookupError(f"no version {version!r}")
    return found


def _read_parts(spark: SparkSession, found: Row, buckets: Iterable[int] | None = None) -> DataFrame:
    """Rows of a version, or of some of its buckets."""
    wanted = None if buckets is None else set(buckets)
    paths = [p["path"] for p in found["parts"] if wanted is None or p["bucket"] in wanted]
    schema = StructType.fromJson(json.loads(found["schema"]))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def switch_alias(spark: SparkSession, base: str, alias: str, version: str) -> None:
    row = spark.range(1).select(
        F.lit(alias).alias("alias"), F.lit(version).alias("version"),
        F.lit(datetime.now(timezone.utc).isoformat()).cast("timestamp").alias("switched_at"),
    )
    row.coalesce(1).write.mode("append").json(f"{base}/_aliases")


def aliases(spark: SparkSession, base: str) -> DataFrame:
    """``(alias, version)``: where every alias points now."""
    log = spark.read.schema(ALIAS_SCHEMA).json(f"{base}/_aliases")
    return log.groupBy("alias").agg(F.max_by("version", "switched_at").alias("version"))


def current_version(spark: SparkSession, base: str, alias: str) -> str | None:
    row = aliases(spark, base).where(F.col("alias") == alias).first()
    return row["version"] if row else None


def read_current(spark: SparkSession, base: str, alias: str) -> DataFrame:
    version = current_version(spark, base, alias)
    if version is None:
        raise LookupError(f"nothing published as {alias!r}")
    return _read_parts(spark, layout(spark, base, version))


def merge_into_current(
    spark: SparkSession, base: str, alias: str, updates: DataFrame, key: str, last_modified: str,
    deleted: DataFrame | None = None, only_newer: bool = False,
) -> None:
    """Partial import: a new version with upserts and deletions, to which the alias is switched at the end.

    Only the buckets that the changes touch are read and written, by the key and number of buckets the live
    version was published with; the new version takes the folders of the others over. A version without
    buckets is written in full. Readers of the old version are not disturbed, a failed merge leaves no trace
    in the live one, and running it again with the same changes gives the same data.
    """
    version = current_version(spark, base, alias)
    if version is None:
        raise LookupError(f"nothing published as {alias!r}")
    found = layout(spark, base, version)
    touched_ids = updates.select(key) if deleted is None else updates.select(key).unionByName(deleted.select(key))
    buckets = found["buckets"]
    if buckets and found["key"] != key:
        raise ValueError(f"{version} is bucketed by {found['key']!r}, not by {key!r}")
    touched = None
    if buckets:
        touched = [r[0] for r in touched_ids.select(bucket_of(key, buckets).alias(BUCKET)).distinct().collect()]
    elif touched_ids.isEmpty():
        touched = []
    if touched == []:
        return
    part = _read_parts(spark, found, touched)
    merged = upsert_documents(part, updates, key, last_modified, deleted, only_newer).select(*part.columns)
    new = version_name(alias)
    parts = {p["bucket"]: p["path"] for p in found["parts"] if touched is not None and p["bucket"] not in touched}
    parts |= _write_parts(merged, f"{base}/{new}", found["key"], buckets)
    _write_layout(spark, base, new, found["key"], buckets, part.schema, parts)
    switch_alias(spark, base, alias, new)


def versions_in_use(spark: SparkSession, base: str) -> DataFrame:
    """``(alias, version)``: current versions and those whose folders a current version took over."""
    own = aliases(spark, base)
    folder = F.element_at(F.split(F.regexp_replace("part.path", f"/{BUCKET}=\\d+$", ""), "/"), -1)
    lent = own.join(layouts(spark, base), "version").select("alias", F.explode("parts").alias("part")).select(
        "alias", folder.alias("version")
    )
    return own.unionByName(lent).distinct()


def stale_versions(versions: DataFrame, aliases: DataFrame, prefix: Column | str) -> DataFrame:
    """Versions ``(name, …)`` of the given prefix that no alias points to; deleting is the caller's.

    Of merged datasets, ``aliases`` should be :func:`versions_in_use`.
    """
    own = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return versions.where(F.col("name").startswith(F.concat(own, F.lit("-")))).join(
        aliases.select(F.col("version").alias("name")).distinct(), "name", "left_anti"
    )
