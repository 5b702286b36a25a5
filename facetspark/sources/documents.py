"""Reading documents and taxonomies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_documents(
    spark: SparkSession, path: str | list[str], schema: T.StructType, limit: int | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """JSON lines, plain or compressed, with a declared schema; blank lines are passed over.

    Lines that do not parse are kept in ``_corrupt_record``. A gzip file is read by one task, so
    ``partitions`` spreads its rows for what follows.
    """
    full = schema if CORRUPT in schema.names else T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    lines = spark.read.text(path).where(F.trim("value") != "")
    df = lines.select(F.from_json("value", full, options).alias("doc")).select("doc.*")
    if limit is not None:
        df = df.limit(limit)
    return df.repartition(partitions) if partitions else df


@dataclass(frozen=True)
class Parsed:
    documents: DataFrame
    corrupt: DataFrame


def split_corrupt(df: DataFrame) -> Parsed:
    """Readable documents, and the lines that were not."""
    return Parsed(df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT))


def ingest_report(df: DataFrame, id_col: str, denied: DataFrame | None = None) -> DataFrame:
    """``(outcome, n)`` over rows read: accepted, missing id, denied id, corrupt."""
    key = F.col(f"`{id_col}`").cast("string")
    outcome = F.when(F.col(CORRUPT).isNotNull(), "corrupt").when(key.isNull() | (key == ""), "missing id")
    narrow = df.select(key.alias("_key"), outcome.alias("outcome"))
    if denied is not None:
        ids = denied.select(F.col("id").cast("string").alias("_key"), F.lit("denied id").alias("_denied")).distinct()
        narrow = narrow.join(ids, "_key", "left").withColumn("outcome", F.coalesce("outcome", "_denied"))
    return narrow.groupBy(F.coalesce("outcome", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def lookup_documents(docs: DataFrame, key: str, ids) -> DataFrame:
    """Documents by id: one value, a short list (pushed into the scan), or a table with column ``key``."""
    if isinstance(ids, DataFrame):
        return docs.join(ids.select(key).distinct(), key, "left_semi")
    if isinstance(ids, (list, tuple, set)):
        return docs.where(F.col(key).isin(list(ids)))
    return docs.where(F.col(key) == F.lit(ids)).limit(1)


ENTRY = "struct<name:map<string,string>,synonyms:map<string,array<string>>,parents:array<string>>"


def read_taxonomy(spark: SparkSession, path: str, taxonomy: str) -> DataFrame:
    """``(taxonomy, id, name, synonyms, parents)`` from one JSON object ``{id: entry}``, plain or gzip.

    Such a file is one value and is parsed by one task; larger taxonomies belong in JSON lines or
    Parquet, see :func:`read_taxonomy_lines`.
    """
    raw = spark.read.text(path, wholetext=True)
    return (
        raw.select(F.explode(F.from_json("value", f"map<string,{ENTRY}>")).alias("id", "entry"))
        .select(F.lit(taxonomy).alias("taxonomy"), "id", "entry.name", "entry.synonyms", "entry.parents")
    )


def read_taxonomy_lines(spark: SparkSession, path: str, taxonomy: str) -> DataFrame:
    """The same from JSON lines ``{"id": …, "name": …, …}``, which Spark splits."""
    schema = "id string, name map<string,string>, synonyms map<string,array<string>>, parents array<string>"
    return spark.read.schema(schema).json(path).select(F.lit(taxonomy).alias("taxonomy"), "*")
