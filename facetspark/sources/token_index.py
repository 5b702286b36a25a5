"""Stored token tables: texts are analysed once, and requests read postings instead of texts.

Below a path lie three Parquet tables. ``postings (doc_id, field, lang, term, tf, length)`` is bucketed by document
and sorted by term inside a bucket: all postings of a document are in one task, so scores are summed without a
shuffle, and row groups without an asked term are skipped. A row without a term stands for a text and its length. ``terms (field, lang, term, doc_freq, total_tf, peak)``
has the largest saturated frequency of each term, which bounds its scores. ``stats (field, lang, n_docs, n_tokens,
avg_length)`` is of the size of fields times languages.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.operators.postings import run_lengths
from facetspark.operators.ranking import B, K1, saturated_tf

#: Parquet row groups of postings; small ones are skipped more often.
ROW_GROUP_BYTES = 16 << 20
META_SCHEMA = "id_type string, buckets int, k1 double, b double"


@dataclass(frozen=True)
class TokenIndex:
    """Tables of a stored index; ``k1`` and ``b`` are those that ``terms.peak`` is made with."""

    postings: DataFrame
    terms: DataFrame
    stats: DataFrame
    k1: float
    b: float


def write_token_index(tokens: DataFrame, path: str, buckets: int, k1: float = K1, b: float = B) -> None:
    """Write the index of ``tokens (doc_id, field, lang, tokens)`` to a new path.

    The one shuffle of the postings deals them to the buckets; a document is in one bucket however many fields and
    languages it has. Terms and statistics are made from the stored postings, not from the texts again.
    """
    spark = tokens.sparkSession
    name = f"token_postings_{uuid.uuid4().hex}"
    rows = tokens.select("doc_id", "field", "lang", F.size("tokens").alias("length"), F.concat(
        F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("tf"))), run_lengths(F.col("tokens"))
    ).alias("words"))
    columns = ["doc_id", "field", "lang", "term", F.col("tf").cast("int").alias("tf"), F.col("length").cast("int").alias("length")]
    # a document's words are dealt together, and become rows where they are written
    postings = rows.repartition(buckets, "doc_id").select("doc_id", "field", "lang", "length", F.inline("words")).select(*columns)
    postings.write.bucketBy(buckets, "doc_id").sortBy("term").option(
        "parquet.block.size", ROW_GROUP_BYTES
    ).option("path", f"{path}/postings").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay; only the name goes
    id_type = dict(postings.dtypes)["doc_id"]
    meta = spark.range(1).select(
        F.lit(id_type).alias("id_type"), F.lit(buckets).alias("buckets"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")
    )
    meta.coalesce(1).write.json(f"{path}/meta")
    stored = open_postings(spark, path, id_type, buckets)
    stored.where("term is null").groupBy("field", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("length").alias("n_tokens"), F.avg("length").alias("avg_length")
    ).write.parquet(f"{path}/stats")
    stats, stored = spark.read.parquet(f"{path}/stats"), stored.where("term is not null")
    peak = saturated_tf(F.col("tf"), F.col("length"), F.col("avg_length"), k1, b)
    terms = stored.join(F.broadcast(stats.select("field", "lang", "avg_length")), ["field", "lang"]).groupBy("field", "lang", "term").agg(
        F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_tf"), F.max(peak).alias("peak")
    )
    terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")


def open_postings(spark: SparkSession, path: str, id_type: str, buckets: int) -> DataFrame:
    """The stored postings with their buckets, which a plain Parquet reader does not know of."""
    name = f"token_postings_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} (doc_id {id_type}, field string, lang string, term string, tf int, length int) USING parquet "
        f"CLUSTERED BY (doc_id) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{path}/postings'"
    )
    return spark.table(name)


def open_token_index(spark: SparkSession, path: str) -> TokenIndex:
    """The index stored at ``path``, in any session."""
    meta = spark.read.schema(META_SCHEMA).json(f"{path}/meta").first()
    return TokenIndex(
        open_postings(spark, path, meta.id_type, meta.buckets), spark.read.parquet(f"{path}/terms"),
        spark.read.parquet(f"{path}/stats"), meta.k1, meta.b,
    )
