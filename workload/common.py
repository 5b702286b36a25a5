"""Shared pieces of the registered queries: tables, corpora, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.functions.text import FOLD_PAIRS, FOLDED, TOKEN_PATTERN, fold_table
from facetspark.operators.postings import TextSource, token_arrays


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_clock(name: str):
    """A timestamp without time zone as the instant of that wall clock in UTC, in any session time zone."""
    return F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone())


# --- text ---------------------------------------------------------------

def fold_sql(expr: str) -> str:
    letters, bases = fold_table()
    out = f"translate({expr}, '{letters}', '{bases}')"
    for letter, pair in FOLD_PAIRS.items():
        out = f"replace({out}, '{letter}', '{pair}')"
    return out


def tokens_sql(expr: str, fold: bool = True) -> str:
    return f"regexp_extract_all(lower({fold_sql(expr) if fold else expr}), '{TOKEN_PATTERN}')"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token arrays of all documents, accents folded."""
    return token_arrays(table(spark, sf_dir, "documents"), "doc_id", [TextSource("text", lang="lang")], FOLDED)


CORPUS_SQL = f"""
corpus AS MATERIALIZED (
  SELECT doc_id, lang, {tokens_sql('text')} AS tokens FROM documents WHERE text IS NOT NULL
),
pos AS MATERIALIZED (
  SELECT doc_id, lang, len(tokens) AS length, unnest(tokens) AS term, unnest(range(len(tokens))) AS p
  FROM corpus
),
tf AS MATERIALIZED (
  SELECT doc_id, lang, length, term, count(*) AS tf FROM pos GROUP BY ALL
)"""

STATS_SQL = """
df AS (SELECT lang, term, count(*) AS doc_freq FROM tf GROUP BY ALL),
stats AS (SELECT lang, count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM corpus GROUP BY ALL),
w AS MATERIALIZED (
  SELECT doc_id, tf.lang, tf.term, length, tf, avg_length,
         ln(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) AS idf
  FROM tf JOIN df USING (lang, term) JOIN stats USING (lang)
)"""

BM25_SQL = "idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length)))"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, words)``: every sentence of the benchmark texts with at least two words."""
    b = table(spark, sf_dir, "benchmark")
    parts = b.select("item_id", F.posexplode(F.split("text", "[.\\n]", -1)).alias("n", "sentence"))
    return parts.select(
        F.concat_ws(":", F.col("item_id").cast("string"), F.col("n").cast("string")).alias("query_id"),
        FOLDED.tokens(F.col("sentence")).alias("words"),
    ).where(F.size("words") >= 2)


SENTENCES_SQL = f"""
parts AS (
  SELECT item_id, unnest(regexp_split_to_array(text, '[.\\n]')) AS sentence,
         unnest(range(len(regexp_split_to_array(text, '[.\\n]')))) AS n
  FROM benchmark
),
sentences AS MATERIALIZED (
  SELECT item_id || ':' || n AS query_id, {tokens_sql('sentence')} AS words
  FROM parts WHERE len({tokens_sql('sentence')}) >= 2
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, words)`` of the whole benchmark texts."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), FOLDED.tokens(F.col("text")).alias("words")
    )


ITEMS_SQL = f"items AS (SELECT item_id AS query_id, {tokens_sql('text')} AS words FROM benchmark)"


# --- facets -------------------------------------------------------------

def facets_sql(base: str, fields: dict[str, str], k: int, selected: dict[str, list[str]] | None = None) -> str:
    """Top values, the rest and selections of ``base``; ``fields`` maps names to SQL expressions."""
    values = " UNION ALL ".join(
        f"SELECT '{name}' AS field, CAST({expr} AS VARCHAR) AS key FROM base" for name, expr in fields.items()
    )
    rows = [f"('{f}', '{v}')" for f, vs in (selected or {}).items() for v in vs]
    sel = f"SELECT * FROM (VALUES {', '.join(rows)}) s(field, key)" if rows else "SELECT NULL AS field, NULL AS key WHERE false"
    return f"""
WITH base AS ({base}),
v AS ({values}),
c AS (SELECT field, key, count(*) AS n FROM v WHERE key IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, key) AS pos_at FROM c),
sel AS ({sel}),
items AS (
  SELECT r.field, r.key, r.key AS name, r.n AS count, sel.key IS NOT NULL AS selected, r.pos_at
  FROM r LEFT JOIN sel ON r.field = sel.field AND r.key = sel.key WHERE r.pos_at <= {k}
  UNION ALL
  SELECT sel.field, sel.key, sel.key, NULL, true, {k + 1} FROM sel
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.pos_at <= {k} AND r.field = sel.field AND r.key = sel.key)
  UNION ALL
  SELECT field, '--other--', 'Other', CAST(sum(n) AS BIGINT), false, {k + 2} FROM r WHERE pos_at > {k} GROUP BY field
)
SELECT field, key, name, CAST(count AS BIGINT) AS count, selected,
       CAST(row_number() OVER (PARTITION BY field ORDER BY selected DESC, pos_at, key) AS INTEGER) AS rank
FROM items"""
