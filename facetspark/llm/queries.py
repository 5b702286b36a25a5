"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.llm import bpe, chat, classifier, decontamination, huffman, lines, minhash, partenum, rules, sharding, suffix
from facetspark.llm.common import table
from facetspark.llm.repair_query import REPAIR_SQL, conversation_repair
from facetspark.llm.variants_query import VARIANTS_SQL, spelling_variant_grouping


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A conversation whose texts hold control strings.
ODD_TEXT = r"\### Assistant: </turn> ok"


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD_TEXT).alias("text"),
    )
    typed = turns.unionByName(odd).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.chat_digests(chat.format_chats(typed))


CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (
  SELECT *, length(regexp_replace(text, '([\\<>])', '\\\1', 'g')) + length(regexp_replace(role, '([\\<>])', '\\\1', 'g'))
            + length('<turn:>') + length('</turn>') + 1 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return rules.filter_by_rules(table(spark, sf_dir, "documents"), trusted)


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_crc32")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ 	-
]+') AS words
  FROM documents
),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL
),
link AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (
  SELECT a, a FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.component_id, w.doc_id) AS component_id,
       coalesce(least.component_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""


def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


#: Windows as hexadecimal text, two characters a byte.
REPEATS_SQL = """
WITH d AS MATERIALIZED (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
),
w AS MATERIALIZED (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 100)) AS m FROM (SELECT doc_id, h, unnest(range(n - 49)) AS p FROM d WHERE n >= 50)
),
least AS (SELECT m, min(doc_id) AS doc_id FROM w GROUP BY m HAVING min(doc_id) < max(doc_id)),
hit AS MATERIALIZED (SELECT w.doc_id, w.p FROM w JOIN least USING (m) WHERE least.doc_id < w.doc_id),
island AS (
  SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM (
    SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM hit)
),
span AS MATERIALIZED (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM island GROUP BY doc_id, k),
gap AS (
  SELECT doc_id, a, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1,
    2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0))) AS t FROM span JOIN d USING (doc_id)
),
cut AS (
  SELECT doc_id, string_agg(t, '' ORDER BY a) AS t FROM gap GROUP BY doc_id
),
total AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, max(b) AS tail FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(cut.t, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id) LEFT JOIN total USING (doc_id)"""


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(table(spark, sf_dir, "documents"))


LINES_SQL = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, list_sort(list_distinct(regexp_extract_all(line, '[^ 	-
]+'))) AS words
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)
),
c AS MATERIALIZED (
  SELECT row_number() OVER () AS k, words, min((doc_id, line_no)) AS first, len(words) AS n FROM l WHERE len(words) > 0 GROUP BY words
),
w AS MATERIALIZED (SELECT k, n, unnest(words) AS word FROM c),
freq AS (SELECT word, count(*) AS f FROM w GROUP BY word),
ranked AS (SELECT k, n, word, row_number() OVER (PARTITION BY k ORDER BY f, word) AS pos FROM w JOIN freq USING (word)),
p AS MATERIALIZED (SELECT * FROM ranked WHERE pos <= n - ceil(n * 80 / 100.0) + 1),
maybe AS MATERIALIZED (
  SELECT DISTINCT x.k AS a, y.k AS b FROM p x JOIN p y USING (word) WHERE x.k < y.k AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
),
link AS MATERIALIZED (
  SELECT a, b FROM maybe JOIN c x ON x.k = a JOIN c y ON y.k = b
  WHERE 100 * len(list_intersect(x.words, y.words)) >= 80 * (x.n + y.n - len(list_intersect(x.words, y.words)))
),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
best AS (SELECT a AS k, min(c.first) AS partner, count(*) AS n_links FROM both_ways JOIN c ON c.k = b GROUP BY a),
r AS (
  SELECT l.doc_id, l.line_no, coalesce(n_links, 0) AS n_links,
         c.first < (l.doc_id, l.line_no) OR coalesce(best.partner < (l.doc_id, l.line_no), false) AS removed
  FROM l JOIN c USING (words) LEFT JOIN best USING (k)
)
SELECT d.doc_id, count(line_no) AS n_lines, CAST(count(*) FILTER (removed) AS BIGINT) AS n_removed,
       CAST(coalesce(sum(n_links), 0) AS BIGINT) AS n_links,
       coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (removed), '') AS removed_lines
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id"""


def token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return huffman.binary_output(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, end_id=2)


def bpe_ranks() -> dict[bytes, int]:
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        return bpe.load_ranks(lines)


def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe_ranks(), public_tokenizers.PATTERN)


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.ngram_join(table(spark, sf_dir, "documents")).drop("text_crc32")


#: As for near-duplicates, from 80 % on.
JOIN_SQL = NEAR_SQL.replace(">= 75 *", ">= 80 *").replace(""",
       coalesce(least.component_id, w.doc_id) = w.doc_id AS kept""", "")


QUERIES = {
    "op1_benchmark_decontamination": benchmark_decontamination,
    "op2_quality_classifier": quality_classifier,
    "op3_chat_formatting": chat_formatting,
    "op4_quality_rules": quality_rules,
    "op5_minhash_near_dedup": minhash_near_dedup,
    "op6_suffix_array_dedup": suffix_array_dedup,
    "op7_token_id_output": token_id_output,
    "op8_line_dedup": line_dedup,
    "op9_sharding": sharded,
    "op10_byte_level_bpe": byte_level_bpe,
    "op11_conversation_repair": conversation_repair,
    "op12_spelling_variant_grouping": spelling_variant_grouping,
    "op13_ngram_jaccard_join": ngram_jaccard_join,
}

SQL = {
    "op3_chat_formatting": CHAT_SQL,
    "op5_minhash_near_dedup": NEAR_SQL,
    "op6_suffix_array_dedup": REPEATS_SQL,
    "op8_line_dedup": LINES_SQL,
    "op11_conversation_repair": REPAIR_SQL,
    "op12_spelling_variant_grouping": VARIANTS_SQL,
    "op13_ngram_jaccard_join": JOIN_SQL,
}
