"""The registered query of conversation repair: damage by a checksum of each row, repair, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetspark.llm.common import table
from facetspark.llm.repair import repair_conversations


def damaged(turns: DataFrame) -> DataFrame:
    """Rows after damage, chosen by the crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 marks a row as dropped, 1 empties its text, 2 takes ``.!?`` from it, 3 repeats the row, 4 makes its role user.
    """
    space = F.lit(" ")
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), space) if c else F.lit(":") for c in ("conv_id", "", "turn")])
    harm = F.crc32(F.encode(key, "utf-8")) % 20
    text = F.coalesce("text", space)
    return turns.select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (harm == 0).alias("dropped"), F.explode(F.sequence(F.lit(1), F.when(harm == 3, 2).otherwise(1))).alias("copy"),
    )


def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    lines = F.transform(F.arrays_zip("roles", "texts"), lambda t: F.concat(t["roles"], F.lit(":"), t["texts"]))
    return repair_conversations(damaged(turns)).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.encode(F.array_join(lines, "\n"), "utf-8"), 256).alias("repaired_sha256"),
    )


#: The cheapest repair in SQL: row by row, the cheapest edits for each initial that may be put out last
#: (0 nothing, 1 system, 2 user, 3 assistant). ``key`` orders by cost, then audit.
REPAIR_SQL = r"""
WITH RECURSIVE harm AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
           lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS h
  FROM (SELECT conv_id, turn::BIGINT AS turn, role, text FROM conversations)
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM harm, (VALUES (1), (2)) c(copy) WHERE h <> 0 AND (copy = 1 OR h = 3)
),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS nth FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, substr(role, 1, 1) AS i FROM damaged)
),
faulty AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i AS pair
  FROM numbered
),
ins(a, b, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (3, 2, 1), (2, 3, 1), (0, 3, 2), (1, 3, 2)),
filled AS (
  SELECT a, b, 5 * n AS cost, repeat('I', n) AS audit,
         CASE WHEN n = 0 THEN [] WHEN n = 2 THEN ['user:', 'assistant:'] WHEN b = 2 THEN ['user:'] ELSE ['assistant:'] END AS lines
  FROM ins
),
walk(conv_id, k, last, key, lines) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, '000000000', []::VARCHAR[] FROM faulty
  UNION ALL
  SELECT conv_id, k, last, min(key), arg_min(lines, key) FROM (
    SELECT f.conv_id, f.k, CASE e WHEN 'D' THEN b WHEN 'S' THEN 1 WHEN 'E' THEN CASE WHEN b = 2 THEN 3 ELSE 2 END END AS last,
           printf('%09d', CAST(substr(key, 1, 9) AS BIGINT) + filled.cost + CASE WHEN e = 'D' THEN 2 ELSE
             CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END + CASE WHEN e = 'E' AND i <> d THEN 1 ELSE 0 END END)
             || substr(key, 10) || filled.audit || CASE WHEN e = 'D' THEN 'D' WHEN e = 'E' AND i <> d THEN 'R' ELSE 'K' END AS key,
           walk.lines || filled.lines || CASE WHEN e = 'D' THEN [] WHEN e = 'E' AND i <> d
             THEN [CASE d WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text] ELSE [role || ':' || text] END AS lines
    FROM walk JOIN (SELECT * FROM faulty) f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.k = walk.k + 1
    JOIN (SELECT *, CASE WHEN b = 2 THEN 'a' ELSE 'u' END AS d FROM filled) filled ON filled.a = walk.last
    CROSS JOIN (VALUES ('D'), ('E'), ('S')) edit(e)
    WHERE e = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (e = 'E' OR (i = 's' AND b = 0)))
  ) GROUP BY conv_id, k, last
),
facts AS (
  SELECT conv_id, max(k) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
ended AS (
  SELECT walk.conv_id, min(printf('%09d', CAST(substr(key, 1, 9) AS BIGINT) + cost) || substr(key, 10) || audit) AS key,
         arg_min(walk.lines || filled.lines, printf('%09d', CAST(substr(key, 1, 9) AS BIGINT) + cost) || substr(key, 10) || audit) AS lines
  FROM walk JOIN facts ON walk.conv_id IS NOT DISTINCT FROM facts.conv_id AND walk.k = facts.n JOIN filled ON filled.a = walk.last
  WHERE b IN (0, 3) GROUP BY walk.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(substr(key, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(key, 10), '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id"""
