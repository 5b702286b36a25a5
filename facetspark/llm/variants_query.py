"""The registered query of spelling variants, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetspark.llm.common import table
from facetspark.llm.variants import spelling_variants, word_counts


def spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), damage=31))


#: Near words in SQL: a word equals another less one letter, or both are equal less the letter at one place.
VARIANTS_SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run
),
b AS (SELECT *, hex(encode(CAST(doc_id AS VARCHAR) || ':' || run)) AS x FROM r),
h AS MATERIALIZED (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(x), 2),
    lambda p: [instr('123456789ABCDEF', x[p + 1]) * 16 + instr('123456789ABCDEF', x[p + 2]), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, v: CASE WHEN v >= 0 THEN xor(c, v) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h
  FROM b
),
w AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
),
d AS MATERIALIZED (
  SELECT word, n, p, substr(word, 1, p) || substr(word, p + 2) AS less FROM (SELECT word, n, unnest(range(length(word))) AS p FROM w)
),
pair AS MATERIALIZED (
  SELECT DISTINCT d.word AS a, d.n AS na, w.word AS b, w.n AS nb FROM d JOIN w ON w.word = d.less
  UNION ALL SELECT x.word, x.n, y.word, y.n FROM d x JOIN d y USING (p, less) WHERE x.word <> y.word
),
near AS (SELECT a AS word, na AS n, b AS other, nb AS m FROM pair UNION SELECT b, nb, a, na FROM pair),
best AS (
  SELECT word, count(*) AS n_near, max(m) AS top, arg_min(other, (-m, other)) AS other FROM near GROUP BY word
),
form AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN other END AS form,
         CASE WHEN top >= 10 * w.n THEN top END AS form_n
  FROM w LEFT JOIN best USING (word)
),
way(word, root) AS (
  SELECT word, form FROM form WHERE form IS NOT NULL
  UNION ALL SELECT way.word, form.form FROM way JOIN form ON form.word = way.root WHERE form.form IS NOT NULL
),
ends AS (SELECT way.word, way.root FROM way JOIN form ON form.word = way.root WHERE form.form IS NULL)
SELECT form.word, n, n_near, form, form_n, coalesce(root, form.word) AS root FROM form LEFT JOIN ends USING (word)"""
