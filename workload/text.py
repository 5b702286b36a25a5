"""Full-text search over the documents, with the benchmark texts as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetspark.functions.text import FOLDED, Analyzer
from facetspark.operators import matching, ranking
from facetspark.operators.bounded_topk import stored_page, stored_topk
from facetspark.operators.postings import TextSource, field_stats, positions, term_frequencies, token_arrays, vocabulary
from facetspark.operators.predicates import Match, Phrase, Scope, Wildcard, all_of, any_of, none_of
from facetspark.scale import scratch_path
from facetspark.sources.token_index import TokenIndex, open_token_index, write_token_index
from workload.common import (
    BM25_SQL, CORPUS_SQL, ITEMS_SQL, SENTENCES_SQL, STATS_SQL, Query, corpus, items, sentences, table, tokens_sql,
)


# A few common words per language.
STOP_WORDS = {
    "de": ["das", "der", "die", "ein", "ist", "und"],
    "en": ["and", "are", "in", "is", "of", "the", "to"],
    "es": ["de", "el", "es", "la", "que", "se"],
    "fr": ["des", "et", "la", "le", "les", "un"],
}


def clauses(queries):
    """One clause per word."""
    return queries.select("query_id", F.posexplode("words").alias("clause", "term"))


def one_clause(queries):
    return queries.select("query_id", F.lit(0).alias("clause"), F.explode(F.array_distinct("words")).alias("term"))


def postings_stats(spark, d):
    return vocabulary(term_frequencies(corpus(spark, d))).drop("field")


def stats_per_lang(spark, d):
    return field_stats(corpus(spark, d)).select("lang", "n_docs", "n_tokens", F.round("avg_length", 6).alias("avg_length"))


def term_positions(spark, d):
    return positions(corpus(spark, d)).groupBy("lang", "term").agg(
        F.min("pos").alias("first_at"), F.max("pos").alias("last_at"), F.count(F.lit(1)).alias("n")
    )


def match_any(spark, d):
    """Documents in English or German with any word of a benchmark sentence."""
    queries = one_clause(sentences(spark, d)).withColumn("langs", F.array(F.lit("en"), F.lit("de")))
    return matching.word_matches(corpus(spark, d), queries).select("query_id", "doc_id").distinct()


def match_all_words(spark, d):
    return matching.match_all_words(corpus(spark, d), sentences(spark, d))


def match_all_clauses(spark, d):
    """Like the former, but a clause is any two neighbouring words."""
    queries = items(spark, d).select("query_id", F.posexplode("words").alias("i", "term")).select(
        "query_id", F.expr("cast(i div 2 as int)").alias("clause"), "term"
    )
    return matching.match_all_clauses(corpus(spark, d), queries)


def phrase_match(spark, d):
    phrases = sentences(spark, d).select("query_id", F.lit(0).alias("clause"), "words", F.lit(0).alias("slop"))
    return matching.phrase_matches(corpus(spark, d), phrases).select("query_id", "doc_id").distinct()


def word_pairs(spark, d):
    """Neighbouring, different words of the benchmark texts."""
    words = items(spark, d).select(F.posexplode("words").alias("i", "w1"), F.col("words"))
    return words.select("w1", F.get("words", F.col("i") + 1).alias("w2")).where("w1 <> w2").distinct()


def phrase_slop(spark, d):
    pairs = word_pairs(spark, d).select(
        F.concat_ws(" ", "w1", "w2").alias("query_id"), F.lit(0).alias("clause"), F.array("w1", "w2").alias("words"),
        F.lit(2).alias("slop"),
    )
    tokens = corpus(spark, d)
    freq = vocabulary(term_frequencies(tokens, word_pairs(spark, d).select(F.explode(F.array("w1", "w2")).alias("term")).distinct()))
    return matching.phrase_matches(tokens, pairs, freq).select("query_id", "doc_id").distinct()


def bm25_topk(spark, d):
    """Best documents for the whole benchmark texts, any word counting."""
    return ranking.bm25_best(corpus(spark, d), one_clause(items(spark, d)), 10, digits=6)


def bm25_required(spark, d):
    """All words of a sentence required, the first one boosted."""
    queries = clauses(sentences(spark, d)).select(
        "*", F.lit(True).alias("required"), F.when(F.col("clause") == 0, 3.0).otherwise(1.0).alias("boost")
    )
    return ranking.bm25_best(corpus(spark, d), queries, 10, digits=6)


def all_words_topk(spark, d):
    """All words of a sentence required, scored only where they match."""
    return ranking.topk(ranking.all_words_scores(corpus(spark, d), sentences(spark, d)), 10, digits=6)


def phrase_boost_topk(spark, d):
    scores = ranking.phrase_boosted_scores(corpus(spark, d), clauses(sentences(spark, d)), 2.0, one_text_per_doc=True)
    return ranking.topk(scores, 10, digits=6)


def fuzzy_terms(spark, d):
    vocab = vocabulary(term_frequencies(corpus(spark, d)))
    words = items(spark, d).select(F.explode("words").alias("word")).distinct().select(
        F.col("word").alias("query_id"), F.lit(0).alias("clause"), "word"
    )
    return matching.expand_fuzzy(vocab, words, 1).select("word", "term", "edits")


def patterns(spark, d):
    """Patterns out of the longer benchmark words: a start and end, and a gap of one character."""
    words = items(spark, d).select(F.explode("words").alias("w")).distinct().where(F.length("w") >= 6)
    return words.select("w", F.explode(F.array(
        F.concat(F.left("w", F.lit(4)), F.lit("*"), F.right("w", F.lit(1))),
        F.concat(F.left("w", F.lit(2)), F.lit("?"), F.substring("w", 4, 100)),
        F.concat(F.lit("*"), F.right("w", F.lit(5))),
    )).alias("pattern")).select("pattern").distinct().select(F.col("pattern").alias("query_id"), F.lit(0).alias("clause"), "pattern")


def wildcard_terms(spark, d):
    vocab = vocabulary(term_frequencies(corpus(spark, d)))
    return matching.expand_wildcards(vocab, patterns(spark, d)).select("pattern", "term")


def wildcard_documents(spark, d):
    """Documents that contain some expansion of a pattern."""
    return matching.count_wildcard_documents(corpus(spark, d), patterns(spark, d))


def text_filter(spark, d):
    """One request over the texts as a filter."""
    df = table(spark, d, "documents")
    scope = Scope(schema=df.schema, default_analyzer=FOLDED)
    query = all_of(
        any_of(Match("text", "que"), Match("text", "the"), Phrase("text", "de la")), Wildcard("*ing", "text") | Wildcard("es*", "text"),
        none_of(Phrase("text", "of the"), Match("text", "...")),
    )
    neutral = all_of(query.parts[0], query.parts[1], none_of(Phrase("text", "of the")), Match("text", "..."))
    return df.where(neutral.compile(scope)).select("doc_id", "lang")


def stopword_free_terms(spark, d):
    analyzer = Analyzer(fold=False, stop_words=STOP_WORDS)
    tokens = token_arrays(table(spark, d, "documents"), "doc_id", [TextSource("text", lang="lang")], analyzer)
    return tokens.select("doc_id", "lang", F.size("tokens").alias("n_terms"))


def stop_words_sql() -> str:
    rows = ", ".join(f"('{lang}', [{', '.join(repr(w) for w in words)}])" for lang, words in STOP_WORDS.items())
    return f"""
WITH stop AS (SELECT * FROM (VALUES {rows}) s(lang, words))
SELECT doc_id, documents.lang,
       CAST(len(list_filter({tokens_sql('text', fold=False)}, lambda t: NOT list_contains(words, t))) AS INTEGER) AS n_terms
FROM documents JOIN stop USING (lang)"""


TOP_SQL = """
SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM scores)) WHERE rank <= 10"""

WORD_SCORES_SQL = f"""
clauses AS (SELECT query_id, unnest(words) AS term, unnest(range(len(words))) AS clause, len(words) AS n FROM sentences),
ws AS MATERIALIZED (SELECT query_id, clause, n, doc_id, max({BM25_SQL}) AS s
  FROM clauses JOIN w USING (term) GROUP BY ALL)"""

QUERIES = {
    "postings_stats": Query(postings_stats, f"""
WITH {CORPUS_SQL} SELECT lang, term, count(*) AS doc_freq, CAST(sum(tf) AS BIGINT) AS total_tf FROM tf GROUP BY ALL"""),
    "field_stats": Query(stats_per_lang, f"""
WITH {CORPUS_SQL} SELECT lang, count(*) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens,
  round(avg(len(tokens)), 6) AS avg_length FROM corpus GROUP BY ALL"""),
    "term_positions": Query(term_positions, f"""
WITH {CORPUS_SQL} SELECT lang, term, CAST(min(p) AS INTEGER) AS first_at, CAST(max(p) AS INTEGER) AS last_at, count(*) AS n
FROM pos GROUP BY ALL"""),
    "match_any": Query(match_any, f"""
WITH {CORPUS_SQL}, {SENTENCES_SQL},
q AS (SELECT DISTINCT query_id, unnest(words) AS term FROM sentences)
SELECT DISTINCT query_id, doc_id FROM q JOIN tf USING (term) WHERE lang IN ('en', 'de')"""),
    "match_all_words": Query(match_all_words, f"""
WITH {CORPUS_SQL}, {SENTENCES_SQL},
q AS (SELECT query_id, unnest(words) AS term, unnest(range(len(words))) AS clause, len(words) AS n FROM sentences)
SELECT query_id, doc_id FROM q JOIN tf USING (term) GROUP BY query_id, doc_id, n HAVING count(DISTINCT clause) = n"""),
    "match_all_clauses": Query(match_all_clauses, f"""
WITH {CORPUS_SQL}, {ITEMS_SQL},
q AS (SELECT query_id, unnest(words) AS term, unnest(range(len(words))) // 2 AS clause, (len(words) + 1) // 2 AS n FROM items)
SELECT query_id, doc_id FROM q JOIN tf USING (term) GROUP BY query_id, doc_id, n HAVING count(DISTINCT clause) = n"""),
    "all_words_topk": Query(all_words_topk, f"""
WITH {CORPUS_SQL}, {STATS_SQL}, {SENTENCES_SQL}, {WORD_SCORES_SQL},
scores AS (SELECT query_id, doc_id, sum(s) AS score FROM ws GROUP BY query_id, doc_id, n HAVING count(*) = n)
{TOP_SQL}"""),
    "phrase_match": Query(phrase_match, f"""
WITH {CORPUS_SQL}, {SENTENCES_SQL},
flat AS MATERIALIZED (SELECT doc_id, ' ' || array_to_string(tokens, ' ') || ' ' AS body FROM corpus)
SELECT query_id, doc_id FROM sentences JOIN flat ON contains(body, ' ' || array_to_string(words, ' ') || ' ')"""),
    "phrase_slop": Query(phrase_slop, f"""
WITH {CORPUS_SQL}, {ITEMS_SQL},
pairs AS (SELECT DISTINCT words[i] AS w1, words[i + 1] AS w2
          FROM (SELECT words, unnest(range(1, len(words))) AS i FROM items) WHERE words[i] <> words[i + 1])
SELECT DISTINCT w1 || ' ' || w2 AS query_id, a.doc_id
FROM pairs JOIN pos a ON a.term = w1 JOIN pos b ON b.term = w2 AND b.doc_id = a.doc_id AND abs(b.p - 1 - a.p) <= 2"""),
    "bm25_topk": Query(bm25_topk, f"""
WITH {CORPUS_SQL}, {STATS_SQL}, {ITEMS_SQL},
q AS (SELECT DISTINCT query_id, unnest(words) AS term FROM items),
scores AS (SELECT query_id, doc_id, sum({BM25_SQL}) AS score FROM q JOIN w USING (term) GROUP BY ALL)
{TOP_SQL}"""),
    "bm25_required": Query(bm25_required, f"""
WITH {CORPUS_SQL}, {STATS_SQL}, {SENTENCES_SQL}, {WORD_SCORES_SQL},
scores AS (SELECT query_id, doc_id, sum(CASE WHEN clause = 0 THEN 3 * s ELSE s END) AS score
           FROM ws GROUP BY query_id, doc_id, n HAVING count(*) = n)
{TOP_SQL}"""),
    "phrase_boost_topk": Query(phrase_boost_topk, f"""
WITH {CORPUS_SQL}, {STATS_SQL}, {SENTENCES_SQL}, {WORD_SCORES_SQL},
word_hits AS (SELECT query_id, doc_id, sum(s) AS score FROM ws GROUP BY query_id, doc_id, n HAVING count(*) = n),
flat AS MATERIALIZED (SELECT doc_id, lang, len(tokens) AS length, ' ' || array_to_string(tokens, '  ') || ' ' AS body FROM corpus),
ph AS (SELECT query_id, doc_id, lang, length, CAST(
         (length(body) - length(replace(body, phrase, ''))) / length(phrase) AS BIGINT) AS tf
       FROM (SELECT query_id, ' ' || array_to_string(words, '  ') || ' ' AS phrase FROM sentences) JOIN flat ON contains(body, phrase)),
pidf AS (SELECT query_id, lang, avg_length, sum(ln(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5))) AS idf
         FROM clauses JOIN df USING (term) JOIN stats USING (lang) GROUP BY ALL),
phrase_hits AS (SELECT query_id, doc_id, 2.0 * {BM25_SQL} AS score FROM ph JOIN pidf USING (query_id, lang)),
scores AS (SELECT query_id, doc_id, sum(score) AS score
           FROM (SELECT * FROM word_hits UNION ALL SELECT * FROM phrase_hits) GROUP BY ALL)
{TOP_SQL}"""),
    "fuzzy_terms": Query(fuzzy_terms, f"""
WITH {CORPUS_SQL}, {ITEMS_SQL},
words AS (SELECT DISTINCT unnest(words) AS word FROM items), vocab AS (SELECT DISTINCT term FROM tf)
SELECT word, term, CAST(levenshtein(term, word) AS INTEGER) AS edits FROM vocab JOIN words
ON abs(length(term) - length(word)) <= 1 WHERE levenshtein(term, word) <= 1"""),
    "wildcard_terms": Query(wildcard_terms, None),
    "wildcard_documents": Query(wildcard_documents, None),
    "text_filter": Query(text_filter, f"""
WITH {CORPUS_SQL}, flat AS (SELECT doc_id, lang, tokens, ' ' || array_to_string(tokens, ' ') || ' ' AS body FROM corpus)
SELECT doc_id, lang FROM flat
WHERE (list_contains(tokens, 'que') OR list_contains(tokens, 'the') OR contains(body, ' de la '))
  AND len(list_filter(tokens, lambda t: ends_with(t, 'ing') OR starts_with(t, 'es'))) > 0
  AND NOT contains(body, ' of the ')"""),
    "stopword_free_terms": Query(stopword_free_terms, stop_words_sql()),
}

PATTERNS_SQL = f"""
words AS (SELECT DISTINCT w FROM (SELECT unnest(words) AS w FROM items) WHERE length(w) >= 6),
vocab AS (SELECT DISTINCT term FROM tf),
found AS MATERIALIZED (
  SELECT left(w, 4) || '*' || right(w, 1) AS pattern, term FROM words JOIN vocab ON left(term, 4) = left(w, 4)
  WHERE right(term, 1) = right(w, 1) AND length(term) >= 5
  UNION SELECT left(w, 2) || '?' || substr(w, 4), term FROM words
  JOIN vocab ON left(term, 2) = left(w, 2) AND substr(term, 4) = substr(w, 4) AND length(term) = length(w)
  UNION SELECT '*' || right(w, 5), term FROM words JOIN vocab ON right(term, 5) = right(w, 5)
)"""
def fuzzy_two_edits(spark, d):
    vocab = vocabulary(term_frequencies(corpus(spark, d)))
    words = items(spark, d).select(F.explode("words").alias("word")).distinct().select("word", F.lit(0).alias("query_id"), F.lit(0).alias("clause"))
    return matching.expand_fuzzy(vocab, words, 2).select("word", "term", "edits")


QUERIES["fuzzy_two_edits"] = Query(fuzzy_two_edits, QUERIES["fuzzy_terms"].sql.replace("<= 1", "<= 2"))
QUERIES["wildcard_terms"] = Query(wildcard_terms, f"WITH {CORPUS_SQL}, {ITEMS_SQL}, {PATTERNS_SQL} SELECT pattern, term FROM found")
QUERIES["wildcard_documents"] = Query(wildcard_documents, f"""
WITH {CORPUS_SQL}, {ITEMS_SQL}, {PATTERNS_SQL}
SELECT pattern AS query_id, count(DISTINCT doc_id) AS n_docs FROM found JOIN tf USING (term) GROUP BY ALL""")


def inner_patterns(spark, d):
    """Patterns out of all benchmark words, short ones too: inner parts of three and of one character, and starts of one."""
    words = items(spark, d).select(F.explode("words").alias("w")).distinct()
    return words.select(F.explode(F.array_compact(F.array(
        F.when(F.length("w") >= 4, F.concat(F.lit("*"), F.substring("w", 2, 3), F.lit("*"))),
        F.when(F.length("w") >= 2, F.concat(F.lit("*"), F.substring("w", 2, 1), F.lit("*"))),
        F.when(F.length("w") <= 5, F.concat(F.left("w", F.lit(1)), F.lit("*"))),
    ))).alias("pattern")).distinct().select(F.col("pattern").alias("query_id"), F.lit(0).alias("clause"), "pattern")


def wildcard_inner(spark, d):
    """Documents that contain some word with a part asked for."""
    return matching.count_wildcard_documents(corpus(spark, d), inner_patterns(spark, d))


def word_triples(spark, d):
    """Three neighbouring words of the benchmark texts, and each two of them with the first one repeated."""
    words = items(spark, d).select(F.posexplode("words").alias("i", "w1"), "words").select(
        "w1", F.get("words", F.col("i") + 1).alias("w2"), F.get("words", F.col("i") + 2).alias("w3")
    ).where("w3 IS NOT NULL")
    return words.select(F.explode(F.array(F.array("w1", "w2", "w3"), F.array("w1", "w2", "w1"))).alias("words")).distinct()


def phrase_slop_long(spark, d):
    """Documents with three words within a slop of one; equal words are different places."""
    triples = word_triples(spark, d)
    phrases = triples.select(F.array_join("words", " ").alias("query_id"), F.lit(0).alias("clause"), "words", F.lit(1).alias("slop"))
    tokens = corpus(spark, d)
    freq = vocabulary(term_frequencies(tokens, triples.select(F.explode("words").alias("term")).distinct()))
    return matching.phrase_matches(tokens, phrases, freq).select("query_id", "doc_id").distinct()


QUERIES["wildcard_inner"] = Query(wildcard_inner, f"""
WITH {CORPUS_SQL}, {ITEMS_SQL},
words AS (SELECT DISTINCT w FROM (SELECT unnest(words) AS w FROM items)),
vocab AS (SELECT DISTINCT term FROM tf),
parts AS (
  SELECT substr(w, 2, 3) AS part, '*' AS front FROM words WHERE length(w) >= 4
  UNION SELECT substr(w, 2, 1), '*' FROM words WHERE length(w) >= 2
  UNION SELECT left(w, 1), '' FROM words WHERE length(w) <= 5),
found AS MATERIALIZED (
  SELECT front || part || '*' AS pattern, term FROM parts JOIN vocab ON CASE WHEN front = '*' THEN contains(term, part) ELSE starts_with(term, part) END)
SELECT pattern AS query_id, count(DISTINCT doc_id) AS n_docs FROM found JOIN tf USING (term) GROUP BY ALL""")
QUERIES["phrase_slop_long"] = Query(phrase_slop_long, f"""
WITH {CORPUS_SQL}, {ITEMS_SQL},
near AS (SELECT words[i] AS w1, words[i + 1] AS w2, words[i + 2] AS w3 FROM (SELECT words, unnest(range(1, len(words) - 1)) AS i FROM items)),
triples AS (SELECT w1, w2, w3 FROM near UNION SELECT w1, w2, w1 FROM near),
two AS MATERIALIZED (
  SELECT w.w1, w.w2, a.doc_id, a.p AS p1, b.p AS p2 FROM (SELECT DISTINCT w1, w2 FROM triples) w
  JOIN pos a ON a.term = w.w1 JOIN pos b ON b.term = w.w2 AND b.doc_id = a.doc_id AND abs(b.p - 1 - a.p) <= 1 AND a.p <> b.p)
SELECT DISTINCT w1 || ' ' || w2 || ' ' || w3 AS query_id, two.doc_id
FROM two JOIN triples USING (w1, w2) JOIN pos c ON c.term = w3 AND c.doc_id = two.doc_id AND c.p <> p1 AND c.p <> p2
  AND greatest(p1, p2 - 1, c.p - 2) - least(p1, p2 - 1, c.p - 2) <= 1""")


# --- ranked search over a stored index --------------------------------------------

def stored_index(spark, tokens) -> TokenIndex:
    """The index of ``tokens``, written and opened again."""
    path = scratch_path(spark, "token-index")
    write_token_index(tokens, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return open_token_index(spark, path)


def bm25_topk_stored(spark, d):
    """As ``bm25_topk``, over stored postings and by score bounds."""
    return stored_topk(stored_index(spark, corpus(spark, d)), one_clause(items(spark, d)), 10, digits=6)


def title_and_text(spark, d):
    """Tokens of two fields: the first line of a document and its text."""
    docs = table(spark, d, "documents").withColumn("title", F.split_part("text", F.lit("\n"), F.lit(1)))
    return token_arrays(docs, "doc_id", [TextSource("title", lang="lang"), TextSource("text", lang="lang")], FOLDED)


def word_clauses(spark, d):
    """The distinct words of each benchmark text, each a clause of its own; every third one counts twice."""
    words = items(spark, d).select("query_id", F.posexplode(F.array_distinct("words")).alias("clause", "term"))
    return words.withColumn("boost", F.when(F.col("clause") % 3 == 0, 2.0).otherwise(1.0))


def bm25_two_fields(spark, d):
    """The better of two fields for each word."""
    return ranking.bm25_best(title_and_text(spark, d), word_clauses(spark, d), 10, digits=6)


def bm25_two_fields_stored(spark, d):
    return stored_topk(stored_index(spark, title_and_text(spark, d)), word_clauses(spark, d), 10, digits=6)


def search_stored(spark, d):
    """The documents behind the best hits for sentences whose words are all required; scores come from the index alone."""
    queries = clauses(sentences(spark, d)).select(
        "*", F.lit(True).alias("required"), F.when(F.col("clause") == 0, 3.0).otherwise(1.0).alias("boost")
    )
    docs = table(spark, d, "documents")
    page = stored_page(stored_index(spark, corpus(spark, d)), docs, "doc_id", queries, 10, digits=6)
    return page.select("query_id", "rank", "score", "doc_id", "source", F.length("text").alias("text_length"))


TWO_FIELDS_SQL = f"""
WITH {ITEMS_SQL},
corpus AS MATERIALIZED (
  SELECT doc_id, lang, 'text' AS field, {tokens_sql('text')} AS tokens FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, lang, 'title', {tokens_sql("split_part(text, chr(10), 1)")} FROM documents WHERE text IS NOT NULL
),
tf AS MATERIALIZED (
  SELECT doc_id, lang, field, length, term, count(*) AS tf
  FROM (SELECT doc_id, lang, field, len(tokens) AS length, unnest(tokens) AS term FROM corpus) GROUP BY ALL
),
df AS (SELECT lang, field, term, count(*) AS doc_freq FROM tf GROUP BY ALL),
stats AS (SELECT lang, field, count(*) AS n_docs, avg(len(tokens)) AS avg_length FROM corpus GROUP BY ALL),
w AS (
  SELECT doc_id, tf.lang, tf.field, tf.term, length, tf, avg_length, ln(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5)) AS idf
  FROM tf JOIN df USING (lang, field, term) JOIN stats USING (lang, field)
),
q AS (
  SELECT query_id, term, CASE WHEN clause % 3 = 0 THEN 2.0 ELSE 1.0 END AS boost FROM (
    SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(i)) - 1 AS clause FROM (
      SELECT query_id, unnest(words) AS term, unnest(range(len(words))) AS i FROM items) GROUP BY query_id, term)
),
best AS (SELECT query_id, term, doc_id, max(boost * {BM25_SQL}) AS s FROM q JOIN w USING (term) GROUP BY ALL),
scores AS (SELECT query_id, doc_id, sum(s) AS score FROM best GROUP BY ALL)
{TOP_SQL}"""

QUERIES["bm25_topk_stored"] = Query(bm25_topk_stored, QUERIES["bm25_topk"].sql)
QUERIES["bm25_two_fields"] = Query(bm25_two_fields, TWO_FIELDS_SQL)
QUERIES["bm25_two_fields_stored"] = Query(bm25_two_fields_stored, TWO_FIELDS_SQL)
QUERIES["search_stored"] = Query(search_stored, f"""
WITH hits AS ({QUERIES["bm25_required"].sql})
SELECT query_id, rank, score, doc_id, source, CAST(length(text) AS INTEGER) AS text_length FROM hits JOIN documents USING (doc_id)""")
