"""Relevance: BM25 over clause tables, phrase boosts, top-k per query.

Okapi BM25 after Robertson & Zaragoza (2009), statistics per field and language.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.operators.in_task import asked_postings, collect_weights, scored_documents
from facetspark.operators.matching import all_words_hits, phrase_matches
from facetspark.operators.postings import in_scope, request_statistics, term_frequencies
from facetspark.scale import broadcast_if_bounded, cut_lineage, literal_codes, measure_request, topk_per_group

K1, B = 1.2, 0.75


def idf(n_docs: Column, doc_freq: Column) -> Column:
    return F.log(1 + (n_docs - doc_freq + 0.5) / (doc_freq + 0.5))


def saturated_tf(tf: Column, length: Column, avg_length: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avg_length))


def with_defaults(queries: DataFrame) -> DataFrame:
    """Clause table with ``clause``, ``boost`` and ``required`` filled in."""
    for name, value in (("clause", F.lit(0)), ("boost", F.lit(1.0)), ("required", F.lit(False))):
        if name not in queries.columns:
            queries = queries.withColumn(name, value)
    return queries


def clause_scores(
    tokens: DataFrame,
    queries: DataFrame,
    stats: DataFrame | None = None,
    vocab: DataFrame | None = None,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """``(query_id, clause, doc_id, score, required)``: boosted score of the best field per clause.

    Words of one clause in one field add up; between fields and languages the best one counts. All
    terms of a document field meet in the task that read the document, so the partial aggregation
    there already sums them and the shuffle carries one row per clause, document and field.
    """
    queries = with_defaults(queries)
    request = measure_request(queries, "term")
    frequencies = term_frequencies(tokens, queries, request)
    if stats is None or vocab is None:
        stats, vocab = request_statistics(tokens, queries, request)
    weights = (
        vocab.select("field", "lang", "term", "doc_freq")
        .join(stats.select("field", "lang", "n_docs", "avg_length"), ["field", "lang"])
        .select("field", "lang", "term", idf(F.col("n_docs"), F.col("doc_freq")).alias("idf"), "avg_length")
    )
    lookup = in_scope(weights.join(queries, "term"))
    scored = frequencies.join(request.hint(lookup), ["field", "lang", "term"]).withColumn(
        "term_score", F.col("idf") * saturated_tf(F.col("tf"), F.col("length"), F.col("avg_length"), k1, b)
    )
    return _best_field(scored, "term_score")


def _best_field(rows: DataFrame, score: str) -> DataFrame:
    per_field = rows.groupBy("query_id", "clause", "doc_id", "field", "lang").agg(
        F.sum(F.col(score) * F.col("boost")).alias("score"), F.max("required").alias("required")
    )
    # From here on everything is per query and document; one shuffle by both serves all of it.
    return per_field.repartition("query_id", "doc_id").groupBy("query_id", "clause", "doc_id").agg(
        F.max("score").alias("score"), F.max("required").alias("required")
    )


def phrase_scores(
    tokens: DataFrame,
    phrases: DataFrame,
    stats: DataFrame | None = None,
    vocab: DataFrame | None = None,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """:func:`clause_scores` for phrases: the summed idf of the words times the saturated count."""
    phrases = with_defaults(phrases)
    words = phrases.select("query_id", "clause", F.explode("words").alias("term"))
    request = measure_request(words, "term")
    if stats is None or vocab is None:
        stats, vocab = request_statistics(tokens, words, request)
    hits = phrase_matches(tokens, phrases.drop("boost", "required"), vocab.select("term", "doc_freq"))
    weights = (
        words.join(vocab.select("field", "lang", "term", "doc_freq"), "term")
        .join(stats, ["field", "lang"])
        .groupBy("query_id", "clause", "field", "lang")
        .agg(F.sum(idf(F.col("n_docs"), F.col("doc_freq"))).alias("idf"), F.first("avg_length").alias("avg_length"))
        .join(phrases.select("query_id", "clause", "boost", "required"), ["query_id", "clause"])
    )
    scored = hits.join(request.hint(weights), ["query_id", "clause", "field", "lang"]).withColumn(
        "term_score", F.col("idf") * saturated_tf(F.col("freq"), F.col("length"), F.col("avg_length"), k1, b)
    )
    return _best_field(scored, "term_score")


def combine_clauses(scores: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id, score)``: sum over matched clauses of documents with all required ones."""
    required = with_defaults(queries).where("required").groupBy("query_id").agg(
        F.countDistinct("clause").alias("n_required")
    )
    per_doc = scores.groupBy("query_id", "doc_id").agg(
        F.sum("score").alias("score"), F.count_if("required").alias("n_matched")
    )
    return (
        per_doc.join(broadcast_if_bounded(required), "query_id", "left")
        .where(F.col("n_matched") == F.coalesce("n_required", F.lit(0)))
        .select("query_id", "doc_id", "score")
    )


def bm25_scores(tokens: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """Scores of all matching documents for ``queries(query_id, term[, clause, boost, required, …])``."""
    return combine_clauses(clause_scores(tokens, queries, **options), queries)


def bm25_best(
    tokens: DataFrame, queries: DataFrame, k: int, digits: int | None = None, k1: float = K1, b: float = B
) -> DataFrame:
    """The rows of ``topk(bm25_scores(tokens, queries), k, digits)``.

    For a request of bounded size documents are scored in the task that holds them, and only rows that may be among
    the best ``k`` leave it. Texts are read once: the words asked for are written, counted and scored from there.
    """
    queries = with_defaults(queries)
    request = measure_request(queries, "term")
    if request.values is None or not request.bounded:
        return topk(bm25_scores(tokens, queries, k1=k1, b=b), k, digits)
    postings = asked_postings(tokens, request.values)
    stats = cut_lineage(postings.groupBy("field", "lang").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length")))
    counts = postings.select("field", "lang", F.explode("codes").alias("code")).groupBy("field", "lang", "code").agg(
        F.count(F.lit(1)).alias("doc_freq")
    )
    coded = queries.join(F.broadcast(literal_codes(tokens.sparkSession, request.values)), "term")
    lookup = in_scope(counts.join(F.broadcast(stats), ["field", "lang"]).join(F.broadcast(coded), "code")).select(
        "query_id", "clause", "field", "lang", "code", (idf(F.col("n_docs"), F.col("doc_freq")) * F.col("boost")).alias("weight"),
        F.col("required").alias("needed"), "avg_length",
    )
    clauses = queries.groupBy("query_id", "clause").agg(F.max("required").alias("required"))
    n_terms = max(len(request.values), 1)
    together = postings.where(F.size("codes") > 0).repartition("doc_id").sortWithinPartitions("doc_id", "field", "lang")
    slack = 1e-9 if digits is None else 10.0 ** -digits
    return topk(scored_documents(together, collect_weights(lookup, clauses, n_terms), n_terms, k1, b, k, slack), k, digits)


def all_words_scores(
    tokens: DataFrame, queries: DataFrame, stats: DataFrame | None = None, vocab: DataFrame | None = None,
    k1: float = K1, b: float = B,
) -> DataFrame:
    """``(query_id, doc_id, score)`` of documents with every word of ``queries(query_id, words)``.

    For corpora with one text per document: only documents that match are scored, in the task that
    found them. ``boosts`` may be given as ``queries.boosts``, a map from word to factor; a word
    that a query repeats counts once for each time.
    """
    words = queries.select("query_id", F.explode("words").alias("term"))
    request = measure_request(words, "term")
    if stats is None or vocab is None:
        stats, vocab = request_statistics(tokens, words, request)
    boost = F.coalesce(F.col("boosts")[F.col("term")], F.lit(1.0)) if "boosts" in queries.columns else F.lit(1.0)
    repeated = (queries if "boosts" in queries.columns else queries.select("query_id", "words")).withColumn(
        "term", F.explode("words")
    ).groupBy("query_id", "term").agg(F.sum(boost).alias("boost"))
    weights = (
        vocab.select("field", "lang", "term", "doc_freq").join(stats, ["field", "lang"])
        .select("field", "lang", "term", idf(F.col("n_docs"), F.col("doc_freq")).alias("idf"), "avg_length")
        .join(repeated, "term")
    )
    rows = all_words_hits(tokens, queries, vocab.select("term", "doc_freq")).select(
        "query_id", "doc_id", "field", "lang", "length", F.inline("hits")
    )
    score = F.col("boost") * F.col("idf") * saturated_tf(F.col("tf"), F.col("length"), F.col("avg_length"), k1, b)
    return rows.join(request.hint(weights), ["query_id", "field", "lang", "term"]).groupBy("query_id", "doc_id").agg(
        F.sum(score).alias("score")
    )


def topk(scores: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """Best ``k`` documents per query with their rank; ties go to the smaller id."""
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return topk_per_group(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def phrase_boost(words: DataFrame, boost: float, slop: int = 0) -> DataFrame:
    """Phrase clauses for the runs of free words of each query.

    ``words(query_id, clause, term)`` holds the free words at their clause numbers; a gap between the
    numbers is another clause and ends a run. Runs are numbered below zero, so that their clauses
    never meet those of the words. The groups are single queries.
    """
    per_query = words.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("clause", "term"))).alias("items")
    )
    runs = (
        per_query.select("query_id", F.posexplode("items").alias("at", "item"))
        .select("query_id", "item.*", (F.col("item.clause") - F.col("at")).alias("run"))
        .groupBy("query_id", "run")
        .agg(F.array_sort(F.collect_list(F.struct("clause", "term"))).alias("items"))
        .where(F.size("items") >= 2)
    )
    return runs.select(
        "query_id",
        (-1 - F.col("items")[0]["clause"]).alias("clause"),
        F.transform("items", lambda i: i["term"]).alias("words"),
        F.transform("items", lambda i: i["clause"]).alias("replaces"),
        F.lit(slop).alias("slop"),
        F.lit(float(boost)).alias("boost"),
    )


def phrase_boosted_scores(
    tokens: DataFrame, words: DataFrame, boost: float, slop: int = 0, one_text_per_doc: bool = False, **options
) -> DataFrame:
    """Scores for AND queries whose runs of words are boosted where they form a phrase.

    On text fields a document with the phrase has all its words, so the words alone decide what
    matches, and a phrase only adds to the score. ``words(query_id, clause, term)``. With
    ``one_text_per_doc`` only matching documents are scored, see :func:`all_words_scores`.
    """
    if not options.get("stats") or not options.get("vocab"):
        stats, vocab = request_statistics(tokens, words, measure_request(words, "term"))
        options = {**options, "stats": stats, "vocab": vocab}
    if one_text_per_doc:
        ordered = words.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("clause", "term"))).alias("w"))
        queries = ordered.select("query_id", F.transform("w", lambda w: w["term"]).alias("words"))
        base = all_words_scores(tokens, queries, **options)
    else:
        required = with_defaults(words).withColumn("required", F.lit(True))
        base = combine_clauses(clause_scores(tokens, required, **options), required)
    phrases = phrase_boost(words, boost, slop).drop("replaces")
    extra = phrase_scores(tokens, phrases, **options).select("query_id", "doc_id", "score")
    both = base.withColumn("matched", F.lit(True)).unionByName(extra.withColumn("matched", F.lit(False)))
    return (
        both.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"), F.max("matched").alias("matched"))
        .where("matched").select("query_id", "doc_id", "score")
    )
