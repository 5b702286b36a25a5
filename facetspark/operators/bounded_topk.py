"""Top-k over a stored token index by score bounds, without a shuffle of query and document pairs.

Pass 1 scores one word of each query, that with the highest bound among those in at least k documents, and takes its
k-th best score: no document below that threshold can be among the best k. In pass 2 the words of a query are ordered
by their bounds; the weakest ones, whose bounds together stay below the threshold, cannot lift a document over it by
themselves. Only documents with one of the other, essential words are scored, on all their words.

Postings of a document lie in one bucket, so every sum is made in the task that read it, batch by batch; pairs of
queries and documents are never rows. What is shuffled are the rows of a query and task that may be among the k best.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.operators.in_task import collect_weights, scored_documents
from facetspark.operators.postings import in_scope
from facetspark.operators.ranking import idf, saturated_tf, with_defaults
from facetspark.scale import Request, broadcast_if_bounded, cut_lineage, literal_codes, measure_request, topk_per_group
from facetspark.sources.token_index import TokenIndex

KEYS = ["field", "lang", "term"]


def weighted_terms(index: TokenIndex, queries: DataFrame, asked: Column) -> DataFrame:
    """Clause rows with ``weight`` (idf times boost) and ``bound``, the most a posting can score, per field and language."""
    stats = F.broadcast(index.stats.select("field", "lang", "n_docs", "avg_length"))  # fields times languages
    known = index.terms.where(asked).join(stats, ["field", "lang"])
    rows = in_scope(known.join(queries, "term"))
    weight = idf(F.col("n_docs"), F.col("doc_freq")) * F.col("boost")
    return rows.select("query_id", "clause", "required", *KEYS, "doc_freq", "avg_length", weight.alias("weight"),
                       (weight * F.col("peak")).alias("bound"))


def postings_of(index: TokenIndex, asked: Column) -> DataFrame:
    return index.postings.where(asked)


def term_score(index: TokenIndex) -> Column:
    return F.col("weight") * saturated_tf(F.col("tf"), F.col("length"), F.col("avg_length"), index.k1, index.b)


def anchor_terms(weighted: DataFrame, k: int) -> DataFrame:
    """``(query_id, field, lang, term, weight, avg_length)``: the word of the highest bound among those in at least k
    documents, for queries without required clauses that have such a word."""
    free = weighted.groupBy("query_id").agg(F.bool_or("required").alias("any")).where("NOT any").select("query_id")
    best = weighted.where(F.col("doc_freq") >= k).groupBy("query_id").agg(
        F.max_by(F.struct(*KEYS, "weight", "avg_length"), F.struct("bound", *KEYS)).alias("t")
    )
    return best.join(free, "query_id").select("query_id", "t.*")


def thresholds(index: TokenIndex, weighted: DataFrame, asked: Column, k: int) -> DataFrame:
    """``(query_id, threshold)``: the k-th best score of a query's anchor word."""
    anchors = anchor_terms(weighted, k)
    scored = postings_of(index, asked).join(broadcast_if_bounded(anchors), KEYS).select("query_id", "doc_id", term_score(index).alias("score"))
    kth = topk_per_group(scored, ["query_id"], [F.desc("score")], k).where(F.col("rank") == k)
    return kth.select("query_id", F.col("score").alias("threshold"))


def essential_terms(weighted: DataFrame, limits: DataFrame, slack: float) -> DataFrame:
    """``(query_id, term)`` one of which a document must have to be among the best: groups are single queries.

    For a query with required clauses these are the words of the required clause that fewest documents can meet.
    """
    per_term = weighted.groupBy("query_id", "clause", "term").agg(
        F.max("bound").alias("bound"), F.max("required").alias("required"), F.sum("doc_freq").alias("doc_freq")
    ).join(limits, "query_id", "left")
    rising = Window.partitionBy("query_id").orderBy("bound", "term", "clause").rowsBetween(Window.unboundedPreceding, 0)
    clause = Window.partitionBy("query_id", "clause")
    ranked = per_term.withColumn("below", F.sum("bound").over(rising)).withColumn("reach", F.sum("doc_freq").over(clause))
    narrow = F.min(F.when(F.col("required"), F.struct("reach", "clause"))).over(Window.partitionBy("query_id"))
    kept = F.when(F.col("narrow").isNotNull(), F.col("clause") == F.col("narrow.clause")).otherwise(
        F.col("threshold").isNull() | (F.col("below") + slack >= F.col("threshold"))
    )
    return ranked.withColumn("narrow", narrow).where(kept).select("query_id", "term").distinct()


def stored_topk(index: TokenIndex, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """``(query_id, doc_id, score, rank)``: the best ``k`` documents per query, as ``topk(bm25_scores(…))`` finds them.

    ``queries (query_id, term[, clause, boost, required, fields, langs])`` with boosts of zero or more. Words of a
    clause add up within a field and language, the best of these counts, and clauses add up; a document must meet every
    required clause. Ties go to the smaller id; with ``digits`` scores are rounded before they are compared.
    """
    queries = with_defaults(queries)
    request = measure_request(queries, "term")
    asked = F.expr(request.test("term"))
    weighted = cut_lineage(weighted_terms(index, queries, asked))  # of the request's size, used several times
    slack = 1e-9 if digits is None else 10.0 ** -digits
    if request.values is None or not request.bounded:
        scores = joined_scores(index, queries, weighted, request, asked, k, slack)
    else:
        scores = scores_in_task(index, queries, weighted, request, k, slack)
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return topk_per_group(scores, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def held_words(index: TokenIndex, asked: Column) -> DataFrame:
    """``(doc_id, held)``: one row a document with its asked postings; a document is in one bucket."""
    return postings_of(index, asked).groupBy("doc_id").agg(F.collect_list(F.struct(*KEYS, "tf", "length")).alias("held"))


def in_task(index: TokenIndex, held: DataFrame, rows: DataFrame, queries: DataFrame, terms: list[str], k: int, slack: float, least=None) -> DataFrame:
    """Scores of the documents ``held`` by the clause rows ``rows``, added up in the tasks; only the best leave them."""
    coded = rows.join(F.broadcast(literal_codes(rows.sparkSession, terms)), "term").withColumnRenamed("required", "needed")
    clauses = queries.groupBy("query_id", "clause").agg(F.max("required").alias("required"))
    weights, n_terms = collect_weights(coded, clauses, max(len(terms), 1)), max(len(terms), 1)
    floor = None if least is None else np.array([least.get(q, -np.inf) for q in weights.queries.to_pylist()])
    return scored_documents(held, weights, n_terms, index.k1, index.b, k, slack, terms, floor)


def scores_in_task(index: TokenIndex, queries: DataFrame, weighted: DataFrame, request: Request, k: int, slack: float) -> DataFrame:
    """Scores that may be among the best ``k``, for a request of bounded size."""
    anchors = cut_lineage(anchor_terms(weighted, k))
    words = [r.term for r in anchors.select("term").distinct().collect()]
    single = queries.select("query_id").distinct().select("query_id", F.lit(0).alias("clause"), F.lit(False).alias("required"))
    first = in_task(
        index, held_words(index, F.expr(Request(words, True).test("term"))),
        anchors.select("query_id", F.lit(0).alias("clause"), F.lit(False).alias("required"), *KEYS, "weight", "avg_length"), single, words, k, 0.0,
    )
    kth = topk_per_group(first, ["query_id"], [F.desc("score")], k).where(F.col("rank") == k)
    limits = cut_lineage(kth.select("query_id", F.col("score").alias("threshold")))
    essential = essential_terms(weighted, limits, slack)
    asked = F.expr(request.test("term"))
    found = Request([r.term for r in essential.select("term").distinct().collect()], True)
    held = held_words(index, asked).where(F.expr(f"exists(held, p -> {found.test('p.term')})"))
    least = {r.query_id: r.threshold for r in limits.collect()}
    return in_task(index, held, weighted, queries, request.values, k, slack, least)


def joined_scores(
    index: TokenIndex, queries: DataFrame, weighted: DataFrame, request: Request, asked: Column, k: int, slack: float
) -> DataFrame:
    """As :func:`scores_in_task`, by joins, for requests too large to be sent to every task."""
    limits = thresholds(index, weighted, asked, k)
    essential = essential_terms(weighted, limits, slack)

    # one row a document: the asked postings, then the queries that have an essential word in it
    held = held_words(index, asked)
    words = held.withColumn("term", F.explode(F.array_distinct(F.transform("held", lambda p: p["term"]))))
    found = words.join(request.hint(essential), "term").groupBy("doc_id", "query_id").agg(F.any_value("held").alias("held"))
    scored = found.select("doc_id", "query_id", F.inline("held")).join(request.hint(weighted), ["query_id", *KEYS])
    per_field = scored.groupBy("doc_id", "query_id", "clause", "field", "lang").agg(
        F.sum(term_score(index)).alias("score"), F.max("required").alias("required")
    )
    per_clause = per_field.groupBy("doc_id", "query_id", "clause").agg(F.max("score").alias("score"), F.max("required").alias("required"))
    per_doc = per_clause.groupBy("doc_id", "query_id").agg(F.sum("score").alias("score"), F.count_if("required").alias("n_matched"))
    needed = queries.where("required").groupBy("query_id").agg(F.countDistinct("clause").alias("n_required"))
    return (
        per_doc.join(request.hint(needed), "query_id", "left").where(F.col("n_matched") == F.coalesce("n_required", F.lit(0)))
        .join(request.hint(limits), "query_id", "left").where(F.col("threshold").isNull() | (F.col("score") + slack >= F.col("threshold")))
        .select("query_id", "doc_id", "score")
    )


def stored_page(index: TokenIndex, docs: DataFrame, id_col: str, queries: DataFrame, k: int, digits: int | None = None) -> DataFrame:
    """The rows of ``docs`` behind the best ``k`` hits of each query, with ``query_id``, ``score`` and ``rank``.

    Only the hits' ids, at most ``k`` a query, meet the document table; its columns are read for no other purpose.
    """
    hits = broadcast_if_bounded(cut_lineage(stored_topk(index, queries, k, digits)).withColumnRenamed("doc_id", "_hit"))
    return docs.join(hits, docs[id_col] == hits["_hit"]).drop("_hit")
