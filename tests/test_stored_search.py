"""Top-k over stored postings against scoring every pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from facetspark.operators import ranking
from facetspark.operators.bounded_topk import essential_terms, stored_page, stored_topk, thresholds, weighted_terms
from facetspark.operators.postings import TextSource, token_arrays
from facetspark.operators.ranking import with_defaults
from facetspark.sources.token_index import open_token_index, write_token_index

WORDS = [f"w{k}" for k in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(5)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    made = [
        (i, draw.choice(["en", "fr", None]), None if i % 17 == 0 else " ".join(draw.choices(WORDS, weights, k=draw.randint(0, 25))),
         " ".join(draw.choices(WORDS, k=2)))
        for i in range(300)
    ]
    made += [(1000 + k, "en", "w3 w4 w5", "w3") for k in range(12)]  # equal scores
    return spark.createDataFrame(made, "id long, lang string, body string, title string")


def tokens_of(docs):
    return token_arrays(docs, "id", [TextSource("body", lang="lang"), TextSource("title")])


@pytest.fixture(scope="module")
def tokens(docs):
    return tokens_of(docs)


@pytest.fixture(scope="module")
def index(spark, tokens, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "tokens")
    write_token_index(tokens, path, 3)
    return open_token_index(spark, path)


def queries(spark, required=False, clauses=True):
    draw = random.Random(9)
    out = []
    for q in range(12):
        for c, term in enumerate(draw.sample(WORDS, draw.randint(1, 6))):
            out.append((q, c if clauses else c // 2, term, draw.choice([0.0, 1.0, 2.5]), required and c % 2 == 0))
    out.append((99, 0, "nowhere", 1.0, required))
    return spark.createDataFrame(out, "query_id int, clause int, term string, boost double, required boolean")


@pytest.mark.parametrize("k", [1, 4, 500])
@pytest.mark.parametrize("required", [False, True])
@pytest.mark.parametrize("clauses", [False, True])
def test_stored_topk_is_the_topk_of_all_scores(spark, tokens, index, k, required, clauses):
    asked = queries(spark, required, clauses)
    want = ranking.topk(ranking.bm25_scores(tokens, asked), k, digits=6)
    assert rows(stored_topk(index, asked, k, digits=6)) == rows(want)


def test_fields_and_languages_of_a_query_count(spark, tokens, index):
    asked = queries(spark).withColumn("fields", F.array(F.lit("title"))).withColumn("langs", F.array(F.lit("")))
    want = ranking.topk(ranking.bm25_scores(tokens, asked), 5, digits=6)
    assert rows(stored_topk(index, asked, 5, digits=6)) == rows(want)


def test_frequent_words_are_not_essential(spark, index):
    asked = spark.createDataFrame([(1, "w0"), (1, "w25")], "query_id int, term string")
    weighted = weighted_terms(index, with_defaults(asked), F.lit(True))
    limits = thresholds(index, weighted, F.lit(True), 3)
    assert rows(limits) and ("w25",) in {t[1:] for t in rows(essential_terms(weighted, limits, 1e-9))}
    weak = rows(weighted.groupBy("term").agg(F.max("bound").alias("b")).where("term = 'w0'").select("b"))[0][0]
    if weak < rows(limits)[0][1]:
        assert rows(essential_terms(weighted, limits, 1e-9)) == [(1, "w25")]


def test_pairs_are_not_shuffled(spark, index):
    plan = stored_topk(index, queries(spark), 3)._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "Bucketed: true" in plan


def test_page_brings_the_columns_of_the_hits(spark, docs, tokens, index):
    asked = queries(spark)
    page = stored_page(index, docs.select("id", "title"), "id", asked, 3, digits=6)
    hits = ranking.topk(ranking.bm25_scores(tokens, asked), 3, digits=6)
    want = hits.join(docs, docs["id"] == hits["doc_id"]).select("id", "title", "query_id", "score", "rank")
    assert rows(page) == rows(want)


def test_empty_corpus(spark, docs, tmp_path):
    write_token_index(tokens_of(docs.limit(0)), str(tmp_path / "none"), 2)
    assert rows(stored_topk(open_token_index(spark, str(tmp_path / "none")), queries(spark), 3)) == []
