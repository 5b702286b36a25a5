"""Requests answered inside the tasks that hold the documents, against the joins they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from facetspark.operators import in_task, matching, ranking, taxonomy
from facetspark.scale import Request
from conftest import rows

SCHEMA = "doc_id int, field string, lang string, tokens array<string>"


@pytest.fixture(scope="module")
def tokens(spark):
    """Documents of two fields and languages; some ids repeat, some are null, one text is empty."""
    rng = random.Random(5)
    words = ["bread", "brown", "dark", "de", "la", "été", "salt", "butter_x", "b", "ab"]
    made = [(rng.choice([None, *range(40)]), rng.choice(["title", "text"]), rng.choice(["en", "fr", None]),
             rng.choices(words, range(10, 0, -1), k=rng.randint(0, 12))) for _ in range(150)]
    return spark.createDataFrame(made, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(
        [(1, 0, "bread", 2.0, True), (1, 0, "été", 1.0, True), (1, 1, "brown", 1.0, False), (1, 1, "brown", 1.0, False),
         (2, 0, "salt", 1.0, False), (2, 1, "nowhere", 1.0, False), (3, 0, "dark", 1.0, True), (3, 1, "gone", 1.0, True)],
        "query_id int, clause int, term string, boost double, required boolean",
    )


def by_joins(monkeypatch, module):
    """Lets an operator take the way of requests too large for every task."""
    monkeypatch.setattr(module, "measure_request", lambda df, column: Request(None, False))


def plan_of(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning" in line]


@pytest.mark.parametrize("cells", [1, 1 << 20])
@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_documents_are_those_of_all_scores(spark, tokens, asked, k, cells, monkeypatch):
    monkeypatch.setattr(in_task, "CELLS", cells)
    best = ranking.bm25_best(tokens, asked, k, digits=6)
    assert not any("query_id" in line and "doc_id" in line for line in plan_of(best))
    assert rows(best) == rows(ranking.topk(ranking.bm25_scores(tokens, asked), k, digits=6))


def test_scopes_of_queries_hold(spark, tokens, asked):
    narrow = asked.withColumn("fields", F.array(F.lit("text"))).withColumn("langs", F.array(F.lit("fr")))
    assert rows(ranking.bm25_best(tokens, narrow, 5, 6)) == rows(ranking.topk(ranking.bm25_scores(tokens, narrow), 5, 6))


def test_clauses_met_in_several_rows_of_a_document(spark, tokens, asked, monkeypatch):
    queries = asked.where("term not in ('gone', 'nowhere')").select("query_id", "clause", "term")
    found = matching.match_all_clauses(tokens.where("doc_id is not null"), queries)
    assert not any("query_id" in line for line in plan_of(found))
    found = rows(found)
    by_joins(monkeypatch, matching)
    assert found and found == rows(matching.match_all_clauses(tokens.where("doc_id is not null"), queries))


@pytest.mark.parametrize("slop", [0, 1, 2])
def test_phrases_are_those_of_the_join(spark, tokens, slop, monkeypatch):
    phrases = spark.createDataFrame(
        [(i, 0, w, slop) for i, w in enumerate([["bread", "brown"], ["brown", "bread", "brown"], ["dark"], ["de", "la", "de"],
                                                ["bread", "bread"], ["bread", "gone"]])],
        "query_id int, clause int, words array<string>, slop int",
    )
    found = matching.phrase_matches(tokens, phrases)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    found = rows(found.fillna(-1).fillna(""))
    by_joins(monkeypatch, matching)
    assert found and found == rows(matching.phrase_matches(tokens, phrases).fillna(-1).fillna(""))


def test_documents_of_patterns_are_those_of_the_expansion(spark, tokens, monkeypatch):
    patterns = spark.createDataFrame(
        [(p, 0, p) for p in ["b*", "*b", "*b*", "*", "?", "??", "BR*d", "*t?", "é*é", "*_x", "*rea*", "d?", "de", "*zz*", "butt*r*x"]],
        "query_id string, clause int, pattern string",
    )
    counted = matching.count_wildcard_documents(tokens, patterns)
    assert not any("query_id" in line and "doc_id" in line for line in plan_of(counted))
    counted = rows(counted)
    by_joins(monkeypatch, matching)
    assert len(counted) > 9 and counted == rows(matching.count_wildcard_documents(tokens, patterns))


def test_tasks_of_tags_grow_with_them(spark, monkeypatch):
    edges = spark.createDataFrame([("t", f"n{i}", f"n{i // 2}") for i in range(1, 64)], "taxonomy string, child string, parent string")
    rng = random.Random(2)
    tags = spark.createDataFrame([("t", d, f"n{rng.randrange(64)}") for d in range(60) for _ in range(3)] + [("t", 0, None)], "taxonomy string, doc_id int, tag string")
    closure = taxonomy.ancestors(edges)
    want = rows(taxonomy.deepest_tags(tags, closure).fillna("-"))
    monkeypatch.setattr("facetspark.scale.TASK_ROWS", 10)
    monkeypatch.setattr(taxonomy, "FREQUENT", 30)
    monkeypatch.setattr(taxonomy, "is_bounded", lambda df: False)
    found = taxonomy.deepest_tags(tags, closure)
    assert any(", 19)" in line and "doc_id" in line for line in plan_of(found))
    assert rows(found.fillna("-")) == want


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(1, 40)] + [(100, 5), (101, 100)],
    [(1, 2), (2, 1), (3, 1), (4, 3)],
    [(1, 2), (2, 3), (3, 1), (9, 3), (4, 4)],
    [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)],
])
def test_ancestors_of_chains_and_cycles(spark, edges):
    want, parents = set(), {}
    for child, parent in edges:
        parents.setdefault(child, set()).add(parent)
    for start in parents:
        depth, level, seen = 0, {start}, {start}
        while level:
            depth, level = depth + 1, {p for x in level for p in parents.get(x, ())} - seen
            seen |= level
            want |= {("t", start, x, depth) for x in level}
    df = spark.createDataFrame([("t", a, b) for a, b in edges], "taxonomy string, child int, parent int")
    assert set(rows(taxonomy.ancestors(df))) == want
