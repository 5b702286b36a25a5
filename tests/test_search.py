"""Whole requests over a small collection: words, phrases, synonyms, languages, facets, charts."""

import pytest
from pyspark.sql import functions as F

from facetspark.operators.predicates import (
    Everything, Match, MatchAny, Phrase, PhraseAny, Term, all_of, any_of, boost_phrases, ge, none_of,
)
from facetspark.operators.tagging import resolver, synonym_spans
from facetspark.plans.search import Distribution, Scatter, SearchRequest, search
from facetspark.specs import CollectionSpec, FieldSpec, SpecError
from conftest import rows

SPEC = CollectionSpec(
    "goods",
    (
        FieldSpec("code", "keyword"),
        FieldSpec("title", "text_lang", full_text=True),
        FieldSpec("labels", "taxonomy", taxonomy="labels", full_text=True, facet=True),
        FieldSpec("kind", "keyword", facet=True),
        FieldSpec("sales", "integer"),
        FieldSpec("quality", "double", facet=True),
        FieldSpec("modified", "date"),
    ),
    id_field="code", last_modified_field="modified", langs=("en", "fr"), taxonomies=("labels",),
)
DOCS = [
    ("a1", {"main": "Dark tea", "en": "Dark tea", "fr": "Thé noir"}, ["en:fair-trade", "en:bio"], "tea", 100, 0.5, 10),
    ("a2", {"main": "Green tea", "en": "Green tea", "fr": "Thé vert"}, ["en:bio"], "tea", 200, 0.6, 20),
    ("a3", {"main": "Tea of the dark hills", "fr": "Thé des collines"}, [], "tea", 300, 0.6, 30),
    ("a4", {"main": "Dark bread", "en": "Dark bread"}, None, "bread", 400, None, 40),
    ("a5", {"main": "Bread", "en": "Bread dark tea"}, ["en:fair-trade"], "bread", 500, 0.9, 50),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        DOCS, "code string, title map<string,string>, labels array<string>, kind string, sales int, quality double, modified long"
    ).persist()


@pytest.fixture(scope="module")
def lookup(spark):
    synonyms = spark.createDataFrame(
        [("labels", "en", "en:bio", "organically grown"), ("labels", "en", "en:bio", "organic"), ("labels", "fr", "en:bio", "bio"),
         ("labels", "en", "en:fair-trade", "fairly traded"), ("labels", "fr", "en:fair-trade", "commerce de l'équité")],
        "taxonomy string, lang string, id string, synonym string",
    )
    return resolver(synonym_spans(synonyms))


CASES = [
    (MatchAny("tea"), ("en",), {"a1", "a2", "a5"}),
    (MatchAny("TEA"), ("en", "main"), {"a1", "a2", "a3", "a5"}),
    (MatchAny("organic"), ("en",), {"a1", "a2"}),
    (MatchAny("bio"), ("fr",), {"a1", "a2"}),
    (PhraseAny("organically grown"), ("en",), {"a1", "a2"}),
    (PhraseAny("commerce de l’équité"), ("fr",), {"a1", "a5"}),
    (Match("labels", "en:fair-trade"), ("fr",), {"a1", "a5"}),
    (Phrase("labels", "fairly traded"), ("en",), {"a1", "a5"}),
    (PhraseAny("dark tea"), ("en",), {"a1", "a5"}),
    (Phrase("title", "tea dark", slop=1), ("en", "main"), set()),
    (Phrase("title", "tea dark", slop=2), ("en", "main"), {"a1", "a3", "a5"}),
    (Phrase("title", "tea dark", slop=2), ("en",), {"a1", "a5"}),
    (all_of(MatchAny("dark"), MatchAny("tea")), ("en",), {"a1", "a5"}),
    (all_of(PhraseAny("dark tea"), MatchAny("bread")), ("en",), {"a5"}),
    (MatchAny("collines"), ("en",), set()),
    (none_of(Term("kind", "tea")), ("en",), {"a4", "a5"}),
    (any_of(Term("sales", 400), ge("quality", 0.6)), ("en",), {"a2", "a3", "a4", "a5"}),
    (none_of(ge("quality", 0.6)), ("en",), {"a1", "a4"}),
    (all_of(MatchAny("..."), Term("kind", "bread")), ("en",), {"a4", "a5"}),
]


@pytest.mark.parametrize("query,langs,codes", CASES)
def test_matches(docs, lookup, query, langs, codes):
    result = search(docs, SPEC, SearchRequest(query, langs, sort_by="code"), resolver=lookup)
    assert {r["code"] for r in result.hits.collect()} == codes


def test_boosted_phrase_widens_to_synonyms(docs, lookup):
    query = all_of(MatchAny("organically"), MatchAny("grown"))
    plain = search(docs, SPEC, SearchRequest(query), resolver=lookup)
    boosted = search(docs, SPEC, SearchRequest(query, phrase_boost=True), resolver=lookup)
    assert plain.hits.count() == 0
    assert {r["code"] for r in boosted.hits.collect()} == {"a1", "a2"}


def test_rank_prefers_short_and_phrase(docs, lookup):
    query = all_of(MatchAny("dark"), MatchAny("tea"))
    ranked = [r["code"] for r in search(docs, SPEC, SearchRequest(query, ("en", "main"), phrase_boost=True), resolver=lookup).hits.collect()]
    assert ranked[0] == "a1" and set(ranked) == {"a1", "a3", "a5"}


def test_facets_charts_summary_and_projection(docs):
    request = SearchRequest(
        all_of(Term("kind", "tea")), ("en",), sort_by="-sales", page=1, page_size=2, fields=("code", "title", "title_fr"),
        facets=("labels", "kind"), charts=(Distribution("labels"), Scatter("sales", "quality")),
    )
    result = search(docs, SPEC, request)
    assert [tuple(r) for r in result.hits.collect()] == [("a3", "Tea of the dark hills", "Thé des collines"), ("a2", "Green tea", "Thé vert")]
    assert rows(result.facets.select("field", "key", "count", "selected", "rank")) == [
        ("kind", "tea", 3, True, 1), ("labels", "en:bio", 2, False, 1), ("labels", "en:fair-trade", 1, False, 2),
    ]
    assert rows(result.charts["labels"]) == [("labels", "en:bio", 2), ("labels", "en:fair-trade", 1)]
    assert rows(result.charts["sales:quality"]) == [(200.0, 0.6), (300.0, 0.6)]
    assert rows(result.summary) == [(3, 2, True)]


def test_pages_partition_the_result(docs):
    pages = [
        [r["code"] for r in search(docs, SPEC, SearchRequest(sort_by="code", page=n, page_size=2)).hits.collect()]
        for n in (1, 2, 3, 4)
    ]
    assert pages == [["a1", "a2"], ["a3", "a4"], ["a5"], []]


@pytest.mark.parametrize("options", [
    {"facets": ("sales",)}, {"facets": ("missing",)}, {"charts": (Distribution("title"),)},
    {"charts": (Scatter("kind", "sales"),)}, {"sort_by": "missing"}, {"page": 2000, "page_size": 10},
])
def test_refused_requests(docs, options):
    with pytest.raises(SpecError):
        search(docs, SPEC, SearchRequest(**{"sort_by": "code", **options}))


def test_query_or_sort_needed(docs):
    with pytest.raises(SpecError):
        search(docs, SPEC, SearchRequest(Everything()))


def free(*words):
    return all_of(*[MatchAny(w) for w in words])


# Own cases, by the rule: each run of two or more neighbouring free words directly under one AND, and nothing else.
@pytest.mark.parametrize("query,phrases", [
    (Everything(), []),
    (any_of(free("river", "stone"), MatchAny("moss")), ["river stone"]),
    (all_of(Term("kind", "tea"), MatchAny("river"), Term("sales", 100), MatchAny("stone")), []),
    (all_of(MatchAny("river"), MatchAny("stone"), none_of(free("wet", "moss")), MatchAny("fern")), ["river stone", "wet moss"]),
    (all_of(Phrase("title", "old oak"), free("bark", "beetle", "larva"), ge("sales", 1)), ["bark beetle larva"]),
    (all_of(free("one", "two"), any_of(MatchAny("three"), all_of(MatchAny("four"), MatchAny("five")))), ["one two", "four five"]),
])
def test_phrase_boost_runs(query, phrases):
    def inside(q):
        return ([q.text] if isinstance(q, PhraseAny) else []) + [p for c in q.children() for p in inside(c)]

    assert inside(boost_phrases(query, 2.0, 3)) == phrases


def scores(docs, query, **options):
    hits = search(docs, SPEC, SearchRequest(query), **options).hits
    return {r["code"]: r["_score"] for r in hits.collect()}


def test_parts_of_a_group_that_is_not_met_do_not_score(docs):
    # a5 meets the second alternative only, though it has a word of the first; a2 has no word of it
    query = any_of(all_of(MatchAny("dark"), Term("kind", "none")), Term("sales", 200), Term("sales", 500))
    assert scores(docs, query) == {"a2": 1.0, "a5": 1.0}
    met = any_of(all_of(MatchAny("dark"), Term("kind", "bread")), Term("sales", 200), Term("sales", 500))
    got = scores(docs, met)
    assert got["a2"] == 1.0 and got["a5"] > 2.0 and got["a4"] > 1.0


def test_scores_use_the_analyzer_of_the_language(docs):
    from facetspark.functions.text import STANDARD, Analyzer

    first = Analyzer(stem=lambda t: F.left(t, F.lit(4)))
    got = scores(docs, MatchAny("greenish"), analyzers={"en": first}, default_analyzer=STANDARD)
    assert set(got) == {"a2"} and got["a2"] > 0


def test_long_texts_resolve(lookup):
    text = " ".join(f"word{k}" for k in range(1000)) + " organically grown"
    assert lookup("labels", text, ["en"])[-2:] == ["word999", "en:bio"]
