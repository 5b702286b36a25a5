"""Operators on small tables, several against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from facetspark.functions.codes import code_path
from facetspark.functions.scoring import weighted_grade_score, with_tables
from facetspark.functions.text import STANDARD, TAXONOMY, deletion_variants, fold_diacritics, normalize_term
from facetspark.operators import matching, ranking, suggest, taxonomy
from facetspark.operators.facets import facet_counts, label_facets
from facetspark.operators.normalize import normalize_documents
from facetspark.operators.postings import TextSource, token_arrays
from facetspark.operators.predicates import (
    AnyElement, Exists, Fuzzy, Match, Scope, Term, Wildcard, all_of, any_of, between_range, facet_filter, none_of,
    selected_facets, terms_all, terms_any,
)
from facetspark.operators.shape import fold_languages
from facetspark.operators.sorting import score_by, sort_documents, with_places
from facetspark.operators.tagging import synonym_spans, tag_entities
from facetspark.operators.upsert import upsert_documents
from facetspark.scale import topk_per_group
from facetspark.specs import CollectionSpec, FieldSpec, SpecError
from conftest import rows


def tokens_of(spark, texts, analyzer=STANDARD):
    df = spark.createDataFrame(texts, "id int, text string, lang string")
    return token_arrays(df, "id", [TextSource("text", lang="lang")], analyzer)


# Own cases: ids stay whole with hyphens read as underscores, apostrophes split, letters are folded, numbers keep their point.
@pytest.mark.parametrize("text,expected", [
    ("xx:tin-can 0.33", ["xx:tin_can", "0.33"]),
    ("d'Åland? O’Neill", ["d", "aland", "o", "neill"]),
    ("Größe-M, Ünal_7", ["grosse_m", "unal_7"]),
    ("", []),
])
def test_taxonomy_analysis(spark, text, expected):
    assert spark.range(1).select(TAXONOMY.tokens(F.lit(text))).first()[0] == expected


def test_scalar_text(spark):
    row = spark.range(1).select(
        fold_diacritics(F.lit("Crème Œuf ñ")), normalize_term(F.lit("  FR-BIO, l'eau ")), F.size(deletion_variants(F.lit("abc"), 1))
    ).first()
    assert tuple(row) == ("Creme OEuf n", "fr bio l eau", 4)


@pytest.mark.parametrize("code,path", [
    ("3012345670001", "301/234/567/0001"), ("123456789", "123/456/789"), ("12345", "12345"), ("12a", None),
    ("org-x/3012345670001", "301/234/567/0001/org-x"),
])
def test_code_path(spark, code, path):
    assert spark.range(1).select(code_path(F.lit(code))).first()[0] == path


def brute_phrase(tokens, words, slop):
    def fill(first, j, used):
        if j == len(words):
            return True
        return any(
            0 <= p < len(tokens) and tokens[p] == words[j] and p not in used and fill(first, j + 1, used | {p})
            for p in range(first + j, first + j + slop + 1)
        )

    return any(fill(first, 0, frozenset()) for first in range(-slop - len(words), len(tokens) + 1))


@pytest.mark.parametrize("slop", [0, 1, 2, 3])
def test_phrases_against_brute_force(spark, slop):
    rng = random.Random(slop)
    texts = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))), "en") for i in range(40)]
    queries = sorted({tuple(rng.choice("abcde") for _ in range(rng.randint(1, 4))) for _ in range(25)})
    phrases = spark.createDataFrame(
        [(i, 0, list(q), slop) for i, q in enumerate(queries)], "query_id int, clause int, words array<string>, slop int"
    )
    found = matching.phrase_matches(tokens_of(spark, texts), phrases).select("query_id", "doc_id")
    expected = sorted((i, d) for i, q in enumerate(queries) for d, t, _ in texts if brute_phrase(t.split(), q, slop))
    assert rows(found) == expected


def test_and_matching_forms_agree(spark):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(6)), "en") for i in range(60)]
    queries = [(i, sorted({rng.choice("abcdefgh") for _ in range(3)})) for i in range(20)]
    tokens, q = tokens_of(spark, texts), spark.createDataFrame(queries, "query_id int, words array<string>")
    clauses = q.select("query_id", F.posexplode("words").alias("clause", "term"))
    expected = sorted((i, d) for i, ws in queries for d, t, _ in texts if set(ws) <= set(t.split()))
    assert rows(matching.match_all_words(tokens, q)) == expected
    assert rows(matching.match_all_clauses(tokens, clauses)) == expected
    required = clauses.withColumn("required", F.lit(True))
    general = rows(ranking.bm25_scores(tokens, required).withColumn("score", F.round("score", 9)))
    assert general == rows(ranking.all_words_scores(tokens, q).withColumn("score", F.round("score", 9)))


def test_many_clauses(spark):
    words = [f"w{i}" for i in range(130)]
    tokens = tokens_of(spark, [(1, " ".join(words), "en"), (2, " ".join(words[1:]), "en")])
    clauses = spark.createDataFrame([(7, i, w) for i, w in enumerate(words)], "query_id int, clause int, term string")
    assert rows(matching.match_all_clauses(tokens, clauses)) == [(7, 1)]


def test_best_field_and_languages(spark):
    df = spark.createDataFrame([(1, {"en": "red red", "fr": "rouge"}, "red"), (2, {"en": "blue"}, None)], "id int, name map<string,string>, note string")
    tokens = token_arrays(df, "id", [TextSource("name", by_lang=True), TextSource("note")], langs=["en"])
    assert rows(tokens.select("doc_id", "field", "lang")) == [(1, "name", "en"), (1, "note", ""), (2, "name", "en")]
    q = spark.createDataFrame([(0, 0, "red", ["note"]), (1, 0, "red", None)], "query_id int, clause int, term string, fields array<string>")
    found = rows(matching.word_matches(tokens, q))
    assert found == [(0, 0, 1, "note", ""), (1, 0, 1, "name", "en"), (1, 0, 1, "note", "")]
    assert ranking.clause_scores(tokens, q).where("query_id = 1").count() == 1


def test_wildcards_and_fuzzy_against_brute_force(spark):
    import re

    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(120)})
    vocab = spark.createDataFrame([(w,) for w in words], "term string")
    patterns = ["a*", "*b", "a*b", "?b*", "*abc*", "a?c", "*", "??", "abca*"]
    p = spark.createDataFrame([(i, 0, x) for i, x in enumerate(patterns)], "query_id int, clause int, pattern string")
    expected = sorted(
        (x, w) for x in patterns for w in words if re.fullmatch(x.replace("*", ".*").replace("?", "."), w)
    )
    assert rows(matching.expand_wildcards(vocab, p).select("pattern", "term")) == expected

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    asked = ["abc", "aabb", "c"]
    q = spark.createDataFrame([(i, 0, x) for i, x in enumerate(asked)], "query_id int, clause int, word string")
    for n in (1, 2):
        got = rows(matching.expand_fuzzy(vocab, q, n).select("word", "term", "edits"))
        assert got == sorted((a, w, edits(a, w)) for a in asked for w in words if edits(a, w) <= n)


def test_predicates(spark):
    df = spark.createDataFrame(
        [(1, "x", [1, 5], {"k": 3}, [("a", 2)], "dark choc"), (2, None, [], {}, [("b", 9), ("a", 1)], "milk"), (3, "y", None, None, None, None)],
        "id int, s string, n array<int>, m map<string,int>, items array<struct<name:string,size:int>>, text string",
    )

    def ids(p):
        return [r[0] for r in rows(df.where(p.compile(Scope(schema=df.schema))).select("id"))]

    assert ids(Term("n", 5)) == [1]
    assert ids(between_range("n", 2, "*")) == [1]
    assert ids(between_range("m:k", 3, 4, include_low=False)) == []
    assert ids(between_range("m.k", 3, 4, include_high=False)) == [1]
    assert ids(Exists("n")) == [1] and ids(Exists("s")) == [1, 3] and ids(Exists("m.zzz")) == []
    assert ids(none_of(Term("s", "x"))) == [2, 3]
    assert ids(terms_any("n", [7, 1])) == [1] and ids(terms_all("n", [5, 1])) == [1] and ids(terms_all("n", [5, 2])) == []
    assert ids(AnyElement("items", lambda e: (e["name"] == "a") & (e["size"] > 1))) == [1]
    assert ids(Wildcard("cho*", "text")) == [1] and ids(Wildcard("m?lk", "text")) == [2] and ids(Wildcard("*", "text")) == [1, 2]
    assert ids(Fuzzy("text", "chic", 1)) == [1] and ids(Match("text", "milk dark")) == [1, 2]
    with pytest.raises(SpecError):
        ids(Term("nope", 1))


def test_selected_facets():
    query = all_of(Term("a", '"x"'), terms_any("b", ["1", "2"]), Term("c", 1), Term("c", 2), Term("c", 3), any_of(Term("d", 1), Term("e", 2)))
    assert selected_facets(query) == {"a": ["x"], "b": ["1", "2"]}
    assert selected_facets(facet_filter({"a": ["x", "y"]})) == {"a": ["x", "y"]}


def test_facets(spark):
    df = spark.createDataFrame([(["a", "b", "a"], 1), (["b"], 2), (["c", "b"], 2), (None, None)], "tags array<string>, n int")
    got = facet_counts(df, ["tags", "n"], 1, {"tags": ["z", "c"]})
    assert [tuple(r) for r in got.orderBy("field", "rank").select("field", "key", "count", "selected").collect()] == [
        ("n", "2", 2, False), ("n", "--other--", 1, False),
        ("tags", "c", None, True), ("tags", "z", None, True), ("tags", "b", 3, False), ("tags", "--other--", 2, False),
    ]
    names = spark.createDataFrame(
        [("t", "en:b", "fr", "Bé"), ("t", "en:b", "en", "Bee"), ("t", "de:c", "de", "Ce"), ("t", "de:c", "en", "Cee")],
        "taxonomy string, id string, lang string, name string",
    )
    items = facet_counts(spark.createDataFrame([(["en:b", "de:c", "c", "x"],)], "tags array<string>"), ["tags"])
    assert {r["key"]: r["name"] for r in label_facets(items, names, "fr", {"tags": "t"}).collect()} == {
        "en:b": "Bé", "de:c": "Ce", "c": "Cee", "x": "x"
    }


@pytest.mark.parametrize("k", [3, 1500])
def test_topk_forms(spark, k):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    top = topk_per_group(df, ["g"], [F.desc("v")], k)
    assert top.count() == 2 * k and top.agg(F.max("rank")).first()[0] == k
    assert top.agg(F.min("v")).first()[0] == 5000 - 2 * k


def test_ancestors_with_diamond_cycle_and_depth(spark):
    edges = spark.createDataFrame(
        [("t", "d", "b"), ("t", "d", "c"), ("t", "b", "a"), ("t", "c", "a"), ("t", "a", "top"), ("t", "p", "q"), ("t", "q", "p")],
        "taxonomy string, child string, parent string",
    )
    closure = taxonomy.ancestors(edges)
    got = {(r["id"], r["ancestor"]): r["depth"] for r in closure.collect()}
    assert got[("d", "a")] == 2 and got[("d", "top")] == 3 and ("p", "p") not in got and len(got) == 11
    tags = spark.createDataFrame(
        [("t", 1, "d"), ("t", 1, "a"), ("t", 1, "z"), ("t", 2, "b"), ("t", 2, "c"), ("t", 2, "top"), ("other", 1, "d"), ("other", 1, "a")],
        "taxonomy string, doc_id int, tag string",
    )
    assert rows(taxonomy.deepest_tags(tags, closure)) == [
        ("other", 1, "a"), ("other", 1, "d"), ("t", 1, "d"), ("t", 1, "z"), ("t", 2, "b"), ("t", 2, "c")]


def test_ancestors_of_a_deep_taxonomy(spark):
    edges = spark.range(200).selectExpr("'t' AS taxonomy", "'n' || (id + 1) AS child", "'n' || id AS parent")
    closure = taxonomy.ancestors(edges)
    assert closure.count() == 200 * 201 // 2 and closure.agg(F.max("depth")).first()[0] == 200


def test_fill_international(spark):
    names = spark.createDataFrame([("t", "fr:a", "fr", "Un"), ("t", "xx:b", "xx", "Bee"), ("brands", "xx:m", "xx", "Em")], "taxonomy string, id string, lang string, name string")
    synonyms = spark.createDataFrame([("t", "xx:b", "xx", "Bey"), ("brands", "xx:m", "xx", "Emm")], "taxonomy string, id string, lang string, synonym string")
    n, s = taxonomy.fill_main_and_international(names, synonyms, ["fr", "en"], ["brands"])
    assert ("t", "fr:a", "main", "Un") in rows(n) and ("t", "xx:b", "en", "Bee") in rows(n) and ("brands", "xx:m", "main", "Em") in rows(n)
    assert not [r for r in rows(n) if r[0] == "brands" and r[2] == "fr"]
    assert {("t", "xx:b", "fr", "Bee"), ("t", "xx:b", "fr", "Bey"), ("brands", "xx:m", "main", "Emm")} <= set(rows(s))


def test_tagging_is_longest_leftmost(spark):
    spans = synonym_spans(spark.createDataFrame(
        [("t", "en", "e:bio", "organic"), ("t", "en", "e:farm", "organic farming"), ("t", "en", "e:leaf", "farming leaf green")],
        "taxonomy string, lang string, id string, synonym string",
    ))
    tokens = tokens_of(spark, [(1, "Organic farming leaf green organic", "en"), (2, "farming leaf green", "fr")], TAXONOMY)
    assert rows(tag_entities(tokens, spans).select("doc_id", "start", "n_words", "id")) == [(1, 0, 2, "e:farm"), (1, 4, 1, "e:bio")]


def test_completion(spark):
    names = spark.createDataFrame(
        [("l", "en:organic", "en", "Organic"), ("l", "en:organic", "fr", "Biologique"), ("l", "en:max-h", "fr", "Max Havelaar"), ("c", "en:oranges", "en", "Orangés")],
        "taxonomy string, id string, lang string, name string",
    )
    synonyms = spark.createDataFrame([("l", "en:organic", "en", "organically grown"), ("l", "en:organic", "en", "Organic")], "taxonomy string, id string, lang string, synonym string")
    table = suggest.suggest_table(names, synonyms, ["en", "fr"])
    assert rows(table.where("id = 'en:organic' and lang = 'en'").select("position", "input")) == [(1, "Organic"), (2, "organically grown")]

    def ask(q, langs, fuzziness=0, taxonomies=None):
        queries = spark.createDataFrame([(0, q, taxonomies)], "query_id int, q string, taxonomies array<string>")
        got = suggest.complete(queries, table, names, langs, 5, fuzziness).orderBy("rank")
        return [(r["id"], r["text"], r["name"], r["score"]) for r in got.collect()]

    assert ask("ORGAN", ["en"]) == [("en:organic", "Organic", "Organic", 90)]
    assert ask("orange", ["en"]) == [("en:oranges", "Orangés", "Orangés", 90)]
    assert ask("or", ["en"]) == [("en:oranges", "Orangés", "Orangés", 90), ("en:organic", "Organic", "Organic", 90)]
    assert ask("or", ["en"], taxonomies=["c"]) == [("en:oranges", "Orangés", "Orangés", 90)]
    assert ask("biol", ["en", "fr"]) == [("en:organic", "Biologique", "Organic", 90)]
    assert ask("max h", ["fr"]) == [("en:max-h", "Max Havelaar", "Max Havelaar", 92)]
    assert ask("orgam", ["en"]) == [] and ask("orgam", ["en"], 1)[0][0] == "en:organic"


def test_language_folding_and_normalisation(spark):
    df = spark.createDataFrame(
        [("1", "n", None, "", "br", "vn", "a,b", 0, False), (None, "m", "f", "i", "p", "v", None, 3, True), ("9", "x", "y", None, None, None, "", 1, True)],
        "`id` string, `name` string, `name_fr` string, `name_it` string, `name_pt-BR` string, `name_vn` string, tags string, n int, flag boolean",
    )
    folded = fold_languages(df.select("name", "name_fr", "name_it", "name_pt-BR", "name_vn"), "name", ["fr", "it", "pt-BR"])
    assert folded.first()[0] == {"main": "n", "pt-BR": "br"}
    spec = CollectionSpec(
        "c", (FieldSpec("id", "keyword"), FieldSpec("name", "text_lang"), FieldSpec("labels", "taxonomy", input_field="tags", split=True, taxonomy="t"),
              FieldSpec("n", "integer"), FieldSpec("flag", "bool"), FieldSpec("gone", "keyword"), FieldSpec("t", "date")),
        "id", "t", langs=("fr",), taxonomies=("t",), denylist=frozenset({"9"}),
    )
    result = normalize_documents(df, spec)
    assert [tuple(r)[:6] for r in result.accepted.collect()] == [("1", {"main": "n"}, ["a", "b"], None, None, None)]
    assert rows(result.rejected.select("reason")) == [("denied id",), ("missing id",)]
    sane = normalize_documents(df, spec, falsy_as_null=False).accepted.first()
    assert sane["n"] == 0 and sane["flag"] is False


@pytest.mark.parametrize("bad", [
    dict(fields=(FieldSpec("id", "keyword"),), last_modified_field="id"),
    dict(fields=(FieldSpec("id", "keyword"), FieldSpec("l", "taxonomy", taxonomy="none"), FieldSpec("t", "date")), last_modified_field="t"),
    dict(fields=(FieldSpec("t", "date"),), last_modified_field="t"),
])
def test_refused_specs(bad):
    with pytest.raises(SpecError):
        CollectionSpec("c", id_field="id", **bad)
    with pytest.raises(SpecError):
        FieldSpec("x", "text", facet=True)


def test_scorer(spark):
    scorer = with_tables(weighted_grade_score([("nova", "w1", "t1", "unknown"), ("grade", "w2", "t2", "e")]), t1={"1": 100, "3": 75}, t2={"a": 100, "e": 0})
    df = spark.createDataFrame([(1, 1, "a"), (2, None, None), (3, 3, "zz")], "id int, nova int, grade string")
    assert rows(score_by(df, scorer, {"w1": 1.0, "w2": 2.0, }).select("id", "score")) == [(1, 300.0), (2, 0.0), (3, 75.0)]
    with pytest.raises(SpecError):
        score_by(df, scorer, {"w1": 1.0})
    with pytest.raises(SpecError):
        score_by(df, scorer, {"w1": 1.0, "w2": 1.0, "w3": 1.0})


def test_sorting_arrays_and_nulls(spark):
    df = spark.createDataFrame([(1, [5, 1]), (2, [3]), (3, None), (4, [4, 2])], "id int, n array<int>")
    assert [r["id"] for r in sort_documents(df, "n", "id").collect()] == [1, 4, 2, 3]
    assert [r["id"] for r in sort_documents(df, "-n", "id").collect()] == [1, 4, 2, 3]


def test_upsert_replaces_whole_documents_and_is_idempotent(spark):
    current = spark.createDataFrame([(1, "a", ["x"], 5), (2, "b", None, 5), (3, "c", None, 9)], "id int, name string, labels array<string>, t long")
    updates = spark.createDataFrame([(1, "old", 6), (1, "new", 7), (4, "d", 1), (3, "late", 2)], "id int, name string, t long")
    deleted = spark.createDataFrame([(2,)], "id int")
    once = upsert_documents(current, updates, "id", "t", deleted, only_newer=True)
    expected = [(1, "new", None, 7), (3, "c", None, 9), (4, "d", None, 1)]
    assert rows(once) == expected
    assert rows(upsert_documents(once, updates, "id", "t", deleted, only_newer=True)) == expected


def test_fuzzy_words_of_many_lengths_and_longer_in_lower_case(spark, monkeypatch):
    from facetspark import scale
    from facetspark.operators.matching import expand_fuzzy

    vocab = spark.createDataFrame([("i\u0307ab",), ("bread",), ("x" * 12,)], "term string")
    words = spark.createDataFrame([("\u0130a", 0, "\u0130a"), ("brad", 0, "brad")], "query_id string, clause int, word string")
    want = {("\u0130a", "i\u0307ab", 1), ("brad", "bread", 1)}
    odd = words.where("word <> 'brad'")
    found = lambda asked: {(r.word, r.term, r.edits) for r in expand_fuzzy(vocab, asked, 1).collect()}
    assert found(odd) == {w for w in want if w[0] != "brad"}
    monkeypatch.setattr(scale, "LITERAL_VALUES", 1)
    assert found(words) == want


def test_places_follow_the_order(spark):
    draw = [(k * 7919) % 1000 for k in range(1000)] + [None, None]
    df = spark.createDataFrame(list(zip(draw, range(len(draw)))), "x int, id int").repartition(7)
    got = with_places(sort_documents(df, "-x", "id")).collect()
    want = sorted(zip(draw, range(len(draw))), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert {(r.x, r.id, r.place) for r in got} == {(x, i, k) for k, (x, i) in enumerate(want, 1)}
    assert with_places(sort_documents(df.limit(0), "x", "id")).collect() == []
