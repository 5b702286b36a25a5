"""One search request as a set of DataFrames: hits, facets, charts and totals."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.functions.text import STANDARD, Analyzer
from facetspark.operators.charts import distribution, scatter
from facetspark.operators.facets import DEFAULT_BUCKETS, facet_counts, label_facets
from facetspark.operators.postings import TextSource, token_arrays
from facetspark.operators.predicates import (
    Everything, Match, MatchAny, Phrase, PhraseAny, Predicate, Resolver, Scope, boost_phrases, scored_leaves,
    selected_facets,
)
from facetspark.operators.ranking import clause_scores, phrase_scores
from facetspark.operators.shape import flatten_languages, post_process, project
from facetspark.operators.sorting import page, result_summary, score_by, sort_key, split_sign
from facetspark.specs import MAIN_LANG, CollectionSpec, SpecError

SCORE = "_score"


@dataclass(frozen=True)
class Distribution:
    field: str


@dataclass(frozen=True)
class Scatter:
    x: str
    y: str


@dataclass(frozen=True)
class SearchRequest:
    """A query with languages, order, page, facets and charts."""

    query: Predicate = field(default_factory=Everything)
    langs: tuple[str, ...] = ("en",)
    sort_by: str | None = None
    sort_params: Mapping | None = None
    page: int = 1
    page_size: int = 10
    fields: tuple[str, ...] = ()
    facets: tuple[str, ...] = ()
    charts: tuple[Distribution | Scatter, ...] = ()
    phrase_boost: bool = False


@dataclass(frozen=True)
class SearchResult:
    hits: DataFrame
    facets: DataFrame | None
    charts: dict[str, DataFrame]
    summary: DataFrame


def check_request(request: SearchRequest, spec: CollectionSpec) -> None:
    spec.check_page(request.page, request.page_size)
    spec.check_sort(request.sort_by)
    spec.check_facets(request.facets)
    for chart in request.charts:
        if isinstance(chart, Distribution):
            spec.check_facets([chart.field])
        else:
            spec.check_numeric([chart.x, chart.y])
    if isinstance(request.query, Everything) and request.sort_by is None:
        raise SpecError("a request needs a query or a sort order")


def search(
    docs: DataFrame,
    spec: CollectionSpec,
    request: SearchRequest,
    names: DataFrame | None = None,
    resolver: Resolver | None = None,
    analyzers: Mapping[str, Analyzer] | None = None,
    default_analyzer: Analyzer = STANDARD,
    buckets: int = DEFAULT_BUCKETS,
    processors: Sequence[Callable[[DataFrame], DataFrame]] = (),
    constant_score: float = 1.0,
) -> SearchResult:
    """Run a request. All results share one filtered set; persist ``docs`` to reuse its scan."""
    check_request(request, spec)
    scope = Scope(
        spec, request.langs, analyzers or {}, default_analyzer, resolver=resolver,
    )
    query = request.query
    if request.phrase_boost and request.sort_by is None:
        query = boost_phrases(query, spec.phrase_boost, spec.phrase_slop)
    matching = docs.where(query.compile(scope))

    if request.sort_by is None:
        ranked = _scored(docs, matching, spec, query, scope, constant_score)
        order = [F.col(SCORE).desc(), F.col(f"`{spec.id_field}`").asc()]
    else:
        descending, name = split_sign(request.sort_by)
        if name in spec.scorers:
            ranked = score_by(matching, spec.scorers[name], request.sort_params, SCORE)
            order = [F.col(SCORE).desc() if descending else F.col(SCORE).asc(), F.col(f"`{spec.id_field}`").asc()]
        else:
            ranked = matching.withColumn(SCORE, F.lit(None).cast("double"))
            order = [sort_key(ranked, request.sort_by), F.col(f"`{spec.id_field}`").asc()]
    raw_page = page(ranked, order, request.page, request.page_size)
    shaped = flatten_languages(raw_page, spec.text_lang_fields, [MAIN_LANG, *spec.langs])
    hits = project(post_process(shaped, processors), request.fields)

    facets = None
    if request.facets:
        facets = facet_counts(matching, list(request.facets), buckets, _selections(request.query, spec, request.facets))
        taxonomies = {f: spec[f].taxonomy for f in request.facets if spec[f].taxonomy}
        if names is not None and taxonomies:
            facets = label_facets(facets, names, request.langs[0], taxonomies)
    charts = {}
    for chart in request.charts:
        if isinstance(chart, Distribution):
            charts[chart.field] = distribution(matching, [chart.field], buckets)
        else:
            charts[f"{chart.x}:{chart.y}"] = scatter(raw_page, chart.x, chart.y)
    return SearchResult(hits, facets, charts, result_summary(matching, request.page_size))


def _selections(query: Predicate, spec: CollectionSpec, facets: Sequence[str]) -> dict[str, list]:
    return {k: v for k, v in selected_facets(query).items() if k in facets}


def _scored(docs, matching, spec, query, scope, constant_score) -> DataFrame:
    """Matching documents with the sum of the scores of the clauses each one meets.

    Text clauses score by BM25 with the statistics of the whole collection, other clauses by a constant. Texts and
    query words of a language go through the same analyzer. A clause inside a group counts only where the whole
    group is met. Scores join the matching documents by their id.
    """
    spark = docs.sparkSession
    constant = F.lit(0.0)
    words, phrases, gated = [], [], {}
    text_fields = [f.name for f in spec.full_text_fields if f.type in ("text", "text_lang")]
    for clause, (leaf, boost, gates) in enumerate(scored_leaves(query)):
        is_free = isinstance(leaf, (MatchAny, PhraseAny))
        fields = text_fields if is_free else [getattr(leaf, "field", None)]
        is_text = is_free or (
            isinstance(leaf, (Match, Phrase)) and spec.resolve(leaf.field).type in ("text", "text_lang")
        )
        open_ = reduce(lambda a, b: a & b, (F.coalesce(g.compile(scope), F.lit(False)) for g in gates), F.lit(True))
        if gates:
            gated[clause] = open_
        bonus = F.lit(constant_score * boost)
        if not is_text:
            met = F.coalesce(leaf.compile(scope), F.lit(False)) & open_
            constant = constant + F.when(met, bonus).otherwise(F.lit(0.0))
            continue
        row = (clause, leaf.text, list(fields), float(boost))
        if isinstance(leaf, (Phrase, PhraseAny)):
            phrases.append((*row, leaf.slop))
        else:
            words.append((*row, 0))
        taxonomy_fields = [f.name for f in spec.full_text_fields if f.type == "taxonomy"] if is_free and scope.resolver else []
        for name in taxonomy_fields:
            met = F.coalesce((Match if isinstance(leaf, MatchAny) else Phrase)(name, leaf.text).compile(scope), F.lit(False))
            constant = constant + F.when(met & open_, bonus).otherwise(F.lit(0.0))
    base = matching.withColumn(SCORE, constant)
    if not words and not phrases:
        return base

    asked = {f for row in [*words, *phrases] for f in row[2]}
    sources = [TextSource(f.name, by_lang=f.type == "text_lang") for f in spec.fields if f.name in asked]
    groups: dict[int, tuple[Analyzer, list[str]]] = {}
    for lang in [*scope.supported_langs(), ""]:
        analyzer = scope.analyzer(lang)
        groups.setdefault(id(analyzer), (analyzer, []))[1].append(lang)
    shape = "query_id int, clause int, text string, fields array<string>, boost double, slop int"

    def scored_by(analyzer: Analyzer, langs: list[str]) -> list[DataFrame]:
        """Scores in the languages of one analyzer, which texts and queries both go through."""
        tokens = token_arrays(docs, spec.id_field, sources, analyzer, scope.supported_langs()).where(F.col("lang").isin(langs))
        asked = [
            spark.createDataFrame([(0, *row) for row in rows], shape)
            .withColumn("words", analyzer.tokens(F.col("text"), F.lit(langs[0]))).drop("text")
            if rows else None
            for rows in (words, phrases)
        ]
        parts = []
        if asked[0] is not None:
            parts.append(clause_scores(tokens, asked[0].drop("slop").withColumn("term", F.explode("words")).drop("words")))
        if asked[1] is not None:
            parts.append(phrase_scores(tokens, asked[1]))
        return parts

    scores = reduce(DataFrame.unionByName, (part for group in groups.values() for part in scored_by(*group)))
    per_clause = scores.groupBy("doc_id", "clause").agg(F.max("score").alias("score"))
    found = per_clause.groupBy("doc_id").agg(
        F.sum(F.when(~F.col("clause").isin(list(gated)), F.col("score")) if gated else F.col("score")).alias("_open"),
        *[F.max(F.when(F.col("clause") == c, F.col("score"))).alias(f"_gated_{c}") for c in gated],
    )
    total = reduce(
        lambda a, b: a + b,
        (F.when(gate, F.coalesce(f"_gated_{c}", F.lit(0.0))).otherwise(F.lit(0.0)) for c, gate in gated.items()),
        F.col(SCORE) + F.coalesce("_open", F.lit(0.0)),
    )
    joined = base.join(found, base[spec.id_field] == found.doc_id, "left")
    return joined.withColumn(SCORE, total).drop("doc_id", "_open", *[f"_gated_{c}" for c in gated])
