"""Token tables: the searchable form of a document table and its statistics.

Everything per document is computed inside its row (token lists, term frequencies), so no shuffle
carries raw tokens; only per-term and per-field totals are aggregated across documents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.functions.text import STANDARD, Analyzer, bind
from facetspark.scale import Request, cut_lineage, measure_request, spread_small


@dataclass(frozen=True)
class TextSource:
    """Where the text of one searchable field lives.

    A language map (``by_lang=True``), or a string column with its language in ``lang`` (a column
    name) or in none, which stands for text without a language.
    """

    field: str
    column: str | None = None
    lang: str | None = None
    by_lang: bool = False

    @property
    def source(self) -> str:
        return self.column or self.field


def token_arrays(
    docs: DataFrame,
    id_col: str,
    sources: Sequence[TextSource],
    analyzer: Analyzer = STANDARD,
    langs: Sequence[str] | None = None,
) -> DataFrame:
    """``(doc_id, field, lang, tokens)``: one row per document, field and language with text.

    Map-only but for small inputs, which are spread over the cores. ``langs`` keeps only those languages (and text without a language).
    """
    def lang_of(s: TextSource) -> Column:
        return F.col(s.lang) if s.lang else F.lit("").cast("string")

    if len(sources) == 1 and not sources[0].by_lang:
        s = sources[0]
        texts = docs.select(
            F.col(id_col).alias("doc_id"), F.lit(s.field).alias("field"),
            lang_of(s).alias("lang"), F.col(s.source).alias("text"),
        )
    else:
        parts = []
        for s in sources:
            if s.by_lang:
                entries = F.transform(
                    F.map_entries(F.col(s.source)),
                    lambda e: F.struct(
                        F.lit(s.field).alias("field"), e["key"].alias("lang"), e["value"].alias("text")
                    ),
                )
                parts.append(F.coalesce(entries, F.array().cast("array<struct<field:string,lang:string,text:string>>")))
            else:
                parts.append(F.array(F.struct(
                    F.lit(s.field).alias("field"), lang_of(s).alias("lang"), F.col(s.source).alias("text")
                )))
        texts = docs.select(F.col(id_col).alias("doc_id"), F.inline(F.concat(*parts)))
    texts = spread_small(texts.where(F.col("text").isNotNull()))
    if langs is not None:
        texts = texts.where(F.col("lang").isin([*langs, ""]))
    return texts.select("doc_id", "field", "lang", analyzer.tokens(F.col("text"), F.col("lang")).alias("tokens"))


def positions(tokens: DataFrame) -> DataFrame:
    """``(doc_id, field, lang, pos, term)`` with positions from 0."""
    return tokens.select("doc_id", "field", "lang", F.posexplode("tokens").alias("pos", "term"))


def run_lengths(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, by sorting it and measuring the runs."""
    def runs(ordered: Column) -> Column:
        marked = F.transform(ordered, lambda t, i: F.struct(t.alias("term"), i.alias("at")))
        starts = F.filter(marked, lambda m: (m["at"] == 0) | (F.get(ordered, m["at"] - 1) != m["term"]))
        return bind(starts, lambda s: F.zip_with(
            s,
            F.slice(s, 2, F.size(ordered)),
            lambda a, b: F.struct(
                a["term"].alias("term"), (F.coalesce(b["at"], F.size(ordered)) - a["at"]).alias("tf")
            ),
        ))

    return bind(F.array_sort(tokens), runs)


def term_frequencies(
    tokens: DataFrame, terms: DataFrame | None = None, request: Request | None = None
) -> DataFrame:
    """``(doc_id, field, lang, length, term, tf)``.

    With ``terms(term)`` only those terms are kept: a limited number by a hash-set filter inside the
    row, before anything is exploded; more by a semi-join.
    """
    request = request or (measure_request(terms, "term") if terms is not None else None)
    rows = tokens.select(
        "doc_id", "field", "lang", F.size("tokens").alias("length"), asked_tokens(request).alias("kept")
    )
    result = rows.select("doc_id", "field", "lang", "length", F.inline(run_lengths(F.col("kept"))))
    if terms is None or request.values is not None:
        return result
    return result.join(terms.select("term").distinct(), "term", "left_semi")


def asked_tokens(request: Request | None) -> Column:
    """The tokens of a row that a request asks for, as far as its values are known."""
    if request is None or request.values is None:
        return F.col("tokens")
    return F.expr(f"filter(tokens, t -> {request.test('t')})")


def request_statistics(tokens: DataFrame, terms: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
    """:func:`field_stats` of a corpus and :func:`vocabulary` of the terms asked for, from one scan.

    Each document contributes its length under a null term besides its terms. The result, of the
    size of the request, is checkpointed because planning and scoring both use it.
    """
    if request.values is None:
        return field_stats(tokens), vocabulary(term_frequencies(tokens, terms, request))
    rows = tokens.select("field", "lang", F.size("tokens").alias("length"), asked_tokens(request).alias("kept"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.col("length").alias("tf")))
    counted = cut_lineage(
        rows.select("field", "lang", F.inline(F.concat(whole, run_lengths(F.col("kept")))))
        .groupBy("field", "lang", "term")
        .agg(F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_tf"))
    )
    stats = counted.where("term is null").select(
        "field", "lang", F.col("doc_freq").alias("n_docs"), F.col("total_tf").alias("n_tokens"),
        (F.col("total_tf") / F.col("doc_freq")).alias("avg_length"),
    )
    return stats, counted.where("term is not null")


def vocabulary(frequencies: DataFrame) -> DataFrame:
    """``(field, lang, term, doc_freq, total_tf)``."""
    return frequencies.groupBy("field", "lang", "term").agg(
        F.count(F.lit(1)).alias("doc_freq"), F.sum("tf").alias("total_tf")
    )


def field_stats(tokens: DataFrame) -> DataFrame:
    """``(field, lang, n_docs, n_tokens, avg_length)``."""
    return tokens.groupBy("field", "lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum(F.size("tokens")).alias("n_tokens"),
        F.avg(F.size("tokens")).alias("avg_length"),
    )


def expand_words(queries: DataFrame, text_col: str, analyzer: Analyzer = STANDARD) -> DataFrame:
    """Query texts to clause rows ``(…, clause, term)``, one clause per word in text order."""
    others = [c for c in queries.columns if c != text_col]
    return queries.select(*others, F.posexplode(analyzer.tokens(F.col(text_col))).alias("clause", "term"))


def in_scope(rows: DataFrame) -> DataFrame:
    """Rows whose field and language the query admits.

    A query table may carry ``fields`` and ``langs`` arrays; null or absent means any.
    """
    for name, column in (("fields", "field"), ("langs", "lang")):
        if name in rows.columns:
            rows = rows.where(F.col(name).isNull() | F.array_contains(name, F.col(column))).drop(name)
    return rows
