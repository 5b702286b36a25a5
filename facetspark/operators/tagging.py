"""Texts to taxonomy entries through the synonym table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.functions.text import TAXONOMY, Analyzer
from facetspark.scale import LITERAL_VALUES, broadcast_if_bounded, measure_request


def synonym_spans(synonyms: DataFrame, analyzer: Analyzer = TAXONOMY) -> DataFrame:
    """``(taxonomy, lang, words, n_words, id)``: synonyms analysed like the texts they are met in.

    A phrase shared by several entries stands for the smallest id.
    """
    tokens = analyzer.tokens(F.col("synonym"), F.col("lang"))
    return (
        synonyms.select("taxonomy", "lang", F.array_join(tokens, " ").alias("words"), F.size(tokens).alias("n_words"), "id")
        .where("n_words > 0")
        .groupBy("taxonomy", "lang", "words", "n_words")
        .agg(F.min("id").alias("id"))
    )


def span_matches(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, field, lang, taxonomy, start, n_words, id)`` for every occurrence of a synonym.

    Runs of as many words as some synonym has are made in the row. While the first words of the
    synonyms are few, only runs that begin with one of them are kept before they are exploded.
    """
    lengths = sorted(r[0] for r in spans.select("n_words").distinct().collect())
    firsts = measure_request(spans.select(F.substring_index("words", " ", 1).alias("head")), "head")
    t = F.col("tokens")
    starts = F.expr(f"filter(transform(tokens, (w, i) -> struct(w as w, i as start)), s -> {firsts.test('s.w')})")
    runs = F.flatten(F.transform(starts, lambda s: F.array(*[
        F.struct(
            s["start"].alias("start"),
            F.lit(n).alias("n_words"),
            F.array_join(F.slice(t, s["start"] + 1, n), " ").alias("words"),
        )
        for n in lengths
    ]))) if lengths else F.array().cast("array<struct<start:int,n_words:int,words:string>>")
    fitting = F.filter(runs, lambda r: r["start"] + r["n_words"] <= F.size(t))
    rows = tokens.select("doc_id", "field", "lang", F.inline(fitting))
    return rows.join(firsts.hint(spans), ["lang", "words", "n_words"]).select(
        "doc_id", "field", "lang", "taxonomy", "start", "n_words", "id"
    )


def longest_leftmost(spans: Column) -> Column:
    """From one text's ``array<struct<start, reach, id>>`` the spans met reading from left to right.

    At each place the longest span is taken and reading goes on behind it. ``reach`` is minus the
    number of words, so that the natural order of the structs is the reading order.
    """
    ordered = F.array_sort(spans)
    state = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<start:int,reach:int,id:string>>").alias("kept"))
    return F.aggregate(
        ordered,
        state,
        lambda acc, s: F.when(
            s["start"] >= acc["free"],
            F.struct((s["start"] - s["reach"]).alias("free"), F.concat(acc["kept"], F.array(s)).alias("kept")),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )


def tag_entities(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, field, lang, taxonomy, start, n_words, id)``: the longest synonyms, none overlapping.

    What is gathered per group are the matches within one text.
    """
    found = span_matches(tokens, spans)
    per_text = found.groupBy("doc_id", "field", "lang", "taxonomy").agg(
        F.collect_list(F.struct("start", (-F.col("n_words")).alias("reach"), "id")).alias("spans")
    )
    return per_text.select(
        "doc_id", "field", "lang", "taxonomy", F.inline(longest_leftmost(F.col("spans")))
    ).select("doc_id", "field", "lang", "taxonomy", "start", (-F.col("reach")).alias("n_words"), "id")


def match_taxonomy(docs: DataFrame, id_col: str, field: str, queries: DataFrame, spans: DataFrame, taxonomy: str) -> DataFrame:
    """``(query_id, doc_id)`` of documents whose ids in ``field`` include one the query text names.

    ``queries(query_id, text, lang)``. Hyphens and underscores in ids are one.
    """
    tokens = queries.select(
        F.col("query_id").alias("doc_id"), F.lit("").alias("field"), "lang",
        TAXONOMY.tokens(F.col("text"), F.col("lang")).alias("tokens"),
    )
    tagged = tag_entities(tokens, spans.where(F.col("taxonomy") == taxonomy)).select(
        F.col("doc_id").alias("query_id"), F.col("id").alias("entry")
    )
    literal = tokens.select(F.col("doc_id").alias("query_id"), F.explode("tokens").alias("entry"))
    asked = tagged.unionByName(literal).select("query_id", F.translate("entry", "-", "_").alias("entry")).distinct()
    values = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(F.col(field))).alias("value"))
    return (
        values.withColumn("entry", F.translate("value", "-", "_"))
        .join(broadcast_if_bounded(asked), "entry")
        .select("query_id", "doc_id")
        .distinct()
    )


def resolver(spans: DataFrame) -> Callable[[str, str, Sequence[str]], list[str]]:
    """A lookup for single request texts: taxonomy, text and languages to the words and ids it means.

    Small jobs read only the synonyms made of the text's own words: runs of no more words than the longest
    synonym has, asked for in lists of bounded length, whatever the length of the text.
    """
    longest: dict[str, int] = {}

    def resolve(taxonomy: str, text: str, langs: Sequence[str]) -> list[str]:
        spark = spans.sparkSession
        words = spark.range(1).select(TAXONOMY.tokens(F.lit(text)).alias("t")).first()["t"]
        if not words:
            return []
        own = spans.where(F.col("taxonomy") == taxonomy)
        if taxonomy not in longest:
            longest[taxonomy] = own.agg(F.max("n_words")).first()[0] or 0
        most = longest[taxonomy]
        runs = sorted({" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(i + most, len(words)) + 1)})
        known = {}
        for start in range(0, len(runs), LITERAL_VALUES):
            rows = own.where(F.col("lang").isin(list(langs)) & F.col("words").isin(runs[start:start + LITERAL_VALUES]))
            known |= {r["words"]: r["id"] for r in rows.groupBy("words").agg(F.min("id").alias("id")).collect()}
        out, i = [], 0
        while i < len(words):
            ends = range(min(i + most, len(words)), i, -1)
            end = next((j for j in ends if " ".join(words[i:j]) in known), None)
            out.append(known[" ".join(words[i:end])] if end else words[i])
            i = end or i + 1
        return out

    return resolve
