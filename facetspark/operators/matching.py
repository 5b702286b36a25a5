"""Text matches for a table of queries: words, phrases, wildcards and fuzzy terms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.functions.text import deletion_variants, glob_regex_column
from facetspark.operators.in_task import asked_postings, collect_weights, pattern_counts, phrase_places, scored_documents
from facetspark.operators.postings import asked_tokens, in_scope, run_lengths, term_frequencies, vocabulary
from facetspark.scale import cut_lineage, literal_codes, measure_request


def word_matches(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, clause, doc_id, field, lang)`` for each clause any of whose terms occurs.

    ``queries(query_id, clause, term[, fields, langs])``; several rows of a clause are alternatives.
    """
    request = measure_request(queries, "term")
    joined = in_scope(term_frequencies(tokens, queries, request).join(request.hint(queries), "term"))
    return joined.select("query_id", "clause", "doc_id", "field", "lang").distinct()


def match_all_clauses(tokens: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, doc_id)`` of documents matching every clause of the query in some field.

    A clause without terms is neutral: only clauses present in ``queries`` are required. For a
    request of bounded size the clauses met are counted in the task that holds the document; else
    they are bits of a few numbers per query and document, which map tasks already combine. For
    words of a corpus with one text per document, :func:`match_all_words` does without a shuffle.
    """
    request = measure_request(queries, "term")
    if request.values is not None and request.bounded:
        postings = asked_postings(tokens, request.values)
        scopes = F.broadcast(cut_lineage(postings.select("field", "lang").distinct()))
        coded = queries.where("clause is not null").join(F.broadcast(literal_codes(tokens.sparkSession, request.values)), "term")
        lookup = in_scope(coded.crossJoin(scopes)).select(
            "query_id", "clause", "field", "lang", "code", F.lit(1.0).alias("weight"), F.lit(True).alias("needed"), F.lit(1.0).alias("avg_length")
        )
        clauses = queries.where("clause is not null").select("query_id", "clause", F.lit(True).alias("required")).distinct()
        n_terms = max(len(request.values), 1)
        together = postings.where(F.size("codes") > 0).repartition("doc_id").sortWithinPartitions("doc_id", "field", "lang")
        return scored_documents(together, collect_weights(lookup, clauses, n_terms), n_terms, 0.0, 0.0).select("query_id", "doc_id")
    needed = queries.groupBy("query_id").agg(F.countDistinct("clause").alias("n_clauses"))
    numbered = queries.withColumn("_n", F.dense_rank().over(Window.partitionBy("query_id").orderBy("clause")) - 1)
    asked = numbered.join(request.hint(needed), "query_id").select(
        *[c for c in queries.columns if c != "clause"], "n_clauses",
        F.floor(F.col("_n") / 60).cast("int").alias("_block"),
        F.expr("shiftleft(1L, cast(_n % 60 as int))").alias("_bit"),
    )
    joined = in_scope(term_frequencies(tokens, queries, request).join(request.hint(asked), "term"))
    per_block = joined.groupBy("query_id", "doc_id", "n_clauses", "_block").agg(F.bit_or("_bit").alias("_met"))
    per_doc = per_block.groupBy("query_id", "doc_id", "n_clauses").agg(F.sum(F.bit_count("_met")).alias("n_met"))
    return per_doc.where(F.col("n_met") == F.col("n_clauses")).select("query_id", "doc_id")


def anchor_words(queries: DataFrame, doc_freq: DataFrame | None = None) -> DataFrame:
    """``queries(query_id, words)`` with distinct ``words`` and one ``anchor`` of them each.

    The anchor is the word to look documents up by: the rarest by ``doc_freq(term, doc_freq)``, else
    the longest.
    """
    distinct = queries.select("query_id", F.array_distinct("words").alias("words")).where(F.size("words") > 0)
    if doc_freq is None:
        longest = F.array_max(F.transform("words", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
        return distinct.withColumn("anchor", longest["w"])
    weights = doc_freq.groupBy("term").agg(F.sum("doc_freq").alias("weight"))
    rarest = (
        distinct.select("query_id", F.explode("words").alias("term")).join(weights, "term", "left")
        .groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("weight", F.lit(0)), "term")).alias("anchor"))
    )
    return cut_lineage(distinct.join(rarest, "query_id"))


def all_words_hits(tokens: DataFrame, queries: DataFrame, doc_freq: DataFrame | None = None) -> DataFrame:
    """Documents with every word of a query: ``(query_id, doc_id, field, lang, length, hits)``.

    ``queries(query_id, words array<string>)``; ``tokens`` with one text per document. ``hits`` is
    ``array<struct<term, tf>>`` of the query's words. Documents meet a query only by its anchor word
    and the other words are checked in the row: with broadcast queries nothing is shuffled, and
    common words cost nothing unless a query has no rarer one.
    """
    lookup = anchor_words(queries, doc_freq)
    words = measure_request(queries.select(F.explode("words").alias("term")), "term")
    anchors = measure_request(lookup, "anchor")
    counted = tokens.select("doc_id", "field", "lang", F.size("tokens").alias("length"), asked_tokens(words).alias("kept")).select(
        "doc_id", "field", "lang", "length", run_lengths(F.col("kept")).alias("freqs")
    )
    present = F.expr(f"filter(transform(freqs, f -> f.term), t -> {anchors.test('t')})")
    rows = counted.select("*", F.explode(present).alias("anchor")).join(anchors.hint(lookup), "anchor")
    hits = F.filter("freqs", lambda f: F.array_contains("words", f["term"]))
    return rows.select("query_id", "doc_id", "field", "lang", "length", "words", hits.alias("hits")).where(
        F.size("hits") == F.size("words")
    ).drop("words")


def match_all_words(tokens: DataFrame, queries: DataFrame, doc_freq: DataFrame | None = None) -> DataFrame:
    """``(query_id, doc_id)`` of documents with every word of ``queries(query_id, words)``."""
    return all_words_hits(tokens, queries, doc_freq).select("query_id", "doc_id")


def _pick_slots(window: Column, words: Column, first: Column, slop: Column) -> Column:
    """Smallest window index for each phrase slot, or null when a slot cannot be filled.

    Slot ``j`` may lie at ``first + j … first + j + slop``; equal words never share a token, which
    taking the smallest free index for each slot in turn decides exactly.
    """
    empty = F.array().cast("array<int>")
    slots = F.transform(words, lambda w, j: F.struct(w.alias("w"), j.alias("j")))

    def place(picked: Column, slot: Column) -> Column:
        offsets = F.sequence(F.lit(0), slop)
        spots = F.transform(offsets, lambda d: first + slot["j"] + d)
        taken = F.transform(
            F.filter(
                F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
                lambda s: (s["i"] < slot["j"]) & (s["w"] == slot["w"]),
            ),
            lambda s: F.get(picked, s["i"]),
        )
        free = F.filter(
            spots,
            lambda p: (p >= 0) & (F.get(window, p) == slot["w"]) & ~F.coalesce(F.array_contains(taken, p), F.lit(False)),
        )
        return F.when(picked.isNull(), picked).otherwise(
            F.when(F.size(free) > 0, F.concat(picked, F.array(F.array_min(free))))
        )

    return F.aggregate(slots, empty, place)


def phrase_matches(tokens: DataFrame, phrases: DataFrame, doc_freq: DataFrame | None = None) -> DataFrame:
    """``(query_id, clause, doc_id, field, lang, length, freq)`` for phrases, exact or with slop.

    ``phrases(query_id, clause, words array<string>, slop int[, fields, langs])``. Each phrase is
    looked up by one anchor word: the rarest by ``doc_freq(term, doc_freq)``, else the longest. At
    each occurrence of an anchor the row carries the few tokens around it, so phrases are checked on
    the spot; positions are never joined with each other and common words are never expanded.
    ``freq`` counts the anchor occurrences that belong to a match.
    """
    located = phrases.where(F.size("words") > 0)
    words = located.select(
        "query_id", "clause", F.posexplode("words").alias("anchor_at", "anchor"), F.size("words").alias("n")
    )
    if doc_freq is not None:
        per_term = doc_freq.groupBy("term").agg(F.sum("doc_freq").alias("weight"))
        words = words.join(per_term, words.anchor == per_term.term, "left").drop("term")
        weight = F.coalesce(F.col("weight"), F.lit(0))
    else:
        weight = -F.length("anchor")
    anchors = words.groupBy("query_id", "clause").agg(
        F.min_by(F.struct("anchor", "anchor_at"), F.struct(weight, F.col("anchor_at"))).alias("a")
    ).select("query_id", "clause", "a.anchor", "a.anchor_at")
    lookup = located.join(anchors, ["query_id", "clause"])
    if doc_freq is not None:
        lookup = cut_lineage(lookup)
    asked = measure_request(located.select(F.explode("words").alias("term")), "term")
    if asked.values is not None and asked.bounded:
        return _placed_phrases(tokens, lookup, asked.values)
    span = located.agg(F.max(F.size("words") + F.col("slop"))).first()[0] or 1

    request = measure_request(lookup, "anchor")
    marked = F.expr(f"filter(transform(tokens, (t, i) -> struct(t as anchor, i as at)), m -> {request.test('m.anchor')})")
    around = F.transform(
        marked,
        lambda m: F.struct(
            m["anchor"].alias("anchor"),
            F.least(m["at"], F.lit(span)).alias("centre"),
            F.slice(
                F.col("tokens"),
                F.greatest(m["at"] - span, F.lit(0)) + 1,
                F.least(m["at"], F.lit(span)) + 1 + span,
            ).alias("around"),
        ),
    )
    spots = tokens.select("doc_id", "field", "lang", F.size("tokens").alias("length"), F.inline(around))
    joined = in_scope(spots.join(request.hint(lookup), "anchor"))

    start = F.col("centre") - F.col("anchor_at")
    exact = (start >= 0) & (F.slice("around", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    first = F.sequence(start - F.col("slop"), start)
    sloppy = F.exists(
        first, lambda s: _pick_slots(F.col("around"), F.col("words"), s, F.col("slop")).isNotNull()
    )
    # All words nearby is cheap to see and rules out most places before the slots are tried.
    nearby = F.size(F.array_except("words", "around")) == 0
    return joined.where(nearby).where(F.when(F.col("slop") == 0, exact).otherwise(sloppy)).groupBy("query_id", "clause", "doc_id", "field", "lang", "length").agg(
        F.count(F.lit(1)).alias("freq")
    )


def _placed_phrases(tokens: DataFrame, lookup: DataFrame, terms: list[str]) -> DataFrame:
    """:func:`phrase_matches` for phrases few enough to be sent to every task: texts are compared where they are."""
    found = lookup.where("slop is not null").toArrow()
    names = [c for c in ("query_id", "clause", "fields", "langs") if c in found.column_names]
    numbered = tokens.sparkSession.createDataFrame(
        found.select(names).append_column("number", pa.array(range(len(found)), pa.int32())),
        schema=lookup.select(*names, F.lit(0).alias("number")).schema,
    )
    hits = in_scope(phrase_places(tokens, found, terms).join(F.broadcast(numbered), "number"))
    # rows of one document meet; one shuffle by query and document serves what follows, too
    return hits.repartition("query_id", "doc_id").groupBy("query_id", "clause", "doc_id", "field", "lang", "length").agg(
        F.sum("freq").alias("freq")
    )


def _pattern_keys(pattern: Column) -> Column:
    """Blocking key of a wildcard pattern: its literal start, end or longest inner trigram."""
    head = F.regexp_extract(pattern, r"^([^*?]*)", 1)
    tail = F.regexp_extract(pattern, r"([^*?]*)$", 1)
    inner = F.regexp_extract(pattern, r"([^*?]{3})", 1)
    return (
        F.when(F.length(head) >= 3, F.concat(F.lit("^"), F.substring(head, 1, 3)))
        .when(F.length(tail) >= 3, F.concat(F.lit("$"), F.right(tail, F.lit(3))))
        .when(F.length(inner) == 3, F.concat(F.lit("~"), inner))
        .when(F.length(head) > 0, F.concat(F.lit("^"), head))
        .when(F.length(tail) > 0, F.concat(F.lit("$"), tail))
        .otherwise(F.lit("*"))
    )


def _term_keys(term: Column) -> Column:
    """All keys under which a vocabulary term can be asked for, see :func:`_pattern_keys`."""
    sizes = F.sequence(F.lit(1), F.least(F.length(term), F.lit(3)))
    inner = F.when(
        F.length(term) >= 3,
        F.transform(F.sequence(F.lit(1), F.length(term) - 2), lambda i: F.concat(F.lit("~"), F.substring(term, i, F.lit(3)))),
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(
        F.transform(sizes, lambda n: F.concat(F.lit("^"), F.left(term, n))),
        F.transform(sizes, lambda n: F.concat(F.lit("$"), F.right(term, n))),
        inner,
        F.array(F.lit("*")),
    ))


def expand_wildcards(vocab: DataFrame, patterns: DataFrame) -> DataFrame:
    """Vocabulary terms for patterns with ``*`` and ``?``: the pattern rows with a ``term`` each.

    ``patterns(query_id, clause, pattern, …)``. Terms and patterns meet on a short literal part.
    """
    terms = vocab.select("term").where(F.length("term") > 0).distinct()
    keys = patterns.withColumn("_key", _pattern_keys(F.lower("pattern")))
    keyed = terms.select("term", F.explode(_term_keys(F.col("term"))).alias("_key"))
    request = measure_request(keys, "_key")
    return (
        keyed.where(F.expr(request.test("_key"))).join(request.hint(keys), "_key")
        .where(F.rlike(F.col("term"), glob_regex_column(F.lower("pattern"))))
        .drop("_key")
    )


def count_wildcard_documents(tokens: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(query_id, n_docs)``: how many documents have a word that a pattern expands to, for queries with any.

    ``patterns(query_id, clause, pattern[, fields, langs])``; several patterns of a query are alternatives. Patterns few
    enough to be sent to every task are expanded to the words of its own texts; pairs of a query and a document are
    bits of one row a document. Else the vocabulary is expanded, and meets the texts in a join.
    """
    request = measure_request(patterns, "pattern")
    if request.values is None or not request.bounded or {"fields", "langs"} & set(patterns.columns):
        found = expand_wildcards(vocabulary(term_frequencies(tokens)), patterns)
        return expanded_matches(tokens, found).groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_docs"))
    known = patterns.where("pattern is not null").select("query_id", F.lower("pattern").alias("pattern"))
    return pattern_counts(tokens, known.toArrow(), known.schema["query_id"].dataType.simpleString())


def expand_fuzzy(vocab: DataFrame, words: DataFrame, distance: int) -> DataFrame:
    """Vocabulary terms within ``distance`` edits of each word: word rows with ``term, edits``.

    ``words(query_id, clause, word, …)``. Both sides meet on a shared deletion variant, which every
    pair within the distance has, and the edit distance is then checked exactly.
    """
    # only terms of a length near one asked for can be within the distance; a long junk term makes no variants
    length = F.length(F.lower("word"))  # may be longer than the word
    near = words.select(F.explode(F.sequence(length - distance, length + distance)).alias("_length")).distinct()
    sizes = measure_request(near, "_length").values
    terms = vocab.select("term").distinct()
    if sizes is None:  # too many lengths for a list
        terms = terms.join(near, F.length("term") == F.col("_length"), "left_semi")
    else:
        terms = terms.where(F.length("term").isin(sizes) if sizes else F.lit(False))
    left = terms.select("term", F.explode(deletion_variants(F.col("term"), distance)).alias("_variant"))
    asked = words.withColumn("_variant", F.explode(deletion_variants(F.lower("word"), distance)))
    edits = F.levenshtein(F.col("term"), F.lower("word"), distance)
    request = measure_request(asked, "_variant")
    return (
        left.join(request.hint(asked), "_variant")
        .withColumn("edits", edits)
        .where(F.col("edits") >= 0)
        .drop("_variant")
        .distinct()
    )


def expanded_matches(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """:func:`word_matches` for the terms a pattern or fuzzy word was expanded to.

    The expansion is checkpointed: planning and matching both read it, the vocabulary only once.
    """
    return word_matches(tokens, cut_lineage(terms.select("query_id", "clause", "term").distinct()))
