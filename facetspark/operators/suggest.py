"""Autocompletion over taxonomy names and synonyms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetspark.functions.text import deletion_variants, suggestion_key
from facetspark.scale import Request, broadcast_if_bounded, measure_request, spread_small, topk_per_group

# Weight of an entry, and the rules of fuzzy prefixes.
MAX_WEIGHT = 100
FUZZY_MIN_LENGTH = 3
BLOCK = 6


def suggest_table(names: DataFrame, synonyms: DataFrame, langs: Sequence[str]) -> DataFrame:
    """``(taxonomy, lang, id, input, weight, position)``: what may be typed to reach an entry.

    Per entry and supported language its name first, then the synonyms by length; short ids weigh
    more.
    """
    named = names.where(F.col("lang").isin(list(langs)) & F.col("name").isNotNull() & (F.col("name") != ""))
    other = synonyms.where(F.col("lang").isin(list(langs)) & F.col("synonym").isNotNull() & (F.col("synonym") != ""))
    inputs = (
        named.select("taxonomy", "lang", "id", F.col("name").alias("input"), F.lit(1).alias("is_name"))
        .unionByName(other.select("taxonomy", "lang", "id", F.col("synonym").alias("input"), F.lit(0).alias("is_name")))
        .groupBy("taxonomy", "lang", "id", "input")
        .agg(F.max("is_name").alias("is_name"))
    )
    order = Window.partitionBy("taxonomy", "lang", "id").orderBy(
        F.desc("is_name"), F.when(F.col("is_name") == 1, 0).otherwise(F.length("input")), "input"
    )
    return inputs.select(
        "taxonomy", "lang", "id", "input",
        F.greatest(F.lit(MAX_WEIGHT) - F.length("id"), F.lit(0)).alias("weight"),
        F.row_number().over(order).alias("position"),
    )


def prefix_matches(queries: DataFrame, suggest: DataFrame, fuzziness: int = 0) -> DataFrame:
    """Query rows with every suggestion their text begins: ``(query…, taxonomy, lang, id, input, weight, edits)``.

    ``queries(query_id, q[, taxonomies array])``. Case, diacritics and separators do not matter.
    Both sides meet by equality on the first few characters. With ``fuzziness`` some prefix of the
    suggestion lies within that many edits of a text of three or more characters, first characters
    equal; then they meet on a shared deletion variant of those first characters.
    """
    asked = queries.withColumn("_q", suggestion_key(F.col("q"))).where(F.length("_q") > 0)
    targets = suggest.withColumn("_key", suggestion_key(F.col("input"))).where(F.length("_key") > 0)
    exact_asked = asked.withColumn("_block", F.left("_q", F.lit(BLOCK)))
    exact_targets = targets.withColumn("_block", F.explode(F.transform(
        F.sequence(F.lit(1), F.least(F.length("_key"), F.lit(BLOCK))), lambda n: F.left(F.col("_key"), n)
    )))
    request = measure_request(exact_asked, "_block")
    found = exact_targets.where(F.expr(request.test("_block"))).join(request.hint(exact_asked), "_block").where(
        F.col("_key").startswith(F.col("_q"))
    ).withColumn("edits", F.lit(0)).drop("_block")
    if fuzziness:
        found = found.unionByName(_fuzzy_prefixes(asked, targets, fuzziness))
    if "taxonomies" in queries.columns:
        found = found.where(F.col("taxonomies").isNull() | F.array_contains("taxonomies", F.col("taxonomy"))).drop("taxonomies")
    return found.drop("_key", "_q")


def _fuzzy_prefixes(asked: DataFrame, targets: DataFrame, fuzziness: int) -> DataFrame:
    """Suggestions one of whose prefixes is near the text but that the text does not begin."""
    near = asked.where(F.length("_q") >= FUZZY_MIN_LENGTH).withColumn(
        "_cut", F.least(F.length("_q"), F.lit(BLOCK))
    )
    keyed = near.withColumn("_block", F.explode(F.transform(
        deletion_variants(F.left("_q", F.col("_cut")), fuzziness),
        lambda v: F.concat_ws(":", F.col("_cut").cast("string"), F.substring("_q", 1, 1), v),
    )))
    def blocks(cut: int):
        prefixes = F.transform(
            F.sequence(F.lit(max(cut - fuzziness, 1)), F.lit(cut + fuzziness)), lambda n: F.left(F.col("_key"), n)
        )
        variants = F.array_distinct(F.flatten(F.transform(
            F.array_distinct(prefixes), lambda p: deletion_variants(p, fuzziness)
        )))
        return F.transform(variants, lambda v: F.concat_ws(":", F.lit(str(cut)), F.substring("_key", 1, 1), v))

    request = measure_request(keyed, "_block")
    # Only lengths and first characters that are asked for make blocks at all.
    cuts = list(range(FUZZY_MIN_LENGTH, BLOCK + 1))
    if request.values is not None:
        cuts = sorted({int(v.split(":", 1)[0]) for v in request.values})
        firsts = Request(sorted({v.split(":", 2)[1] for v in request.values}), True)
        targets = targets.where(F.expr(firsts.test("substring(_key, 1, 1)")))
    made = F.concat(*[blocks(cut) for cut in cuts]) if cuts else F.array().cast("array<string>")
    every = spread_small(targets).withColumn("_blocks", made)
    spread = every.withColumn("_block", F.expr(f"explode(filter(_blocks, b -> {request.test('b')}))")).drop("_blocks")
    lengths = F.sequence(F.greatest(F.length("_q") - fuzziness, F.lit(1)), F.length("_q") + fuzziness)
    distances = F.filter(
        F.transform(lengths, lambda n: F.levenshtein(F.left(F.col("_key"), n), F.col("_q"), fuzziness)), lambda d: d >= 0
    )
    return (
        spread.join(request.hint(keyed), "_block")
        .drop("_block", "_cut")
        .where(~F.col("_key").startswith(F.col("_q")))
        .withColumn("edits", F.array_min(distances))
        .where(F.col("edits").isNotNull())
        .distinct()
    )


def complete(
    queries: DataFrame, suggest: DataFrame, names: DataFrame, langs: Sequence[str], size: int = 10, fuzziness: int = 0
) -> DataFrame:
    """``(query_id, id, taxonomy, text, name, score, rank)``: suggestions for typed texts.

    In each language the best ``size`` entries, each by its best input; then one row per entry over
    all languages (the first language by name wins), named in the first language asked for, best
    score first.
    """
    found = prefix_matches(queries, suggest.where(F.col("lang").isin(list(langs))), fuzziness)
    best = found.groupBy("query_id", "lang", "taxonomy", "id", "weight").agg(
        F.min(F.struct("edits", "position", "input")).alias("b")
    ).select("query_id", "lang", "taxonomy", "id", "weight", "b.edits", F.col("b.input").alias("text"))
    # One entry per text and language, then the best few of each language.
    by_text = best.groupBy("query_id", "lang", "text").agg(
        F.min(F.struct("edits", (-F.col("weight")).alias("minus"), "id", "taxonomy")).alias("b")
    ).select("query_id", "lang", "text", "b.edits", (-F.col("b.minus")).alias("weight"), "b.id", "b.taxonomy")
    kept = topk_per_group(by_text, ["query_id", "lang"], [F.asc("edits"), F.desc("weight"), F.asc("id"), F.asc("text")], size, "_at")
    merged = kept.groupBy("query_id", "taxonomy", "id").agg(
        F.min(F.struct("lang", "_at", "text", "edits", "weight")).alias("b")
    ).select("query_id", "taxonomy", "id", F.col("b.text").alias("text"), "b.edits", F.col("b.weight").alias("score"))
    shown = names.where(F.col("lang") == langs[0]).select("taxonomy", "id", "name")
    named = shown.join(broadcast_if_bounded(merged), ["taxonomy", "id"], "right")
    order = Window.partitionBy("query_id").orderBy(F.asc("edits"), F.desc("score"), F.asc("id"))
    return named.select(
        "query_id", "id", "taxonomy", "text", F.coalesce("name", F.lit("")).alias("name"), "score",
        F.row_number().over(order).alias("rank"),
    )


def suggestion_label(text, name):
    """``text (name)`` when the name says something else."""
    return F.when(name.isNotNull() & (name != "") & (name != text), F.concat(text, F.lit(" ("), name, F.lit(")"))).otherwise(text)


def strip_lang_prefix(entry_id):
    """``en:some-id`` without its language prefix."""
    return F.regexp_replace(entry_id, "^[a-z]{2}:", "")
