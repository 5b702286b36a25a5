"""Facet buckets: counts per value, the rest, selections and labels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetspark.scale import broadcast_if_bounded, literal_rows, topk_per_group

DEFAULT_BUCKETS = 10
# Key and name of the bucket for all values beyond the kept ones.
OTHER_KEY, OTHER_NAME = "--other--", "Other"


def facet_values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, value)`` of every document: one row per facet field and distinct value.

    All facets are exploded together from one scan of only their columns.
    """
    rows = df.select(F.inline(_entries(df, fields, "value")))
    # Both are stated, so that no branch of a plan adds one of them and stops sharing the shuffle.
    return rows.where(F.col("field").isNotNull() & F.col("value").isNotNull())


def _entries(df: DataFrame, fields: Sequence[str], value_col: str) -> Column:
    """``array<struct<field, value>>`` over all facet fields of a row."""
    parts = []
    for name in fields:
        c = F.col(f"`{name}`")
        values = F.array_distinct(c) if isinstance(df.schema[name].dataType, T.ArrayType) else F.array(c)
        part = F.transform(values, lambda v: F.struct(F.lit(name).alias("field"), v.cast("string").alias(value_col)))
        parts.append(F.coalesce(part, F.array().cast(f"array<struct<field:string,{value_col}:string>>")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def value_counts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, value, count)`` with partial counts in the map tasks and a single shuffle."""
    return facet_values(df, fields).groupBy("field", "value").agg(F.count(F.lit(1)).alias("count"))


def facet_counts(
    df: DataFrame,
    fields: Sequence[str],
    k: int = DEFAULT_BUCKETS,
    selected: Mapping[str, Sequence] | DataFrame | None = None,
    other: bool = True,
) -> DataFrame:
    """``(field, key, name, count, selected, rank)``: the top ``k`` values per field and the rest.

    Selected values come first, also those outside the top (with no count); the rank is the order to
    show. ``selected`` is ``{field: values}`` or a table ``(field, key)``.
    """
    counts = value_counts(df, fields)
    kept = topk_per_group(counts, ["field"], [F.desc("count"), F.asc("value")], k).select(
        "field", F.col("value").alias("key"), "count", "rank", F.lit(False).alias("selected")
    )
    if isinstance(selected, Mapping):
        selected = {f: v for f, v in selected.items() if f in fields}
        selected = selections(df, selected) if selected else None
    elif selected is not None:
        selected = selected.where(F.col("field").isin(list(fields)))
    if selected is not None:
        chosen = selected.select(
            "field", "key", F.lit(None).cast("long").alias("count"), F.lit(k + 1).alias("rank"), F.lit(True).alias("selected")
        )
        kept = kept.unionByName(chosen).groupBy("field", "key").agg(
            F.max("count").alias("count"), F.min("rank").alias("rank"), F.max("selected").alias("selected")
        )
    items = kept.withColumn("name", F.col("key"))
    if other:
        totals = counts.groupBy("field").agg(F.sum("count").alias("count")).select(
            "field", F.lit(OTHER_KEY).alias("key"), "count", F.lit(k + 2).alias("rank"), F.lit(False).alias("selected"),
            F.lit(OTHER_NAME).alias("name"),
        )
        items = items.unionByName(totals)
    # Only k + 1 rows and the selections of a request remain per field here.
    within = Window.partitionBy("field")
    shown = F.coalesce(F.sum(F.when(F.col("rank") <= k, F.col("count"))).over(within), F.lit(0))
    items = items.withColumn("count", F.when(F.col("rank") == k + 2, F.col("count") - shown).otherwise(F.col("count")))
    items = items.where((F.col("rank") < k + 2) | (F.col("count") > 0))
    order = within.orderBy(F.desc("selected"), F.asc("rank"), F.asc("key"))
    return items.withColumn("_order", F.row_number().over(order)).select(
        "field", "key", "name", "count", "selected", F.col("_order").alias("rank")
    )


def selections(df: DataFrame, selected: Mapping[str, Sequence]) -> DataFrame:
    """Facet selections of a request as a table ``(field, key)``."""
    rows = [(name, str(v)) for name, values in selected.items() for v in values]
    return literal_rows(df.sparkSession, rows, "field string, key string")


def facet_matches(df: DataFrame, id_col: str, selections: DataFrame) -> DataFrame:
    """``(query_id, doc_id)`` for a table of selections ``(query_id, field, key)``.

    Any value within a facet, all facets of a query. Values meet selections by equality, and map
    tasks already reduce them to one row per query and document.
    """
    fields = [r[0] for r in selections.select("field").distinct().collect()]
    needed = selections.groupBy("query_id").agg(F.countDistinct("field").alias("n_fields"))
    asked = broadcast_if_bounded(selections.join(needed, "query_id"))
    rows = df.select(F.col(id_col).alias("doc_id"), F.inline(_entries(df, fields, "key")))
    hits = rows.join(asked, ["field", "key"]).groupBy("query_id", "doc_id", "n_fields").agg(
        F.collect_set("field").alias("met")
    )
    return hits.where(F.size("met") == F.col("n_fields")).select("query_id", "doc_id")


def label_facets(
    items: DataFrame, names: DataFrame, lang: str, taxonomies: Mapping[str, str], fallback_lang: str = "en"
) -> DataFrame:
    """Names of facet keys from ``names(taxonomy, id, lang, name)``.

    Tried in turn: the requested language, the language prefix of the entry's id, ``fallback_lang``,
    the key itself. A key without a language prefix stands for any entry ``*:key`` (the smallest id
    that has a label is taken). Names are cut to the languages an item can use and aggregated before the join, and
    the facets are computed once.
    """
    pairs = F.create_map(*[F.lit(x) for pair in taxonomies.items() for x in pair]) if taxonomies else None
    keyed = items.withColumn("taxonomy", pairs[F.col("field")] if pairs is not None else F.lit(None).cast("string"))
    entry = names.select(
        "taxonomy", "id", "lang", "name", F.regexp_replace("id", "^[^:]*:", "").alias("bare")
    ).where(F.col("name").isNotNull() & (F.col("name") != ""))
    useful = entry.where(F.col("lang").isin(lang, fallback_lang) | (F.col("lang") == F.substring_index("id", ":", 1)))
    # Each entry can be asked for by its id and, with a prefix to leave out, by what follows it.
    keys = F.array_distinct(F.array(F.col("id"), F.when(~F.col("bare").contains(":"), F.col("bare")).otherwise(F.col("id"))))
    wanted = useful.select("taxonomy", F.explode(keys).alias("key"), "id", "lang", "name")
    per_entry = wanted.groupBy("taxonomy", "key", "id").agg(
        F.max(F.when(F.col("lang") == lang, F.col("name"))).alias("own"),
        F.max(F.when(F.col("lang") == F.substring_index("key", ":", 1), F.col("name"))).alias("prefix"),
        F.max(F.when(F.col("lang") == fallback_lang, F.col("name"))).alias("fallback"),
    ).select("taxonomy", "key", "id", F.coalesce("own", "prefix", "fallback").alias("label"))
    labels = per_entry.where("label IS NOT NULL").groupBy("taxonomy", "key").agg(F.min_by("label", "id").alias("label"))
    return keyed.join(labels, ["taxonomy", "key"], "left").select(
        "field", "key", F.coalesce("label", "name").alias("name"), "count", "selected", "rank"
    )
