"""Order, pages and totals of a result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetspark.scale import broadcast_if_bounded, cut_lineage, topk_per_group
from facetspark.specs import MAIN_LANG, Scorer, check_page_numbers


def split_sign(sort_by: str) -> tuple[bool, str]:
    """``(descending, name)`` of a sort key with an optional leading minus."""
    return sort_by.startswith("-"), sort_by.removeprefix("-")


def sort_key(df: DataFrame, sort_by: str) -> Column:
    """Ordering by one field: nulls last, multi-valued fields by their least or greatest value, and
    translated text by its main language."""
    descending, name = split_sign(sort_by)
    head, *rest = name.split(".")
    c = F.col(f"`{head}`")
    kind = df.schema[head].dataType
    if isinstance(kind, T.MapType) and not rest:
        c, kind = c[MAIN_LANG], kind.valueType
    for part in rest:
        c = c[part]
        kind = kind.valueType if isinstance(kind, T.MapType) else kind[part].dataType
    if isinstance(kind, T.ArrayType):
        c = F.array_max(c) if descending else F.array_min(c)
    return c.desc_nulls_last() if descending else c.asc_nulls_last()


def sort_documents(df: DataFrame, sort_by: str, id_col: str) -> DataFrame:
    return df.orderBy(sort_key(df, sort_by), F.asc(id_col))


#: Bits of ``monotonically_increasing_id`` that number the rows within a partition.
ROW_BITS = 33


def with_places(ordered: DataFrame, name: str = "place") -> DataFrame:
    """The rows of a sorted result with their place in it, from 1.

    The sort deals ranges to the partitions, so a row's place is its number within its partition behind all rows of
    the partitions before. Only the partitions' counts, a row each, are summed up in one task. The sorted rows are
    checkpointed: sorting again might draw other ranges.
    """
    numbered = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_part", F.shiftrightunsigned("_at", ROW_BITS))
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1
    return numbered.join(broadcast_if_bounded(starts), "_part").select(*ordered.columns, place.alias(name))


def page(df: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """One page of the ordered result; Spark keeps only the rows up to its end in each task."""
    check_page_numbers(page, page_size)
    return df.orderBy(*order).offset(page_size * (page - 1)).limit(page_size)


def page_per_query(df: DataFrame, order: Sequence[Column], page: int, page_size: int) -> DataFrame:
    """The same page of each query of ``df(query_id, …)``, with ranks over the whole result."""
    check_page_numbers(page, page_size)
    top = topk_per_group(df, ["query_id"], list(order), page * page_size)
    return top.where(F.col("rank") > page_size * (page - 1))


def result_summary(df: DataFrame, page_size: int, keys: Sequence[str] = (), cap: int | None = None) -> DataFrame:
    """``(…keys, count, page_count, is_count_exact)``; with ``cap`` larger counts are cut and flagged."""
    n = F.count(F.lit(1))
    counted = df.groupBy(*keys).agg(n.alias("n")) if keys else df.agg(n.alias("n"))
    count = F.least(F.col("n"), F.lit(cap)) if cap is not None else F.col("n")
    return counted.select(
        *keys,
        count.cast("long").alias("count"),
        F.ceil(count / page_size).cast("long").alias("page_count"),
        (F.col("n") <= cap if cap is not None else F.lit(True)).alias("is_count_exact"),
    )


def score_by(df: DataFrame, scorer: Scorer, params: Mapping | None = None, name: str = "score") -> DataFrame:
    """A named scoring expression as a column, with checked request parameters."""
    return df.withColumn(name, scorer.column(params))


def score_by_profiles(df: DataFrame, scorer: Scorer, profiles: Mapping[str, Mapping], name: str = "score") -> DataFrame:
    """The scorer under several parameter sets at once: rows ``(profile, …, score)``.

    The scores are computed side by side in the row and then turned into rows, without a join.
    """
    scores = F.array(*[
        F.struct(F.lit(profile).alias("profile"), scorer.column(params).alias(name))
        for profile, params in sorted(profiles.items())
    ])
    return df.select("*", F.inline(scores))


def score_by_params_table(
    df: DataFrame, scorer: Scorer, params: DataFrame, key: str = "query_id", name: str = "score"
) -> DataFrame:
    """The scorer with the parameters that a table holds for each row's ``key``.

    ``params(key, param, value)`` is of the size of the requests: its rows become one map a key, which is broadcast
    while it is small and met by equality. As with :func:`score_by` the parameters of a key must be exactly those the
    scorer declares, or the job fails and names the key; static ones win. Rows whose key has no parameters are
    dropped, as a request without them cannot be asked.
    """
    asked = sorted(scorer.params)
    maps = params.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("param", "value"))).alias("_params"))
    given = F.array_sort(F.map_keys("_params"))
    wanted = F.array(*[F.lit(p) for p in asked]).cast("array<string>")
    wrong = F.concat(
        F.lit("parameters of "), F.col(key).cast("string"), F.lit(" are "), F.array_join(given, ", "),
        F.lit("; expected " + ", ".join(asked)),
    )
    checked = maps.withColumn("_params", F.when(given == wanted, F.col("_params")).otherwise(F.raise_error(wrong)))
    joined = df.join(broadcast_if_bounded(checked), key)
    return joined.withColumn(name, scorer.build({**{p: F.col("_params")[p] for p in asked}, **scorer.static_params})).drop("_params")
