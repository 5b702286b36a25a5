"""Ingest normalisation: declared fields only, split, typed, falsy values dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetspark.operators.shape import _quoted, language_map
from facetspark.specs import CollectionSpec, FieldSpec

INDEXED_AT = "last_indexed_datetime"


@dataclass(frozen=True)
class Normalized:
    accepted: DataFrame
    rejected: DataFrame


def drop_falsy(c: Column, kind: T.DataType) -> Column:
    """Null for zero, false, the empty string and empty collections."""
    if isinstance(kind, T.BooleanType):
        return F.when(c, c)
    if isinstance(kind, T.NumericType):
        return F.when(c != 0, c)
    if isinstance(kind, T.StringType):
        return F.when(c != "", c)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(c) > 0, c)
    return c


def field_column(df: DataFrame, spec: CollectionSpec, field: FieldSpec, falsy_as_null: bool = True) -> Column:
    """The value of one declared field from its input column."""
    if field.source not in df.columns:
        return F.lit(None).cast(field.data_type())
    c = F.col(f"`{field.source}`")
    kind = df.schema[field.source].dataType
    if falsy_as_null:
        c = drop_falsy(c, kind)
    if field.split and isinstance(kind, T.StringType):
        c = F.split(c, _quoted(spec.split_separator), -1)
    elif field.is_array and not isinstance(kind, T.ArrayType):
        c = F.when(c.isNotNull(), F.array(c))
    if field.type == "taxonomy":
        c = F.array_distinct(c)
    return c.cast(field.data_type())


def normalize_documents(
    df: DataFrame, spec: CollectionSpec, falsy_as_null: bool = True, denied: DataFrame | None = None,
    stamp: bool = True,
) -> Normalized:
    """Documents in the collection's schema, and the rows refused with the reason.

    Refused are rows without an id and those on the deny-list of the spec or of ``denied(id)``.
    """
    key = F.col(f"`{spec[spec.id_field].source}`").cast("string")
    reason = F.when(key.isNull() | (key == ""), F.lit("missing id"))
    if spec.denylist:
        reason = reason.when(key.isin(sorted(spec.denylist)), F.lit("denied id"))
    marked = df.withColumn("_reason", reason)
    if denied is not None:
        ids = denied.select(F.col("id").cast("string").alias("_denied")).distinct()
        marked = marked.join(ids, key == F.col("_denied"), "left").withColumn(
            "_reason", F.when(F.col("_reason").isNull() & F.col("_denied").isNotNull(), F.lit("denied id")).otherwise(F.col("_reason"))
        ).drop("_denied")
    rejected = marked.where(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason")
    good = marked.where(F.col("_reason").isNull()).drop("_reason")
    columns = []
    for f in spec.fields:
        if f.type == "text_lang":
            columns.append(language_map(
                good, f.source, spec.langs, spec.lang_separator,
                spec.split_separator if f.split else None, falsy_as_null,
            ).alias(f.name))
        elif f.name == spec.id_field:
            columns.append(F.col(f"`{f.source}`").cast(f.data_type()).alias(f.name))
        else:
            columns.append(field_column(good, spec, f, falsy_as_null).alias(f.name))
    if stamp:
        columns.append(F.current_timestamp().alias(INDEXED_AT))
    return Normalized(good.select(*columns), rejected)


# What a fetched document can turn out to be.
FOUND, REMOVED, SKIP, RETRY, OTHER = "FOUND", "REMOVED", "SKIP", "RETRY", "OTHER"


@dataclass(frozen=True)
class Routed:
    index: DataFrame
    delete: DataFrame
    retry: DataFrame
    ignored: DataFrame


def route_by_status(df: DataFrame, status: str = "status") -> Routed:
    """Rows to index, to delete, to try again and to leave alone."""
    s = F.upper(F.col(status))
    return Routed(
        df.where(s == FOUND), df.where(s == REMOVED), df.where(s == RETRY),
        df.where(~F.coalesce(s.isin(FOUND, REMOVED, RETRY), F.lit(False))),
    )


def to_bool(c: Column, kind: T.DataType) -> Column:
    """Truth of a loosely typed flag; a missing one is false."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    if isinstance(kind, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    return c.isNotNull()


def keep_map_keys(c: Column, keys: list[str]) -> Column:
    """Only the named entries of a sparse map."""
    return F.map_filter(c, lambda k, v: k.isin(keys))


def copy_main_language(df: DataFrame, fields: list[str], separator: str = "_") -> DataFrame:
    """``name_main`` next to ``name`` for the given translated fields that are present."""
    return df.withColumns({f"{f}{separator}main": F.col(f"`{f}`") for f in fields if f in df.columns})
