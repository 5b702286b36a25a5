"""Chart data: distributions over facet values and point clouds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.operators.facets import DEFAULT_BUCKETS, value_counts
from facetspark.scale import topk_per_group

# Fixed value: the category a distribution does not show.
UNKNOWN = "unknown"


def distribution(df: DataFrame, fields: Sequence[str], k: int = DEFAULT_BUCKETS) -> DataFrame:
    """``(field, category, amount)`` of the top ``k`` values, without the unknown category."""
    top = topk_per_group(value_counts(df, fields), ["field"], [F.desc("count"), F.asc("value")], k)
    return (
        top.where(F.col("value") != UNKNOWN)
        .select("field", F.col("value").alias("category"), F.col("count").alias("amount"))
        .orderBy("field", "category")
    )


def scatter(page: DataFrame, x: str, y: str) -> DataFrame:
    """``(x, y)`` of the hits on a page."""
    return page.select(_path(x).cast("double").alias("x"), _path(y).cast("double").alias("y"))


def scatter_bins(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """``(x, y, amount)`` over all matching documents, on a grid given by its cell widths."""
    def cell(path: str, width: float) -> Column:
        return F.floor(_path(path).cast("double") / width) * F.lit(float(width))

    return (
        df.select(cell(x, x_width).alias("x"), cell(y, y_width).alias("y"))
        .where("x is not null and y is not null")
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("amount"))
    )


def _path(path: str) -> Column:
    head, *rest = path.split(".")
    c = F.col(f"`{head}`")
    for name in rest:
        c = c[name]
    return c
