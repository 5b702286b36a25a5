"""Ready-made scoring expressions for ``Scorer``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetspark.specs import Scorer


def lookup(c: Column, table: Mapping[str, float], missing: str, default: float = 0.0) -> Column:
    """Value of a grade in a small fixed table; a missing grade reads as ``missing``."""
    pairs = F.create_map(*[F.lit(x) for key, value in sorted(table.items()) for x in (key, float(value))])
    return F.coalesce(pairs[F.coalesce(c.cast("string"), F.lit(missing))], F.lit(default))


def weighted_grade_score(attributes: Sequence[tuple[str, str, str, str]]) -> Scorer:
    """Weighted sum of graded attributes.

    Each attribute is ``(column, weight parameter, table parameter, grade of a missing value)``; the
    tables are static parameters, the weights come with the request.
    """
    def build(params: Mapping) -> Column:
        total = F.lit(0.0)
        for column, weight, table, missing in attributes:
            total = total + lookup(F.col(column), params[table], missing) * F.lit(float(params[weight]))
        return total

    return Scorer(build, params={weight: 1.0 for _, weight, _, _ in attributes})


def with_tables(scorer: Scorer, **tables: Mapping[str, float]) -> Scorer:
    """The scorer with its lookup tables as static parameters."""
    return Scorer(scorer.build, scorer.params, {**scorer.static_params, **tables})
