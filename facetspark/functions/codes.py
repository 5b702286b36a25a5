"""Identifiers as storage paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: nine leading characters in three folders, the rest in a fourth.
CODE_PATTERN = "^(...)(...)(...)(.*)$"


def code_path(code: Column) -> Column:
    """``123/456/789/0123`` of an all-digit code; null for any other.

    Codes of fewer than nine digits stay whole. An owner before a slash moves to the end.
    """
    has_owner = F.contains(code, F.lit("/"))
    owner = F.when(has_owner, F.substring_index(code, "/", 1))
    digits = F.when(has_owner, F.regexp_replace(code, "^[^/]*/", "")).otherwise(code)
    parts = F.filter(
        F.array(*[F.regexp_extract(digits, CODE_PATTERN, i) for i in range(1, 5)]), lambda p: p != ""
    )
    path = F.when(F.length(digits) >= 9, F.array_join(parts, "/")).otherwise(digits)
    return F.when(digits.rlike(r"^\p{Nd}+$"), F.concat_ws("/", path, owner))
