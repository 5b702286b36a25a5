"""Shape of returned documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetspark.specs import MAIN_LANG


def flatten_languages(df: DataFrame, fields: Iterable[str], langs: Sequence[str]) -> DataFrame:
    """Language maps back to ``name`` (main language), ``name_fr``, …, for the languages asked for."""
    fields = set(fields)
    columns = []
    for c in df.columns:
        if c in fields:
            for lang in langs:
                columns.append(F.col(f"`{c}`")[lang].alias(c if lang == MAIN_LANG else f"{c}_{lang}"))
        else:
            columns.append(F.col(f"`{c}`"))
    return df.select(*columns)


def language_columns(df: DataFrame, source: str, separator: str = "_") -> dict[str, str]:
    """``{language: column}`` of ``name`` (key ``main``) and every ``name_xx`` or ``name_xx-YY``."""
    found = {MAIN_LANG: source} if source in df.columns else {}
    for c in df.columns:
        suffix = c.removeprefix(source + separator)
        if suffix != c and _is_lang_code(suffix):
            found[suffix] = c
    return found


def language_map(
    df: DataFrame, source: str, langs: Iterable[str], separator: str = "_",
    split: str | None = None, falsy_as_null: bool = True,
) -> Column:
    """One map from language to text out of the columns of a translated field.

    Other languages than ``langs`` and the main one are left out, as are empty texts; an empty map
    is null.
    """
    wanted = {MAIN_LANG, *langs}
    found = {k: c for k, c in language_columns(df, source, separator).items() if k in wanted}
    if not found:
        kind = T.ArrayType(T.StringType()) if split else T.StringType()
        return F.lit(None).cast(T.MapType(T.StringType(), kind))

    def value(c: str) -> Column:
        text = F.col(f"`{c}`")
        kept = F.when(text != "", text) if falsy_as_null else text
        return F.split(kept, _quoted(split), -1) if split else kept

    keys = F.array(*[F.lit(k) for k in found])
    full = F.map_from_arrays(keys, F.array(*[value(c) for c in found.values()]))
    present = F.map_filter(full, lambda k, v: v.isNotNull())
    return F.when(F.size(present) > 0, present)


def fold_languages(df: DataFrame, field: str, langs: Iterable[str], separator: str = "_", **options) -> DataFrame:
    """``name``, ``name_fr``, ``name_pt-BR``, … replaced by one map column ``name``."""
    used = set(language_columns(df, field, separator).values())
    others = [F.col(f"`{c}`") for c in df.columns if c not in used]
    return df.select(*others, language_map(df, field, langs, separator, **options).alias(field))


def _is_lang_code(suffix: str) -> bool:
    """Two word characters, optionally ``-`` or ``_`` and two more."""
    if len(suffix) == 5 and suffix[2] in "-_":
        suffix = suffix[:2] + suffix[3:]
        return len(suffix) == 4 and all(ch.isalnum() for ch in suffix)
    return len(suffix) == 2 and all(ch.isalnum() or ch == "_" for ch in suffix)


def _quoted(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def project(df: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """Only the named fields, after all post-processing; names that do not exist are passed over."""
    if not fields:
        return df
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in set(fields)])


def post_process(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df
