"""Full and partial imports as jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from facetspark.operators.normalize import INDEXED_AT, Normalized, normalize_documents
from facetspark.operators.taxonomy import TaxonomyTables
from facetspark.sources.documents import CORRUPT, split_corrupt
from facetspark.sources.versions import merge_into_current, publish_version
from facetspark.specs import CollectionSpec


def prepare_import(
    raw: DataFrame, spec: CollectionSpec, preprocess: Callable[[DataFrame], DataFrame] | None = None,
    denied: DataFrame | None = None,
) -> Normalized:
    """Readable rows, preprocessed and normalised."""
    docs = split_corrupt(raw).documents if CORRUPT in raw.columns else raw
    return normalize_documents(preprocess(docs) if preprocess else docs, spec, denied=denied)


def import_documents(
    raw: DataFrame, spec: CollectionSpec, base: str, buckets: int = 64, partial: bool = False,
    preprocess: Callable[[DataFrame], DataFrame] | None = None, denied: DataFrame | None = None,
) -> None:
    """Full import into a new version behind the collection's name, or a partial one merged into the live version.

    ``buckets`` is for full imports; a partial one keeps those of the live version.
    """
    ready = prepare_import(raw, spec, preprocess, denied).accepted
    if partial:
        merge_into_current(raw.sparkSession, base, spec.name, ready, spec.id_field, spec.last_modified_field)
    else:
        publish_version(ready, base, spec.name, spec.id_field, buckets)


def import_taxonomy(tables: TaxonomyTables, base: str, name: str, preprocess=None) -> None:
    """The tables of a taxonomy as new versions behind ``<name>-nodes``, ``-edges``, ``-names`` and ``-synonyms``."""
    if preprocess:
        tables = preprocess(tables)
    for part in ("edges", "names", "synonyms", "nodes"):
        publish_version(getattr(tables, part), base, f"{name}-{part}")


__all__ = ["INDEXED_AT", "import_documents", "import_taxonomy", "prepare_import"]
