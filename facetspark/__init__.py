"""Faceted document search analytics as PySpark DataFrame jobs."""

from facetspark.specs import CollectionSpec, FieldSpec, SpecError

__all__ = ["CollectionSpec", "FieldSpec", "SpecError"]
