"""Declarative description of a collection: typed fields, languages, identifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T


class SpecError(ValueError):
    """A request or a declaration does not fit the collection."""


# Declared field types and what they hold in Spark.
SCALAR_TYPES: dict[str, T.DataType] = {
    "keyword": T.StringType(),
    "date": T.LongType(),
    "half_float": T.FloatType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "integer": T.IntegerType(),
    "short": T.ShortType(),
    "long": T.LongType(),
    "unsigned_long": T.DecimalType(20, 0),
    "bool": T.BooleanType(),
    "text": T.StringType(),
    "disabled": T.StringType(),
}
COMPOUND_TYPES = {"scaled_float", "text_lang", "taxonomy", "object", "nested"}
NUMERIC_TYPES = {
    "half_float", "scaled_float", "float", "double", "integer", "short", "long", "unsigned_long", "bool",
}
FACET_TYPES = {"keyword", "bool", "taxonomy", "integer", "float", "double"}
RESERVED_NAMES = {"last_indexed_datetime", "_id"}
MAIN_LANG = "main"
MAX_DEPTH = 10_000


@dataclass(frozen=True)
class FieldSpec:
    """One declared field."""

    name: str
    type: str
    required: bool = False
    input_field: str | None = None
    split: bool = False
    multiple: bool = False
    full_text: bool = False
    facet: bool = False
    taxonomy: str | None = None
    fields: tuple[FieldSpec, ...] = ()
    precision: int = 18
    scale: int | None = None
    sparse: bool = False  # object kept as map<string,double>

    def __post_init__(self):
        if self.type not in SCALAR_TYPES and self.type not in COMPOUND_TYPES:
            raise SpecError(f"unknown type {self.type!r} of field {self.name!r}")
        if self.name in RESERVED_NAMES:
            raise SpecError(f"reserved field name {self.name!r}")
        if self.facet and self.type not in FACET_TYPES:
            raise SpecError(f"field {self.name!r} of type {self.type} cannot be a facet")
        if self.fields and self.type not in ("object", "nested"):
            raise SpecError(f"only object and nested fields have sub-fields, not {self.name!r}")
        if self.type in ("object", "nested") and not (self.fields or self.sparse):
            raise SpecError(f"field {self.name!r} needs sub-fields")
        if self.type == "taxonomy" and not self.taxonomy:
            raise SpecError(f"field {self.name!r} must name its taxonomy")
        if self.type == "scaled_float" and self.scale is None:
            raise SpecError(f"field {self.name!r} needs a scale")

    @property
    def source(self) -> str:
        return self.input_field or self.name

    @property
    def is_numeric(self) -> bool:
        return self.type in NUMERIC_TYPES

    @property
    def is_array(self) -> bool:
        return self.type in ("taxonomy", "nested") or self.split or self.multiple

    def scalar_type(self) -> T.DataType:
        if self.type == "scaled_float":
            return T.DecimalType(self.precision, self.scale)
        if self.type == "taxonomy":
            return T.StringType()
        if self.type in ("object", "nested"):
            if self.sparse:
                return T.MapType(T.StringType(), T.DoubleType())
            return T.StructType([T.StructField(f.name, f.data_type()) for f in self.fields])
        return SCALAR_TYPES[self.type]

    def data_type(self) -> T.DataType:
        if self.type == "text_lang":
            value = T.ArrayType(T.StringType()) if self.split else T.StringType()
            return T.MapType(T.StringType(), value)
        return T.ArrayType(self.scalar_type()) if self.is_array else self.scalar_type()


@dataclass(frozen=True)
class CollectionSpec:
    """A collection of documents: fields, identifier, languages and search defaults."""

    name: str
    fields: tuple[FieldSpec, ...]
    id_field: str
    last_modified_field: str
    langs: tuple[str, ...] = ("en",)
    lang_separator: str = "_"
    split_separator: str = ","
    taxonomies: tuple[str, ...] = ()
    denylist: frozenset[str] = frozenset()
    phrase_boost: float = 2.0
    phrase_slop: int = 0
    scorers: Mapping[str, Scorer] = field(default_factory=dict)
    max_depth: int = MAX_DEPTH

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise SpecError("field names must be unique")
        if self.id_field not in names:
            raise SpecError(f"id field {self.id_field!r} is not declared")
        if self.last_modified_field not in names or self[self.last_modified_field].type != "date":
            raise SpecError(f"last-modified field {self.last_modified_field!r} must be a declared date")
        for f in self.fields:
            if f.taxonomy and f.taxonomy not in self.taxonomies:
                raise SpecError(f"field {f.name!r} names the undeclared taxonomy {f.taxonomy!r}")

    def __getitem__(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise SpecError(f"unknown field {name!r}")

    def __contains__(self, name: str) -> bool:
        return any(f.name == name for f in self.fields)

    @property
    def text_lang_fields(self) -> list[str]:
        return [f.name for f in self.fields if f.type == "text_lang"]

    @property
    def full_text_fields(self) -> list[FieldSpec]:
        return [f for f in self.fields if f.full_text]

    def document_type(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.data_type()) for f in self.fields])

    # --- argument checks -------------------------------------------------

    def resolve(self, path: str) -> FieldSpec:
        """The declared field (or sub-field) behind ``a``, ``a.b`` or ``a:b``."""
        head, *rest = path.replace(":", ".").split(".")
        current = self[head]
        for name in rest:
            if current.sparse:
                return FieldSpec(name, "double")
            if current.type == "text_lang":
                if name != MAIN_LANG and name not in self.langs:
                    raise SpecError(f"unknown language {name!r} in {path!r}")
                return current
            found = [f for f in current.fields if f.name == name]
            if not found:
                raise SpecError(f"unknown field {path!r}")
            current = found[0]
        return current

    def check_facets(self, names: Iterable[str]) -> None:
        for name in names:
            if not self[name].facet:
                raise SpecError(f"field {name!r} is not a facet")

    def check_numeric(self, paths: Iterable[str]) -> None:
        for path in paths:
            if not self.resolve(path).is_numeric:
                raise SpecError(f"field {path!r} is not numeric")

    def check_sort(self, sort_by: str | None) -> None:
        if sort_by is None:
            return
        name = sort_by.removeprefix("-")
        if name not in self.scorers:
            self.resolve(name)

    def check_page(self, page: int, page_size: int) -> None:
        """Whether a request may ask for this page; batch forms have no such bound."""
        check_page_numbers(page, page_size)
        if page * page_size > self.max_depth:
            raise SpecError(f"page * page_size must not exceed {self.max_depth}")


def check_page_numbers(page: int, page_size: int) -> None:
    if page < 1 or page_size < 1:
        raise SpecError("page and page_size start at 1")


@dataclass(frozen=True)
class Scorer:
    """A named scoring expression: ``build(params) -> Column`` with its parameters."""

    build: Callable[[Mapping], Column]
    params: Mapping = field(default_factory=dict)
    static_params: Mapping = field(default_factory=dict)

    def column(self, params: Mapping | None = None) -> Column:
        """Request parameters must have exactly the declared keys; static ones win."""
        given = dict(params or {})
        if set(given) != set(self.params):
            raise SpecError(
                f"missing parameters {sorted(set(self.params) - set(given))}, "
                f"unexpected parameters {sorted(set(given) - set(self.params))}"
            )
        return self.build({**given, **self.static_params})
