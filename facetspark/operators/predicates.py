"""Boolean search predicates as a small expression tree that compiles to one Column.

``compile(scope)`` gives a filter over the document row; combinators are ``all_of`` (also what
juxtaposed words mean), ``any_of`` and ``none_of``. Text predicates analyse the field in the row, so
a single query is a map-only scan that Catalyst can push the plain parts of into the source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facetspark.functions.text import STANDARD, Analyzer, bind, glob_regex
from facetspark.operators.matching import _pick_slots
from facetspark.specs import CollectionSpec, FieldSpec, SpecError

Resolver = Callable[[str, str, Sequence[str]], list[str]]


@dataclass(frozen=True)
class Scope:
    """What a predicate is compiled against.

    ``text`` analyses words and phrases (see :func:`analyze`); ``resolver`` turns a query text into
    taxonomy entry ids. Fields are those of ``spec``; without one, plain columns of any type.
    """

    spec: CollectionSpec | None = None
    langs: tuple[str, ...] = ("en",)
    analyzers: Mapping[str, Analyzer] = field(default_factory=dict)
    default_analyzer: Analyzer = STANDARD
    schema: T.StructType | None = None
    resolver: Resolver | None = None

    def analyzer(self, lang: str) -> Analyzer:
        return self.analyzers.get(lang, self.default_analyzer)

    def supported_langs(self) -> list[str]:
        if self.spec is None:
            return list(self.langs)
        known = {*self.spec.langs, "main"}
        return [lang for lang in self.langs if lang in known]

    def field_spec(self, path: str) -> FieldSpec | None:
        return self.spec.resolve(path) if self.spec else None

    def data_type(self, path: str) -> T.DataType | None:
        if self.spec:
            f = self.spec.resolve(path)
            return f.data_type()
        if self.schema is None:
            return None
        current: T.DataType = self.schema
        for name in path.replace(":", ".").split("."):
            if isinstance(current, T.StructType):
                if name not in current.names:
                    raise SpecError(f"unknown field {path!r}")
                current = current[name].dataType
            elif isinstance(current, T.MapType):
                current = current.valueType
            else:
                raise SpecError(f"unknown field {path!r}")
        return current

    def column(self, path: str) -> Column:
        """The column behind ``a``, ``a.b`` or ``a:b``; a missing map key reads as null."""
        head, *rest = path.replace(":", ".").split(".")
        self.data_type(path)
        return reduce(lambda c, name: c[name], rest, F.col(f"`{head}`"))

    def is_array(self, path: str) -> bool:
        return isinstance(self.data_type(path), T.ArrayType)

    def text_columns(self, path: str, langs: Sequence[str] | None = None) -> list[tuple[str, Column]]:
        """``(lang, text column)`` of a text field: one per language for a language map."""
        wanted = list(langs) if langs is not None else self.supported_langs()
        head = path.replace(":", ".").split(".")
        f = self.field_spec(path)
        is_map = f.type == "text_lang" if f else isinstance(self.data_type(path), T.MapType)
        if is_map and len(head) == 1:
            return [(lang, F.col(f"`{path}`")[lang]) for lang in wanted]
        return [("", self.column(path))]


    def words(self, path: str, lang: str, c: Column) -> Column:
        """What word patterns compare with: tokens of text, whole values of keywords."""
        if isinstance(self.data_type(path), T.ArrayType):
            return c
        f = self.field_spec(path)
        if f and f.type == "keyword":
            return F.array(c)
        return self.analyzer(lang).tokens(c, F.lit(lang))


def analyze(text: str, analyzer: Analyzer, lang: str) -> Column:
    """Query text through the analysis of the field, as a constant expression."""
    return analyzer.tokens(F.lit(text), F.lit(lang))


class Predicate:
    """Base of all predicates."""

    boost: float = 1.0

    def compile(self, scope: Scope) -> Column:
        raise NotImplementedError

    def children(self) -> tuple[Predicate, ...]:
        return ()

    def __and__(self, other: Predicate) -> Predicate:
        return all_of(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return any_of(self, other)

    def __invert__(self) -> Predicate:
        return none_of(self)

    def boosted(self, factor: float) -> Predicate:
        return Boosted(self, factor)


def _null_safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Everything(Predicate):
    """The empty query: all documents."""

    def compile(self, scope):
        return F.lit(True)


@dataclass(frozen=True)
class AllOf(Predicate):
    parts: tuple[Predicate, ...]

    def children(self):
        return self.parts

    def compile(self, scope):
        return reduce(lambda a, b: a & b, (p.compile(scope) for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class AnyOf(Predicate):
    parts: tuple[Predicate, ...]

    def children(self):
        return self.parts

    def compile(self, scope):
        return reduce(lambda a, b: a | b, [p.compile(scope) for p in self.parts])


@dataclass(frozen=True)
class NoneOf(Predicate):
    parts: tuple[Predicate, ...]

    def children(self):
        return self.parts

    def compile(self, scope):
        return reduce(lambda a, b: a & b, (~_null_safe(p.compile(scope)) for p in self.parts))


@dataclass(frozen=True)
class Boosted(Predicate):
    part: Predicate
    boost: float

    def children(self):
        return (self.part,)

    def compile(self, scope):
        return self.part.compile(scope)


@dataclass(frozen=True)
class Term(Predicate):
    """Exact value of a keyword, number, boolean or date field; any element of a multi-valued one."""

    field: str
    value: object

    def compile(self, scope):
        c = scope.column(self.field)
        return F.array_contains(c, F.lit(self.value)) if scope.is_array(self.field) else c == F.lit(self.value)


@dataclass(frozen=True)
class Terms(Predicate):
    """Any (or every) one of several exact values."""

    field: str
    values: tuple
    every: bool = False

    def compile(self, scope):
        c = scope.column(self.field)
        if scope.is_array(self.field):
            wanted = F.array(*[F.lit(v) for v in self.values])
            if self.every:
                return F.size(F.array_except(wanted, c)) == 0
            return F.arrays_overlap(c, wanted)
        if self.every:
            return reduce(lambda a, b: a & b, [c == F.lit(v) for v in self.values])
        return c.isin(*self.values)


@dataclass(frozen=True)
class Range(Predicate):
    """Bounds on a field; an absent bound is open; any element of a multi-valued field may fit."""

    field: str
    gte: object = None
    gt: object = None
    lte: object = None
    lt: object = None

    def _within(self, c: Column) -> Column:
        checks = [
            check(c, F.lit(bound))
            for bound, check in (
                (self.gte, lambda c, v: c >= v), (self.gt, lambda c, v: c > v),
                (self.lte, lambda c, v: c <= v), (self.lt, lambda c, v: c < v),
            )
            if bound is not None
        ]
        return reduce(lambda a, b: a & b, checks, c.isNotNull())

    def compile(self, scope):
        c = scope.column(self.field)
        return F.exists(c, self._within) if scope.is_array(self.field) else self._within(c)


@dataclass(frozen=True)
class Exists(Predicate):
    """The field has a value (a non-empty one if multi-valued)."""

    field: str

    def compile(self, scope):
        c = scope.column(self.field)
        kind = scope.data_type(self.field)
        return c.isNotNull() & (F.size(c) > 0) if isinstance(kind, (T.ArrayType, T.MapType)) else c.isNotNull()


@dataclass(frozen=True)
class AnyElement(Predicate):
    """Some element of a nested array meets a condition given on the element."""

    field: str
    condition: Callable[[Column], Column]

    def compile(self, scope):
        return F.exists(scope.column(self.field), self.condition)


@dataclass(frozen=True)
class Match(Predicate):
    """A word on one text field in the requested languages; its tokens are alternatives."""

    field: str
    text: str
    langs: tuple[str, ...] | None = None

    def compile(self, scope):
        f = scope.field_spec(self.field)
        if f and f.type == "taxonomy":
            return MatchTaxonomy(self.field, self.text).compile(scope)
        checks = []
        for lang, c in scope.text_columns(self.field, self.langs):
            analyzer = scope.analyzer(lang)
            query = analyze(self.text, analyzer, lang)
            checks.append((F.size(query) == 0) | _null_safe(F.arrays_overlap(analyzer.tokens(c, F.lit(lang)), query)))
        return reduce(lambda a, b: a | b, checks, F.lit(False))


@dataclass(frozen=True)
class Phrase(Predicate):
    """Consecutive words of one field, with up to ``slop`` moves between them."""

    field: str
    text: str
    slop: int = 0
    langs: tuple[str, ...] | None = None

    def compile(self, scope):
        f = scope.field_spec(self.field)
        if f and f.type == "taxonomy":
            return MatchTaxonomy(self.field, self.text, phrase=True).compile(scope)
        checks = []
        for lang, c in scope.text_columns(self.field, self.langs):
            analyzer = scope.analyzer(lang)
            query, tokens = analyze(self.text, analyzer, lang), analyzer.tokens(c, F.lit(lang))
            if self.slop:
                found = bind(tokens, lambda t: F.exists(
                    F.sequence(F.lit(-self.slop), F.size(t)),
                    lambda s: _pick_slots(t, query, s, F.lit(self.slop)).isNotNull(),
                ))
            else:
                def padded(words: Column) -> Column:
                    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))

                found = F.contains(padded(tokens), padded(query))
            checks.append((F.size(query) == 0) | _null_safe(c.isNotNull() & found))
        return reduce(lambda a, b: a | b, checks, F.lit(False))


@dataclass(frozen=True)
class MatchTaxonomy(Predicate):
    """A text on a taxonomy field: through the synonyms to entry ids, then equality on ids."""

    field: str
    text: str
    phrase: bool = False

    def compile(self, scope):
        f = scope.field_spec(self.field)
        taxonomy = f.taxonomy if f else self.field
        if scope.resolver is None:
            raise SpecError("matching a taxonomy field needs a resolver")
        found = []
        for lang in scope.supported_langs():
            words = scope.resolver(taxonomy, self.text, [lang])
            if not self.phrase or len(words) == 1:
                found.extend(words)
        if not found:
            return F.lit(False)
        ids = [i.replace("-", "_") for i in dict.fromkeys(found)]
        c = scope.column(self.field)
        if scope.is_array(self.field):
            return _null_safe(F.exists(c, lambda v: F.translate(v, "-", "_").isin(ids)))
        return F.translate(c, "-", "_").isin(ids)


def _any_field(scope: Scope, leaf: Callable[[str], Predicate]) -> Column:
    if scope.spec is None:
        raise SpecError("a search in all fields needs a collection spec")
    checks = []
    for f in scope.spec.full_text_fields:
        if f.type == "taxonomy" and scope.resolver is None:
            continue
        checks.append(leaf(f.name).compile(scope))
    return reduce(lambda a, b: a | b, checks, F.lit(False))


@dataclass(frozen=True)
class MatchAny(Predicate):
    """A word in any full-text field and requested language."""

    text: str

    def compile(self, scope):
        return _any_field(scope, lambda name: Match(name, self.text))


@dataclass(frozen=True)
class PhraseAny(Predicate):
    """A phrase in any one full-text field."""

    text: str
    slop: int = 0

    def compile(self, scope):
        return _any_field(scope, lambda name: Phrase(name, self.text, self.slop))


@dataclass(frozen=True)
class Wildcard(Predicate):
    """A word pattern with ``*`` and ``?``; on every full-text field when no field is named."""

    pattern: str
    field: str | None = None

    def compile(self, scope):
        if not self.pattern.strip("*"):
            if self.field is None:
                raise SpecError("a lone * is not a query; use Everything or Exists")
            return Exists(self.field).compile(scope)
        if self.field is None:
            if scope.spec is None:
                raise SpecError("a search in all fields needs a collection spec")
            names = [f.name for f in scope.spec.full_text_fields if f.type != "taxonomy"]
            return reduce(
                lambda a, b: a | b, (Wildcard(self.pattern, n).compile(scope) for n in names), F.lit(False)
            )
        pattern = self.pattern.lower()
        stem = pattern[:-1]
        checks = []
        for lang, c in scope.text_columns(self.field):
            def fits(t: Column) -> Column:
                if pattern.endswith("*") and not set(stem) & set("*?"):
                    return t.startswith(stem)
                return t.rlike(glob_regex(pattern))

            checks.append(_null_safe(F.exists(scope.words(self.field, lang, c), fits)))
        return reduce(lambda a, b: a | b, checks, F.lit(False))


@dataclass(frozen=True)
class Fuzzy(Predicate):
    """A word within an edit distance of ``word``, on a named field only."""

    field: str
    word: str
    distance: int = 2

    def compile(self, scope):
        checks = [
            _null_safe(F.exists(
                scope.words(self.field, lang, c),
                lambda t: F.levenshtein(t, F.lit(self.word.lower()), self.distance) >= 0,
            ))
            for lang, c in scope.text_columns(self.field)
        ]
        return reduce(lambda a, b: a | b, checks, F.lit(False))


def all_of(*parts: Predicate) -> Predicate:
    return parts[0] if len(parts) == 1 else AllOf(tuple(parts))


def any_of(*parts: Predicate) -> Predicate:
    return parts[0] if len(parts) == 1 else AnyOf(tuple(parts))


def none_of(*parts: Predicate) -> Predicate:
    return NoneOf(tuple(parts))


def terms_any(field: str, values: Iterable) -> Predicate:
    return Terms(field, tuple(values))


def terms_all(field: str, values: Iterable) -> Predicate:
    return Terms(field, tuple(values), every=True)


def between_range(field: str, low=None, high=None, include_low: bool = True, include_high: bool = True) -> Predicate:
    """``[low TO high]`` and its half-open forms; ``None`` or ``"*"`` leaves a side open."""
    low, high = (None if v == "*" else v for v in (low, high))
    return Range(
        field,
        gte=low if include_low else None, gt=None if include_low else low,
        lte=high if include_high else None, lt=None if include_high else high,
    )


def gt(field: str, value) -> Predicate:
    return Range(field, gt=value)


def ge(field: str, value) -> Predicate:
    return Range(field, gte=value)


def lt(field: str, value) -> Predicate:
    return Range(field, lt=value)


def le(field: str, value) -> Predicate:
    return Range(field, lte=value)


def facet_filter(selected: Mapping[str, Sequence]) -> Predicate:
    """Selected facet values: any within a facet, all facets together."""
    parts = [terms_any(name, values) for name, values in selected.items() if values]
    return all_of(*parts) if parts else Everything()


def selected_facets(query: Predicate) -> dict[str, list]:
    """Facet selections in a query: top-level ``field:value`` and ``field:(v1 OR v2)`` clauses.

    A field stated twice selects nothing.
    """
    clauses = query.parts if isinstance(query, AllOf) else (query,)
    seen: dict[str, list[list]] = {}
    for clause in clauses:
        if isinstance(clause, Term):
            seen.setdefault(clause.field, []).append([clause.value])
        elif isinstance(clause, Terms) and not clause.every:
            seen.setdefault(clause.field, []).append(list(clause.values))
        elif isinstance(clause, (Match, MatchTaxonomy)):
            seen.setdefault(clause.field, []).append([clause.text])
    return {
        name: [v.strip('"') if isinstance(v, str) else v for v in values[0]]
        for name, values in seen.items()
        if len(values) == 1
    }


def boost_phrases(query: Predicate, boost: float, slop: int = 0) -> Predicate:
    """Each run of two or more neighbouring free words under AND gets an alternative boosted phrase."""
    if isinstance(query, AllOf):
        out: list[Predicate] = []
        run: list[MatchAny] = []

        def close() -> None:
            if len(run) >= 2:
                text = " ".join(w.text for w in run)
                out.append(AnyOf((AllOf(tuple(run)), Boosted(PhraseAny(text, slop), boost))))
            else:
                out.extend(run)
            run.clear()

        for part in query.parts:
            if isinstance(part, MatchAny):
                run.append(part)
            else:
                close()
                out.append(boost_phrases(part, boost, slop))
        close()
        return all_of(*out)
    if isinstance(query, (AnyOf, NoneOf)):
        return replace(query, parts=tuple(boost_phrases(p, boost, slop) for p in query.parts))
    if isinstance(query, Boosted):
        return replace(query, part=boost_phrases(query.part, boost, slop))
    return query


def scored_leaves(
    query: Predicate, boost: float = 1.0, gates: tuple[Predicate, ...] = ()
) -> list[tuple[Predicate, float, tuple[Predicate, ...]]]:
    """Leaves that add to the score with their boosts and gates; those under NOT do not.

    The gates of a leaf are the groups around it that a matching document may miss: parts of an OR. A leaf
    counts only where all of them are met.
    """
    if isinstance(query, (NoneOf, Everything)):
        return []
    if isinstance(query, Boosted):
        return scored_leaves(query.part, boost * query.boost, gates)
    if isinstance(query, AllOf):
        return [leaf for part in query.parts for leaf in scored_leaves(part, boost, gates)]
    if isinstance(query, AnyOf):
        return [
            leaf for part in query.parts
            for leaf in scored_leaves(part, boost, (*gates, part) if _is_group(part) else gates)
        ]
    return [(query, boost, gates)]


def _is_group(query: Predicate) -> bool:
    """Whether parts of ``query`` can be met without the whole."""
    return isinstance(query, AllOf) or isinstance(query, Boosted) and _is_group(query.part)
