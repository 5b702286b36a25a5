"""Text analysis as Column expressions: mapping, folding, tokens, stop words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token: letters, digits and underscores, kept together over an inner "." or ":".
TOKEN_PATTERN = r"[\p{L}\p{N}_]+(?:[.:][\p{L}\p{N}_]+)*"
NON_WORD_PATTERN = r"[^\p{L}\p{N}_]+"
# Letters that fold to more than one, and letters without a decomposition.
FOLD_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "Æ": "AE", "Œ": "OE", "Þ": "TH"}
FOLD_SINGLE = {"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ħ": "h", "ı": "i", "Ø": "O", "Đ": "D", "Ð": "D", "Ł": "L", "Ħ": "H"}
QUOTES = "'’"


@cache
def fold_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode decompositions."""
    pairs = dict(FOLD_SINGLE)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char and base.isascii():
            pairs[char] = base
    return "".join(pairs), "".join(pairs.values())


def fold_diacritics(c: Column) -> Column:
    """Latin letters without their marks."""
    letters, bases = fold_table()
    folded = F.translate(c, letters, bases)
    for letter, pair in FOLD_PAIRS.items():
        folded = F.replace(folded, F.lit(letter), F.lit(pair))
    return folded


def map_taxonomy_chars(c: Column) -> Column:
    """Hyphens become underscores and quotes cut words."""
    return F.translate(c, "-" + QUOTES, "_" + " " * len(QUOTES))


def normalize_term(c: Column) -> Column:
    """Lower case with every run of other than word characters turned into one space."""
    return F.trim(F.regexp_replace(F.lower(c), NON_WORD_PATTERN, " "))


def tokenize(c: Column, pattern: str = TOKEN_PATTERN) -> Column:
    """Lower-cased tokens in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), 0)


def remove_stop_words(tokens: Column, lang: Column | str, stop_words: Mapping[str, Iterable[str]]) -> Column:
    """Tokens without the stop words of the row's language; languages without a list keep all."""
    lang = F.lit(lang) if isinstance(lang, str) else lang
    result = None
    for code, words in sorted(stop_words.items()):
        kept = F.filter(tokens, lambda t: ~t.isin(sorted(words)))
        result = F.when(lang == code, kept) if result is None else result.when(lang == code, kept)
    return tokens if result is None else result.otherwise(tokens)


def default_stop_words(langs: Iterable[str]) -> dict[str, list[str]]:
    """Spark's own stop word lists for two-letter language codes that have one."""
    from pyspark.ml.feature import StopWordsRemover

    # Language codes of the lists Spark ships.
    names = {
        "da": "danish", "nl": "dutch", "en": "english", "fi": "finnish", "fr": "french", "de": "german",
        "hu": "hungarian", "it": "italian", "no": "norwegian", "pt": "portuguese", "ru": "russian",
        "es": "spanish", "sv": "swedish", "tr": "turkish",
    }
    return {code: sorted(set(StopWordsRemover.loadDefaultStopWords(names[code]))) for code in langs if code in names}


@dataclass(frozen=True)
class Analyzer:
    """How text becomes tokens. ``stem`` is a caller's Column function on one token."""

    fold: bool = False
    taxonomy_chars: bool = False
    pattern: str = TOKEN_PATTERN
    stop_words: Mapping[str, Iterable[str]] = field(default_factory=dict)
    stem: Callable[[Column], Column] | None = None

    def tokens(self, text: Column, lang: Column | str = "") -> Column:
        c = map_taxonomy_chars(text) if self.taxonomy_chars else text
        result = tokenize(fold_diacritics(c) if self.fold else c, self.pattern)
        if self.stop_words:
            result = remove_stop_words(result, lang, self.stop_words)
        return F.transform(result, self.stem) if self.stem else result


STANDARD = Analyzer()
FOLDED = Analyzer(fold=True)
TAXONOMY = Analyzer(fold=True, taxonomy_chars=True)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` on a value computed once.

    Inside the lambda of an array function an outer expression is evaluated for every element; a
    value bound this way is not.
    """
    return F.get(F.transform(F.array(value), body), 0)


def suggestion_key(c: Column) -> Column:
    """Folded lower-case text without separators, the key that completion compares."""
    return F.regexp_replace(fold_diacritics(F.lower(c)), NON_WORD_PATTERN, "")


def literal(text: str) -> str:
    """``text`` quoted for use inside a regular expression."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression of a wildcard pattern with ``*`` and ``?``."""
    return "^" + "".join({"*": ".*", "?": "."}.get(ch, literal(ch)) for ch in pattern) + "$"


def glob_regex_column(pattern: Column) -> Column:
    """Column form of :func:`glob_regex`."""
    quoted = F.regexp_replace(pattern, r"([^\p{L}\p{N}_*?])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def deletion_variants(word: Column, distance: int) -> Column:
    """All strings left after deleting up to ``distance`` characters.

    Two words within that edit distance always share a variant, which turns a fuzzy match into an
    equality join followed by an exact check.
    """
    def shorter(words: Column) -> Column:
        return F.flatten(F.transform(words, lambda w: F.when(
            F.length(w) > 0,
            F.transform(F.sequence(F.lit(1), F.length(w)),
                        lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))),
        ).otherwise(F.array().cast("array<string>"))))

    variants = F.array(word)
    for _ in range(distance):
        variants = F.array_distinct(F.concat(variants, shorter(variants)))
    return variants
