"""Benchmark decontamination by pigeonhole edit matching.

A text that holds an item with at most k edits holds at least one of the item's k + 1 pieces unchanged.
One automaton finds all pieces of all items in a single pass over a text; around each hit Myers' bit-parallel
algorithm computes the least edit distance of the item to any passage there.

Items and texts are compared with a space at both ends, so that an item begins and ends where words do: "art" is not
found in "party". A missing word end counts as one edit, which only items with a budget can afford.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import map_rows, utf8

#: Edits allowed in an item, as a share of its normalised length.
ERROR_RATE = 0.08
#: Items matched in one pass over the documents, by their normalised length; more take more passes.
ITEM_BYTES = 8 << 20
#: Letters are lower-cased; ASCII punctuation, control characters and white space become single spaces.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def normalised(text: str | None) -> str:
    """One character per UTF-8 byte."""
    return b" ".join(utf8((text or "").lower()).translate(_TABLE).split()).decode("latin-1")


def budget(length: int, rate: float = ERROR_RATE) -> int:
    return int(length * rate)


def bounded(text: str) -> str:
    """A normalised text whose words all have a space on both sides."""
    return f" {text} "


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets."""
    cuts = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item ready for Myers' algorithm: bit masks of its characters."""

    def __init__(self, text: str):
        self.n = len(text)
        self.masks: dict[str, int] = {}
        for k, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << k

    def search(self, text: str, limit: int) -> tuple[int, int]:
        """Least edit distance to any part of ``text`` and the end of the first such part; stops at distance 0.

        The distance is ``limit + 1`` when there is none within the limit.
        """
        full, high = (1 << self.n) - 1, 1 << (self.n - 1)
        up, down, score = full, 0, self.n
        best, end = limit + 1, 0
        get = self.masks.get
        for k, c in enumerate(text, 1):
            eq = get(c, 0)
            diagonal = (((eq & up) + up) ^ up) | eq | down
            plus = down | (full & ~(diagonal | up))
            minus = up & diagonal
            if plus & high:
                score += 1
            elif minus & high:
                score -= 1
            plus = (plus << 1) & full
            minus = (minus << 1) & full
            up = minus | (full & ~(diagonal | plus))
            down = plus & diagonal
            if score < best:
                best, end = score, k
                if not best:
                    break
        return best, end


class Matcher:
    """All items of one pass."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.items = []
        owners: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            errors = budget(len(text), rate)
            number = len(self.items)
            text = bounded(text)
            self.items.append((item_id, Pattern(text), errors))
            for at, piece in pieces(text, errors):
                owners.setdefault(piece, []).append((number, at))
        for piece, owner in owners.items():
            self.automaton.add_word(piece, (len(piece), owner))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``(item_id, errors, end)`` of the items that ``text`` (normalised) holds."""
        text = bounded(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (length, owner) in self.automaton.iter(text):
            for number, at in owner:
                _, pattern, errors = self.items[number]
                start = last + 1 - length - at
                a, b = max(0, start - errors), min(len(text), start + pattern.n + errors)
                if b - a < pattern.n - errors:
                    continue
                own = windows.setdefault(number, [])
                if own and a <= own[-1][1] and a >= own[-1][0]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
        for number, own in sorted(windows.items()):
            item_id, pattern, errors = self.items[number]
            best, end = errors + 1, 0
            for a, b in own:
                found, at = pattern.search(text[a:b], errors)
                if found < best:
                    best, end = found, a + at
                    if not best:
                        break
            if best <= errors:
                # back to the text without its spaces at the ends, and to before the one behind the passage
                yield item_id, best, max(0, end - 1 - (text[end - 1] == " "))


def item_blocks(items: DataFrame, item_bytes: int = ITEM_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in lists of bounded length; those without a letter or digit match nothing and are left out."""
    held, size = [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        text = normalised(text)
        if text:
            held.append((item_id, text))
            size += len(text)
            if size >= item_bytes:
                yield held
                held, size = [], 0
    if held:
        yield held


def find_contamination(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """Pairs ``doc_id, item_id, errors, end``: documents that hold an item within its error budget.

    Input ``docs (doc_id, text)`` and ``items (item_id, text)``; other columns are ignored. ``errors`` is
    the least edit distance of the normalised item to any passage of the normalised text, both between word ends,
    and ``end`` where the first such passage found ends. Null and empty texts and items match nothing; repeated rows give
    repeated pairs; null ids stay null; an empty table on either side gives an empty result.
    """
    ddl = "doc_id long, item_id long, errors int, end int"
    out = None
    for block in item_blocks(items):

        def run(rows, block=block):
            matcher = Matcher(block, rate)
            for doc_id, text in rows:
                for found in matcher.matches(normalised(text)):
                    yield (doc_id, *found)

        part = map_rows(docs.select("doc_id", "text"), run, ddl)
        out = part if out is None else out.unionAll(part)
    return docs.sparkSession.createDataFrame([], ddl) if out is None else out


def is_contaminated(text: Column, items: DataFrame, rate: float = ERROR_RATE) -> Column:
    """Whether a text holds any of the items; for filters that keep the rows where they are.

    The cases of ``find_contamination`` hold: never null, false for null and empty texts and without items.
    """
    condition = F.lit(False)
    for block in item_blocks(items):
        condition = condition | F.pandas_udf(_holds_any(block, rate), "boolean")(text)
    return condition


def _holds_any(block: list[tuple[int, str]], rate: float):
    import pandas as pd

    def run(parts):
        matcher = Matcher(block, rate)
        for part in parts:
            yield pd.Series([next(matcher.matches(normalised(t)), None) is not None for t in part], dtype=bool)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return run
