"""Cutting texts into chunks that tokenise independently.

Byte-level tokenisers of the common split pattern never join a visible character with white space
behind it. So a text may be cut before each run of spaces and line feeds that follows a visible
character, every distinct chunk be encoded once per task, and the results be put together.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+\Z")
#: Other white space could stand before a cut; such a text stays whole.
_ODD = re.compile(r"[^\S \n]|\x00")
#: Texts that are not cut at every space and before every line feed.
_UNEVEN = r"[\t\x0b\x0c\r\x00\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]| $"
#: What a task remembers of chunks, and of words, is bounded in bytes, objects counted; and the texts (bytes) looked at together.
KNOWN_BYTES = 96 << 20
#: What a remembered text and its ids take besides their own bytes.
ENTRY_BYTES = 190
TOGETHER = 16 << 20
#: A chunk is named by its text without the leading space; this stands before one that has neither space nor line feed there.
_BARE = "\x00"


def chunk_names(text: str) -> list[str]:
    """Names of the chunks of a text that is not plainly cut at single spaces and line feeds."""
    return [_BARE + text] if _ODD.search(text) else [_BARE + chunk for chunk in _CHUNK.findall(text)]


def chunk_of(name: str) -> str:
    first = name[:1]
    return name[1:] if first == _BARE else name if first == "\n" else " " + name


def split_words(chunk: str, split: Callable[[str], list[str]]) -> list[str]:
    """The matches of the common pattern in ``chunk``: at once for plain words, else by ``split``."""
    body = chunk[1:] if chunk[:1] in (" ", "\n") else chunk
    ending = body[-1:]
    mark = ending in (".", ",")
    if not (body[:-1] if mark else body).isalpha():
        return split(chunk)
    if chunk[0] == "\n":
        return ["\n", body[:-1], ending] if mark else ["\n", body]
    return [chunk[:-1], ending] if mark else [chunk]


def encode_batches(
    batches: Iterable[pa.RecordBatch], encode: Callable[[list[str]], list[bytes]], kind: str
) -> Iterator[tuple]:
    """Batches of ``(key, text)`` as rows ``(key, ids)``.

    ``encode`` turns new chunks into the bytes of their ids, numbers of the numpy type ``kind``. Cutting, finding the
    distinct chunks and putting ids together are vectorised; Python sees each distinct chunk once a batch.
    """
    known = Remembered()

    def ids_of(names: list[str]) -> list[bytes]:
        known.make_room()
        new = [name for name in names if name not in known]
        known.add(new, encode([chunk_of(name) for name in new]))
        return list(map(known.__getitem__, names))

    def whole(texts: pa.Array) -> list[bytes]:
        marked = pc.replace_substring(pc.binary_join_element_wise(_BARE, texts, ""), "\n", " \n")
        cut = pc.split_pattern(marked, " ")
        coded = cut.flatten().dictionary_encode()
        parts = ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // np.dtype(kind).itemsize
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        ends = np.cumsum(sizes[at])
        total = int(ends[-1]) if len(ends) else 0
        ids = np.frombuffer(b"".join(parts), kind)[np.repeat(starts[at] - ends + sizes[at], sizes[at]) + np.arange(total)]
        rows = np.append(0, ends)[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return [ids[x:y].tobytes() for x, y in zip(rows[:-1].tolist(), rows[1:].tolist())]

    for batch in batches:
        for start, n in _slices(batch):
            part = batch.slice(start, n)
            keys, texts = part.column(0).to_pylist(), pc.fill_null(part.column(1), "")
            odd = pc.match_substring_regex(texts, _UNEVEN)
            plain = iter(whole(texts.filter(pc.invert(odd))))
            for key, text, is_odd in zip(keys, texts, odd.to_pylist()):
                yield key, b"".join(ids_of(chunk_names(text.as_py()))) if is_odd else next(plain)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Runs of rows of about TOGETHER bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return ((a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


class Remembered(dict):
    """Texts and their ids, emptied when they take more than KNOWN_BYTES."""

    size = 0

    def make_room(self):
        if self.size > KNOWN_BYTES:
            self.clear()
            self.size = 0

    def add(self, texts: list[str], ids: list[bytes]):
        self.update(zip(texts, ids))
        self.size += ENTRY_BYTES * len(texts) + sum(map(len, texts)) + sum(map(len, ids))


class WordCache:
    """Chunks by way of their words, each of which is encoded once while it is remembered."""

    def __init__(self, split: Callable[[str], list[str]]):
        self.split, self.known = split, Remembered()

    def encode(self, chunks: list[str], encode_words: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        split = self.split
        pieces = [(c,) if c[:1] == " " and c[1:].isalpha() else split_words(c, split) for c in chunks]
        self.known.make_room()
        new = list(set().union(*pieces).difference(self.known))
        self.known.add(new, encode_words(new))
        get = self.known.__getitem__
        return [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in pieces]
