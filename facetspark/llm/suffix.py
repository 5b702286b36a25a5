"""Removal of repeated passages by a hash-compared suffix sort.

A byte is removed when a string of LENGTH bytes that covers it also starts in a document with a smaller id.

1. Documents are dealt into hash blocks of bounded size. Each window of LENGTH bytes is represented by the least
   of the hashes of the GRAM-byte strings in it, its anchor; equal windows have equal anchors. Neighbouring
   windows share anchors, so a text has one anchor for about 16 bytes.
2. Blocks send their distinct anchors, anchors that two documents have come back marked.
3. For marked anchors, blocks send the bytes that their windows span, each distinct span once. The windows of an
   anchor at the same offset are suffixes to be sorted, but for those whose prefix hash occurs once there, which
   equal nothing: prefix polynomial hashes and binary search give the common extension of two suffixes, by which a
   merge sort compares them in logarithmic time. Windows found equal are compared byte by byte; the least document of
   each comes back.
4. Blocks mark the windows that a smaller document has, and cut.

What is sent grows with the number of blocks a string occurs in, never with its number of copies, and texts are
shuffled once: the later steps reuse that shuffle.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import arrow_schema, batches_of, block_count, utf8

LENGTH = 50
GRAM = 20
GRAMS = LENGTH - GRAM + 1
#: Bytes of stored documents in a block (about twice that of text).
BLOCK_BYTES = 4 << 20
#: Windows looked at together; their numbers share a word with 46 bits of a hash.
POSITION_BITS = 18
CHUNK = (1 << POSITION_BITS) - 2 * LENGTH
#: Runs of windows marked together.
RUNS = 1 << 14
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
NO_DOC = np.int64(2**63 - 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling."""
    part = {1: data.astype(np.uint64) + np.uint64(1)}
    power, size = {1: _BASE}, 1
    with np.errstate(over="ignore"):
        while 2 * size <= GRAM:
            x = part[size]
            part[2 * size] = x[:-size] * power[size] + x[size:]
            power[2 * size] = power[size] * power[size]
            size *= 2
        value, done, rest = part[size], size, GRAM - size
        while rest:
            step = 1 << (rest.bit_length() - 1)
            n = len(value) - step
            value = value[:n] * power[step] + part[step][done:done + n]
            done, rest = done + step, rest - step
        value = (value ^ (value >> np.uint64(29))) * _M1
        value = (value ^ (value >> np.uint64(32))) * _M2
    return value ^ (value >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, size = len(x) - width + 1, 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:n], x[width - size:width - size + n])


class Block:
    """The documents of a block in a fixed order, and the runs of windows that share an anchor."""

    def __init__(self, doc_ids: list, texts: list):
        rows = sorted(zip(doc_ids, map(utf8, texts)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        self.doc_ids = [r[0] for r in rows]
        sizes = np.array([len(r[1]) for r in rows], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.ends = self.starts + sizes
        self.data = np.frombuffer(b"".join(r[1] for r in rows), np.uint8)
        self.ids = np.array([NO_DOC if i is None else i for i in self.doc_ids], np.int64)
        self._find_runs()
        self.anchors, self.which = np.unique(self.run_anchor, return_inverse=True)

    def _find_runs(self):
        parts = []
        # rows without an id neither lose bytes nor take them from others
        known = int(self.ends[sum(i is not None for i in self.doc_ids) - 1]) if any(i is not None for i in self.doc_ids) else 0
        data = self.data[:known]
        bounds = self.ends.astype(np.int64)
        mask = np.uint64((1 << POSITION_BITS) - 1)
        for a in range(0, max(0, known - LENGTH + 1), CHUNK):
            piece = data[a:a + CHUNK + LENGTH - 1]
            own = np.searchsorted(bounds, np.arange(a, a + len(piece)), "right").astype(np.int32)
            n = len(piece) - LENGTH + 1
            hashes = gram_hashes(piece)
            keyed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
            at = (sliding_min(keyed, GRAMS) & mask).astype(np.int64)
            inside = np.flatnonzero(own[:n] == own[LENGTH - 1:])
            if not len(inside):
                continue
            at = at[inside]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            last = np.append(first[1:], len(at)) - 1
            parts.append((a + inside[first], last - first + 1, a + at[first], hashes[at[first]], own[inside[first]]))
        if not parts:
            parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        #: Start of the first window, number of windows, position and hash of the anchor, row of the document.
        self.run_start, self.run_windows, self.run_at, self.run_anchor, self.run_row = map(np.concatenate, zip(*parts))

    def dealt(self, buckets: int) -> list[tuple[int, np.ndarray]]:
        """Numbers of the distinct anchors by bucket, in order of the anchor."""
        return group_numbers(bucket_of(self.anchors, buckets))

    def repeated(self) -> np.ndarray:
        """Anchors that two documents of this block have."""
        least, most = np.full(len(self.anchors), NO_DOC), np.full(len(self.anchors), np.iinfo(np.int64).min)
        own = self.ids[self.run_row]
        np.minimum.at(least, self.which, own)
        np.maximum.at(most, self.which, own)
        return least != most

    def spans(self, marked: np.ndarray) -> "Spans":
        """The runs of marked anchors, each distinct string once."""
        return Spans(self, np.flatnonzero(marked[self.which]))


class Spans:
    def __init__(self, block: Block, runs: np.ndarray):
        self.runs = runs
        start, size = block.run_start[runs], block.run_windows[runs] + LENGTH - 1
        data = block.data
        keys: dict[tuple, int] = {}
        raw = data.tobytes()
        anchors = block.run_anchor[runs]
        number = np.fromiter(
            (keys.setdefault((x, raw[a:a + n]), len(keys)) for x, a, n in zip(anchors.tolist(), start.tolist(), size.tolist())),
            np.int64, len(runs),
        )
        self.span_of_run = number
        self.text = [k[1] for k in keys]
        self.anchor = np.fromiter((k[0] for k in keys), np.uint64, len(keys))
        self.offset = np.zeros(len(keys), np.int64)
        self.offset[number] = block.run_at[runs] - start
        self.doc = np.full(len(keys), NO_DOC)
        np.minimum.at(self.doc, number, block.ids[block.run_row[runs]])

    def dealt(self, buckets: int):
        return group_numbers(bucket_of(self.anchor, buckets))


def bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors are least hashes, so small ones abound; they are mixed again to be dealt evenly."""
    with np.errstate(over="ignore"):
        anchors = (anchors ^ (anchors >> np.uint64(31))) * _M2
        anchors = (anchors ^ (anchors >> np.uint64(29))) * _M1
    return (((anchors >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def group_numbers(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    return [(int(keys[part[0]]), part) for part in np.split(order, cuts) if len(part)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + size - 1`` of each pair, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


# --- the suffix sort -------------------------------------------------------------


class Suffixes:
    """Compares suffixes of a buffer, up to LENGTH bytes, by prefix polynomial hashes."""

    def __init__(self, data: np.ndarray):
        self.data = np.append(data, np.zeros(LENGTH, np.uint8))
        n = len(self.data)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(n, _BASE)), dtype=np.uint64)
            terms = (self.data.astype(np.uint64) + np.uint64(1)) * self.powers[:n]
            self.prefix = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))

    def equal(self, a, b, size):
        """Whether ``size`` bytes from ``a`` and from ``b`` have the same hash (both moved to one power)."""
        top = len(self.powers) - 1
        with np.errstate(over="ignore"):
            x = (self.prefix[a + size] - self.prefix[a]) * self.powers[top - a]
            y = (self.prefix[b + size] - self.prefix[b]) * self.powers[top - b]
        return x == y

    def common(self, a, b):
        """Length of the common extension, LENGTH at most, by binary search."""
        found = np.zeros(len(a), np.int64)
        step = 1 << (LENGTH.bit_length() - 1)
        while step:
            fits = found + step <= LENGTH
            same = self.equal(a + found, b + found, np.where(fits, step, 0)) & fits
            found += step * same
            step >>= 1
        return found

    def repeated(self, at, segments):
        """Which windows may equal another one of their segment: those whose hash of LENGTH bytes occurs again there."""
        top = len(self.powers) - 1
        with np.errstate(over="ignore"):
            key = (self.prefix[at + LENGTH] - self.prefix[at]) * self.powers[top - at]
            key = (key ^ (segments.astype(np.uint64) * _M1)) * _M2
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        return again

    def less(self, a, b):
        at = self.common(a, b)
        return (at < LENGTH) & (self.data[a + at] < self.data[b + at])

    def bytes_equal(self, a, b):
        same = np.ones(len(a), bool)
        for k in range(LENGTH):
            same &= self.data[a + k] == self.data[b + k]
        return same

    def sort(self, suffixes: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Order of ``suffixes`` in each of the segments (equal numbers, side by side): bottom-up merge sort.

        All merges of a level run together; the rank of an element in the other run is found by binary search.
        """
        order = np.arange(len(suffixes))
        begin = np.flatnonzero(np.append(True, segments[1:] != segments[:-1])) if len(segments) else order
        size = np.diff(np.append(begin, len(segments)))
        begin, size = np.repeat(begin, size), np.repeat(size, size)
        width = 1
        while len(size) and width < size.max():
            live = np.flatnonzero(size > width)
            local = live - begin[live]
            in_right = (local // width) % 2 == 1
            pair = local // (2 * width) * (2 * width)
            other = np.where(in_right, pair, pair + width)
            n_other = np.clip(size[live] - other, 0, width)
            low, high = np.zeros(len(live), np.int64), n_other.copy()
            own = suffixes[order[live]]
            while (open_ := np.flatnonzero(low < high)).size:
                middle = (low[open_] + high[open_]) // 2
                there = suffixes[order[begin[live[open_]] + other[open_] + middle]]
                right = in_right[open_]
                # elements of the left run go before equal ones of the right run
                x, y = np.where(right, own[open_], there), np.where(right, there, own[open_])
                before = np.where(right, ~self.less(x, y), self.less(x, y))
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            rank = local - np.where(in_right, pair + width, pair) + low
            moved = order.copy()
            moved[begin[live] + pair + rank] = order[live]
            order = moved
            width *= 2
        return order


def least_documents(texts: list[bytes], anchor: np.ndarray, offset: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """For each span, the least document that has each of its windows."""
    n = len(texts)
    classes: dict[tuple, int] = {}
    which = np.fromiter((classes.setdefault(k, len(classes)) for k in zip(anchor.tolist(), texts)), np.int64, n)
    first = np.full(len(classes), n)
    np.minimum.at(first, which, np.arange(n))
    class_doc = np.full(len(classes), NO_DOC)
    np.minimum.at(class_doc, which, doc)
    windows = np.fromiter((len(t) - LENGTH + 1 for _, t in classes), np.int64, len(classes))
    starts = np.cumsum(windows) - windows
    least = np.repeat(class_doc, windows)

    _, group, spans_of = np.unique(anchor[first], return_inverse=True, return_counts=True)
    open_ = np.flatnonzero(spans_of[group] > 1)  # an anchor with one distinct span needs no sorting
    if len(open_):
        names = list(classes)
        sizes = windows[open_] + LENGTH - 1
        suffixes = Suffixes(np.frombuffer(b"".join(names[k][1] for k in open_.tolist()), np.uint8))
        at = ragged(np.cumsum(sizes) - sizes, windows[open_])
        window = ragged(starts[open_], windows[open_])
        distance = np.repeat(offset[first[open_]], windows[open_]) - ragged(np.zeros(len(open_), np.int64), windows[open_])
        segment = np.repeat(group[open_], windows[open_]) * GRAMS + distance
        again = np.flatnonzero(suffixes.repeated(at, segment))
        dealt = again[np.argsort(segment[again], kind="stable")]
        at, window, segment = at[dealt], window[dealt], segment[dealt]
        order = suffixes.sort(at, segment)
        at, window = at[order], window[order]
        same = (segment[1:] == segment[:-1]) & (suffixes.common(at[1:], at[:-1]) >= LENGTH)
        same = np.append(np.zeros(min(1, len(at)), bool), same)
        check = np.flatnonzero(same)
        wrong = check[~suffixes.bytes_equal(at[check], at[check - 1])]
        if len(wrong):  # unequal windows with equal hashes: sort those segments by their bytes
            again = np.flatnonzero(np.isin(segment, segment[wrong]))
            raw = suffixes.data.tobytes()
            keyed = sorted(again.tolist(), key=lambda k: (segment[k], raw[at[k]:at[k] + LENGTH]))
            at[again], window[again] = at[keyed], window[keyed]
            same[again] = [
                k > 0 and segment[k] == segment[k - 1] and raw[at[k]:at[k] + LENGTH] == raw[at[k - 1]:at[k - 1] + LENGTH]
                for k in again.tolist()
            ]
        runs = np.flatnonzero(~same)
        lowest = np.minimum.reduceat(least[window], runs)
        least[window] = np.repeat(lowest, np.diff(np.append(runs, len(window))))
    return [least[starts[k]:starts[k] + windows[k]] for k in which.tolist()]


# --- the steps on Spark ----------------------------------------------------------

BLOCK_DDL = "bucket int, blk int, payload binary"
_BLOB = np.dtype("<u8")


def _low48(values: np.ndarray) -> bytes:
    return values.astype(_BLOB).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from48(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view(_BLOB).ravel()


def _table(rows, ddl) -> pa.Table:
    return pa.Table.from_batches(list(batches_of(rows, ddl)), schema=arrow_schema(ddl))


def _block_of(table: pa.Table) -> tuple[int, Block]:
    return table.column("blk")[0].as_py(), Block(table.column("doc_id").to_pylist(), table.column("text").to_pylist())


def _replies(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()))


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, finish=None, ddl: str | None = None) -> DataFrame:
    """Removes repeated passages: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row a document.

    Input ``doc_id``, ``text``; other columns are ignored. Texts are taken as UTF-8 bytes, null as empty; texts
    shorter than LENGTH lose nothing. Strings are judged on the input. Rows with the same id do not take bytes from
    each other; rows without an id neither lose nor take any. An empty table gives an empty result. ``finish(doc_id,
    data, removed)`` can make other rows, of ``ddl``: ``removed`` is a mask over the bytes.
    """
    ddl = ddl or "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    finish = finish or digest
    blocks = block_count(docs, block_bytes)
    texts = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("blk"))

    def send_anchors(table):
        blk, block = _block_of(table)
        repeated = block.repeated().astype(np.uint64)
        rows = (
            (bucket, blk, _low48((block.anchors[part] << np.uint64(1)) | repeated[part]))
            for bucket, part in block.dealt(blocks)
        )
        return _table(rows, BLOCK_DDL)

    def mark_shared(table):
        bucket = table.column("bucket")[0].as_py()
        payloads = table.column("payload").to_pylist()
        sizes = [len(p) // 6 for p in payloads]
        values = _from48(b"".join(payloads))
        _, which, times = np.unique(values >> np.uint64(1), return_inverse=True, return_counts=True)
        shared = (times[which] > 1) | ((values & np.uint64(1)) == 1)
        parts = np.split(shared, np.cumsum(sizes)[:-1])
        rows = ((bucket, blk, np.packbits(p).tobytes()) for blk, p in zip(table.column("blk").to_pylist(), parts))
        return _table(rows, BLOCK_DDL)

    def marked(block, replies):
        out = np.zeros(len(block.anchors), bool)
        for bucket, part in block.dealt(blocks):
            out[part] = np.unpackbits(np.frombuffer(replies[bucket], np.uint8), count=len(part)).astype(bool)
        return out

    def send_spans(table, replies):
        if not len(table):
            return _table((), BLOCK_DDL)
        blk, block = _block_of(table)
        spans = block.spans(marked(block, _replies(replies)))

        def rows():
            for bucket, part in spans.dealt(blocks):
                text = [spans.text[k] for k in part.tolist()]
                head = b"".join([
                    len(part).to_bytes(8, "little"), spans.anchor[part].astype("<u8").tobytes(), spans.doc[part].astype("<i8").tobytes(),
                    spans.offset[part].astype(np.uint8).tobytes(), np.array([len(t) for t in text], np.uint8).tobytes(),
                ])
                yield bucket, blk, zlib.compress(head + b"".join(text), 1)

        return _table(rows(), BLOCK_DDL)

    def compare(table):
        bucket = table.column("bucket")[0].as_py()
        heads = ([], [], [])
        texts, counts = [], []
        for payload in table.column("payload").to_pylist():
            raw = zlib.decompress(payload)
            n = int.from_bytes(raw[:8], "little")
            for k, (kind, a, width) in enumerate((("<u8", 8, 8), ("<i8", 8 + 8 * n, 8), (np.uint8, 8 + 16 * n, 1))):
                heads[k].append(np.frombuffer(raw, kind, n, a))
            at = 8 + 18 * n
            for size in raw[8 + 17 * n:at]:
                texts.append(raw[at:at + size])
                at += size
            counts.append(n)
        anchor, doc, offset = map(np.concatenate, heads)
        least = least_documents(texts, anchor, offset.astype(np.int64), doc)

        def rows():
            at = 0
            for blk, n in zip(table.column("blk").to_pylist(), counts):
                yield bucket, blk, zlib.compress(np.concatenate(least[at:at + n]).astype("<i8").tobytes(), 1)
                at += n

        return _table(rows(), BLOCK_DDL)

    def cut(table, replies):
        if not len(table):
            return _table((), ddl)
        _, block = _block_of(table)
        found = {}
        mark = np.zeros(len(block.anchors), bool)
        for bucket, payload, kind in zip(*(replies.column(c).to_pylist() for c in ("bucket", "payload", "kind"))):
            found[kind, bucket] = payload
        for bucket, part in block.dealt(blocks):
            mark[part] = np.unpackbits(np.frombuffer(found["mark", bucket], np.uint8), count=len(part)).astype(bool)
        spans = block.spans(mark)
        windows = np.array([len(t) - LENGTH + 1 for t in spans.text], np.int64)
        starts = np.cumsum(windows) - windows
        least = np.full(int(windows.sum()), NO_DOC)
        for bucket, part in spans.dealt(blocks):
            least[ragged(starts[part], windows[part])] = np.frombuffer(zlib.decompress(found["least", bucket]), "<i8")
        edge = np.zeros(len(block.data) + LENGTH + 1, np.int8)
        for first in range(0, len(spans.runs), RUNS):
            runs, of = spans.runs[first:first + RUNS], spans.span_of_run[first:first + RUNS]
            n = block.run_windows[runs]
            hit = least[ragged(starts[of], n)] < np.repeat(block.ids[block.run_row[runs]], n)
            edge[ragged(block.run_start[runs], n)[hit]] = 1  # every window starts at a place of its own
        # a byte is covered when one of the LENGTH windows up to it was found
        edge[LENGTH:] -= edge[:-LENGTH].copy()
        removed = np.cumsum(edge, dtype=np.int32)[: len(block.data)] > 0
        rows = (
            finish(i, block.data[a:b], removed[a:b])
            for i, a, b in zip(block.doc_ids, block.starts.tolist(), block.ends.tolist())
        )
        return _table(rows, ddl)

    by_block = texts.groupBy("blk")
    marks = by_block.applyInArrow(send_anchors, BLOCK_DDL).groupBy("bucket").applyInArrow(mark_shared, BLOCK_DDL)
    spans = by_block.cogroup(marks.groupBy("blk")).applyInArrow(send_spans, BLOCK_DDL)
    least = spans.groupBy("bucket").applyInArrow(compare, BLOCK_DDL)
    replies = marks.withColumn("kind", F.lit("mark")).unionByName(least.withColumn("kind", F.lit("least")))
    return by_block.cogroup(replies.groupBy("blk")).applyInArrow(cut, ddl)


def digest(doc_id, data, removed):
    """The columns of ``remove_repeats``."""
    spans = int(removed[0]) + int((removed[1:] & ~removed[:-1]).sum()) if len(removed) else 0
    return doc_id, len(data), int(removed.sum()), spans, hashlib.sha256(data[~removed].tobytes()).hexdigest()


def kept_text(doc_id, data, removed):
    """What is left of a document; cut characters are dropped."""
    return doc_id, data[~removed].tobytes().decode("utf-8", "ignore")
