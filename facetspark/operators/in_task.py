"""Requests scored on whole documents inside the tasks that hold them.

For requests small enough to be sent to every task. What is shuffled are a document's own asked words, once, however
many queries share them; pairs of queries and documents are made and reduced batch by batch and never leave the task,
but for those that are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from facetspark.scale import scratch_path

#: Cells (documents and fields times clauses) that a task adds up at once.
CELLS = 1 << 20


def asked_postings(tokens: DataFrame, terms: list[str]) -> DataFrame:
    """``(doc_id, field, lang, length, codes, tfs)`` of every row of ``tokens``, written once and read again.

    ``codes`` are the row's distinct words that are asked for, as places in ``terms``.
    """
    asked = pa.array(terms, pa.string())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=asked), -1).to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(sizes)), sizes)[codes >= 0]
            keys, tfs = np.unique(rows * max(len(terms), 1) + codes[codes >= 0], return_counts=True)
            at = pa.array(np.searchsorted(keys, np.arange(len(sizes) + 1) * max(len(terms), 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("field"), batch.column("lang"), pa.array(sizes.astype(np.int32)),
                pa.ListArray.from_arrays(at, pa.array((keys % max(len(terms), 1)).astype(np.int32))),
                pa.ListArray.from_arrays(at, pa.array(tfs.astype(np.int32))),
            ], names=["doc_id", "field", "lang", "length", "codes", "tfs"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    path = scratch_path(tokens.sparkSession, "asked-postings")
    schema = f"doc_id {kind}, field string, lang string, length int, codes array<int>, tfs array<int>"
    tokens.select("doc_id", "field", "lang", "tokens").mapInArrow(count, schema).write.parquet(path)
    return tokens.sparkSession.read.parquet(path)


@dataclass
class Weights:
    """A request as arrays: what each word of a field and language adds to which clauses.

    Clauses are columns, those of a query side by side from ``starts`` on. The words of a scope (field and language)
    lie in ``columns``, ``weights`` and ``needed`` from ``first[scope, code]`` on, ``many[scope, code]`` of them.
    """

    queries: pa.Array
    query_kind: str
    starts: np.ndarray
    required: np.ndarray
    n_columns: int
    scopes: dict
    avg_length: np.ndarray
    first: np.ndarray
    many: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    needed: np.ndarray


def collect_weights(lookup: DataFrame, clauses: DataFrame, n_terms: int) -> Weights:
    """``lookup(query_id, clause, field, lang, code, weight, needed, avg_length)`` and all ``clauses(query_id, clause,
    required)`` of a request of bounded size, the same for every task."""
    asked = clauses.toArrow()
    order = pc.dictionary_encode(asked.column("query_id").combine_chunks(), null_encoding="encode")
    queries = order.dictionary
    numbers = order.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    by_query = np.argsort(numbers, kind="stable")
    ids, marks = asked.column("query_id").to_pylist(), asked.column("clause").to_pylist()
    column_of = {(ids[i], marks[i]): c for c, i in enumerate(by_query)}
    flags = asked.column("required").to_numpy().astype(np.int64)
    required = np.bincount(numbers, weights=flags, minlength=len(queries)).astype(np.int64)
    starts = np.searchsorted(numbers[by_query], np.arange(len(queries)))

    rows = lookup.toArrow()
    fields, langs = rows.column("field").to_pylist(), rows.column("lang").to_pylist()
    scopes = {key: i for i, key in enumerate(dict.fromkeys(zip(fields, langs)))}
    scope = np.array([scopes[key] for key in zip(fields, langs)], np.int64)
    column = np.array([column_of[key] for key in zip(rows.column("query_id").to_pylist(), rows.column("clause").to_pylist())], np.int64)
    average = np.ones(max(len(scopes), 1))
    average[scope] = rows.column("avg_length").to_numpy()
    key = scope * n_terms + rows.column("code").to_numpy().astype(np.int64)
    ordered = np.argsort(key, kind="stable")
    many = np.bincount(key, minlength=max(len(scopes), 1) * n_terms)
    return Weights(
        queries, clauses.schema["query_id"].dataType.simpleString(), starts, required, len(by_query), scopes, average, np.cumsum(many) - many, many,
        column[ordered], rows.column("weight").to_numpy()[ordered], rows.column("needed").to_numpy().astype(bool)[ordered],
    )


def scope_numbers(field: pa.Array, lang: pa.Array, scopes: dict) -> np.ndarray:
    """The number of each row's field and language, -1 where nothing is asked in them."""
    parts = [pc.dictionary_encode(x, null_encoding="encode") for x in (field, lang)]
    names = [x.dictionary.to_pylist() for x in parts]
    table = np.array([[scopes.get((f, g), -1) for g in names[1]] for f in names[0]], np.int64).reshape(len(names[0]), len(names[1]))
    return table[tuple(x.indices.to_numpy(zero_copy_only=False) for x in parts)]


def scored_documents(
    postings: DataFrame, request: Weights, n_terms: int, k1: float, b: float, k: int | None = None, slack: float = 0.0,
    terms: list[str] | None = None, least: np.ndarray | None = None,
) -> DataFrame:
    """``(query_id, doc_id, score)`` of documents that meet all required clauses of a query, or any if none is.

    ``postings`` as of :func:`asked_postings`, all rows of a document in one partition, sorted by document, field and
    language; or with ``terms`` one row a document, with an array ``held(field, lang, term, tf, length)`` of its words. Words of a clause add up in a field and language, the best of
    these counts, clauses add up. With ``k`` a task leaves out what ``k`` others of its documents surpass by more than
    ``slack``; with ``least`` what lies that far below a query's given score.
    """
    kind = postings.schema["doc_id"].dataType.simpleString()
    asked = pa.array(terms, pa.string()) if terms is not None else None
    step = max(1, CELLS // max(request.n_columns, 1))
    any_required = bool(request.needed.any())
    doc_type = to_arrow_type(postings.schema["doc_id"].dataType)

    def unpack(batch):
        """Rows sorted by document and scope (its place in the batch, scope, length), and postings (row, code, frequency)."""
        ids = pc.dictionary_encode(batch.column("doc_id"), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        if asked is None:
            scope = scope_numbers(batch.column("field"), batch.column("lang"), request.scopes)
            at = np.repeat(np.arange(len(ids)), pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False))
            codes, tfs = batch.column("codes").flatten(), batch.column("tfs").flatten()
            return ids, np.arange(len(ids)), scope, batch.column("length"), at, codes.to_numpy(zero_copy_only=False), tfs
        place = np.repeat(np.arange(len(ids)), pc.list_value_length(batch.column("held")).to_numpy(zero_copy_only=False))
        field, lang, term, tf, length = batch.column("held").flatten().flatten()
        scope = scope_numbers(field, lang, request.scopes)
        order = np.argsort(place * (len(request.scopes) + 1) + scope, kind="stable")
        codes = pc.fill_null(pc.index_in(term, value_set=asked), -1).to_numpy(zero_copy_only=False)[order]
        at = np.flatnonzero(codes >= 0)
        return ids, place[order], scope[order], length.take(pa.array(order)), at, codes[at], tf.take(pa.array(order[at]))

    def parts(batches):
        """Documents (values), and for their groups the document, the scope and the sums and counts of each clause."""
        for batch in batches:
            ids, place, scope, length, row, code, tf = unpack(batch)
            if not len(place):
                continue
            sizes, number = length.to_numpy(zero_copy_only=False).astype(np.float64), ids[place]
            new = np.ones(len(scope), bool)
            new[1:] = (number[1:] != number[:-1]) | (scope[1:] != scope[:-1])
            group = np.cumsum(new) - 1
            heads = np.flatnonzero(new)
            known = scope[row] >= 0
            row, code, tf = row[known], code[known].astype(np.int64), tf.to_numpy(zero_copy_only=False)[known].astype(np.float64)
            key = scope[row] * n_terms + code
            weigh = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[row] / request.avg_length[scope[row]]))
            at_group = group[row]
            for lo in range(0, len(heads), step):
                own = heads[lo:lo + step]
                here = slice(*np.searchsorted(at_group, [lo, lo + len(own)]))
                n = request.many[key[here]]
                ends = np.cumsum(n)
                entry = np.repeat(request.first[key[here]] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
                cell = np.repeat(at_group[here] - lo, n) * request.n_columns + request.columns[entry]
                shape, cells = (len(own), request.n_columns), len(own) * request.n_columns
                sums = np.bincount(cell, np.repeat(weigh[here], n) * request.weights[entry], cells).reshape(shape)
                met = (np.bincount(cell, minlength=cells) > 0).reshape(shape)
                needed = (np.bincount(cell[request.needed[entry]], minlength=cells) > 0).reshape(shape) if any_required else met.copy()
                first = np.ones(len(own), bool)
                first[1:] = number[own[1:]] != number[own[:-1]]
                docs = batch.column("doc_id").take(pa.array(place[own[first]])).to_pylist()
                yield docs, np.cumsum(first) - 1, scope[own], np.where(met, sums, -np.inf), needed

    def results(docs, doc, best, needed, top):
        starts = np.searchsorted(doc, np.arange(len(docs)))
        best = np.maximum.reduceat(best, starts, axis=0)
        met = best > -np.inf
        scores = np.add.reduceat(np.where(met, best, 0.0), request.starts, axis=1)
        valid = np.add.reduceat(met, request.starts, axis=1, dtype=np.int64) > 0
        if any_required or request.required.any():
            there = np.logical_or.reduceat(needed, starts, axis=0) if any_required else np.zeros_like(met)
            valid &= np.add.reduceat(there, request.starts, axis=1, dtype=np.int64) == request.required
        if least is not None:
            valid &= scores + slack >= least
        if k is not None:
            top[:] = -np.partition(-np.concatenate([top, np.where(valid, scores, -np.inf)]), k - 1, axis=0)[:k]
            valid &= scores + slack >= top.min(axis=0)
        at, query = np.nonzero(valid)
        return pa.RecordBatch.from_arrays(
            [request.queries.take(pa.array(query)), pa.array([docs[i] for i in at], doc_type), pa.array(scores[at, query])],
            names=["query_id", "doc_id", "score"],
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.full((k or 1, len(request.queries)), -np.inf)
        held = None  # the last document, which the next rows may continue
        for docs, doc, scope, best, needed in parts(batches):
            if held is not None:
                same = held[0] == docs[0]
                if same and held[1][-1] == scope[0]:
                    low, high = held[2][-1], best[0]
                    best[0] = np.where(low == -np.inf, high, np.where(high == -np.inf, low, low + high))
                    needed[0] |= held[3][-1]
                    held = (held[0], *(x[:-1] for x in held[1:]))
                docs = docs if same else [held[0], *docs]
                doc = np.concatenate([np.zeros(len(held[1]), np.int64), doc + (not same)])
                scope, best, needed = (np.concatenate([x, y]) for x, y in zip(held[1:], (scope, best, needed)))
            last = int(np.searchsorted(doc, len(docs) - 1))
            if len(docs) > 1:
                yield results(docs[:-1], doc[:last], best[:last], needed[:last], top)
            # groups of the open document that stand for no scope asked for add nothing
            held = (docs[-1], scope[last:], best[last:], needed[last:])
        if held is not None:
            yield results([held[0]], np.zeros(len(held[1]), np.int64), held[2], held[3], top)

    if not request.n_columns:
        return postings.sparkSession.createDataFrame([], f"query_id {request.query_kind}, doc_id {kind}, score double")
    return postings.mapInArrow(score, f"query_id {request.query_kind}, doc_id {kind}, score double")


def phrase_places(tokens: DataFrame, phrases: pa.Table, terms: list[str]) -> DataFrame:
    """``(number, doc_id, field, lang, length, freq)``: anchor occurrences that belong to a match, by row of ``tokens``.

    ``phrases(words, slop, anchor, anchor_at)``, the same for every task; ``number`` is a phrase's place in them. Slot
    ``j`` of a phrase may lie at ``first + j … first + j + slop``; equal words never share a token, which taking the
    smallest free place for each slot in turn decides exactly.
    """
    asked = pa.array(terms, pa.string())
    code_of = {t: i for i, t in enumerate(terms)}
    words = [[code_of.get(w, -2) for w in row] for row in phrases.column("words").to_pylist()]
    slops, at = (phrases.column(c).to_numpy().astype(np.int64) for c in ("slop", "anchor_at"))
    anchors = np.array([code_of[w] for w in phrases.column("anchor").to_pylist()], np.int64)
    groups = []  # phrases of one length and slop are compared at once, those of an anchor side by side
    for n, slop in sorted(set(zip(map(len, words), slops.tolist()))):
        number = np.array([i for i in np.argsort(anchors, kind="stable") if len(words[i]) == n and slops[i] == slop], np.int64)
        many = np.bincount(anchors[number], minlength=len(terms))
        groups.append((n, slop, number, np.array([words[i] for i in number], np.int64), at[number], np.cumsum(many) - many, many))

    def filled(codes, low, high, first, wanted, slop):
        """Which candidates have every slot filled, by their place of slot 0, row bounds and words."""
        left = np.arange(len(first))
        picks = []
        for j in range(wanted.shape[1]):
            pick = np.full(len(left), -1)
            for d in range(slop, -1, -1):
                spot = first[left] + j + d
                fits = (spot >= low[left]) & (spot < high[left])
                fits &= codes[np.where(fits, spot, 0)] == wanted[left, j]
                for i, other in enumerate(picks):
                    if slop:
                        fits &= ~((wanted[left, i] == wanted[left, j]) & (other == spot))
                pick = np.where(fits, spot, pick)
            kept = pick >= 0
            left, picks = left[kept], [x[kept] for x in (*picks, pick)]
        return left

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = pc.fill_null(pc.index_in(lists.flatten(), value_set=asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            for n, slop, number, wanted, anchor_at, first, many in groups:
                places = np.flatnonzero((codes >= 0) & (many[codes] > 0))
                totals = np.cumsum(many[codes[places]])
                cuts = np.searchsorted(totals, np.arange(0, totals[-1] if len(totals) else 0, CELLS))
                for lo, hi in zip(cuts, [*cuts[1:], len(places)]):
                    spots = places[lo:hi]
                    times = many[codes[spots]]
                    until = np.cumsum(times)
                    phrase = np.repeat(first[codes[spots]] - (until - times), times) + np.arange(until[-1] if len(until) else 0)
                    place = np.repeat(spots, times)
                    high, low = ends[row[place]], (ends - sizes)[row[place]]
                    met = np.zeros(len(place), bool)
                    for back in range(slop + 1):
                        open_ = np.flatnonzero(~met)
                        start = place[open_] - anchor_at[phrase[open_]] - back
                        met[open_[filled(codes, low[open_], high[open_], start, wanted[phrase[open_]], slop)]] = True
                    keys, freq = np.unique(row[place[met]] * len(number) + phrase[met], return_counts=True)
                    found = pa.array(keys // max(len(number), 1))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(number[keys % max(len(number), 1)].astype(np.int32)),
                        *(batch.column(c).take(found) for c in ("doc_id", "field", "lang")),
                        pa.array(sizes.astype(np.int32)).take(found), pa.array(freq.astype(np.int64)),
                    ], names=["number", "doc_id", "field", "lang", "length", "freq"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    schema = f"number int, doc_id {kind}, field string, lang string, length int, freq bigint"
    return tokens.select("doc_id", "field", "lang", "tokens").mapInArrow(find, schema)


class PatternSet:
    """Wildcard patterns, looked up by a literal part of up to three characters and then checked."""

    def __init__(self, patterns: list[str]):
        anything = "[^\\n\\r\x85\u2028\u2029]"
        self.checks = [re.compile("".join({"*": anything + "*", "?": anything}.get(c, re.escape(c)) for c in p), re.S) for p in patterns]
        self.any = []
        keyed: dict[tuple[str, int], dict[int, list[tuple[int, bool]]]] = {}
        for i, p in enumerate(patterns):
            pieces = re.split(r"[*?]", p)
            options = [("~", x[:3]) for x in pieces if x]
            options += [("^", pieces[0][:3])] * bool(pieces[0]) + [("$", pieces[-1][-3:])] * bool(pieces[-1])
            if not options:
                self.any.append(i)
                continue
            where, part = max(options, key=lambda o: (len(o[1]), o[0] != "~"))
            sure = p == {"~": f"*{part}*", "^": f"{part}*", "$": f"*{part}"}[where]
            keyed.setdefault((where, len(part)), {}).setdefault(sum(ord(c) << 21 * j for j, c in enumerate(part)), []).append((i, sure))
        self.keyed = []
        for (where, n), by_key in keyed.items():
            keys = np.array(sorted(by_key), np.int64)
            many = np.array([len(by_key[k]) for k in keys.tolist()])
            flat = [x for k in keys.tolist() for x in by_key[k]]
            self.keyed.append((where, n, keys, np.cumsum(many) - many, many, np.array([x[0] for x in flat]), np.array([x[1] for x in flat])))

    def matches(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word and a pattern it matches, as their places; a pair may come twice."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        word_of = np.repeat(np.arange(len(words)), sizes)
        found = []
        for where, n, keys, first, many, patterns, sure in self.keyed:
            if where == "~":
                at = np.arange(len(chars) - n + 1)
                at = at[word_of[at] == word_of[at + n - 1]]
            else:
                long = np.flatnonzero(sizes >= n)
                at = (ends - sizes)[long] if where == "^" else ends[long] - n
            gram = sum(chars[at + j] << 21 * j for j in range(n))
            key = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            hit = keys[key] == gram
            pairs = np.unique(word_of[at[hit]] * len(keys) + key[hit])
            word, key = pairs // len(keys), pairs % len(keys)
            until = np.cumsum(many[key])
            entry = np.repeat(first[key] - (until - many[key]), many[key]) + np.arange(until[-1] if len(until) else 0)
            word, pattern = np.repeat(word, many[key]), patterns[entry]
            good = sure[entry].copy()
            good[~good] = [self.checks[q].fullmatch(words[w]) is not None for w, q in zip(word[~good].tolist(), pattern[~good].tolist())]
            found.append((word[good], pattern[good]))
        for q in self.any:
            word = np.array([i for i, w in enumerate(words) if w and self.checks[q].fullmatch(w)], np.int64)
            found.append((word, np.full(len(word), q)))
        return tuple(np.concatenate([x[i] for x in found]).astype(np.int64) if found else np.zeros(0, np.int64) for i in (0, 1))


def pattern_counts(tokens: DataFrame, patterns: pa.Table, query_kind: str) -> DataFrame:
    """``(query_id, n_docs)``: the documents with a word that some pattern of a query matches.

    ``patterns(query_id, pattern)``, the same for every task, in lower case. Each batch expands the patterns to its own
    words; a row leaves it as one bit a query, and bits of rows of one document are put together before they are counted.
    """
    queries = pc.dictionary_encode(patterns.column("query_id").combine_chunks(), null_encoding="encode")
    query_of = queries.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ids, n = queries.dictionary, max(len(queries.dictionary), 1)
    texts = patterns.column("pattern").to_pylist()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = PatternSet(texts)
        for batch in batches:
            lists = batch.column("tokens")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.dictionary_encode(lists.flatten(), null_encoding="mask")
            codes = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            word, pattern = wanted.matches(coded.dictionary.to_pylist())
            pairs = np.unique(word * n + query_of[pattern])
            many = np.bincount(pairs // n, minlength=len(coded.dictionary) + 1)
            first, ends = np.cumsum(many) - many, np.cumsum(sizes)
            for lo in range(0, len(sizes), step := max(1, 4 * CELLS // n)):
                hi = min(lo + step, len(sizes))
                begin = int(ends[lo] - sizes[lo])
                own = codes[begin:int(ends[hi - 1])]
                row = np.repeat(np.arange(hi - lo), sizes[lo:hi])
                bits = np.zeros((hi - lo, n), bool)
                for at in range(0, len(own), 1 << 17):
                    code, here = own[at:at + (1 << 17)], row[at:at + (1 << 17)]
                    code, here = code[code >= 0], here[code >= 0]
                    until = np.cumsum(many[code])
                    entry = np.repeat(first[code] - (until - many[code]), many[code]) + np.arange(until[-1] if len(until) else 0)
                    bits[np.repeat(here, many[code]), pairs[entry] % n] = True
                packed = np.packbits(bits, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), pa.array([x.tobytes() for x in packed], pa.binary())], names=["doc_id", "bits"]
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros(n, np.int64), np.zeros(n, bool)
        last, open_ = None, np.zeros((n + 7) // 8, np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            doc = batch.column("doc_id").to_pylist()
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(len(doc), -1)
            starts = np.array([0] + [i for i in range(1, len(doc)) if doc[i] != doc[i - 1]])
            merged = np.bitwise_or.reduceat(bits, starts, axis=0)
            if doc[0] == last:
                merged[0] |= open_
            else:
                merged, starts, doc = np.concatenate([open_[None], merged]), np.concatenate([[0], starts + 1]), [last, *doc]
            last, open_ = doc[-1], merged[-1].copy()
            for lo in range(0, len(starts) - 1, 1000):
                part = np.unpackbits(merged[:-1][lo:lo + 1000], axis=1, count=n).astype(bool)
                known = np.array([doc[i] is not None for i in starts[:-1][lo:lo + 1000]])
                seen |= part.any(axis=0)
                totals += part[known].sum(axis=0)
        part = np.unpackbits(open_, count=n).astype(bool)
        seen |= part
        totals += part & (last is not None)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(found)), pa.array(totals[found])], names=["query_id", "n"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    bits = tokens.select("doc_id", "tokens").mapInArrow(mark, f"doc_id {kind}, bits binary")
    counts = bits.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(count, f"query_id {query_kind}, n bigint")
    return counts.groupBy("query_id").agg(F.sum("n").alias("n_docs"))
