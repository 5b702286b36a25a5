"""Spelling variants of a corpus by blocked Gram matrices of letter counts.

A word is a row of letter counts. One edit changes the counts of at most two letters, so words one edit apart have a
squared distance of one (a letter more) or two (another letter). Letters are dealt to three groups; of two letters
that change, one group at least stays as it is. Words therefore meet in buckets, one for the counts of each group, and
no pair one edit apart is lost. Inside a bucket words lie by length, and products of blocks of the count matrix give
the squared distances of words of equal and adjacent lengths; what is near enough is verified edit by edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import arrow_schema, batches_of, map_batches, map_rows, stored, summed_batches, utf8

#: Runs of letters; only A-Z are lowered.
LETTERS = "a-zA-ZÀ-ÿ"
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word is counted without one letter where this divides the checksum of its document and itself.
DAMAGE = 31
#: A variant's form is so many times as frequent.
RATIO = 10
#: Distinct words a task counts before it passes them on.
HELD_WORDS = 400_000
#: Letters, numbered from 0: a-z, then U+00C0 to U+00FF.
N_LETTERS = 26 + 64
GROUPS = 3
#: Rows and columns of a block of the Gram matrix.
ROWS, COLUMNS = 512, 2048
#: Words of a bucket that meet in one task; larger buckets become a grid.
BUCKET_WORDS = 1 << 14
#: Buckets are dealt to groups of tasks of about so many postings.
TASK_POSTINGS = 1 << 17
#: Longer words are compared as strings, one pair at a time.
WIDE = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


# --- words and their counts ------------------------------------------------------


def lowered_runs(text: str | None, pattern: re.Pattern) -> list[str]:
    return pattern.findall(utf8(text).lower().decode("utf-8")) if text else []


def without_letter(word: str, checksum: int) -> str:
    at = checksum % len(word)
    return word[:at] + word[at + 1:]


def count_words(rows, least_length: int = LEAST_LENGTH, damage: int = DAMAGE) -> Iterator[tuple]:
    """``(doc_id, text)`` as ``(word, n)``, counts of the words of these rows in parts."""
    pattern = re.compile(f"[{LETTERS.replace('A-Z', '')}]{{{least_length},}}")  # shorter runs end too short
    total: Counter = Counter()
    for doc_id, text in rows:
        runs = lowered_runs(text, pattern)
        total.update(runs)
        if damage and runs:
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            harmed = {run: h for run in set(runs) if not (h := zlib.crc32(run.encode(), start)) % damage}
            if harmed:
                times = Counter(run for run in runs if run in harmed)
                for run, h in harmed.items():
                    total[run] -= times[run]
                    if len(run) > least_length:
                        total[without_letter(run, h)] += times[run]
        if len(total) >= HELD_WORDS:
            yield from ((w, n) for w, n in total.items() if n)
            total = Counter()
    yield from ((w, n) for w, n in total.items() if n)


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """``word, n``: the words of all documents with their numbers of occurrences.

    Words are maximal runs of Latin letters, A-Z lower-cased. With ``damage`` a run is counted without its letter
    ``h % length`` in documents where ``damage`` divides ``h``, the crc32 of ``doc_id:run``.
    """
    def run(rows):
        return count_words(rows, least_length, damage)

    found = map_rows(docs.select("doc_id", "text"), run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- letter counts ---------------------------------------------------------------


class Words:
    """Some words as codes, lengths and letter counts."""

    def __init__(self, words: list[str]):
        self.words = words
        raw = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        self.codes = np.where(raw < 128, raw - 97, raw - 0xC0 + 26)
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def counts(self) -> np.ndarray:
        own = np.repeat(np.arange(len(self.words)), self.lengths)
        flat = np.bincount(own * N_LETTERS + self.codes, minlength=len(self.words) * N_LETTERS)
        return flat.reshape(-1, N_LETTERS)

    def matrix(self) -> np.ndarray:
        """Codes as rows of equal width, -1 behind the end; long words are cut and compared otherwise."""
        width = min(int(self.lengths.max(initial=0)), WIDE)
        at = np.arange(width)[None, :]
        inside = at < self.lengths[:, None]
        return np.where(inside, self.codes[np.minimum(self.starts[:, None] + at, max(len(self.codes) - 1, 0))], -1).astype(np.int8)


def letter_groups(totals: np.ndarray) -> np.ndarray:
    """The group of each letter: the letters, most frequent first, each to the group with the least so far."""
    group, load = np.zeros(N_LETTERS, np.int64), np.zeros(GROUPS)
    for letter in np.lexsort((np.arange(N_LETTERS), -totals)).tolist():
        group[letter] = int(load.argmin())
        load[group[letter]] += totals[letter] + 1
    return group


def bucket_hashes(counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Per word and group, a hash of the counts of the group's letters."""
    weight = mix(np.arange(1, N_LETTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = np.empty((len(counts), GROUPS), np.uint64)
    for g in range(GROUPS):
        mine = np.flatnonzero(group == g)
        out[:, g] = mix((counts[:, mine].astype(np.uint64) * weight[mine]).sum(1) + np.uint64(g + 1))
    return out


# --- pairs in a task -------------------------------------------------------------


def near_counts(counts: np.ndarray, length: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs ``i < j`` of one bucket whose squared distance and lengths fit one edit, block by block.

    Rows lie by bucket and length. A block of rows meets the rows up to the end of the length behind its last one.
    """
    n = len(counts)
    square = (counts * counts).sum(1)
    exact = np.float32 if int(square.max(initial=0)) < 1 << 21 else np.float64  # whole numbers stay whole
    full, square = counts.astype(exact), square.astype(exact)
    _, rank = np.unique(bucket, return_inverse=True)
    place = rank * (int(length.max(initial=0)) + 2) + length
    end = np.searchsorted(place, place + 1, "right")
    for a in range(0, n, ROWS):
        b = min(a + ROWS, n)
        for c in range(a, int(end[b - 1]), COLUMNS):
            d = min(c + COLUMNS, int(end[b - 1]))
            far = square[a:b, None] + square[None, c:d] - 2 * (full[a:b] @ full[c:d].T)
            i, j = np.nonzero((far < 2.5) & (far > 0.5))
            i, j, far = i + a, j + c, far[i, j]
            fits = (i < j) & (rank[i] == rank[j]) & (length[j] - length[i] == (far < 1.5))
            yield i[fits], j[fits]


def first_common_group(hashes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first group in whose bucket two words meet: where the pair is looked at."""
    return (hashes[i] == hashes[j]).argmax(1)


def one_edit(words: Words, codes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether two words, the second as long or one longer, differ by exactly one edit; counts are known to fit."""
    out = np.zeros(len(i), bool)
    short = words.lengths[j] <= WIDE
    same = short & (words.lengths[i] == words.lengths[j])
    out[same] = (codes[i[same]] != codes[j[same]]).sum(1) == 1
    longer = np.flatnonzero(short & ~same)
    x, y = codes[i[longer]], codes[j[longer]]
    if len(longer):
        head = np.logical_and.accumulate(x == y, 1).sum(1)
        # the shorter word, from its end on: place k of it against place k + 1 of the longer one
        beside = np.append(x[:, :-1] == y[:, 1:], np.zeros((len(x), 1), bool), 1)
        at = np.arange(x.shape[1])[None, :]
        size = words.lengths[i[longer]]
        beside |= at >= size[:, None]
        tail = np.logical_and.accumulate(beside[:, ::-1], 1).sum(1) - (x.shape[1] - size)
        out[longer] = head + tail >= size
    for k in np.flatnonzero(~short).tolist():
        a, b = words.words[i[k]], words.words[j[k]]
        at = next((p for p in range(len(a)) if a[p] != b[p]), len(a))
        out[k] = a[at:] == b[at + 1:] if len(a) < len(b) else a[at + 1:] == b[at + 1:] and at < len(a)
    return out


def neighbours(words: list, n: list, bucket: list, own_group: list, side: list, group: np.ndarray) -> pa.Table:
    """Postings of one task as ``(word, n_near, best_n, best)`` over the pairs found in it."""
    out = []
    order = np.lexsort((np.fromiter(map(len, words), np.int64, len(words)), bucket)).tolist()
    found = Words([words[k] for k in order])
    counts, codes = found.counts(), found.matrix()
    hashes = bucket_hashes(counts, group)
    n, bucket, own, side = (np.asarray(c)[order] for c in (n, bucket, own_group, side))
    left, right = [], []
    for i, j in near_counts(counts, found.lengths, bucket):
        # in a cell off the diagonal of a grid, the pairs of one side are looked at elsewhere
        fits = (side[i] != side[j]) | (side[i] == 0)
        i, j = i[fits], j[fits]
        fits = first_common_group(hashes, i, j) == own[i]
        i, j = i[fits], j[fits]
        fits = one_edit(found, codes, i, j)
        left += [i[fits], j[fits]]
        right += [j[fits], i[fits]]
    if left:
        left, right = np.concatenate(left), np.concatenate(right)
        rank = np.empty(len(order), np.int64)
        rank[sorted(range(len(order)), key=found.words.__getitem__)] = np.arange(len(order))
        ids = np.array([words[k] for k in order], object)
        # equal words of several buckets are told apart by place only; sums follow over all tasks
        by = np.lexsort((rank[right], -n[right], left))
        left, right = left[by], right[by]
        first = np.flatnonzero(np.append(True, left[1:] != left[:-1])) if len(left) else np.zeros(0, np.int64)
        near = np.diff(np.append(first, len(left)))
        best = right[first]
        out = zip(ids[left[first]].tolist(), near.tolist(), n[best].tolist(), ids[best].tolist())
    return pa.Table.from_batches(list(batches_of(out, NEAR_DDL)), schema=arrow_schema(NEAR_DDL))


NEAR_DDL = "word string, n_near long, best_n long, best string"


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of the distinct ``words (word, n)`` that have a word one edit away.

    ``best`` is the near word of largest ``n``, among equals the first in code-point order.
    """
    spark = words.sparkSession

    def letters(batches):
        total = np.zeros(N_LETTERS + 1, np.int64)
        for batch in batches:
            total[:N_LETTERS] += np.bincount(Words(batch.column(0).to_pylist()).codes, minlength=N_LETTERS)
            total[N_LETTERS] += batch.num_rows
        return total

    totals = summed_batches(words.select("word"), letters, N_LETTERS + 1)
    group = letter_groups(totals[:N_LETTERS])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(totals[-1]) * GROUPS // TASK_POSTINGS))

    def post(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            hashes = bucket_hashes(Words(texts).counts(), group).view(np.int64)
            for word, n, own in zip(texts, batch.column(1).to_pylist(), hashes.tolist()):
                yield from ((h, g, word, n) for g, h in enumerate(own))

    posted = stored(map_batches(words.select("word", "n"), post, "bucket long, own int, word string, n long"), "word-postings")
    # buckets beyond the bound, of which there are at most one for BUCKET_WORDS postings, become grids of parts
    large = posted.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > BUCKET_WORDS)
    parts = F.ceil(F.col("size") / BUCKET_WORDS)
    placed = posted.join(stored(large, "large-buckets"), "bucket", "left").withColumn("parts", F.coalesce(parts, F.lit(1)))
    own_part = F.pmod(F.xxhash64("word"), F.col("parts"))
    placed = placed.select("bucket", "own", "word", "n", own_part.alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    cell = F.when((low == 0) & (high == 0), F.col("bucket")).otherwise(F.xxhash64("bucket", low, high))
    # 0: a cell on the diagonal, where all pairs are looked at; 1 and 2: the two parts of another cell
    side = F.when(low == high, 0).when(F.col("part") == low, 1).otherwise(2).cast("int")
    dealt = placed.select(
        F.pmod(F.xxhash64(cell), F.lit(tasks)).cast("int").alias("task"), cell.alias("bucket"), "own", "word", "n", side.alias("side")
    )

    def meet(table):
        return neighbours(*[table.column(c).to_pylist() for c in ("word", "n", "bucket", "own", "side")], group)

    near = dealt.groupBy("task").applyInArrow(meet, NEAR_DDL)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select(
        "word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best")
    )


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Groups of spelling variants: ``word, n, n_near, form, form_n, root``, one row a word.

    Input distinct ``word`` of Latin letters (no A-Z) and ``n``. Two words are near if exactly one inserted, deleted or
    replaced code point tells them apart; ``n_near`` counts the near words. ``form`` is the near word of largest ``n``
    (ties: the first in code-point order) where that is at least ``ratio`` times the word's, else null; ``form_n`` is
    its ``n``. ``root`` is where following forms ends, the word itself if it has none; ``n`` grows at each step, so it
    does end. Words of any length are compared whole. No words give no rows.
    """
    words = stored(words.select("word", "n"), "words")
    near = near_words(words)
    fits = F.col("best_n") >= ratio * F.col("n")
    out = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(fits, F.col("best")).alias("form"), F.when(fits, F.col("best_n")).alias("form_n"),
    ), "forms")
    roots = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    # a root that has a form of its own moves on; each round doubles the way, which is at most log(largest n)
    while True:
        roots = stored(roots, "roots")
        further = roots.selectExpr("word AS root", "root AS next")
        moved = roots.join(further, "root", "left_semi")
        if moved.isEmpty():
            break
        roots = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return out.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
