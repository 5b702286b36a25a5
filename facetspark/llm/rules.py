"""Quality rules: counts of a text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are estimated, one from trusted texts and one from the
whole corpus. A text's score is the mean log ratio of its n-grams; at or above the threshold it is kept.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import map_rows, summed, utf8, words_of

NGRAM = 4
BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Ratios are fixed-point numbers, so that scores are the same in any order of summation.
UNIT = 1 << 20
#: A text is kept unless its n-grams are on average exp(0.25) times likelier in the corpus than in the trusted texts.
THRESHOLD = -0.25
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
#: Texts are hashed together up to so many bytes.
CHUNK = 1 << 21


def ngram_buckets(data: bytes) -> np.ndarray:
    """Bucket of each byte n-gram; none for a text shorter than that."""
    if len(data) < NGRAM:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    n = len(raw) - NGRAM + 1
    value = raw[:n].copy()
    for k in range(1, NGRAM):
        value |= raw[k:k + n] << np.uint32(8 * k)
    return (value * np.uint32(2654435761)) >> np.uint32(16)


def bucket_counts(rows) -> np.ndarray:
    """Counts of the texts; ``rows`` are (text,)."""
    counts = np.zeros(BUCKETS, np.int64)
    held: list[np.ndarray] = []
    size = 0
    for (text,) in rows:
        held.append(ngram_buckets(utf8(text)))
        size += len(held[-1])
        if size >= CHUNK:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
            held, size = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
    return counts


def log_ratios(corpus: np.ndarray, trusted: np.ndarray) -> np.ndarray:
    """Fixed-point ``log(p_trusted / p_corpus)`` of each bucket, both add-one smoothed; zeros without trusted texts."""
    corpus, trusted = corpus.astype(float), trusted.astype(float)
    if not trusted.any():
        return np.zeros(BUCKETS, np.int64)
    p = (trusted + SMOOTHING) / (trusted.sum() + SMOOTHING * BUCKETS)
    q = (corpus + SMOOTHING) / (corpus.sum() + SMOOTHING * BUCKETS)
    return np.rint(np.log(p / q) * UNIT).astype(np.int64)


def fit_ratios(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """The ratio table from all ``docs (doc_id, text)`` and the ids in ``trusted (doc_id)``.

    The corpus counts cover every document, the trusted counts every document with one of the ids.
    """
    ids = trusted.select("doc_id").where("doc_id is not null").distinct()
    known = docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id").select("text")  # ids may be too many to broadcast
    return log_ratios(*(summed(df, bucket_counts, BUCKETS) for df in (docs.select("text"), known)))


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(ids) < 4 or len(known) == len(ids):
        return 0
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    windows = pairs[:-1].astype(np.int64) * len(known) + ids[2:]
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    start = np.flatnonzero(times[which] > 1)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[start + k] = True
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    data = utf8(text)
    words = words_of(data)
    spaces = len(data) - len(data.translate(None, SPACES))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words), len(text or "") - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words),
    )


DDL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, score double"
)


def score_rules(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Counts, score and verdict of every document.

    Input ``doc_id``, ``text``; other columns are ignored. A null text is empty and fails the base rules
    (fewer than 50 words); a text below four bytes has no n-gram and scores 0. Rows with null or
    repeated ids are judged one by one; an empty table gives an empty result. With no trusted texts
    every ratio is 0 and the base rules decide alone.
    """
    limit = round(threshold * UNIT)

    def judge(rows):
        for doc_id, text in rows:
            counts = text_counts(text)
            failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
            found = ngram_buckets(utf8(text))
            total = int(ratios[found].sum())
            yield (doc_id, *counts, failed, not failed and total >= limit * len(found), total / UNIT / max(1, len(found)))

    return map_rows(docs.select("doc_id", "text"), judge, DDL)


def filter_by_rules(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``score_rules`` with the model of these documents."""
    return score_rules(docs, fit_ratios(docs, trusted))
