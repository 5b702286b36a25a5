"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of a text are standardised and mapped to cosine features that approximate a Gaussian
kernel. The normal equations are summed over partitions, solved once, and the ridge scores are
calibrated by an isotonic fit of the labels over fixed score bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import map_rows, stored, summed, utf8, words_of
from facetspark.llm.rules import repeated_words

FEATURES = 256
#: Width of the Gaussian kernel in standard deviations of the statistics.
WIDTH = 4.0
RIDGE = 1.0
SEED = 20
#: Isotonic regression works on so many equal bins of the ridge score between LOW and HIGH.
BINS, LOW, HIGH = 2000, -0.5, 1.5
ACCEPT = 0.3
MARKS = [b"|", b"!", b"*", b"#", b"$", b"%", b"&", b".", b",", b"<>"]
STATISTICS = 16 + len(MARKS)


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a text; all zero for a null or empty one."""
    data = utf8(text)
    if not data:
        return np.zeros(STATISTICS)
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = len(data)
    letters = bytes_of[65:91].sum() + bytes_of[97:123].sum()
    share = bytes_of[bytes_of > 0] / n
    words = words_of(data)
    n_words = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    lines = data.split(b"\n")
    marked = sum(map(bytes.isalpha, words))
    return np.array([
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
        bytes_of[65:91].sum() / max(1, letters), bytes_of[48:58].sum() / n, letters / n,
        bytes_of[128:].sum() / n, bytes_of[:32].sum() / n, -(share * np.log(share)).sum(),
        lengths.mean(), lengths.std(), len(set(words)) / n_words, repeated_words(words) / n_words,
        1 - len(set(lines)) / len(lines), marked / n_words,
        sum(a == b for a, b in zip(words, words[1:])) / n_words,
        *(sum(int(bytes_of[c]) for c in mark) / n_words for mark in MARKS),
    ])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    steps: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return fourier(x, self.mean, self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1; one half when there was nothing to learn from."""
        return np.full(len(x), 0.5) if self.weights is None else self.steps[bins_of(self.raw(x))]


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    draw = np.random.default_rng(SEED)
    w = draw.normal(0, 1 / WIDTH, (STATISTICS, FEATURES - 1))
    phase = draw.uniform(0, 2 * np.pi, FEATURES - 1)
    z = np.sqrt(2 / (FEATURES - 1)) * np.cos(np.clip((x - mean) / scale, -8, 8) @ w + phase)
    return np.hstack([z, np.ones((len(x), 1))])


def bins_of(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)


def isotonic(n: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing rates that fit the bins best: pool adjacent violators. Bins without rows are interpolated."""
    blocks: list[list[float]] = []
    for k in np.flatnonzero(n):
        blocks.append([positive[k], n[k], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    rates = np.concatenate([np.full(int(size), p / m) for p, m, size in blocks])
    return np.interp(np.arange(len(n)), np.flatnonzero(n), rates)


def held_out(doc_id):
    """One row in five, by the CRC-32 of the id as text."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_statistics(docs: DataFrame) -> DataFrame:
    return map_rows(
        docs.select("doc_id", "text"), lambda rows: ((i, statistics(t).tobytes()) for i, t in rows), "doc_id long, x binary"
    )


def _chunks(rows, size):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def _blocks(rows, size=2048):
    """Rows (x, y) as matrices."""
    for held in _chunks(rows, size):
        yield np.vstack([np.frombuffer(x) for x, _ in held]), np.array([y for _, y in held], float)


def fit(train: DataFrame) -> Model:
    """Model of ``train (x, y)``; each pass sums a vector of fixed length over the partitions."""

    def moments(rows):
        out = np.zeros(1 + 2 * STATISTICS)
        for x, _ in _blocks(rows):
            out += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        return out

    n, *sums = summed(train, moments, 1 + 2 * STATISTICS, "float64")
    if not n:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), None, np.zeros(BINS))
    mean = np.array(sums[:STATISTICS]) / n
    spread = np.sqrt(np.maximum(np.array(sums[STATISTICS:]) / n - mean * mean, 0))
    scale = np.where(spread > 1e-9, spread, 1.0)

    def equations(rows):
        out = np.zeros((FEATURES, FEATURES + 1))
        for x, y in _blocks(rows):
            z = fourier(x, mean, scale)
            out += np.hstack([z.T @ z, (z.T @ y)[:, None]])
        return out.ravel()

    normal = summed(train, equations, FEATURES * (FEATURES + 1), "float64").reshape(FEATURES, FEATURES + 1)
    weights = np.linalg.solve(normal[:, :-1] + RIDGE * np.eye(FEATURES), normal[:, -1])
    ridge = Model(mean, scale, weights, np.zeros(BINS))

    def histogram(rows):
        out = np.zeros((2, BINS))
        for x, y in _blocks(rows):
            at = bins_of(ridge.raw(x))
            out += [np.bincount(at, minlength=BINS), np.bincount(at, y, BINS)]
        return out.ravel()

    return Model(mean, scale, weights, isotonic(*summed(train, histogram, 2 * BINS, "float64").reshape(2, BINS)))


def fit_documents(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """The statistics of all documents, and the model of the labelled ones that are not held out."""
    stats = stored(text_statistics(docs), "quality-statistics")
    known = (
        labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    )
    train = stored(stats.join(known, "doc_id").select("x", "y"), "quality-train")
    return stats, fit(train)


def score_quality(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Calibrated quality of every document: ``doc_id, held_out, score, predicted``.

    Input ``docs (doc_id, text)`` and ``labels (doc_id, quality)``; other columns are ignored and never
    reach the score. Labels of held-out ids are not read; null labels are skipped, of repeated ones the
    least counts. A null or empty text has zero statistics and gets the score learned for such texts.
    Rows with null or repeated ids are scored one by one. Without labels every score is 0.5. An empty
    table gives an empty result.
    """
    stats, model = fit_documents(docs, labels)

    def score(rows):
        for held in _chunks(rows, 4096):
            values = model.score(np.vstack([np.frombuffer(x) for _, x in held]))
            yield from zip((i for i, _ in held), values.tolist())

    scored = map_rows(stats, score, "doc_id long, score double")
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score ``accept`` or more, with all their columns.

    Judges each row by its own text where it stands, so no text is shuffled.
    """
    import pandas as pd

    _, model = fit_documents(docs, labels)

    def judge(parts):
        for part in parts:
            x = [statistics(t) for t in part]
            yield pd.Series(model.score(np.vstack(x)) >= accept if x else [], dtype=bool)

    judge.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(judge, "boolean")("text"))
