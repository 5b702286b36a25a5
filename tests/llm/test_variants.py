"""Spelling variants against comparing all words with each other."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetspark.llm import variants


def one_edit_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(a == b[:k] + b[k + 1:] for k in range(len(b)))


def plain_variants(counts):
    near = {w: [x for x in counts if x != w and one_edit_apart(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, n, len(near[w]), form[w], counts[form[w]] if form[w] else None, root))
    return out


def plain_counts(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            word = run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]
            if len(word) >= 7:
                total[word] += 1
    return {w: n for w, n in total.items() if n >= 2}


def word_list(draw):
    base = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(7, 11))) for _ in range(60)]
    words = set(base)
    for w in base:
        for _ in range(4):
            k = draw.randrange(len(w))
            words.add(draw.choice([w[:k] + w[k + 1:], w[:k] + draw.choice("abcdeéß") + w[k:], w[:k] + draw.choice("abcdeéß") + w[k + 1:]]))
    long = "ab" * 70
    huge = "w" * 6000
    words |= {long, long[:33] + "c" + long[34:], long[:-1], long + "a", long[::-1], huge, huge + "x", huge[:-1] + "x", "w" * 6001, "x" + huge[:-2] + "x"}
    return {w: draw.choice([2, 2, 3, 20, 30, 200, 2000]) for w in sorted(words)}


@pytest.mark.parametrize("bucket_words", [1 << 14, 3])
def test_variants_agree_with_all_pairs(spark, monkeypatch, bucket_words):
    monkeypatch.setattr(variants, "BUCKET_WORDS", bucket_words)  # 3: nearly every bucket is a grid
    counts = word_list(random.Random(2))
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("root", F.lit("x"))
    rows = variants.spelling_variants(df).collect()
    assert len(rows) == len(counts) and set(map(tuple, rows)) == plain_variants(counts)


def test_words_of_odd_documents(spark):
    from test_corpus_small import documents, odd_rows

    draw = random.Random(4)
    rows = odd_rows() + [(k, " ".join(draw.choice(["Zürichsee", "colourful", "ÉCOLIERS", "colorful", "abcdefg"]) for _ in range(40))) for k in range(20, 60)]
    got = {r.word: r.n for r in variants.word_counts(documents(spark, rows)).collect()}
    assert got == plain_counts(rows)
    assert set(map(tuple, variants.spelling_variants(variants.word_counts(documents(spark, rows))).collect())) == plain_variants(got)


def test_no_documents_no_words(spark):
    from test_corpus_small import documents

    assert variants.spelling_variants(variants.word_counts(documents(spark, [(1, None), (2, "")]))).count() == 0
    assert variants.spelling_variants(variants.word_counts(documents(spark, []))).count() == 0


def test_pairs_are_looked_at_where_their_hashes_meet():
    words = ["abcdefgh", "abcdefgx", "abcdefghi", "bacdefgh"]
    counts = variants.Words(words).counts()
    group = variants.letter_groups(counts.sum(0))
    hashes = variants.bucket_hashes(counts, group)
    i, j = np.array([0, 0, 0]), np.array([1, 2, 3])
    found = variants.first_common_group(hashes, i, j)
    for a, b, g in zip(i, j, found):
        same = [(counts[a][group == k] == counts[b][group == k]).all() for k in range(variants.GROUPS)]
        assert g == same.index(True)
