"""Registered corpus queries and the pipeline over the given tables, against SQL and brute force."""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
from facetspark.llm import classifier, decontamination
from facetspark.llm.common import stored, table
from facetspark.llm.queries import QUERIES, SQL, bpe_ranks
from test_corpus_small import edit_distance_inside, plain_components, plain_counts, plain_lines
from workload.compare import connect, difference

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, SQL[name]) is None


def test_rules_agree_with_plain_counts(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_quality_rules"](spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert set(rows) == {d.doc_id for d in docs}
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(d.text)


def test_leaks_are_those_with_an_item_near(spark):
    found = {(r.doc_id, r.item_id) for r in QUERIES["op1_benchmark_decontamination"](spark, SF).collect()}
    norm = decontamination.normalised
    items = [(r.item_id, norm(r.text)) for r in table(spark, SF, "benchmark").collect()]
    docs = [(r.doc_id, norm(r.text)) for r in table(spark, SF, "documents").collect()]
    assert {(d, i) for d, t in docs for i, item in items if item in t} <= found
    texts, by_id = dict(docs), dict(items)
    assert all(edit_distance_inside(by_id[i], texts[d]) <= decontamination.budget(len(by_id[i])) for d, i in found)


def test_classifier_is_right_on_held_out_rows(spark):
    scored = QUERIES["op2_quality_classifier"](spark, LARGER).where("held_out")
    rows = scored.join(table(spark, LARGER, "labels"), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_pipeline_stage_by_stage(spark):
    """Each stage against a plain version of itself on what the stage before it kept."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, SF), f"test-{k}")
        after = docs.collect()
        if k < 4:
            assert docs.columns == columns
        texts = {r.doc_id: r.text for r in before}
        got = {r.doc_id: r for r in after}
        if k == 0:
            scored = classifier.score_quality(table(spark, SF, "documents"), table(spark, SF, "labels"))
            assert set(got) == {r.doc_id for r in scored.where("predicted = 1").collect()} and 0 < len(got) < len(texts)
        elif k == 1:
            gone = {i: set(map(int, filter(None, lines.split(",")))) for i, _, _, _, lines in plain_lines(list(texts.items()))}
            for i, text in texts.items():
                kept = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in gone[i])
                assert (got[i].text, got[i].n_chars) == (kept, len(kept))
        elif k == 2:
            want = {i for i, _, component in plain_components(list(texts.items())) if i == component}
            assert set(got) == want
        elif k == 3:
            items = [decontamination.normalised(r.text) for r in table(spark, SF, "benchmark").collect()]
            clean = {i for i, t in texts.items() if not any(x in decontamination.normalised(t) for x in items)}
            assert set(got) <= clean and len(clean - set(got)) <= 1
        else:
            import tiktoken

            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_ranks(), special_tokens={})
            for i, text in texts.items():
                ids = np.array(library.encode_ordinary(text), "<u4").tobytes()
                assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
                assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        before = after


def test_pipeline_runs_over_odd_documents(spark):
    from test_corpus_small import documents, odd_rows

    docs = documents(spark, odd_rows())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, SF)
            assert out.count() <= rows.count()
            if k < 4:
                assert out.columns == rows.columns
