"""Registered queries against their SQL at the smallest scale.

A selection by default; all of them with FACETSPARK_ALL=1.
"""

import os

import pytest

import __spark_entry__ as entry
from workload.compare import connect, difference

SF = "/root/testdata/sf0.001"
SELECTION = [
    "facets_filtered", "facets_selected", "facets_labelled", "boolean_filter", "map_subfield", "score_by_grades",
    "postings_stats", "phrase_match", "bm25_topk", "taxonomy_deepest", "synonym_rules", "complete_prefix",
    "normalize_documents", "upsert_merge", "replay_changes", "search_hits", "image_urls",
    "search_nested", "merge_other_buckets", "fill_international", "sorted_documents", "stamped_import", "first_rows",
    "sorted_by_array", "taxonomy_import_lines", "wildcard_inner", "phrase_slop_long",
]
NAMES = sorted(entry.queries()) if os.environ.get("FACETSPARK_ALL") else SELECTION
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
