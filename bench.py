"""Times the headline queries; prints one JSON line.

Data from ``$BENCH_SF_DIR``, ``local[$BENCH_CPUS]``; each query is run once to warm up at the
smallest scale and once timed, with its whole result consumed by a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from facetspark.session import build_session  # noqa: E402
from workload import registry  # noqa: E402

HEADLINE = [
    "facets_filtered", "facets_selected", "facets_labelled", "boolean_filter", "sorted_page", "score_by_grades",
    "postings_stats", "match_all_words", "phrase_match", "phrase_slop", "bm25_topk", "phrase_boost_topk",
    "fuzzy_terms", "wildcard_terms", "tag_entities", "taxonomy_ancestors", "taxonomy_deepest", "synonym_rules",
    "complete_prefix", "complete_fuzzy", "normalize_documents", "upsert_merge", "latest_per_key", "search_ranked",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    found = registry()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    times = {}
    for name in names:
        if os.path.isdir(small):
            found[name].run(spark, small).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        found[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
