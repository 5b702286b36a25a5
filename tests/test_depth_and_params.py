"""Ancestors of deep, wide and cyclic taxonomies; scores by a table of parameters; a tail that keeps running."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from facetspark.operators.sorting import score_by_params_table
from facetspark.operators.taxonomy import ancestors
from facetspark.specs import Scorer
from facetspark.streaming import changes

EDGES = "taxonomy string, child string, parent string"


def plain_ancestors(edges):
    out = set()
    for tax, start in {(t, c) for t, c, _ in edges}:
        seen, at, depth = {start: 0}, {start}, 0
        while at:
            depth += 1
            at = {p for t, c, p in edges if t == tax and c in at and p not in seen}
            seen |= dict.fromkeys(at, depth)
        out |= {(tax, start, a, d) for a, d in seen.items() if d}
    return out


def test_long_chain(spark):
    edges = spark.createDataFrame([("t", f"{k}", f"{k + 1}") for k in range(100)], EDGES)
    found = ancestors(edges).where("depth <> cast(ancestor as int) - cast(id as int)").count(), ancestors(edges).count()
    assert found == (0, 100 * 101 // 2)


def test_random_graphs_with_cycles(spark):
    draw = random.Random(6)
    edges = list({(draw.choice("xy"), f"n{draw.randrange(25)}", f"n{draw.randrange(25)}") for _ in range(70)})
    edges += [("z", f"c{k}", f"c{(k + 1) % 9}") for k in range(9)] + [("z", "c0", "c0")]
    want = {r for r in plain_ancestors([e for e in edges if e[1] != e[2]]) if r[1] != r[2]}
    assert set(rows(ancestors(spark.createDataFrame(edges, EDGES)))) == want


def test_no_edges(spark):
    assert rows(ancestors(spark.createDataFrame([], EDGES))) == []


SCORER = Scorer(lambda p: F.col("v") * p["a"] + p["b"], params={"a": 1.0, "b": 0.0}, static_params={"b": 100.0})


def test_parameters_of_a_table_are_used_and_static_ones_win(spark):
    docs = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 5.0), (3, 7.0), (None, 1.0)], "query_id int, v double")
    params = spark.createDataFrame([(1, "a", 10.0), (1, "b", 1.0), (2, "a", -1.0), (2, "b", 1.0)], "query_id int, param string, value double")
    assert rows(score_by_params_table(docs, SCORER, params)) == [(1, 2.0, 120.0), (1, 3.0, 130.0), (2, 5.0, 95.0)]
    assert rows(score_by_params_table(docs, SCORER, params.limit(0))) == []


@pytest.mark.parametrize("keys", [("a",), ("a", "b", "c")])
def test_keys_of_parameters_must_match(spark, keys):
    docs = spark.createDataFrame([(1, 2.0)], "query_id int, v double")
    params = spark.createDataFrame([(1, k, 1.0) for k in keys], "query_id int, param string, value double")
    with pytest.raises(Exception, match="parameters of 1 are a"):
        score_by_params_table(docs, SCORER, params).collect()


def test_running_tail_reports_what_it_applied(spark, tmp_path):
    log, out = str(tmp_path / "log"), []
    event = lambda ids: spark.createDataFrame([(f"{k}-0", f"u{k}", None) for k in ids], "event_id string, id string, action string")

    def start():
        return changes.run_changes(
            changes.read_change_files(spark, log), lambda df, n: out.extend(r.id for r in df.collect()), str(tmp_path / "at"), True, "0 seconds"
        )

    event(range(3)).coalesce(1).write.mode("append").json(log)
    query = start()
    changes.wait_until_applied(query, 3)
    event(range(3, 5)).coalesce(1).write.mode("append").json(log)
    changes.wait_until_applied(query, 5)
    query.stop()
    event([9]).coalesce(1).write.mode("append").json(log)
    query = start()
    changes.wait_until_applied(query, 1)
    query.stop()
    assert sorted(out) == ["u0", "u1", "u2", "u3", "u4", "u9"]
    with pytest.raises(TimeoutError):
        changes.wait_until_applied(query, 10, seconds=0.2)
