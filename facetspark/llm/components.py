"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetspark.llm.common import stored
from facetspark.scale import broadcast_if_bounded


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges (a, b)``; the component is one of its nodes.

    Each round, every node points at the neighbour (or itself) with the least hash of that round, and
    the graph of the nodes pointed at is what the next round works on. Random orders shrink chains and
    stars alike by a constant factor a round. Rounds are written to the shared folder; edges and labels
    stay distributed. No edges give no rows.
    """
    edges = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    # tables of a known small size are broadcast; larger ones are joined by a shuffle
    for turn in range(1_000):
        if edges.isEmpty():
            return edges.selectExpr("a AS node", "b AS component") if labels is None else labels
        both = edges.unionAll(edges.selectExpr("b AS a", "a AS b"))
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("h"), F.col(c).alias("node"))
        points = stored(
            both.groupBy("a").agg(F.least(F.min(order("b")), order("a"))["node"].alias("to")), "pointers"
        )
        near = broadcast_if_bounded(points)
        edges = stored(
            edges.join(near.withColumnRenamed("to", "ta"), "a")
            .join(near.selectExpr("a AS b", "to AS tb"), "b")
            .selectExpr("least(ta, tb) AS a", "greatest(ta, tb) AS b").where("a <> b").distinct(),
            "edges",
        )
        if labels is None:
            labels = points.selectExpr("a AS node", "to AS component")
        else:
            moved = near.selectExpr("a AS component", "to")
            labels = stored(
                labels.join(moved, "component", "left").selectExpr("node", "coalesce(to, component) AS component"), "labels"
            )
    raise AssertionError("contraction did not end")
