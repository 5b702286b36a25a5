"""Sharding by a hierarchical weighted hash tree.

A row starts at the root and descends region, rack and shard. At each node every child draws
``-ln(u) / weight`` with ``u`` hashed from the row's key and the child's name, and the least draw
wins. A child's draw depends on nothing but itself, so a changed weight moves rows only into or out
of that child's subtree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetspark.llm.common import stored

RACKS = 2
SHARDS_A_RACK = 4
#: Rows of a shard are numbered inside so many hash groups, which are then put end to end.
SLOT_GROUPS = 1024


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int | None = None) -> list[Leaf]:
    """``base`` shards (all of them by default) four to a rack and two racks to a region; each later one
    opens a region of its own, so that it takes rows into itself alone."""
    base = shards if base is None else base
    per_region = RACKS * SHARDS_A_RACK
    leaves = [Leaf(s // per_region, s % per_region // SHARDS_A_RACK, s) for s in range(min(shards, base))]
    first_new = -(-base // per_region)
    return leaves + [Leaf(first_new + s - base, 0, s) for s in range(base, shards)]


def _children(leaves: list[Leaf]) -> list[dict[str, dict[str, float]]]:
    levels = [{}, {}, {}]
    for leaf in leaves:
        path = ["", f"{leaf.region}", f"{leaf.region}/{leaf.rack}", f"{leaf.region}/{leaf.rack}/{leaf.shard}"]
        for level, found in enumerate(levels):
            below = found.setdefault(path[level], {})
            below[path[level + 1]] = below.get(path[level + 1], 0.0) + leaf.weight
    return levels


def assign(key: Column, leaves: list[Leaf]) -> Column:
    """Shard of ``key`` (any type; null is a key of its own)."""
    node = F.lit("")
    for level in _children(leaves):
        choice = F.lit(None).cast("string")
        for parent, below in sorted(level.items()):
            choice = F.when(node == parent, _draw(key, below)).otherwise(choice)
        node = choice
    return F.element_at(F.split(node, "/"), 3).cast("int")


def _draw(key: Column, below: dict[str, float]) -> Column:
    draws = []
    for child, weight in sorted(below.items()):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(child)), 11).cast("double")
        u = (bits + F.lit(0.5)) / F.lit(float(1 << 53))
        draws.append(F.struct((-F.log(u) / F.lit(weight)).alias("draw"), F.lit(child).alias("child")))
    return F.least(*draws)["child"] if len(draws) > 1 else draws[0]["child"]


def shard_documents(docs: DataFrame, shards: int = 16, leaves: list[Leaf] | None = None) -> DataFrame:
    """Shard and slot of every document, and its shard were there one more.

    Input ``doc_id``, ``text``; other columns are ignored. ``size`` is the UTF-8 length of the text
    (null: none) plus 1; ``slot`` is gapless from 0 in each shard. Rows with a null or repeated id all
    get a slot; equal ids share a shard. An empty table gives an empty result. ``leaves`` overrides the
    tree, for other weights; the law stays ``key``.
    """
    now = leaves or topology(shards)
    later = now + [Leaf(1 + max(x.region for x in now), 0, 1 + max(x.shard for x in now))]
    raw = F.coalesce(F.encode(F.col("text"), "utf-8"), F.lit(b""))
    # the texts are read once; what is counted and numbered is a few numbers a row
    rows = stored(docs.select(
        "doc_id", (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        assign(F.col("doc_id"), now).alias("shard"), assign(F.col("doc_id"), later).alias("grown_shard"),
        F.pmod(F.xxhash64(F.lit("slot"), "doc_id", F.length(raw)), F.lit(SLOT_GROUPS)).cast("int").alias("_group"),
    ), "shards")
    counts = rows.groupBy("shard", "_group").agg(F.count(F.lit(1)).alias("_n"))
    # at most shards x SLOT_GROUPS rows
    before = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_group").orderBy("doc_id", "size", "text_crc32")
    return (
        rows.withColumn("_row", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "_group"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("_start") + F.col("_row")).cast("long").alias("slot"), "grown_shard",
        )
    )
