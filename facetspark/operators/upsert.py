"""Keeping a document table up to date: newest change per id, upserts and deletions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetspark.operators.normalize import FOUND, REMOVED
from facetspark.scale import broadcast_if_bounded


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest whole row per key.

    An aggregation, not a window: map tasks already reduce a key that changes all the time to one
    row each.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def resolve_changes(events: DataFrame, snapshot: DataFrame, key: str, action: str = "action") -> DataFrame:
    """``(key, status, doc)``: what each changed id is now.

    ``doc`` is the whole document of the snapshot; an id that is gone from it, or whose event says
    deleted, is removed. The snapshot is first reduced to the ids that changed, by a broadcast of them while
    they are few, so a batch of changes never moves the whole snapshot.
    """
    asked = snapshot.join(broadcast_if_bounded(events.select(key).distinct()), key, "left_semi")
    found = asked.select(key, F.struct(*[F.col(f"`{c}`") for c in snapshot.columns]).alias("doc"))
    gone = F.col("doc").isNull() | F.coalesce(F.lower(F.col(action)) == "deleted", F.lit(False))
    return events.join(found, key, "left").select(
        *[c for c in events.columns if c != action],
        F.when(gone, F.lit(REMOVED)).otherwise(F.lit(FOUND)).alias("status"),
        F.when(~gone, F.col("doc")).alias("doc"),
    )


def upsert_documents(
    current: DataFrame, updates: DataFrame, key: str, last_modified: str, deleted: DataFrame | None = None,
    only_newer: bool = False,
) -> DataFrame:
    """The table after whole-document replacement by id and deletion by id.

    Of several updates of an id the newest counts. A column the updates lack becomes null: the new
    document replaces the old one, it is not merged with it. With ``only_newer`` an update older
    than the stored document is left out.
    """
    newest = latest_per_key(updates, [key], [F.col(last_modified)])
    if only_newer:
        stored = current.select(key, F.col(last_modified).alias("_stored"))
        newest = newest.join(stored, key, "left").where(
            F.col("_stored").isNull() | (F.col(last_modified) >= F.col("_stored"))
        ).drop("_stored")
    replaced = newest.select(key) if deleted is None else newest.select(key).unionByName(deleted.select(key)).distinct()
    kept = current.join(replaced, key, "left_anti")
    if deleted is not None:
        newest = newest.join(deleted.select(key).distinct(), key, "left_anti")
    return kept.unionByName(newest, allowMissingColumns=True)
