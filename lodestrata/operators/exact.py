"""Exact-hash grouping: star edges, group headers, keepers and the byte-identity decision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_edges(items: DataFrame, item: str, key: str) -> DataFrame:
    """(hub, member) for every item that shares its key with a smaller item; null keys match nothing."""
    known = items.where(F.col(key).isNotNull()).select(F.col(item).alias("member"), F.col(key).alias("k"))
    hubs = known.groupBy("k").agg(F.min("member").alias("hub"))
    return known.join(hubs, "k").where("member <> hub").select("hub", "member")


def exact_groups(items: DataFrame, item: str, key: str, score: str) -> DataFrame:
    """Members of every key that two items or more share, with the keeper and each member's decision.

    The keeper has the highest score, the smallest id on ties. Aggregates combine before the shuffle and
    the join back splits a hot key under adaptive execution.
    """
    known = items.where(F.col(key).isNotNull())
    groups = known.groupBy(key).agg(
        F.count("*").alias("member_count"), F.max_by(F.col(item), F.struct(F.col(score), -F.col(item))).alias("keep_id")
    )
    keep = F.col(item) == F.col("keep_id")
    return known.join(groups.where("member_count > 1"), key).select(
        key, item, "member_count", "keep_id",
        keep.cast("int").alias("is_keep"),
        F.when(keep, "KEEP").otherwise("AUTO_REMOVE").alias("decision"),
        F.when(keep, "KEEPER").otherwise("BYTE_IDENTICAL").alias("reason"),
    )
