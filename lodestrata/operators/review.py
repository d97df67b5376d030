"""Review views: dense indexes, pages, queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE_SIZES = (50, 100, 200)


def dense_index(rows: DataFrame, order: list[Column], slices: int = 64) -> DataFrame:
    """`rows` with position: 0, 1, 2... in one global order, without one task that sorts everything.

    Rows are range-partitioned by the order; each partition counts its rows, and only these counts meet.
    """
    ranged = rows.repartitionByRange(slices, *order).withColumn("__p", F.spark_partition_id())
    from pyspark import StorageLevel

    ranged = ranged.persist(StorageLevel.MEMORY_AND_DISK)  # the partition of a row must not change between the two uses
    counts = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__p", before.alias("__s"))
    inner = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return ranged.withColumn("__i", inner).join(F.broadcast(starts), "__p").withColumn("position", F.col("__s") + F.col("__i")).drop("__p", "__i", "__s")


def page(index: DataFrame, number: int, size: int) -> DataFrame:
    """Page `number` (from 0) of a dense index; a filter on position, never an offset."""
    if size not in PAGE_SIZES or number < 0:
        raise ValueError(f"pages have {PAGE_SIZES} rows and numbers from 0")
    return index.where(F.col("position").between(number * size, number * size + size - 1))


def queue_of(decision: Column) -> Column:
    return F.when(decision.isNull(), "PENDING").when(decision == "LATER", "LATER").otherwise("DONE")


def queue_tally(groups: DataFrame, state: DataFrame, key: str, decision: str) -> DataFrame:
    """Groups per queue, those without a state being pending."""
    joined = groups.join(state.select(key, decision), key, "left")
    return joined.groupBy(queue_of(F.col(decision)).alias("queue")).agg(F.count("*").alias("n"))


def stale(decisions: DataFrame, members: DataFrame, key: str, item: str, mark: str) -> DataFrame:
    """Decisions whose group is gone or whose members changed since: (key, reason)."""
    from ..functions.columns import fingerprint

    now = members.groupBy(key).agg(fingerprint(F.collect_list(item)).alias("__now"))
    joined = decisions.select(key, mark).join(now, key, "left")
    return joined.where(~F.col(mark).eqNullSafe(F.col("__now"))).select(key, F.when(F.col("__now").isNull(), "GROUP_GONE").otherwise("MEMBERS_CHANGED").alias("reason"))
