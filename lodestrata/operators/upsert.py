"""Table maintenance as set operations: insert-or-ignore, change detection, latest wins, view replacement."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and the rows of `new` whose keys it hasn't; of new rows with one key, the least row."""
    fresh = new.groupBy(*keys).agg(F.min(F.struct(*(c for c in new.columns if c not in keys))).alias("__v")).select(*keys, "__v.*")
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti"))


def changes(old: DataFrame, new: DataFrame, keys: list[str], watched: list[str]) -> DataFrame:
    """State of every key: new, gone, changed (a watched column differs; nulls compare) or same. Rows that
    are new or changed are those whose features and artifacts must be made again."""
    a = old.select(*keys, *(F.col(c).alias(f"__a_{c}") for c in watched), F.lit(1).alias("__a"))
    b = new.select(*keys, *(F.col(c).alias(f"__b_{c}") for c in watched), F.lit(1).alias("__b"))
    differs = reduce(or_, (~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")) for c in watched))
    state = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "gone").when(differs, "changed").otherwise("same")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`; an aggregate, so it combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(*keys, "__v.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`new`, and the rows of `old` whose keys it hasn't."""
    return new.unionByName(old.join(new.select(*keys), keys, "left_anti"))


def replace_view(rows: DataFrame, path: str, view: str) -> None:
    """Write one view's rows, leaving the other views of the table alone. Column view must hold it."""
    rows.where(F.col("view") == view).write.partitionBy("view").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
