"""Evidence as long tables: flattened JSON, ranks and deltas, summaries, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_json(text: Column) -> Column:
    """The value as a variant; null for bad JSON, repeated keys, and the tokens NaN and Infinity."""
    plain = F.regexp_replace(text, r'"(\\.|[^"\\])*"', '""')
    return F.when(~plain.rlike(r"NaN|Infinity"), F.try_parse_json(text))


def parse_meta(text: Column, schema: str) -> Column:
    """A JSON object by schema; anything else counts as an empty object."""
    return F.coalesce(F.from_json(text, schema), F.from_json(F.lit("{}"), schema))


def json_numbers(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value) of the numbers at the top level of JSON objects; other rows give nothing."""
    pairs = F.explode(F.from_json(text, "map<string,string>"))
    return rows.select(key, pairs.alias("path", "raw")).select(key, "path", F.col("raw").try_cast("double").alias("value")).where("value IS NOT NULL")


def summaries(long_: DataFrame, by: list[str], value: str) -> DataFrame:
    v = F.col(value)
    return long_.groupBy(*by).agg(
        F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"),
        F.median(v).alias("median"), F.stddev_pop(v).alias("spread"),
    )


def top_categories(rows: DataFrame, by: str, category: str, k: int) -> DataFrame:
    """The k most frequent categories of each group, smaller name first on ties."""
    n = rows.groupBy(by, category).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), category))
    return n.withColumn("place", rank).where(F.col("place") <= k)


def mean_vector(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group at length 1: averaged place by place, then put together."""
    flat = rows.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.avg("x").alias("x"))
    parts = flat.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    v = F.transform("v", lambda p: p["x"])
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return parts.select(group, F.transform(v, lambda x: F.try_divide(x, norm)).alias("centre"))


def packed_within(rows: DataFrame, by: str, order: list[str], size: str, cap: int) -> DataFrame:
    """Rows of each group, in order, while the running sum of sizes stays within the cap."""
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= cap)
