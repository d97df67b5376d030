"""Selections against labels: set metrics, phase metrics, deltas, contracts between splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_relation(ai: Column, human: Column) -> Column:
    """How a final set relates to a proposed one."""
    added, removed = F.size(F.array_except(human, ai)) > 0, F.size(F.array_except(ai, human)) > 0
    return F.when(added & removed, "changed").when(added, "human_added").when(removed, "human_removed").otherwise("exact")


def set_metrics(rows: DataFrame, ai: str, human: str, by: list[str]) -> DataFrame:
    """Exact and overlap rates and micro precision, recall and F1 of `ai` against `human` (arrays), overall
    and by each column of `by`: grouping sets in one pass. Columns: by (name or all), value, and metrics."""
    both = F.size(F.array_intersect(ai, human))
    one = rows.select(
        *(F.col(c).cast("string").alias(c) for c in by), both.alias("both"), F.size(F.array_distinct(ai)).alias("n_ai"), F.size(F.array_distinct(human)).alias("n_human"),
        (set_relation(F.col(ai), F.col(human)) == "exact").alias("exact"), (both > 0).alias("overlap"),
    )
    dims = F.explode(F.array(F.struct(F.lit("all").alias("by"), F.lit(None).cast("string").alias("value")), *(F.struct(F.lit(c).alias("by"), F.col(c).alias("value")) for c in by)))
    g = one.withColumn("d", dims).groupBy("d.by", "d.value").agg(
        F.count("*").alias("groups"), F.count_if("exact").alias("exact"), F.count_if("overlap").alias("overlap"), F.sum("both").alias("both"), F.sum("n_ai").alias("n_ai"), F.sum("n_human").alias("n_human")
    )
    p, r = F.try_divide("both", "n_ai"), F.try_divide("both", "n_human")
    r6 = lambda c: F.round(c, 6)
    return g.select(
        "by", "value", "groups", r6(F.col("exact") / F.col("groups")).alias("exact_rate"), r6(F.col("overlap") / F.col("groups")).alias("overlap_rate"),
        r6(p).alias("precision"), r6(r).alias("recall"), r6(F.try_divide(2 * F.col("both"), F.col("n_ai") + F.col("n_human"))).alias("f1"),
    )


def phase_metrics(annotated: DataFrame, predicted: DataFrame, group: str) -> DataFrame:
    """Over all groups: phase_recall (phases of which an acceptable keeper was kept), keeper_precision (kept
    that are acceptable) and retention (kept of all members).

    `annotated` has group, members (array) and phases (array of arrays of acceptable keepers); `predicted`
    group and keepers. A group on one side only is an error of the inputs; see bijection_faults().
    """
    j = annotated.join(predicted, group)
    hit = F.size(F.filter("phases", lambda p: F.arrays_overlap(p, F.col("keepers"))))
    good = F.size(F.array_intersect("keepers", F.flatten("phases")))
    s = j.agg(F.sum(hit).alias("h"), F.sum(F.size("phases")).alias("p"), F.sum(good).alias("g"), F.sum(F.size("keepers")).alias("k"), F.sum(F.size("members")).alias("m"))
    d = lambda a, b: F.round(F.try_divide(a, b), 6)
    return s.select(d("h", "p").alias("phase_recall"), d("g", "k").alias("keeper_precision"), d("k", "m").alias("retention"))


def valid_partition(members: Column, parts: Column) -> Column:
    """Whether `parts` (array of arrays) are disjoint, not empty, and cover the members just so."""
    flat = F.flatten(parts)
    return (F.size(flat) == F.size(F.array_distinct(flat))) & F.forall(parts, lambda p: F.size(p) > 0) & (F.array_sort(flat) == F.array_sort(members))


def leaked_events(splits: DataFrame, event: str, split: str) -> DataFrame:
    """Events that occur in more than one split."""
    return splits.groupBy(event).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def pair_label(final: Column, a: Column, b: Column) -> Column:
    """Which of two members a final set keeps: both, a, b or neither."""
    x, y = F.array_contains(final, a), F.array_contains(final, b)
    return F.when(x & y, "both").when(x, "a").when(y, "b").otherwise("neither")


def faithful(codes: Column, known: Column) -> Column:
    """Whether every evidence id of an explanation is known."""
    return F.forall(codes, lambda c: F.array_contains(known, c))
