"""Choosing what to keep: keeper per group, maximal marginal relevance, phases, protected variants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed
from .grouping import range_cuts


def keeper(members: DataFrame, group: str, item: str, score: str, size: str) -> DataFrame:
    """The member with the highest (score, size) of each group, the smallest id on ties."""
    return members.groupBy(group).agg(F.max_by(item, F.struct(score, size, -F.col(item))).alias("keep_id"))


def mmr_order(scores: np.ndarray, sizes: np.ndarray, ids: np.ndarray, unit: np.ndarray, k: int, weight: float = 0.7) -> list[int]:
    """Greedy picks: first the best score, then weight * score - (1 - weight) * highest similarity to the
    picks. Ties go by score, size, then the smaller id; a missing vector (zero) is similar to nothing."""
    left, picks = set(range(len(ids))), []
    near = np.zeros(len(ids))
    while left and len(picks) < k:
        value = weight * scores - (1 - weight) * near if picks else scores
        best = max(left, key=lambda i: (value[i], scores[i], sizes[i], -ids[i]))
        picks.append(best)
        left.remove(best)
        near = np.maximum(near, unit @ unit[best]) if len(picks) > 1 else unit @ unit[best]
    return picks


def mmr_keepers(members: DataFrame, group: str, item: str, score: str, size: str, vector: str, most: int = 3, weight: float = 0.7) -> DataFrame:
    """(group, item, pick) for min(most, 1 + floor(log2 n), n - 1, at least 1) diverse keepers a group.

    Each pick depends on those before it, so a group is worked on in one task; groups are bursts here.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.asarray(x, float) for x in pdf[vector]])
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.where(norm > 0, v / np.where(norm > 0, norm, 1), 0)
        n = len(pdf)
        k = max(1, min(most, n.bit_length(), n - 1))
        ids = pdf[item].to_numpy()
        picks = mmr_order(pdf[score].to_numpy(float), pdf[size].to_numpy(float), ids, v, k, weight)
        return pd.DataFrame({group: pdf[group].iloc[0], item: ids[picks], "pick": range(1, len(picks) + 1)})

    return members.select(group, item, score, size, vector).groupBy(group).applyInPandas(run, f"{group} long, {item} long, pick long")


def suppress_short(n: int, boundaries: dict[int, tuple[float, bool]], least: int = 2) -> list[int]:
    """Boundaries (place -> weight, strong) that remain when short segments are done away with: over and
    over, the first segment of fewer than `least` members loses the weaker of its boundaries that isn't
    strong; if it has none, it stays."""
    kept = dict(boundaries)
    fixed: set[tuple[int, int]] = set()
    while True:
        edges = [0, *sorted(kept), n]
        short = next(((a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a < least and (a, b) not in fixed), None)
        if short is None:
            return sorted(kept)
        weak = [e for e in short if e in kept and not kept[e][1]]
        if not weak:
            fixed.add(short)
            continue
        del kept[min(weak, key=lambda e: (kept[e][0], e))]


def protect_variants(members: DataFrame, group: str, item: str, score: str, kept: str, place: str, shift: float) -> DataFrame:
    """At most one more keeper a group: the best member that isn't kept and stands more than `shift` from
    every kept one (`place` is an array x, y). (group, item)."""
    keep = members.where(kept).select(group, F.col(place).alias("__p"))
    far = lambda a, b: F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2)) > shift
    rest = members.where(f"NOT {kept}").alias("m").join(keep.alias("k"), F.col(f"m.{group}") == F.col(f"k.{group}"))
    rest = rest.groupBy(f"m.{group}", f"m.{item}").agg(F.bool_and(far(F.col(f"m.{place}"), F.col("k.__p"))).alias("apart"), F.max(f"m.{score}").alias("s"))
    return rest.where("apart").groupBy(group).agg(F.max_by(item, F.struct("s", -F.col(item))).alias(item))


#: Least overlap of matched regions and least gains in the two local qualities: fixed values.
MATCHED_IOU, MUSIQ_GAIN, CLIPIQA_GAIN = 0.4, 1.0, 0.05


def dominance_penalty(members: DataFrame, regions: DataFrame, group: str, item: str, score: str, least: float = 0.9, penalty: float = 0.08) -> DataFrame:
    """Scores less a penalty (once, not below 0) where another member of the group shows the same region
    better: (group, item, adjusted).

    `regions` has group, item, kind, class_id, box (x0, y0, x1, y1 from 0 to 1), vector (of length 1), musiq
    and clipiqa; one row per item, kind and class. Regions match if kind and class agree, boxes overlap by
    MATCHED_IOU or more and vectors are alike; a face is compared by the subject region around it, which
    must match as well. The better one must gain in both qualities."""
    from ..functions.columns import dot, iou

    x, y = regions.alias("x"), regions.alias("y")
    same = (F.col(f"x.{group}") == F.col(f"y.{group}")) & (F.col("x.class_id") == F.col("y.class_id")) & (F.col(f"x.{item}") != F.col(f"y.{item}"))
    gains = (F.col("y.musiq") - F.col("x.musiq") >= MUSIQ_GAIN) & (F.col("y.clipiqa") - F.col("x.clipiqa") >= CLIPIQA_GAIN)
    overlap = iou(F.col("x.box"), F.col("y.box")) >= MATCHED_IOU
    names = [F.col(f"x.{group}").alias("__g"), F.col(f"x.{item}").alias("__x"), F.col(f"y.{item}").alias("__y"), F.col("x.class_id").alias("__c")]
    alike = dot(F.col("x.vector"), F.col("y.vector")) >= least
    better = x.join(y, same & (F.col("x.kind") == F.col("y.kind")) & gains & overlap)
    other = better.where((F.col("x.kind") != "face") & alike).select(*names)
    subject = lambda side: (F.col(f"{side}.kind") == "subject")
    parents = x.join(y, same & subject("x") & subject("y") & overlap & alike).select(*names)
    faces = better.where(F.col("x.kind") == "face").select(*names).join(parents, ["__g", "__x", "__y", "__c"], "left_semi")
    beaten = other.union(faces).select(F.col("__g").alias(group), F.col("__x").alias(item)).distinct()
    out = members.join(beaten.withColumn("__b", F.lit(True)), [group, item], "left")
    return out.select(group, item, F.when(F.col("__b"), F.greatest(F.lit(0.0), F.col(score) - penalty)).otherwise(F.col(score)).alias("adjusted"))


def next_in_queue(rows: DataFrame, item: str, asks: str, queued: str, slices: int = 64) -> DataFrame:
    """For each item that asks: (item, next_id, place), the next queued item, else the last one of all, and how many
    queued rows come before it, once for each of the item's rows that ask. An empty queue gives no rows; a null
    item has none before it and is nobody's next.

    Items are cut into `slices` ranges of about as many each. Within one, running sums and minima do; of each
    range only its number of queued rows and its first queued item meet the other ranges'.
    """
    yes = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    each = checkpointed(rows.groupBy(item).agg(yes(asks).alias("__asks"), yes(queued).alias("__n")).where("__asks > 0 OR __n > 0"))
    cuts = range_cuts(each.where(F.col(item).isNotNull()), item, slices)
    place = F.lit(0)
    for k, cut in enumerate(cuts):
        place = F.when(F.col(item) > cut, k + 1).otherwise(place)
    ranged = each.where(F.col(item).isNotNull()).withColumn("__r", place)
    q = F.when(F.col("__n") > 0, F.col(item))
    back, ahead = Window.partitionBy("__r").orderBy(item), Window.partitionBy("__r").orderBy(F.desc(item))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = ranged.withColumn("__before", F.coalesce(F.sum("__n").over(upto(back)), F.lit(0))).withColumn("__next", F.min(q).over(upto(ahead)))
    # a row a range
    whole = ranged.groupBy("__r").agg(F.sum("__n").alias("n"), F.min(q).alias("first"))
    up, down = Window.orderBy("__r"), Window.orderBy(F.desc("__r"))
    ends = whole.select("__r", F.coalesce(F.sum("n").over(upto(up)), F.lit(0)).alias("__lower"), F.min("first").over(upto(down)).alias("__later"))
    found = inner.join(F.broadcast(ends), "__r").where("__asks > 0")
    found = found.select(item, F.coalesce("__next", "__later").alias("next_id"), ((F.col("__before") + F.col("__lower")) * F.col("__asks")).alias("place"))
    nobody = each.where(F.col(item).isNull() & (F.col("__asks") > 0)).select(item, F.lit(None).cast(each.schema[item].dataType).alias("next_id"), F.lit(0).cast("long").alias("place"))
    last = each.where("__n > 0").agg(F.max(item).alias("__last"), F.count("*").alias("__queued")).where("__queued > 0")
    return found.union(nobody).crossJoin(F.broadcast(last)).select(item, F.coalesce("next_id", "__last").alias("next_id"), "place")
