"""Logical phases of a group in time, and which members to keep of each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot, keeper_budget, unit
from .selection import suppress_short

#: How far below a group's habit a similarity is odd, and the limits of the rules below: fixed values.
PHASE = {"below_habit": 0.035, "strong": 0.88, "strong_below": 0.05, "tableau": 0.955, "sparse": 0.90, "faces": 0.91, "moved": 0.05, "crowd": 3}


def phase_edges(members: DataFrame, group: str, item: str, ts: str, vector: str, faces: str, center: str, kind: str, gap: int = 4, boundary: float = 0.93, shift: float = 0.22) -> DataFrame:
    """Members in order of time (nulls last, then by item) with what sets each apart from the one before it:
    (group, item, place from 0, n, similarity, cut, strong, reasons, doubts).

    A cut takes a jump in time, a very low similarity, or one that is odd for the group along with a moved
    subject or another number of faces; near-hash groups (kind phash_near) also cut at a lasting change of
    scene. `center` is an array (x, y) or null. Groups of two or fewer have no cuts."""
    order = Window.partitionBy(group).orderBy(F.col("t").asc_nulls_last(), item)
    whole = Window.partitionBy(group)
    m = members.select(group, item, kind, F.col(ts).alias("t"), unit(F.col(vector)).alias("v"), F.coalesce(F.col(faces), F.lit(0)).alias("f"), F.col(center).alias("c"))
    m = m.withColumn("place", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(whole))
    for name in "tvfc":
        m = m.withColumn(f"p{name}", F.lag(name).over(order))
    inner = F.col("place") > 0
    m = m.withColumn("similarity", F.when(F.size("v") == F.size("pv"), dot(F.col("v"), F.col("pv")))).withColumn("usual", F.median("similarity").over(whole))
    c, s, p = F.col, F.col("similarity"), PHASE
    yes = lambda x: F.coalesce(x, F.lit(False)) & inner
    moved = F.greatest(F.abs(c("c")[0] - c("pc")[0]), F.abs(c("c")[1] - c("pc")[1]))
    apart, crowd = F.abs(c("f") - c("pf")), F.greatest("f", "pf") > p["crowd"]
    jump, away = yes(c("t") - c("pt") > gap), yes(moved > shift)
    odd = yes((s < boundary) & (s < c("usual") - p["below_habit"]))
    low = yes(s < min(p["strong"], boundary - p["strong_below"]))
    near = F.col(kind) == "phash_near"
    tableau = yes(near & (s < p["tableau"]))
    sparse = yes((F.col(kind) == "burst") & odd & (s < p["sparse"]) & (moved > p["moved"]))
    people = yes(odd & (apart >= 2) & ~crowd & (s < p["faces"]))
    alone = jump | low | tableau | sparse | people
    backed = odd & (away | yes((apart >= 1) & ~crowd))
    cut = F.when(near, jump | low | tableau | (odd & away)).otherwise(alone | backed) & (c("n") >= 3)
    named = lambda *pairs: F.filter(F.array(*(F.when(test, F.lit(name)) for test, name in pairs)), lambda x: x.isNotNull())
    faceless = c("c").isNull() | c("pc").isNull()
    return m.select(
        group, item, "place", "n", "similarity", cut.alias("cut"), (cut & alone).alias("strong"),
        named((jump, "TIME_GAP"), (away, "DETECTED_SUBJECT_POSITION_CHANGE"), (odd, "LOCAL_BASELINE_EMBEDDING_CHANGE")).alias("reasons"),
        named((inner & s.isNull(), "EMBEDDING_MISSING"), (inner & faceless & (F.greatest("f", "pf") > 0), "FACE_POSITION_MISSING"), (inner & (c("t").isNull() | c("pt").isNull()), "TIME_MISSING")).alias("doubts"),
    )


def logical_phases(edges: DataFrame, group: str, item: str, least: int = 2) -> DataFrame:
    """(group, item, phase, reasons, doubts) from phase_edges(): runs between the cuts that remain when runs of
    fewer than `least` members lose their weaker cuts. Only cuts go through Python, never vectors. Reasons are those of
    the phase's first cut, doubts those of all its steps."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cuts = {int(p): (0.0 if np.isnan(s) else 1.0 - s, bool(st)) for p, s, st in zip(pdf.place, pdf.similarity.astype(float), pdf.strong, strict=True)}
        kept = suppress_short(int(pdf.n.iloc[0]), cuts, least)
        return pd.DataFrame({group: pdf[group].iloc[0], "place": kept})

    kinds = dict(edges.dtypes)
    kept = edges.where("cut").select(group, "place", "n", "similarity", "strong").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, place int")
    rows = edges.join(kept.withColumn("starts", F.lit(True)), [group, "place"], "left")
    number = F.count("starts").over(Window.partitionBy(group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("phase", number.cast("int"))
    one = Window.partitionBy(group, "phase")
    first = F.max(F.when(F.col("starts"), F.col("reasons"))).over(one)
    reasons = F.when(F.col("phase") == 0, F.array(F.lit("LOGICAL_PHASE_START"))).otherwise(first)
    return rows.select(group, item, "phase", reasons.alias("reasons"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("doubts").over(one)))).alias("doubts"))


def diverse_order(scores: np.ndarray, sizes: np.ndarray, ids: np.ndarray, unit: np.ndarray, k: int, weight: float = 0.7, slack: float | None = None) -> tuple[list[int], bool]:
    """Up to k picks: the best (score, size, smaller id), then by weight * score - (1 - weight) * highest
    similarity to the picks. With a `slack`, and a vector for every one, a candidate that is less like the picks goes first if
    its score is within slack of the best candidate's. Zero vectors are like nothing. Also whether slack decided."""
    has = np.linalg.norm(unit, axis=1) > 0
    near, any_near, left, picks, banded = np.zeros(len(ids)), np.zeros(len(ids), bool), set(range(len(ids))), [], False
    while left and len(picks) < k:
        value = weight * scores - (1 - weight) * near if picks else scores
        best = max(left, key=lambda i: (value[i], scores[i], sizes[i], -ids[i]))
        if picks and slack is not None and has[[*left, *picks]].all():
            floor = max(scores[i] for i in left) - slack
            other = min((i for i in left if scores[i] >= floor), key=lambda i: (near[i], -scores[i], -sizes[i], ids[i]))
            if near[best] - near[other] > 1e-6:
                best, banded = other, True
        picks.append(best)
        left.remove(best)
        if has[best]:
            alike = unit @ unit[best]
            near = np.where(has, np.where(any_near, np.maximum(near, alike), alike), 0.0)
            any_near |= has
    return picks, banded


#: Doubts that earn a phase one more keeper, and the lead under which missing evidence is reviewed: fixed values.
CRITICAL, CLOSE_LEAD = frozenset({"TIME_MISSING", "EMBEDDING_MISSING", "FACE_POSITION_MISSING"}), 0.08


def phase_keepers(
    members: DataFrame, group: str, item: str, score: str, size: str, vector: str, faces: str, optional: str,
    per_phase: int = 1, most: int = 3, variety: float = 0.965, weight: float = 0.7, slack: float | None = None,
) -> DataFrame:
    """Keepers of each phase, (group, phase, members, keepers, reasons, review, budget, limited), in arrays of ids.

    `members` has phase, reasons and doubts of logical_phases(); `optional` tells that optional evidence is
    missing. A phase keeps `per_phase` members, one more if it varies (three members or more, some pair less alike
    than `variety`, or several numbers of faces) and one more for a critical doubt. Then the group's budget,
    min(most, 1 + floor(log2 n)) and never all, chooses among them the same way. Picks depend on those before
    them, so a group is worked on in one task; groups are bursts here. Null vectors are like nothing."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(item).reset_index(drop=True)
        width = max((len(x) for x in pdf.v if x is not None), default=1)
        v = np.stack([np.zeros(width) if x is None or len(x) != width else np.asarray(x, float) for x in pdf.v])
        scores, sizes, ids, has = pdf.score.to_numpy(float), pdf["size"].fillna(0).to_numpy(float), pdf[item].to_numpy(), np.linalg.norm(v, axis=1) > 0
        rows, kept = [], []
        for phase, part in pdf.groupby("phase"):
            at = part.index.to_numpy()
            target, codes = max(1, per_phase), ["LOGICAL_PHASE_MINIMUM_KEEPER"]
            known = at[has[at]]
            alike = (v[known] @ v[known].T)[np.triu_indices(len(known), 1)]
            if len(at) >= 3 and ((len(alike) and alike.min() < variety) or part.faces.nunique() > 1) and len(at) > target:
                target, codes = target + 1, [*codes, "OBSERVED_VARIATION_EXTRA_KEEPER"]
            critical = bool(CRITICAL & set(part.doubts.iloc[0]))
            if critical and len(at) > target:
                target, codes = target + 1, [*codes, "PRIMARY_BOUNDARY_EVIDENCE_EXTRA_KEEPER"]
            top = np.sort(scores[at])[::-1]
            close = bool(part.optional.any() and (top[0] - top[1] if len(top) > 1 else 1.0) < CLOSE_LEAD and (part.faces > 0).any())
            codes += ["OPTIONAL_SCORING_EVIDENCE_MISSING"] * bool(part.optional.any()) + ["OPTIONAL_EVIDENCE_LOW_MARGIN_REVIEW"] * close
            picks, banded = diverse_order(scores[at], sizes[at], ids[at], v[at], target, weight, slack)
            codes += ["QUALITY_BANDED_DIVERSITY"] * banded + ["MMR_QUALITY_DIVERSITY"] * (len(picks) > 1)
            chosen = at[picks].tolist()
            kept += chosen
            rows.append([phase, at, chosen, [*part.reasons.iloc[0], *part.doubts.iloc[0], *codes], critical or close or banded])
        budget = int(pdf.budget.iloc[0])
        if limited := len(kept) > budget:
            pool = np.array(kept)
            picks, banded = diverse_order(scores[pool], sizes[pool], ids[pool], v[pool], budget, weight, slack)
            stay = set(pool[picks].tolist())
            for r in rows:
                r[2] = [i for i in r[2] if i in stay]
                extra = "LOGICAL_PHASE_ANNOTATED_NOT_SEPARATELY_RETAINED" if not r[2] else "QUALITY_BANDED_BUDGET_ALLOCATION" if banded else None
                if extra:
                    r[3], r[4] = [*r[3], extra], True
        return pd.DataFrame({
            group: pdf[group].iloc[0], "phase": [r[0] for r in rows], "members": [ids[r[1]].tolist() for r in rows], "keepers": [ids[r[2]].tolist() for r in rows],
            "reasons": [list(dict.fromkeys(r[3])) for r in rows], "review": [bool(r[4]) for r in rows], "budget": budget, "limited": limited,
        })

    n = F.count("*").over(Window.partitionBy(group))
    c = members.select(
        group, item, "phase", "reasons", "doubts", F.coalesce(F.col(score), F.lit(0.0)).cast("double").alias("score"), F.col(size).cast("double").alias("size"), unit(F.col(vector)).alias("v"),
        F.coalesce(F.col(faces), F.lit(0)).alias("faces"), F.coalesce(F.col(optional), F.lit(True)).alias("optional"), keeper_budget(n, most).alias("budget"),
    )
    types = dict(members.dtypes)
    ids = f"array<{types[item]}>"
    return c.groupBy(group).applyInPandas(run, f"{group} {types[group]}, phase int, members {ids}, keepers {ids}, reasons array<string>, review boolean, budget int, limited boolean")


def coverage(phases: DataFrame, group: str, phase: str, members: Column, keepers: Column, budget: Column) -> DataFrame:
    """How a group's keepers cover its phases, for review only: (group, phases, uncovered, conflict, extra_needed,
    extra_all, codes). A conflict is more phases than budget; a gap, without a conflict, a phase without keepers."""
    g = phases.groupBy(group).agg(
        F.count("*").alias("phases"), F.array_sort(F.collect_list(F.when(F.size(keepers) == 0, F.col(phase)))).alias("uncovered"), F.first(budget).alias("__b"),
        F.sum(F.size(members) - F.size(keepers)).alias("extra_all"),
    )
    conflict = F.col("phases") > F.col("__b")
    codes = F.when(conflict, F.array(F.lit("PHASE_COVERAGE_BUDGET_CONFLICT"))).when(F.size("uncovered") > 0, F.array(F.lit("PHASE_COVERAGE_GAP"))).otherwise(F.array().cast("array<string>"))
    return g.select(group, "phases", "uncovered", conflict.alias("conflict"), F.greatest(F.lit(0), F.col("phases") - F.col("__b")).alias("extra_needed"), "extra_all", codes.alias("codes"))


def protect_poses(members: DataFrame, compared: DataFrame, group: str, item: str, score: str, kept: str, least: float = 0.4) -> DataFrame:
    """At most one more keeper a group of 2 to 6, (group, item): the best member, the smaller id on ties, whose pose is known
    to differ by `least` or more from every keeper's. `compared` is what compare_poses() gives for frames that are
    members (left) and keepers (right). Groups without a keeper, or with nothing else, get none."""
    n = members.groupBy(group).agg(F.count("*").alias("__n"), F.count_if(F.col(kept)).alias("__k")).where("__n BETWEEN 2 AND 6 AND __k BETWEEN 1 AND __n - 1")
    keep = members.where(kept).select(group, F.col(item).alias("right"))
    rest = members.where(f"NOT {kept}").join(n, group).select(group, F.col(item).alias("left"), F.col(score).alias("__s"))
    far = F.coalesce(F.col("eligible") & (F.col("displacement") >= least), F.lit(False))
    met = rest.join(keep, group).join(compared.select("left", "right", "eligible", "displacement"), ["left", "right"], "left")
    good = met.groupBy(group, "left").agg(F.bool_and(far).alias("far"), F.max("__s").alias("__s")).where("far")
    return good.groupBy(group).agg(F.max_by("left", F.struct("__s", -F.col("left"))).alias(item))
