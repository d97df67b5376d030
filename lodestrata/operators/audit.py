"""Risk, budgets, samples for audit and error bounds."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the risk reasons: fixed values.
RISK_WEIGHTS = {
    "GROUP_NOT_BYTE_IDENTICAL": 0.04,
    "LARGE_GROUP": 0.08,
    "LONG_TIME_SPAN": 0.08,
    "LOW_EMBEDDING_PURITY": 0.13,
    "LOCAL_CHANGE_SIGNAL": 0.13,
    "FACE_COUNT_CONFLICT": 0.10,
    "IDENTITY_OR_POSITION_CONFLICT": 0.12,
    "LOW_QUALITY_MARGIN": 0.12,
    "CRITICAL_EVIDENCE_MISSING": 0.10,
    "V2_V3_DISAGREEMENT": 0.13,
    "MULTI_KEEPER_BUDGET": 0.09,
    "LOGICAL_MULTI_PHASE": 0.10,
    "ALGORITHM_CHANGED_KEEPER": 0.08,
    "BASELINE_KEEPER_DISPLACED": 0.08,
}
#: Members, seconds, similarities and margin from which a reason applies: fixed values.
RISK_LIMITS = {"members": 5, "seconds": 8, "pair": 0.94, "adjacent": 0.95, "margin": 0.06}


def risk_reasons(evidence: dict[str, Column]) -> Column:
    """Reasons that apply to a group, as an array of (weight, reason), the weightiest first, ties by name.

    `evidence` may hold group_type, member_count, time_span_seconds, min_pair_similarity,
    min_adjacent_similarity, face_count_states, position_conflict, quality_margin, critical_missing_count,
    v2_v3_disagreement, keeper_count, logical_phase_count, changed, baseline_keeper_ids and
    candidate_keeper_ids; what is absent or null raises no alarm, but a group of unknown type isn't byte
    identical, and an unknown margin is a low one."""
    t = RISK_LIMITS
    given = lambda name, default=None: F.coalesce(evidence[name], F.lit(default)) if name in evidence else F.lit(default)
    baseline, candidate = (evidence.get(f"{x}_keeper_ids", F.array().cast("array<bigint>")) for x in ("baseline", "candidate"))
    displaced = F.size(F.array_except(baseline, F.coalesce(candidate, F.array().cast("array<bigint>")))) > 0
    tests = {
        "GROUP_NOT_BYTE_IDENTICAL": given("group_type", "") != "sha_exact",
        "LARGE_GROUP": given("member_count", 0) >= t["members"],
        "LONG_TIME_SPAN": given("time_span_seconds", 0) > t["seconds"],
        "LOW_EMBEDDING_PURITY": given("min_pair_similarity", 1.0) < t["pair"],
        "LOCAL_CHANGE_SIGNAL": given("min_adjacent_similarity", 1.0) < t["adjacent"],
        "FACE_COUNT_CONFLICT": given("face_count_states", 1) > 1,
        "IDENTITY_OR_POSITION_CONFLICT": given("position_conflict", False),
        "LOW_QUALITY_MARGIN": given("quality_margin", -1.0) < t["margin"],
        "CRITICAL_EVIDENCE_MISSING": given("critical_missing_count", 0) > 0,
        "V2_V3_DISAGREEMENT": given("v2_v3_disagreement", False),
        "MULTI_KEEPER_BUDGET": given("keeper_count", 1) > 1,
        "LOGICAL_MULTI_PHASE": given("logical_phase_count", 1) > 1,
        "ALGORITHM_CHANGED_KEEPER": given("changed", False),
        "BASELINE_KEEPER_DISPLACED": displaced,
    }
    found = F.array(*(F.when(x, F.struct((-F.lit(RISK_WEIGHTS[k])).alias("w"), F.lit(k).alias("reason"))) for k, x in tests.items()))
    return F.transform(F.array_sort(F.filter(found, lambda r: r.isNotNull())), lambda r: F.struct((-r["w"]).alias("weight"), r["reason"].alias("reason")))


def review_impact(members: Column, keepers: Column) -> Column:
    """How many members a wrong decision concerns: those that aren't kept, at least one."""
    return F.greatest(F.lit(1), F.coalesce(members, F.lit(1)) - F.coalesce(keepers, F.lit(1)))


def risk_score(reasons: Column) -> Column:
    total = F.aggregate(reasons, F.lit(0.0), lambda s, r: s + r["weight"])
    return F.round(F.least(F.lit(1.0), total), 6)


def expected_value(score: Column, impact: Column) -> Column:
    return F.round(score * (1 + F.log2(impact + 1)), 6)


def within_budget(rows: DataFrame, order: list[Column], share: float, mandatory: Column, by: list[str] | None = None) -> DataFrame:
    """`rows` with risk_rank and selected: the first floor(n * share) in order, and all mandatory ones."""
    w, whole = Window.partitionBy(*(by or [])).orderBy(*order), Window.partitionBy(*(by or []))
    out = rows.withColumn("risk_rank", F.row_number().over(w))
    return out.withColumn("selected", (F.col("risk_rank") <= F.floor(F.count("*").over(whole) * share)) | F.coalesce(mandatory, F.lit(False)))


def deciles(rows: DataFrame, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """`rows` with decile: min(10, 1 + index * 10 div n), which isn't ntile where 10 doesn't divide n."""
    w, whole = Window.partitionBy(*(by or [])).orderBy(*order), Window.partitionBy(*(by or []))
    at = F.row_number().over(w) - 1
    return rows.withColumn("decile", F.least(F.lit(10), 1 + F.floor(at * 10 / F.count("*").over(whole))).cast("int"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, seed: int) -> DataFrame:
    """A sample of `size` rows with inclusion probability and weight. Each stratum gives one row first (in
    order of name, while `size` lasts), then always the one that has most left gives another, of equals the
    one whose name sorts last. That empties the fullest strata down to one level, which the counts alone
    determine. Within a stratum rows go by a hash of seed and key, so the draw repeats in any partitioning;
    only one row per stratum meets in one place."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    one = Window.partitionBy()
    by_rest = Window.orderBy(F.desc("rest"), F.desc_nulls_last(stratum))
    shares = counts.withColumn("first", F.row_number().over(Window.orderBy(stratum)) <= size).withColumn("rest", F.col("n") - 1)
    more = F.greatest(F.lit(0), F.least(size - F.count("*").over(one), F.sum("rest").over(one)))
    shares = shares.withColumn("more", more).withColumn("place", F.row_number().over(by_rest))
    upto = F.sum("rest").over(by_rest.rowsBetween(Window.unboundedPreceding, 0))
    shares = shares.withColumn("upto", upto)
    shares = shares.withColumn("level", F.greatest(F.lit(0), F.max(F.ceil((F.col("upto") - F.col("more")) / F.col("place"))).over(one)))
    down = F.greatest(F.lit(0), F.col("rest") - F.col("level"))
    shares = shares.withColumn("down", down).withColumn("over", F.col("more") - F.sum("down").over(one))
    at_level = Window.partitionBy((F.col("rest") >= F.col("level")) & (F.col("level") > 0)).orderBy(F.desc_nulls_last(stratum))
    extra = F.when((F.col("rest") >= F.col("level")) & (F.col("level") > 0) & (F.row_number().over(at_level) <= F.col("over")), 1).otherwise(0)
    shares = shares.withColumn("take", F.when(F.col("first"), 1 + F.col("down") + extra).otherwise(0)).select(F.col(stratum).alias("__s"), "n", "take")
    draw = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key)))
    out = ranked.join(shares, F.col(stratum).eqNullSafe(F.col("__s"))).where("__r <= take").drop("__r", "__s")
    return out.withColumn("inclusion", F.col("take") / F.col("n")).withColumn("weight", F.col("n") / F.col("take"))


def wilson_upper(errors: Column, n: Column, confidence: float = 0.95) -> Column:
    """One-sided Wilson bound on an error rate; 1 without trials."""
    z = NormalDist().inv_cdf(confidence)
    p = errors / n
    mid, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, F.least(F.lit(1.0), (mid + spread) / (1 + z * z / n))).otherwise(1.0)


def zero_event_bound(n: Column, confidence: float = 0.95) -> Column:
    """Exact bound on a rate of which n trials showed no event."""
    return F.when(n > 0, 1 - F.pow(F.lit(1 - confidence), 1 / n)).otherwise(1.0)


def stratum_bound(rate: Column, sampled: Column, population: Column, active: Column, alpha: float = 0.05) -> Column:
    """Hoeffding bound with the error shared over the active strata; a census is exact."""
    return F.when(sampled >= population, rate).otherwise(F.least(F.lit(1.0), rate + F.sqrt(F.ln(active / alpha) / (2 * sampled))))

