"""Ordered decision rules as conditional expressions: members, exposure, eyes, pairs, routing, policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least margin to the keeper by profile: fixed values.
MARGINS = {"conservative": 0.14, "balanced": 0.08, "aggressive": 0.04}
#: Exposure thresholds: fixed values.
EXPOSURE = {"hi": 0.35, "blob": 0.20, "anchor": 0.10, "lo": 0.60, "anchor_dark": 0.05, "entropy": 3.0, "mass": 0.25}
EXPOSURE_MAYBE = {"hi": 0.15, "lo": 0.35, "anchor": 0.25, "mass": 0.45}
#: Event presets (most members of a visual group, keepers a phase, identity required): fixed values.
EVENT_PRESETS = {"general": (8, 1, True), "stage": (5, 2, False), "convention": (8, 1, True), "pet": (6, 2, False), "design_reference": (4, 2, False)}
#: What can be relied on in full, and the least confidence of a policy that isn't weak: fixed values.
FULL_CAPABILITY, LEAST_CONFIDENCE = "full", 0.65
#: Thresholds of eye states: fixed values.
EYES = {"open_max": 0.15, "closed_min": 0.50, "asymmetry_max": 0.25, "min_iod_px": 24.0, "min_face_px": 96.0, "smile_high": 0.45, "squint_high": 0.45}
#: Patterns of reviewers' notes: fixed values.
NOTE_ABSTAIN = "缩略图.{0,12}看不清|没法确认留哪张|(?:没法|无法)判断|要看清晰度|动作很快.{0,12}看不清"
NOTE_ASSESSED = "构图更完整|主体完整|水柱.{0,16}(?:挡住|遮挡)|更水平|正脸优先"
NOTE_PHASE_UNCERTAIN = "(?:阶段|动作|姿势).{0,8}(?:不确定|无法判断|没法判断)|(?:不确定|无法判断|没法判断).{0,8}(?:阶段|动作|姿势)"
#: Purposes that tune something, and the one that reports: fixed values.
TUNING_PURPOSES, REPORT_PURPOSE = ("train", "threshold_search", "prompt_selection", "preset_selection"), "final_evaluation"


def member_decision(profile: str = "balanced", exposure_reason: Column | None = None) -> tuple[Column, Column]:
    """Decision and reason of a member that isn't the keeper. First match wins, and a missing feature comes
    before byte identity. Columns used: missing, same_sha, trusted, group_type, face_conflict, exposure,
    keeper_exposure, margin. `exposure_reason` is put behind the codes that stem from it (else the class)."""
    c = F.col
    detail = F.coalesce(exposure_reason if exposure_reason is not None else c("exposure"), F.lit(""))
    untrusted = F.when(c("group_type") == "phash_near", "PHASH_NEAR_UNTRUSTED").when(c("group_type") == "similar_scene", "SIMILAR_SCENE_UNTRUSTED").otherwise("GROUP_IMPURE")
    reject = (c("exposure") == "reject") & (c("keeper_exposure") != "reject")
    chain = [
        (c("missing"), "UNKNOWN", F.lit("FEATURE_MISSING")),
        (c("same_sha"), "AUTO_REMOVE", F.lit("BYTE_IDENTICAL")),
        (~c("trusted"), "MAYBE", untrusted),
        (c("group_type") == "sha_exact", "MAYBE", F.lit("SHA_GROUP_NO_MATCH")),
        (c("group_type") == "phash_near", "MAYBE", F.lit("PHASH_NEAR_DUP_ONLY")),
        (c("group_type") == "similar_scene", "MAYBE", F.lit("SUBJECTIVE_ONLY: similar_scene")),
        (c("face_conflict"), "MAYBE", F.lit("FACE_COUNT_MISMATCH")),
        (reject, "UNKNOWN" if profile == "conservative" else "MAYBE", F.concat(F.lit(f"EXPOSURE_UNCALIBRATED_{profile.upper()}: "), detail)),
        (c("margin") < MARGINS[profile], "MAYBE", F.lit("LOW_MARGIN")),
        (c("exposure") == "maybe", "MAYBE", F.concat(F.lit("EXPOSURE_BORDERLINE: "), detail)),
    ]
    decision = reason = None
    for when, what, why in chain:
        fits = F.coalesce(when, F.lit(False))
        decision = (F if decision is None else decision).when(fits, what)
        reason = (F if reason is None else reason).when(fits, why)
    return decision.otherwise("MAYBE"), reason.otherwise("RELATIVE_ONLY")


def group_state(decisions: Column) -> Column:
    """AUTO_READY if no member is MAYBE or UNKNOWN (an aggregate)."""
    return F.when(F.bool_or(decisions.isin("MAYBE", "UNKNOWN")), "REVIEW_REQUIRED").otherwise("AUTO_READY")


def exposure_class(m: Column, faces: Column | None = None) -> Column:
    """ok, maybe or reject of exposure metrics (a struct). The first face that is well exposed or clipped
    decides before the whole picture does."""
    t, u = EXPOSURE, EXPOSURE_MAYBE
    burnt = (m["clip_hi"] > t["hi"]) & (m["blob_hi"] > t["blob"]) & (m["anchor_mass"] < t["anchor"])
    dark = (m["clip_lo"] > t["lo"]) & (m["anchor_mass"] < t["anchor_dark"])
    flat = (m["entropy_nonclip"] < t["entropy"]) & (m["mass_usable"] < t["mass"])
    some = (m["clip_hi"] > u["hi"]) | (m["clip_lo"] > u["lo"]) | ((m["anchor_mass"] < u["anchor"]) & (m["mass_usable"] < u["mass"]))
    whole = F.when(burnt | dark | flat, "reject").when(some, "maybe").otherwise("ok")
    if faces is None:
        return whole
    well = lambda f: f["ymean"].between(0.18, 0.85) & (f["clip_hi"] < 0.20) & (f["clip_lo"] < 0.20)
    clipped = lambda f: (f["clip_hi"] > 0.60) | (f["clip_lo"] > 0.60)
    first = F.try_element_at(F.filter(faces, lambda f: well(f) | clipped(f)), F.lit(1))
    return F.when(first.isNull(), whole).when(well(first), "ok").otherwise("reject")


def eye_state(blink_left: Column, blink_right: Column, face_width: Column, eye_distance: Column, smile: Column, squint: Column) -> tuple[Column, Column]:
    """State and reason of one face. Both blinks must agree for OPEN or CLOSED; a strong smile with a strong
    squint (each the larger of its two sides, null as 0) makes closed eyes MAYBE."""
    t, apart = EYES, F.abs(blink_left - blink_right)
    missing = blink_left.isNull() | blink_right.isNull() | face_width.isNull() | eye_distance.isNull()
    shut = lambda blink: blink >= t["closed_min"]
    laughs = (F.coalesce(smile, F.lit(0.0)) >= t["smile_high"]) & (F.coalesce(squint, F.lit(0.0)) >= t["squint_high"])
    rules = (
        (missing, "UNKNOWN", "MISSING_EVIDENCE"),
        ((face_width < t["min_face_px"]) | (eye_distance < t["min_iod_px"]), "UNKNOWN", "SMALL_FACE"),
        ((blink_left <= t["open_max"]) & (blink_right <= t["open_max"]), "OPEN", "BOTH_EYES_OPEN"),
        (shut(blink_left) & shut(blink_right) & (apart <= t["asymmetry_max"]) & laughs, "MAYBE", "SMILE_SQUINT"),
        (shut(blink_left) & shut(blink_right) & (apart <= t["asymmetry_max"]), "CLOSED", "BOTH_EYES_CLOSED"),
        ((shut(blink_left) != shut(blink_right)) | (apart > t["asymmetry_max"]), "MAYBE", "WINK_OR_ASYMMETRIC"),
    )
    state = reason = F
    for fits, what, why in rules:
        state, reason = state.when(fits, what), reason.when(fits, why)
    return state.otherwise("MAYBE"), reason.otherwise("BLINK_GRAY_ZONE")


def frame_eyes(states: Column, expected: Column) -> Column:
    """Status of a frame from its faces' states; a null `expected` number of faces isn't checked."""
    out = F.when(F.size(states) != expected, "UNKNOWN").when(F.size(states) == 0, "NO_FACE")
    for state, status in (("CLOSED", "HAS_CLOSED_EYES"), ("UNKNOWN", "UNKNOWN"), ("MAYBE", "HAS_MAYBE")):
        out = out.when(F.array_contains(states, state), status)
    return out.otherwise("ALL_OPEN")


def authorize(split: Column, purpose: Column, labels: Column) -> Column:
    """Whether a use of a dataset is allowed, as a struct (verdict, labels_authorized, report_only). Held-out
    data are for the final report alone, labels for nothing else, and the report for nothing but held-out data."""
    held = split == "held_out"
    verdict = (
        F.when(~F.coalesce(purpose.isin(*TUNING_PURPOSES, REPORT_PURPOSE), F.lit(False)), "UNKNOWN_PURPOSE")
        .when(held & purpose.isin(*TUNING_PURPOSES), "HELD_OUT_IS_REPORT_ONLY")
        .when(labels & (purpose != REPORT_PURPOSE), "LABELS_NEED_FINAL_EVALUATION")
        .when((purpose == REPORT_PURPOSE) & ~held, "FINAL_EVALUATION_NEEDS_HELD_OUT")
        .otherwise("AUTHORIZED")
    )
    ok = verdict == "AUTHORIZED"
    return F.struct(verdict.alias("verdict"), (ok & labels).alias("labels_authorized"), (ok & held).alias("report_only"))


def dominant_center(faces: Column, width: Column, height: Column, least_score: float) -> Column:
    """Centre (x, y from 0 to 1) of the face with the highest score of `least_score` or more, the first of
    equals; null without one or without a size. Faces are structs with bbox (x, y, w, h in pixels) and score."""
    usable = F.transform(F.filter(faces, lambda f: f["score"] >= least_score), lambda f, i: F.struct(-f["score"], i, f["bbox"]))
    box = F.try_element_at(F.array_sort(usable), F.lit(1))["bbox"]
    center = F.array((box[0] + box[2] / 2) / width, (box[1] + box[3] / 2) / height)
    return F.when(box.isNotNull() & (width > 0) & (height > 0), center)


def displaced(a: Column, b: Column, ratio: float) -> Column:
    """Whether two centres are more than `ratio` apart in x or in y; a missing centre splits nothing."""
    return F.coalesce(F.greatest(F.abs(a[0] - b[0]), F.abs(a[1] - b[1])) > ratio, F.lit(False))


def dominant_identity(faces: Column, least_score: float, least_width: float) -> Column:
    """The unit identity vector of the largest usable face, the first of equals; null without one. Faces are
    structs with bbox, score and identity (an array); a vector must be finite and not all zero."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    sane = lambda f: F.coalesce((norm(f["identity"]) > 0) & (norm(f["identity"]) < float("inf")), F.lit(False))
    fits = lambda f: (F.size(f["bbox"]) == 4) & (f["score"] >= least_score) & (f["bbox"][2] >= least_width) & sane(f)
    ranked = F.array_sort(F.transform(F.filter(faces, fits), lambda f, i: F.struct(-f["bbox"][2] * f["bbox"][3], i, f["identity"])))
    best = F.try_element_at(ranked, F.lit(1))["identity"]
    return F.transform(best, lambda x: x / norm(best))


def identity_compatible(a: Column, b: Column, least_score: float, least_width: float, least_cosine: float) -> Column:
    """Whether two frames may show the same people. Frames without any face may; as soon as one has a face,
    both need an identity and these must be alike."""
    seen = lambda faces: F.coalesce(F.exists(faces, lambda f: f["score"] >= least_score), F.lit(False))
    u, v = (dominant_identity(x, least_score, least_width) for x in (a, b))
    cosine = F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(~seen(a) & ~seen(b), True).otherwise(F.coalesce((F.size(u) == F.size(v)) & (cosine >= least_cosine), F.lit(False)))


def pair_verdict(votes: DataFrame, pair: str, family: str, sign: str, least: int = 6, margin: int = 4) -> DataFrame:
    """Per pair the side (1 or -1) that evidence elects, else null with the reason: each family has one vote
    if its signs agree, none if they conflict; it takes `least` votes and a margin of `margin`."""
    one = votes.where(F.col(sign) != 0).groupBy(pair, family).agg(F.min(sign).alias("lo"), F.max(sign).alias("hi"))
    sums = one.groupBy(pair).agg(
        F.sum(F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(0)).cast("long").alias("balance"),
        F.count_if(F.col("lo") == F.col("hi")).alias("votes"), F.count_if(F.col("lo") != F.col("hi")).alias("conflicts"),
    )
    ok = (F.col("votes") >= least) & (F.abs("balance") >= margin)
    why = F.when(F.col("votes") < least, "TOO_FEW_VOTES").when(F.abs("balance") < margin, "LOW_MARGIN").otherwise("RESOLVED")
    return sums.select(pair, "votes", "conflicts", "balance", F.when(ok, F.signum("balance").cast("int")).alias("side"), why.alias("reason"))


def route_group(members: DataFrame, group: str, sha: str, decision: str) -> DataFrame:
    """cv_only for groups of one byte-exact content whose members are all settled, else vlm."""
    settled = F.bool_and(F.col(decision).isin("KEEP", "AUTO_REMOVE"))
    exact = (F.count_distinct(sha) == 1) & F.bool_and(F.col(sha).isNotNull())
    return members.groupBy(group).agg(F.when(exact & settled, "cv_only").otherwise("vlm").alias("route"))


def compile_policy(events: DataFrame, kind: str, capability: str, confidence: str, mixed: str, sensitive: str) -> DataFrame:
    """`events` with the limits of their policy: max_group, keepers and identity_required.

    A policy is weak without full capability, with a confidence under LEAST_CONFIDENCE, or of a mixed theme;
    then limits only get stricter: at most 4 members a group, at least 2 keepers, identity required. An
    unknown kind, a confidence outside 0 to 1 or a null in either makes a weak general policy."""
    c = F.col
    valid = F.coalesce(c(kind).isin(*EVENT_PRESETS) & c(confidence).between(0, 1) & c(mixed).isNotNull() & c(sensitive).isNotNull(), F.lit(False))
    name = F.when(valid, c(kind)).otherwise("general")
    of = lambda i: F.element_at(F.create_map(*(x for k, v in EVENT_PRESETS.items() for x in (F.lit(k), F.lit(v[i])))), name)
    weak = ~valid | F.coalesce(c(capability) != FULL_CAPABILITY, F.lit(True)) | (c(confidence) < LEAST_CONFIDENCE) | c(mixed)
    return events.select(
        "*", F.when(weak, F.least(of(0), F.lit(4))).otherwise(of(0)).alias("max_group"),
        F.when(weak, F.greatest(of(1), F.lit(2))).otherwise(of(1)).alias("keepers"), (weak | c(sensitive) | of(2)).alias("identity_required"),
    )


def ordered_gates(gates: list[tuple[Column, str]], passed: str = "PASS") -> Column:
    """The name of the first gate that doesn't hold (null counts as not), else `passed`."""
    out = None
    for holds, name in gates:
        out = (F if out is None else out).when(~F.coalesce(holds, F.lit(False)), name)
    return F.lit(passed) if out is None else out.otherwise(passed)


def note_rule(note: Column, status: Column, phases: Column) -> Column:
    """Class of a reviewer's note: doubts come before statements, and statements that conflict decide nothing."""
    note = F.coalesce(note, F.lit(""))
    abstains, assesses = note.rlike(NOTE_ABSTAIN), note.rlike(NOTE_ASSESSED)
    unreviewed = F.coalesce(status != "reviewed", F.lit(True)) | (F.coalesce(F.size(phases), F.lit(0)) <= 0)
    return (
        F.when(unreviewed, "needs_review_nonreviewed")
        .when(note.rlike("[?？]"), "needs_review_question")
        .when(note.rlike(NOTE_PHASE_UNCERTAIN), "needs_review_phase_uncertain")
        .when(abstains & assesses, "needs_review_conflicting_quality")
        .when(abstains, "quality_abstain_explicit")
        .when(assesses, "assessed_explicit")
        .otherwise("needs_review_no_explicit_quality_rule")
    )
