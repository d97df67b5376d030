"""Which object of one frame is which of another: matches that are unique both ways, or a reason why there is none.

Objects come in long form, one row each, with the frame that they belong to; `pairs` says which frames meet
(left, right). A frame holds a few dozen objects at most, so the pairs of objects of two frames are few, and
all windows are over the objects of one pair of frames.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import dot, iou


def meet(pairs: DataFrame, objects: DataFrame, keep: list[str]) -> DataFrame:
    """Every object of the left frame with every one of the right: left, right and x_..., y_... for `keep`."""
    side = lambda name, p: objects.select(F.col("frame").alias(name), *(F.col(c).alias(f"{p}_{c}") for c in keep))
    return pairs.select("left", "right").join(side("left", "x"), "left").join(side("right", "y"), "right")


def ranked(met: DataFrame, score: str, order: str) -> DataFrame:
    """`met` with row_rank and col_rank (1: best of its left or right object, the first by `order` on ties) and
    row_next and col_next, the best score of the other candidates (null: there are none)."""
    row, col = Window.partitionBy("left", "right", f"x_{order}"), Window.partitionBy("left", "right", f"y_{order}")
    out = met.withColumn("row_rank", F.row_number().over(row.orderBy(F.desc(score), f"y_{order}")))
    out = out.withColumn("col_rank", F.row_number().over(col.orderBy(F.desc(score), f"x_{order}")))
    first = lambda r: F.max(F.when(F.col(r) == 1, F.col(score)))
    rest = lambda r: F.max(F.when(F.col(r) > 1, F.col(score)))
    out = out.withColumn("row_next", F.when(F.col("row_rank") == 1, rest("row_rank").over(row)).otherwise(first("row_rank").over(row)))
    return out.withColumn("col_next", F.when(F.col("col_rank") == 1, rest("col_rank").over(col)).otherwise(first("col_rank").over(col)))


def lead(score: str, rival: str, alone: float) -> Column:
    """How far a score is ahead of its rival; `alone` without one."""
    return F.when(F.col(rival).isNull(), F.lit(alone)).otherwise(F.col(score) - F.col(rival))


#: Least overlap and least lead of a match by place: fixed values.
PLACE_IOU, PLACE_LEAD = 0.5, 0.15


def match_by_place(pairs: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects (frame, object, class_id, box) by overlap, within a class: (left, right, side, object, partner,
    overlap, state). matched: best both ways, with an overlap of PLACE_IOU or more and PLACE_LEAD ahead of
    all others. unmatched: no such overlap; ambiguous: not clearly best. No object is left out: right ones that no match
    took are unmatched."""
    met = meet(pairs, objects, ["object", "class_id", "box"]).where("x_class_id = y_class_id")
    best = ranked(met.withColumn("overlap", iou(F.col("x_box"), F.col("y_box"))), "overlap", "object").where("row_rank = 1")
    clear = (F.col("col_rank") == 1) & (lead("overlap", "row_next", 1.0) >= PLACE_LEAD) & (lead("overlap", "col_next", 1.0) >= PLACE_LEAD)
    # the best of its column, even if another is as good, is told apart by the lead
    best = best.select("left", "right", F.col("x_object").alias("object"), "y_object", "overlap", clear.alias("clear"))
    on = ["left", "right", "object"]
    lefts = pairs.select("left", "right").join(objects.select(F.col("frame").alias("left"), "object"), "left").join(best, on, "left")
    state = F.when(F.coalesce(F.col("overlap") < PLACE_IOU, F.lit(True)), "unmatched").when(F.col("clear"), "matched").otherwise("ambiguous")
    lefts = lefts.withColumn("state", state).withColumn("partner", F.when(F.col("state") == "matched", F.col("y_object")))
    taken = lefts.where("state = 'matched'").select("left", "right", F.col("partner").alias("object"), F.col("object").alias("partner"), "overlap")
    rights = pairs.select("left", "right").join(objects.select(F.col("frame").alias("right"), "object"), "right").join(taken, on, "left")
    rights = rights.withColumn("state", F.when(F.col("partner").isNull(), "unmatched").otherwise("matched"))
    columns = lambda side: [F.col(c) for c in ("left", "right")] + [F.lit(side).alias("side"), *(F.col(c) for c in ("object", "partner", "overlap", "state"))]
    return lefts.withColumn("overlap", F.when(F.col("state") == "matched", F.col("overlap"))).select(*columns("left")).unionByName(rights.select(*columns("right")))


#: Floor, lead and overlap of a match by looks: fixed values.
LOOKS_FLOOR, LOOKS_LEAD, LOOKS_IOU = 0.9, 0.03, 0.5


def match_by_looks(pairs: DataFrame, objects: DataFrame) -> DataFrame:
    """Left objects (frame, object, class_id, box, vector of length 1, confirmed) and the right ones that look
    most like them, whatever their class: (left, right, object, partner, similarity, margin, reason)."""
    met = meet(pairs, objects, ["object", "box", "vector", "confirmed"]).withColumn("similarity", dot(F.col("x_vector"), F.col("y_vector")))
    best = ranked(met, "similarity", "object").where("row_rank = 1")
    best = best.withColumn("margin", F.least(lead("similarity", "row_next", 2.0), lead("similarity", "col_next", 2.0)))
    reason = (
        F.when(F.col("similarity") < LOOKS_FLOOR, "FOREGROUND_APPEARANCE_BELOW_FLOOR")
        .when((F.col("margin") < LOOKS_LEAD) | (F.col("col_rank") != 1), "FOREGROUND_APPEARANCE_NOT_UNIQUE")
        .when(iou(F.col("x_box"), F.col("y_box")) < LOOKS_IOU, "OBSERVATION_GEOMETRY_UNCONFIRMED")
        .when(~(F.coalesce("x_confirmed", F.lit(False)) & F.coalesce("y_confirmed", F.lit(False))), "INDEPENDENT_VIEW_UNCONFIRMED")
        .otherwise("MATCHED")
    )
    return best.select("left", "right", F.col("x_object").alias("object"), F.col("y_object").alias("partner"), "similarity", "margin", reason.alias("reason"))


def appearance_unique(pairs: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that look alike enough within their class and like nothing else there, place aside:
    (left, right, object, partner, similarity, margin) for every pair of a class, with `eligible`."""
    met = meet(pairs, objects, ["object", "class_id", "vector"]).where("x_class_id = y_class_id")
    met = ranked(met.withColumn("similarity", dot(F.col("x_vector"), F.col("y_vector"))), "similarity", "object")
    # objects of other classes are rivals at -2
    n = objects.groupBy("frame").agg(F.count("*").alias("n"))
    met = met.join(n.select(F.col("frame").alias("left"), F.col("n").alias("n_left")), "left").join(n.select(F.col("frame").alias("right"), F.col("n").alias("n_right")), "right")
    rival = lambda c, k: F.coalesce(F.col(c), F.when(F.col(k) > 1, -2.0))
    ahead = lambda c, k: F.coalesce(F.col("similarity") - rival(c, k), F.lit(2.0))
    margin = F.least(ahead("row_next", "n_right"), ahead("col_next", "n_left"))
    out = met.select("left", "right", F.col("x_object").alias("object"), F.col("y_object").alias("partner"), "similarity", margin.alias("margin"))
    return out.withColumn("eligible", (F.col("similarity") >= LOOKS_FLOOR) & (F.col("margin") >= LOOKS_LEAD))


#: Least similarity, overlap and lead of regions of two whole sets, and the weights of the two: fixed values.
SET_SIMILARITY, SET_IOU, SET_LEAD, SET_LOOKS, SET_PLACE = 0.97, 0.5, 0.03, 0.8, 0.2


def match_sets(pairs: DataFrame, regions: DataFrame, least: float = SET_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """All regions of a frame one to one with those of another, or none: (verdicts, matches).

    `regions` has frame, region, kind (subject or face), class_id, parent (the subject of a face), box and
    vector of length 1. Verdicts are (left, right, reason), COMPLETE_SYMMETRIC_MATCH or the reason of the first
    subject, by region, that fails; matches are (left, right, object, partner) of complete pairs."""
    subjects = regions.where("kind = 'subject'").withColumnRenamed("region", "object")
    classes = subjects.groupBy("frame", "class_id").agg(F.count("*").alias("n")).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("class_id", "n"))).alias("classes"))
    sizes = regions.groupBy("frame").agg(F.count("*").alias("size"), F.count_if(F.col("kind") == "subject").alias("subjects"))
    about = sizes.join(classes, "frame", "left")
    of = lambda side, p: about.select(F.col("frame").alias(side), *(F.col(c).alias(f"{p}_{c}") for c in ("size", "subjects", "classes")))
    frames = pairs.select("left", "right").distinct().join(of("left", "x"), "left", "left").join(of("right", "y"), "right", "left")
    stable = F.coalesce((F.col("x_subjects") > 0) & (F.col("x_classes") == F.col("y_classes")), F.lit(False))
    frames = frames.withColumn("stable", stable)

    met = meet(frames.where("stable"), subjects, ["object", "class_id", "box", "vector"])
    same = F.col("x_class_id") == F.col("y_class_id")
    met = met.withColumn("sim", dot(F.col("x_vector"), F.col("y_vector"))).withColumn("over", iou(F.col("x_box"), F.col("y_box")))
    fits = same & (F.col("sim") >= least) & (F.col("over") >= SET_IOU)
    met = met.withColumn("cost", F.when(fits, SET_LOOKS * F.col("sim") + SET_PLACE * F.col("over")).otherwise(-2.0)).withColumn("looks", F.when(same, F.col("sim")).otherwise(-2.0))
    met = ranked(met, "cost", "object")
    others = lambda side, rank: F.max(F.when(F.col(rank) > 1, F.col("looks"))).over(Window.partitionBy("left", "right", side))
    met = met.withColumn("looks_row", others("x_object", "row_rank")).withColumn("looks_col", others("y_object", "col_rank")).where("row_rank = 1")
    faces = regions.where("kind = 'face'").groupBy("frame", "parent").agg(F.count("*").alias("faces"))
    f = lambda side, obj, name: faces.select(F.col("frame").alias(side), F.col("parent").alias(obj), F.col("faces").alias(name))
    met = met.join(f("left", "x_object", "x_faces"), ["left", "x_object"], "left").join(f("right", "y_object", "y_faces"), ["right", "y_object"], "left").fillna(0, ["x_faces", "y_faces"])
    close = lambda score, a, b: (lead(score, a, 9.0) < SET_LEAD) | (lead(score, b, 9.0) < SET_LEAD)
    fault = (
        F.when((F.col("cost") < 0) | (F.col("col_rank") != 1), "ASSOCIATION_UNKNOWN")
        .when(close("looks", "looks_row", "looks_col"), "IDENTITY_NOT_UNIQUE_WITHOUT_POSITION")
        .when(close("cost", "row_next", "col_next"), "ASSOCIATION_AMBIGUOUS")
        .when(F.col("x_faces") != F.col("y_faces"), "FACE_COVERAGE_UNSTABLE")
    )
    met = met.withColumn("fault", fault)
    told = met.groupBy("left", "right").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("x_object"))).alias("fault"), F.sum(F.lit(1) + F.col("x_faces")).alias("paired"))
    whole = (F.col("paired") == F.col("x_size")) & (F.col("paired") == F.col("y_size"))
    reason = F.when(~F.col("stable"), "SET_COVERAGE_UNSTABLE").when(F.col("fault").isNotNull(), F.col("fault")).when(~whole, "REGION_COVERAGE_UNSTABLE").otherwise("COMPLETE_SYMMETRIC_MATCH")
    verdicts = frames.join(told, ["left", "right"], "left").select("left", "right", reason.alias("reason"))

    sound = met.join(verdicts.where("reason = 'COMPLETE_SYMMETRIC_MATCH'"), ["left", "right"], "left_semi").select("left", "right", F.col("x_object").alias("object"), F.col("y_object").alias("partner"))
    child = lambda side, p, name: regions.where("kind = 'face'").select(F.col("frame").alias(side), F.col("parent").alias(p), F.col("region").alias(name))
    below = sound.join(child("left", "object", "f"), ["left", "object"]).join(child("right", "partner", "g"), ["right", "partner"]).select("left", "right", F.col("f").alias("object"), F.col("g").alias("partner"))
    return verdicts, sound.unionByName(below)


# ---- bodies --------------------------------------------------------------------------------------

#: Joints of the trunk, and all that are looked at (numbers of the 17 joints), of which the rest are limbs;
#: elbow and wrist of each arm; least confidences and sizes: fixed values.
TRUNK, JOINTS = (5, 6, 11, 12), tuple(range(5, 17))
FOREARMS = ((7, 9), (8, 10))
POSE = {
    "box": 0.5, "joint": 0.6, "far": 0.1, "second": 0.02, "ratio": 1.5, "grow": (0.67, 1.5), "shared": 8, "torso": 0.01, "torso_box": 0.05,
    "arm": 0.8, "arm_length": (0.15, 1.2), "arm_grow": (0.5, 1.5), "turn": math.cos(math.pi / 4), "dominant": 0.15, "twice": 2, "resolved": 0.06, "tall": 0.30,
}


def bodies(people: DataFrame) -> DataFrame:
    """People (frame, person, box from 0 to 1, confidence, points: 17 arrays of x, y and confidence, width and
    height of the frame) that can be used, with what comparing takes: usable joints, centre, size, and `norm`,
    the joints in torso lengths along and across the torso (null where the torso is too short)."""
    box, p = F.col("box"), F.col("points")
    inside = F.forall(box, lambda v: v.between(0, 1)) & (F.size(box) == 4) & (box[2] > box[0]) & (box[3] > box[1])
    out = people.where(F.col("confidence").between(POSE["box"], 1) & inside & (F.size(p) == 17))
    good = lambda q: F.coalesce((F.size(q) == 3) & q[2].between(POSE["joint"], 1) & q[0].between(0, 1) & q[1].between(0, 1), F.lit(False))
    out = out.withColumn("usable", F.filter(F.array(*map(F.lit, JOINTS)), lambda i: good(F.element_at(p, i + 1))))
    out = out.withColumn("center", F.array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2)).withColumn("w", box[2] - box[0]).withColumn("h", box[3] - box[1])
    px = lambda i, k: p[i][k] * F.col("width" if k == 0 else "height")
    mean = lambda joints, k: sum(px(i, k) for i in joints) / len(joints)
    for k in (0, 1):
        out = out.withColumn(f"mid{k}", mean(TRUNK, k)).withColumn(f"axis{k}", mean(TRUNK[2:], k) - mean(TRUNK[:2], k))
    length = F.hypot("axis0", "axis1")
    diagonal, span = F.hypot("width", "height"), F.hypot(F.col("w") * F.col("width"), F.col("h") * F.col("height"))
    out = out.withColumn("torso", F.when(length >= F.greatest(POSE["torso"] * diagonal, POSE["torso_box"] * span), length))
    u, v, t = F.col("axis0"), F.col("axis1"), F.col("torso")

    def along(q: Column) -> Column:
        x, y = q[0] * F.col("width") - F.col("mid0"), q[1] * F.col("height") - F.col("mid1")
        return F.array((x * v - y * u) / t / t, (x * u + y * v) / t / t)

    out = out.withColumn("norm", F.transform(p, along)).withColumn("scale", t / diagonal).withColumn("area", F.col("w") * F.col("h"))
    others = Window.partitionBy("frame").orderBy(F.desc("area"))
    # the largest alone can be dominant, by twice the second or more
    second = F.coalesce(F.lead("area").over(others), F.lit(0.0))
    out = out.withColumn("dominant", (F.row_number().over(others) == 1) & (F.col("area") >= POSE["dominant"]) & (F.col("area") >= POSE["twice"] * second))
    return out.select("frame", "person", "points", "usable", "center", "w", "h", "area", "norm", "scale", "dominant")


def body_matches(pairs: DataFrame, body: DataFrame) -> DataFrame:
    """Bodies of two frames that are each other's nearest, near enough, by a clear lead, of like size, with the
    trunk and 8 joints or more in common: (left, right, person, partner, displacement, forearm, dominant,
    resolved). Displacement is the third largest way of a limb's joint, in torso lengths."""
    met = meet(pairs, body, [c for c in body.columns if c != "frame"])
    gap = lambda a, b: F.hypot(a[0] - b[0], a[1] - b[1])
    met = ranked(met.withColumn("near", -gap(F.col("x_center"), F.col("y_center"))), "near", "person").where("row_rank = 1 AND col_rank = 1")
    d = -F.col("near")
    clear = lambda c: F.coalesce(-F.col(c) >= F.greatest(d + POSE["second"], POSE["ratio"] * d), F.lit(True))
    grown = lambda c, lim: (F.col(f"y_{c}") / F.col(f"x_{c}")).between(*lim)
    met = met.withColumn("shared", F.array_intersect("x_usable", "y_usable"))
    trunk = reduce(and_, (F.array_contains("shared", j) for j in TRUNK))
    met = met.where((d <= POSE["far"]) & clear("row_next") & clear("col_next") & grown("w", POSE["grow"]) & grown("h", POSE["grow"]) & (F.size("shared") >= POSE["shared"]) & trunk & grown("scale", POSE["grow"]))
    at = lambda side, i: F.element_at(F.col(f"{side}_norm"), i + 1)
    limbs = F.filter("shared", lambda i: ~i.isin(*TRUNK))
    ways = F.sort_array(F.transform(limbs, lambda i: gap(at("x", i), at("y", i))), asc=False)

    def forearm(elbow: int, wrist: int) -> Column:
        sure = reduce(and_, (F.col(f"{s}_points")[j][2] >= POSE["arm"] for s in "xy" for j in (elbow, wrist)))
        a, b = ([at(s, F.lit(wrist))[k] - at(s, F.lit(elbow))[k] for k in (0, 1)] for s in "xy")
        la, lb = F.hypot(*a), F.hypot(*b)
        turned = (a[0] * b[0] + a[1] * b[1]) / (la * lb) <= POSE["turn"]
        fits = F.array_contains("shared", elbow) & F.array_contains("shared", wrist) & sure & la.between(*POSE["arm_length"]) & lb.between(*POSE["arm_length"]) & (lb / la).between(*POSE["arm_grow"]) & turned
        return F.when(fits, gap(at("x", F.lit(wrist)), at("y", F.lit(wrist)))).otherwise(0.0)

    resolved = (F.least("x_area", "y_area") >= POSE["resolved"]) & (F.least("x_h", "y_h") >= POSE["tall"])
    return met.select(
        "left", "right", F.col("x_person").alias("person"), F.col("y_person").alias("partner"), ways[2].alias("displacement"),
        F.greatest(*(forearm(*a) for a in FOREARMS)).alias("forearm"), (F.col("x_dominant") & F.col("y_dominant")).alias("dominant"), resolved.alias("resolved"),
    )


def compare_poses(pairs: DataFrame, frames: DataFrame, people: DataFrame, visible: bool = False) -> DataFrame:
    """How far limbs moved between two frames, or why that is unknown: (left, right, eligible, displacement,
    matched_people, reason). `frames` has frame, producer, status, width and height. Among several people, one
    moving body counts only if it dominates both frames, else the second most moved; with `visible`, any well resolved one."""
    sized = frames.select("frame", "width", "height")
    body = bodies(people.join(sized.where("width > 0 AND height > 0"), "frame"))
    found = body_matches(pairs, body)
    n = body.groupBy("frame").agg(F.count("*").alias("n"))
    side = lambda s, p: frames.join(n, "frame", "left").select(F.col("frame").alias(s), *(F.col(c).alias(f"{p}_{c}") for c in ("producer", "status", "width", "height", "n")))
    both = pairs.select("left", "right").distinct().join(side("left", "x"), "left", "left").join(side("right", "y"), "right", "left")
    moved = found.groupBy("left", "right").agg(
        F.count("*").alias("matched"), F.sort_array(F.collect_list("displacement"), asc=False).alias("ways"), F.max(F.when(F.col("dominant"), F.col("displacement"))).alias("dominant"),
        F.max(F.when(F.col("resolved"), F.greatest("displacement", "forearm"))).alias("resolved"),
    )
    both = both.join(moved, ["left", "right"], "left")
    crowd = F.greatest(F.coalesce("x_n", F.lit(0)), F.coalesce("y_n", F.lit(0))) >= 2
    base = F.when(crowd, F.greatest(F.col("dominant"), F.try_element_at("ways", F.lit(2)))).otherwise(F.try_element_at("ways", F.lit(1)))
    displacement = F.greatest(base, F.col("resolved")) if visible else base
    bad = lambda p: F.coalesce((F.col(f"{p}_status") != "ok") | ~(F.col(f"{p}_width") > 0) | ~(F.col(f"{p}_height") > 0), F.lit(True))
    absent = lambda p: F.col(f"{p}_producer").isNull() & F.col(f"{p}_status").isNull()
    reason = (
        F.when(absent("x") | absent("y"), "POSE_EVIDENCE_MISSING")
        .when(F.coalesce((F.col("x_producer") != F.col("y_producer")) | (F.col("x_producer") == ""), F.lit(True)), "POSE_PRODUCER_MISMATCH")
        .when(bad("x") | bad("y"), "POSE_EVIDENCE_INVALID")
        .when(F.col("x_n").isNull() | F.col("y_n").isNull(), "NO_USABLE_BODY")
        .when(F.col("matched").isNull(), "BODY_ASSOCIATION_ABSTAIN")
        .when(displacement.isNull(), "CROWD_SUPPORT_ABSTAIN")
        .otherwise("MATCHED_LIMB_DISPLACEMENT")
    )
    ok = F.col("reason") == "MATCHED_LIMB_DISPLACEMENT"
    out = both.withColumn("reason", reason).withColumn("d", displacement)
    return out.select("left", "right", ok.alias("eligible"), F.when(ok, F.col("d")).alias("displacement"), F.when(F.col("reason").isin("CROWD_SUPPORT_ABSTAIN", "MATCHED_LIMB_DISPLACEMENT"), F.col("matched")).otherwise(0).alias("matched_people"), "reason")


#: Least overlap and lead of a pose and a region, and least size in pixels and of the frame: fixed values.
POSE_IOU, POSE_LEAD, POSE_PIXELS, POSE_AREA = 0.5, 0.1, (96, 192), 0.015


def assign_poses(regions: DataFrame, people: DataFrame) -> DataFrame:
    """Which pose belongs to which person region of its frame: (frame, region, person, points), the points in
    the pose's own box. Both are each other's best by POSE_LEAD or more, with an overlap of POSE_IOU or more, and the pose is
    large enough. `regions` has frame, region, kind, class_id and box; `people` frame, person, box, points,
    confidence, width and height."""
    r = regions.where("kind = 'subject' AND class_id = 0").select("frame", "region", F.col("box").alias("r_box"))
    met = r.join(people.where(F.col("confidence").between(POSE["box"], 1)), "frame").withColumn("overlap", iou(F.col("r_box"), F.col("box")))
    pair = met.select(F.col("frame").alias("left"), F.col("frame").alias("right"), F.col("region").alias("x_k"), F.col("person").alias("y_k"), "overlap", "box", "points", "width", "height")
    best = ranked(pair, "overlap", "k").where((F.col("row_rank") == 1) & (F.col("col_rank") == 1) & (F.col("overlap") >= POSE_IOU))
    best = best.where((lead("overlap", "row_next", 1.0) >= POSE_LEAD) & (lead("overlap", "col_next", 1.0) >= POSE_LEAD))
    b = F.col("box")
    w, h = b[2] - b[0], b[3] - b[1]
    best = best.where((w * F.col("width") >= POSE_PIXELS[0]) & (h * F.col("height") >= POSE_PIXELS[1]) & (w * h >= POSE_AREA))
    points = F.transform("points", lambda q: F.array((q[0] - b[0]) / w, (q[1] - b[1]) / h, q[2]))
    return best.select(F.col("left").alias("frame"), F.col("x_k").alias("region"), F.col("y_k").alias("person"), points.alias("points"))


#: Most subjects and regions of a set, classes, and ranges that values of a region must lie in: fixed values.
SET_SUBJECTS, SET_REGIONS, SET_CLASSES = 12, 24, (0, 15, 16)
SET_RANGES = {"confidence": (0.6, 1), "native_w": (96, 100_000), "native_h": (96, 100_000), "musiq": (0, 100), "clipiqa": (0, 1)}


def sound_sets(regions: DataFrame) -> DataFrame:
    """Frames whose set of regions is sound, all regions or nothing: (frame). `regions` has frame, region, kind,
    class_id, parent, box, vector and the columns of SET_RANGES. Names are unique, values in range, vectors
    finite and not zero, 1 to SET_SUBJECTS subjects without a parent, at most SET_REGIONS regions; a face lies with
    its centre in a person that no other face has as its parent."""
    box, v = F.col("box"), F.col("vector")
    ok = F.col("region").isNotNull() & F.col("kind").isin("subject", "face") & F.col("class_id").isin(*SET_CLASSES) & (F.size(box) == 4) & F.forall(box, lambda x: x.between(0, 1)) & (box[0] < box[2]) & (box[1] < box[3])
    ok = reduce(and_, (F.col(c).between(*lim) for c, lim in SET_RANGES.items()), ok)
    ok = ok & (dot(v, v) > 0) & (dot(v, v) < float("inf")) & F.when(F.col("kind") == "subject", F.col("parent").isNull()).otherwise(F.col("class_id") == 0)
    owner = regions.where("kind = 'subject' AND class_id = 0").select("frame", F.col("region").alias("parent"), F.col("box").alias("__p")).dropDuplicates(["frame", "parent"])
    mid = lambda i: (box[i] + box[i + 2]) / 2
    held = mid(0).between(F.col("__p")[0], F.col("__p")[2]) & mid(1).between(F.col("__p")[1], F.col("__p")[3])
    judged = regions.join(owner, ["frame", "parent"], "left").withColumn("__ok", F.coalesce(ok & F.when(F.col("kind") == "face", held).otherwise(True), F.lit(False)))
    subject = F.col("kind") == "subject"
    g = judged.groupBy("frame").agg(
        F.bool_and("__ok").alias("ok"), F.count("*").alias("n"), F.count_distinct("region").alias("names"), F.count_if(subject).alias("s"),
        F.count_if(F.col("kind") == "face").alias("f"), F.count_distinct(F.when(F.col("kind") == "face", F.col("parent"))).alias("parents"),
    )
    return g.where((F.col("ok")) & (F.col("n") == F.col("names")) & F.col("n").between(1, SET_REGIONS) & F.col("s").between(1, SET_SUBJECTS) & (F.col("f") == F.col("parents"))).select("frame")
