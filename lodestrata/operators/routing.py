"""What a judge has to see of a group, and whose face a face is."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import iou

#: Limits of one cluster (mean and 95th percentile of pixel differences, hash bits, seconds), of a group that needs
#: no judge, and its least lead in quality, by profile: fixed values.
EXPOSURE_PROFILES = {
    "recall_first": {"cluster": (0.012, 0.035, 2, 0), "local": (0.006, 0.015, 1), "lead": 0.18},
    "balanced": {"cluster": (0.025, 0.060, 4, 1), "local": (0.010, 0.025, 2), "lead": 0.14},
    "efficient": {"cluster": (0.040, 0.100, 8, 1), "local": (0.016, 0.040, 4), "lead": 0.10},
}
#: Shapes whose width by height differs by more are never compared; side of the small picture and of its tiles.
ASPECT, SIDE, TILE = 0.001, 64, 8


def _apart(a: dict, b: dict) -> tuple | None:
    """Pixel differences (mean, 95th percentile over tiles), hash bits and seconds between two frames."""
    if a["time"] is None or b["time"] is None or abs(a["aspect"] - b["aspect"]) > ASPECT:
        return None
    pixels = np.abs(a["rgb"] - b["rgb"]).mean(axis=2)
    tiles = pixels.reshape(SIDE // TILE, TILE, SIDE // TILE, TILE).mean(axis=(1, 3))
    bits = ((a["hash"] ^ b["hash"]) & (1 << 64) - 1).bit_count()
    return float(pixels.mean()), float(np.quantile(tiles, 0.95)), bits, abs(a["time"] - b["time"])


def route_exposure(frames: DataFrame, group: str, item: str, profile: str = "recall_first") -> DataFrame:
    """Which members of a group a judge has to see: (group, route, members, representatives, selected, exposed,
    lead, mean, tile, bits). `frames` has quality, time, aspect, hash (64 bits) and rgb (64 x 64 x 3 values from
    0 to 1, row by row).

    Members join the first cluster, by falling quality, whose best one they resemble, or begin one. One cluster
    of three or more, much alike and with a clear best, is local_resolved: nobody has to look. All else is
    vlm_required and shows the best of each cluster. Groups of one, or that repeat an item, are invalid; frames
    without a time or pixels are like none. The greedy order needs a group in one task; groups are bursts."""
    if profile not in EXPOSURE_PROFILES:
        raise ValueError(f"unknown profile {profile}")
    p = EXPOSURE_PROFILES[profile]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf[item].tolist()
        out = {group: [pdf[group].iloc[0]], "members": [len(ids)], "route": ["invalid"], "representatives": [[]], "selected": [[]], "exposed": [[]], "lead": [None], "mean": [None], "tile": [None], "bits": [None]}
        if len(ids) < 2 or len(set(ids)) < len(ids):
            return pd.DataFrame(out)
        rows = []
        for r in pdf.sort_values(["quality", item], ascending=[False, True]).to_dict("records"):
            whole = r["rgb"] is not None and len(r["rgb"]) == SIDE * SIDE * 3 and not pd.isna(r["time"])
            rows.append(r | {"time": int(r["time"]) if whole else None, "rgb": np.asarray(r["rgb"], np.float32).reshape(SIDE, SIDE, 3) if whole else None, "hash": int(r["hash"])})
        best: list[dict] = []
        found: list[tuple] = []
        for r in rows:
            for b in best:
                d = _apart(r, b)
                if d is not None and all(x <= y for x, y in zip(d, p["cluster"], strict=True)):
                    found.append(d)
                    break
            else:
                best.append(r)
        top = rows[0]["quality"]
        lead = (top - rows[1]["quality"]) / top if top > 0 else 0.0
        most = [max((d[k] for d in found), default=None) for k in range(3)]
        alike = len(best) == 1 and all(m <= limit for m, limit in zip(most, p["local"], strict=True)) and lead >= p["lead"]
        names = [b[item] for b in best]
        local = alike and len(ids) > 2  # of two, another rule selects
        out |= {"route": ["local_resolved" if local else "vlm_required"], "representatives": [names], "selected": [names if local else []], "exposed": [[] if local else names], "lead": [lead]}
        return pd.DataFrame(out | dict(zip(("mean", "tile", "bits"), ([m] for m in most), strict=True)))

    types = dict(frames.dtypes)
    ids = f"array<{types[item]}>"
    cols = [F.col(group), F.col(item), F.col("quality").cast("double"), F.col("time").cast("double"), F.col("aspect").cast("double"), F.col("hash").cast("long"), F.col("rgb").cast("array<float>")]
    schema = f"{group} {types[group]}, route string, members int, representatives {ids}, selected {ids}, exposed {ids}, lead double, mean double, tile double, bits double"
    return frames.select(*cols).na.fill({"quality": 0.0, "aspect": 0.0, "hash": 0}).groupBy(group).applyInPandas(run, schema)


#: Subjects that routing knows, those that are people, the two crops that are looked at, and limits of size,
#: overlap and distance: fixed values.
SUBJECTS = ("REAL_PERSON_SUBJECT", "COSTUME_MASKED_PERSON", "NONHUMAN_CHARACTER_DOLL_STATUE", "FOOD_STILL_LIFE", "DOCUMENT_SCREENSHOT", "NO_DOMINANT_SUBJECT")
PEOPLE, CROPS = ("REAL_PERSON_SUBJECT", "COSTUME_MASKED_PERSON"), ("1.3x", "1.6x")
FACE_WIDTH, EYE_DISTANCE, IN_SUBJECT, SAME_IOU, SAME_DISTANCE, MOST_FACES = 96.0, 24.0, 0.5, 0.25, 0.35, 10


def _corners(b: Column) -> Column:
    return F.array(b[0], b[1], b[0] + b[2], b[1] + b[3])


def belongs(face: Column, subject: Column) -> Column:
    """Whether the centre of a box (x, y, width, height) and half of its area or more lie in a subject's box."""
    x, y = face[0] + face[2] / 2, face[1] + face[3] / 2
    side = lambda i: F.greatest(F.lit(0.0), F.least(face[i] + face[i + 2], subject[i] + subject[i + 2]) - F.greatest(face[i], subject[i]))
    return x.between(subject[0], subject[0] + subject[2]) & y.between(subject[1], subject[1] + subject[3]) & (side(0) * side(1) / (face[2] * face[3]) >= IN_SUBJECT)


def same_box(a: Column, b: Column) -> Column:
    """Whether two boxes (x, y, width, height) overlap by SAME_IOU, or their centres are close for their size."""
    gap = F.hypot(a[0] + a[2] / 2 - b[0] - b[2] / 2, a[1] + a[3] / 2 - b[1] - b[3] / 2)
    return (iou(_corners(a), _corners(b)) >= SAME_IOU) | (gap <= SAME_DISTANCE * F.greatest(a[2], a[3], b[2], b[3]))


def ownership(frames: DataFrame, faces: DataFrame, subjects: DataFrame, crops: DataFrame) -> DataFrame:
    """Whether faces are known to be those of the subjects: (frame, applicability, reason, accepted).

    `frames` has frame, state, tags, width, height, printed and nonhuman (risks, null if unknown); `faces` frame,
    face, box and iod; `subjects` frame, subject and box; `crops` frame, face, context, box, iod, observation,
    profile, occluded and eyes_visible. Seven gates in order: what the subject is, risks, number of faces, whose face
    each is, size, one look in each of two crops, and that both agree. The first that fails decides, by face
    where several do. Broken evidence (unknown tags, sizes or boxes that aren't positive, repeated names) is INVALID_EVIDENCE."""
    box = F.col("box")
    sound = lambda b: F.coalesce((F.size(b) == 4) & F.forall(b, lambda v: F.abs(v) < float("inf")) & (b[2] > 0) & (b[3] > 0), F.lit(False))
    f = faces.groupBy("frame").agg(F.count("*").alias("n_faces"), F.count_distinct("face").alias("f_names"), F.bool_and(sound(box)).alias("f_sound"))
    s = subjects.groupBy("frame").agg(F.count("*").alias("n_subjects"), F.count_distinct("subject").alias("s_names"), F.bool_and(sound(box)).alias("s_sound"))
    held = faces.select("frame", "face", box.alias("fb"), "iod").join(subjects.select("frame", "subject", box.alias("sb")), "frame", "left")
    inside = F.coalesce(sound(F.col("fb")) & sound(F.col("sb")) & belongs(F.col("fb"), F.col("sb")), F.lit(False))
    owned = held.groupBy("frame", "face").agg(F.first("fb").alias("fb"), F.first("iod").alias("f_iod"), F.count_if(inside).alias("owners"), F.min(F.when(inside, F.col("subject"))).alias("owner"))

    look = F.struct("box", "iod", "observation", "profile", "occluded", "eyes_visible")
    seen = crops.groupBy("frame", "face").agg(*(F.collect_list(F.when(F.col("context") == c, look)).alias(f"c{i}") for i, c in enumerate(CROPS)), F.count_if(~F.coalesce(F.col("context").isin(*CROPS), F.lit(False))).alias("odd"))
    both = owned.join(seen, ["frame", "face"], "full_outer")
    one = [F.try_element_at(f"c{i}", F.lit(1)) for i in (0, 1)]
    small = F.when(F.col("fb")[2] < FACE_WIDTH, "SMALL_FACE").when(F.col("f_iod").isNull(), "FEATURE_MISSING").when(F.col("f_iod") < EYE_DISTANCE, "SMALL_FACE")
    counted = F.coalesce((F.size("c0") == 1) & (F.size("c1") == 1) & (F.col("odd") == 0) & F.col("owners").isNotNull(), F.lit(False))
    each = lambda test, how: reduce(how, (F.coalesce(test(c), F.lit(False)) for c in one))
    agree = (
        F.when(~each(lambda c: same_box(F.col("fb"), c["box"]), and_), "FACE_BOX_MISMATCH")
        .when(~F.coalesce(same_box(one[0]["box"], one[1]["box"]) & one[0]["observation"].eqNullSafe(one[1]["observation"]), F.lit(False)), "CROP_CONTEXT_CONFLICT")
        .when(each(lambda c: c["iod"].isNull(), or_), "FEATURE_MISSING")
        .when(each(lambda c: c["iod"] < EYE_DISTANCE, or_), "SMALL_FACE")
        .when(each(lambda c: c["profile"] | c["occluded"], or_), "PROFILE_OR_OCCLUDED")
        .when(~each(lambda c: c["eyes_visible"], and_) | ~F.coalesce(one[0]["observation"].isin("OPEN", "CLOSED"), F.lit(False)), "EYE_STATE_UNKNOWN")
    )
    known = F.col("owners").isNotNull()
    both = both.select("*", F.when(known, small).alias("small"), counted.alias("counted"), F.when(known, agree).alias("agree"))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("face")))
    told = both.groupBy("frame").agg(
        F.max("owners").alias("most_owners"), F.count_if(F.col("owners") == 1).alias("assigned"), F.count_distinct(F.when(F.col("owners") == 1, F.col("owner"))).alias("taken"),
        first("small").alias("small"), F.bool_and("counted").alias("counted"), first("agree").alias("agree"), F.array_sort(F.collect_list(F.when(F.col("owners") == 1, F.col("face")))).alias("accepted"),
    )
    c = F.col
    all_ = frames.join(f, "frame", "left").join(s, "frame", "left").join(told, "frame", "left").fillna(0, ["n_faces", "n_subjects", "assigned", "taken", "most_owners"])
    tags = F.coalesce(c("tags"), F.array().cast("array<string>"))
    tagged = lambda *names: F.arrays_overlap(tags, F.array(*map(F.lit, names)))
    broken = (F.size(F.array_except(tags, F.array(*map(F.lit, SUBJECTS)))) > 0) | ~((c("width") > 0) & (c("height") > 0)) | (c("n_faces") != c("f_names")) | (c("n_subjects") != c("s_names")) | ~c("f_sound") | ~c("s_sound")
    gates = [
        (F.coalesce(broken, c("width").isNull() | c("height").isNull()), "UNKNOWN", "INVALID_EVIDENCE"),
        (F.coalesce(c("state") != "KNOWN", F.lit(True)), "UNKNOWN", "SUBJECT_ASSIGNMENT_UNKNOWN"),
        (tagged("DOCUMENT_SCREENSHOT"), "NOT_APPLICABLE", "PRINTED_OR_SCREEN_FACE_RISK"),
        (tagged("NONHUMAN_CHARACTER_DOLL_STATUE"), "NOT_APPLICABLE", "NONHUMAN_FACE_RISK"),
        (~tagged(*PEOPLE), "NOT_APPLICABLE", "DETECTOR_NOT_APPLICABLE"),
        (c("printed").isNull() | c("nonhuman").isNull(), "UNKNOWN", "FEATURE_MISSING"),
        (c("printed"), "UNKNOWN", "PRINTED_OR_SCREEN_FACE_RISK"),
        (c("nonhuman"), "UNKNOWN", "NONHUMAN_FACE_RISK"),
        (c("n_faces") >= MOST_FACES, "UNKNOWN", "MAX_FACES_REACHED"),
        (c("n_subjects") == 0, "UNKNOWN", "SUBJECT_ASSIGNMENT_UNKNOWN"),
        (c("most_owners") > 1, "UNKNOWN", "MULTIPLE_SUBJECTS"),
        ((c("assigned") == 0) & (c("n_faces") > 0), "NOT_APPLICABLE", "BACKGROUND_FACE_ONLY"),
        (c("assigned") == 0, "NOT_APPLICABLE", "SUBJECT_NOT_OWNED"),
        (c("assigned") != c("n_faces"), "UNKNOWN", "BACKGROUND_FACE_ONLY"),
        (c("taken") != c("n_subjects"), "UNKNOWN", "MULTIPLE_SUBJECTS"),
        (c("small").isNotNull(), "UNKNOWN", c("small")),
        (~c("counted"), "UNKNOWN", "FACE_COUNT_MISMATCH"),
        (c("agree").isNotNull(), "UNKNOWN", c("agree")),
    ]
    state = why = F
    for test, how, name in gates:
        state, why = state.when(test, how), why.when(test, name)
    out = all_.select("frame", state.otherwise("APPLICABLE").alias("applicability"), why.alias("reason"), "accepted")
    none = F.array().cast(dict(out.dtypes)["accepted"])
    return out.withColumn("accepted", F.when(F.col("applicability") == "APPLICABLE", F.col("accepted")).otherwise(none))


def pair_deltas(members: DataFrame, summaries: DataFrame, group: str, item: str, values: list[str], counts: list[str]) -> DataFrame:
    """Differences, later less earlier item, of summaries between all members of a group: (group, left, right), one
    column per value (null if either is missing or not finite) and per map of counts (all keys of
    either; an absent one counts 0)."""
    from .joins import member_pairs

    rows = members.select(group, item).join(summaries.select(item, *values, *counts), item, "left")
    p = member_pairs(rows, group, item, [*values, *counts])
    number = lambda c: F.when(F.abs(c.cast("double")) < float("inf"), c.cast("double"))
    one = lambda v: (number(F.col(f"y_{v}")) - number(F.col(f"x_{v}"))).alias(f"{v}_delta")
    empty = F.create_map().cast("map<string,bigint>")
    of = lambda s, v: F.coalesce(F.col(f"{s}_{v}").cast("map<string,bigint>"), empty)
    zero = lambda x: F.coalesce(x, F.lit(0))
    many = lambda v: F.map_zip_with(of("x", v), of("y", v), lambda k, a, b: zero(b) - zero(a)).alias(f"{v}_deltas")
    return p.select(group, F.col(f"x_{item}").alias("left"), F.col(f"y_{item}").alias("right"), *map(one, values), *map(many, counts))

