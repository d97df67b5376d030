"""Exposure routes, ownership of faces and differences of summaries, case by case."""

import numpy as np
import pytest

from lodestrata.operators import routing as R


def test_route_exposure(spark):
    flat = [0.5] * (64 * 64 * 3)
    shifted = lambda d: [0.5 + d] * (64 * 64 * 3)
    corner = np.full((64, 64, 3), 0.5)
    corner[:16, :32] = 0.9  # 8 of 64 tiles
    spot = np.full((64, 64, 3), 0.5)
    spot[:8, :8] = 0.9  # 1 of 64 tiles: below the 95th percentile, mean 0.00625
    rows = [
        (1, 1, 10.0, 5, 1.5, 0, flat), (1, 2, 8.0, 5, 1.5, 1, shifted(0.005)), (1, 3, 5.0, 5, 1.5, 0, flat),  # much alike, clear best
        (2, 1, 10.0, 5, 1.5, 0, flat), (2, 2, 9.0, 5, 1.5, 0, flat), (2, 3, 5.0, 5, 1.5, 0, flat),  # no clear best
        (3, 1, 10.0, 5, 1.5, 0, flat), (3, 2, 5.0, 5, 1.5, 0, flat),  # two
        (4, 1, 10.0, 5, 1.5, 0, flat), (4, 2, 5.0, 6, 1.5, 0, flat), (4, 3, 4.0, None, 1.5, 0, flat), (4, 4, 3.0, 5, 1.4, 0, flat), (4, 5, 2.0, 5, 1.5, 7, flat), (4, 6, 1.0, 5, 1.5, 3, flat),
        (5, 1, 10.0, 5, 1.5, 0, flat), (6, 1, 1.0, 5, 1.5, 0, flat), (6, 1, 2.0, 5, 1.5, 0, flat),  # one, and a repeated one
        (7, 1, 10.0, 5, 1.5, 0, flat), (7, 2, 5.0, 5, 1.5, 0, corner.ravel().tolist()), (7, 3, 4.0, 5, 1.5, -1, flat), (7, 4, 3.0, 5, 1.5, 0, spot.ravel().tolist()), (7, 5, 2.0, 5, 1.5, 0, None),
    ]
    df = spark.createDataFrame(rows, "g long, id long, quality double, time long, aspect double, hash long, rgb array<double>")
    got = {r.g: r for r in R.route_exposure(df, "g", "id").collect()}
    assert got[1].route == "local_resolved" and got[1].selected == [1] and got[1].exposed == [] and got[1].lead == pytest.approx(0.2) and got[1].bits == 1
    assert got[2].route == got[3].route == "vlm_required" and got[2].exposed == [1] and got[3].exposed == [1]
    assert got[4].exposed == [1, 2, 3, 4, 5] and got[4].members == 6  # the sixth differs in two bits only
    assert got[5].route == got[6].route == "invalid" and got[5].exposed == []
    assert got[7].exposed == [1, 2, 3, 5] and got[7].mean == pytest.approx(0.4 / 64, abs=1e-6)
    # one second apart is near enough here
    assert {r.g: r.exposed for r in R.route_exposure(df, "g", "id", "balanced").collect()}[4] == [1, 3, 4]
    assert R.route_exposure(df.limit(0), "g", "id").count() == 0
    with pytest.raises(ValueError):
        R.route_exposure(df, "g", "id", "sharpest")


FRAME = dict(state="KNOWN", tags=["REAL_PERSON_SUBJECT"], width=2000, height=1000, printed=False, nonhuman=False)
FACE, SUBJECT = [100.0, 100.0, 100.0, 100.0], [50.0, 50.0, 400.0, 900.0]
LOOK = dict(box=FACE, iod=30.0, observation="OPEN", profile=False, occluded=False, eyes_visible=True)
CASES = [
    ({}, "APPLICABLE", None), ({"tags": ["ROBOT"]}, "UNKNOWN", "INVALID_EVIDENCE"), ({"width": 0}, "UNKNOWN", "INVALID_EVIDENCE"), ({"height": None}, "UNKNOWN", "INVALID_EVIDENCE"),
    ({"state": "UNKNOWN"}, "UNKNOWN", "SUBJECT_ASSIGNMENT_UNKNOWN"), ({"state": None}, "UNKNOWN", "SUBJECT_ASSIGNMENT_UNKNOWN"),
    ({"tags": ["DOCUMENT_SCREENSHOT", "REAL_PERSON_SUBJECT"]}, "NOT_APPLICABLE", "PRINTED_OR_SCREEN_FACE_RISK"), ({"tags": ["NONHUMAN_CHARACTER_DOLL_STATUE"]}, "NOT_APPLICABLE", "NONHUMAN_FACE_RISK"),
    ({"tags": ["FOOD_STILL_LIFE"]}, "NOT_APPLICABLE", "DETECTOR_NOT_APPLICABLE"), ({"tags": None}, "NOT_APPLICABLE", "DETECTOR_NOT_APPLICABLE"), ({"printed": None}, "UNKNOWN", "FEATURE_MISSING"),
    ({"printed": True}, "UNKNOWN", "PRINTED_OR_SCREEN_FACE_RISK"), ({"nonhuman": True}, "UNKNOWN", "NONHUMAN_FACE_RISK"), ({"faces": [(i, FACE, 30.0) for i in range(10)]}, "UNKNOWN", "MAX_FACES_REACHED"),
    ({"subjects": []}, "UNKNOWN", "SUBJECT_ASSIGNMENT_UNKNOWN"), ({"subjects": [(0, SUBJECT), (1, SUBJECT)]}, "UNKNOWN", "MULTIPLE_SUBJECTS"), ({"subjects": [(0, SUBJECT), (0, SUBJECT)]}, "UNKNOWN", "INVALID_EVIDENCE"),
    ({"faces": [(0, [900.0, 100.0, 100.0, 100.0], 30.0)]}, "NOT_APPLICABLE", "BACKGROUND_FACE_ONLY"), ({"faces": [], "crops": []}, "NOT_APPLICABLE", "SUBJECT_NOT_OWNED"),
    ({"faces": [(0, FACE, 30.0), (1, [900.0, 100.0, 100.0, 100.0], 30.0)]}, "UNKNOWN", "BACKGROUND_FACE_ONLY"), ({"subjects": [(0, SUBJECT), (1, [1500.0, 50.0, 300.0, 900.0])]}, "UNKNOWN", "MULTIPLE_SUBJECTS"),
    ({"faces": [(0, [100.0, 100.0, 95.0, 100.0], 30.0)]}, "UNKNOWN", "SMALL_FACE"), ({"faces": [(0, FACE, None)]}, "UNKNOWN", "FEATURE_MISSING"), ({"faces": [(0, FACE, 23.0)]}, "UNKNOWN", "SMALL_FACE"),
    ({"faces": [(0, [100.0, 100.0, 0.0, 100.0], 30.0)]}, "UNKNOWN", "INVALID_EVIDENCE"), ({"crops": [(0, "1.3x", {})]}, "UNKNOWN", "FACE_COUNT_MISMATCH"), ({"crops": []}, "UNKNOWN", "FACE_COUNT_MISMATCH"),
    ({"crops": [(0, "1.3x", {}), (0, "1.6x", {}), (0, "1.6x", {})]}, "UNKNOWN", "FACE_COUNT_MISMATCH"), ({"crops": [(0, "1.3x", {}), (0, "1.6x", {}), (5, "1.6x", {})]}, "UNKNOWN", "FACE_COUNT_MISMATCH"),
    ({"crops": [(0, "1.3x", {"box": [300.0, 300.0, 100.0, 100.0]}), (0, "1.6x", {})]}, "UNKNOWN", "FACE_BOX_MISMATCH"), ({"crops": [(0, "1.3x", {}), (0, "1.6x", {"observation": "CLOSED"})]}, "UNKNOWN", "CROP_CONTEXT_CONFLICT"),
    ({"crops": [(0, "1.3x", {}), (0, "1.6x", {"iod": None})]}, "UNKNOWN", "FEATURE_MISSING"), ({"crops": [(0, "1.3x", {"iod": 10.0}), (0, "1.6x", {})]}, "UNKNOWN", "SMALL_FACE"),
    ({"crops": [(0, "1.3x", {"profile": True}), (0, "1.6x", {})]}, "UNKNOWN", "PROFILE_OR_OCCLUDED"), ({"crops": [(0, "1.3x", {"eyes_visible": False}), (0, "1.6x", {})]}, "UNKNOWN", "EYE_STATE_UNKNOWN"),
    ({"crops": [(0, "1.3x", {"observation": "MAYBE"}), (0, "1.6x", {"observation": "MAYBE"})]}, "UNKNOWN", "EYE_STATE_UNKNOWN"),
]


def test_ownership(spark):
    frames, faces, subjects, crops = [], [], [], []
    for i, (change, _, _) in enumerate(CASES):
        f = FRAME | {k: v for k, v in change.items() if k in FRAME}
        frames.append((i, f["state"], f["tags"], f["width"], f["height"], f["printed"], f["nonhuman"]))
        faces += [(i, *x) for x in change.get("faces", [(0, FACE, 30.0)])]
        subjects += [(i, *x) for x in change.get("subjects", [(0, SUBJECT)])]
        for face, context, other in change.get("crops", [(0, "1.3x", {}), (0, "1.6x", {})]):
            look = LOOK | other
            crops.append((i, face, context, *(look[k] for k in LOOK)))
    got = R.ownership(
        spark.createDataFrame(frames, "frame long, state string, tags array<string>, width int, height int, printed boolean, nonhuman boolean"), spark.createDataFrame(faces, "frame long, face long, box array<double>, iod double"),
        spark.createDataFrame(subjects, "frame long, subject long, box array<double>"), spark.createDataFrame(crops, "frame long, face long, context string, box array<double>, iod double, observation string, profile boolean, occluded boolean, eyes_visible boolean"),
    )
    got = {r.frame: (r.applicability, r.reason, r.accepted) for r in got.collect()}
    assert got == {i: (state, why, [0] if state == "APPLICABLE" else []) for i, (_, state, why) in enumerate(CASES)}


def test_pair_deltas(spark):
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 4)], "g long, id long")
    sums = spark.createDataFrame([(1, 0.5, {"a": 1, "b": 2}), (2, 0.75, {"a": 3, "b": 2, "c": 1}), (4, 1.0, {})], "id long, m double, n map<string,long>")
    got = {(r.left, r.right): (r.m_delta, r.n_deltas) for r in R.pair_deltas(members, sums, "g", "id", ["m"], ["n"]).collect()}
    assert got == {(1, 2): (0.25, {"a": 2, "b": 0, "c": 1}), (1, 3): (None, {"a": -1, "b": -2}), (2, 3): (None, {"a": -3, "b": -2, "c": -1})}
