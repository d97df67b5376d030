"""Matches between frames against plain Python over all pairs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import correspond as K

SCHEMA = "frame long, object long, class_id int, box array<double>, vector array<double>, confirmed boolean"


def plain_iou(a, b):
    w, h = (max(0.0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union else 0.0


def unit(rng, near=None, spread=0.1):
    v = np.array([rng.gauss(0, 1) for _ in range(4)]) if near is None else np.array(near) + spread * np.array([rng.gauss(0, 1) for _ in range(4)])
    return [float(x) for x in v / np.linalg.norm(v)]


def frames_of(rng, pairs=40):
    """Right frames are left ones, shaken; some objects are missing, copied or of another class."""
    rows = []
    for p in range(pairs):
        objects = []
        for k in range(rng.randrange(0, 5)):
            x, y = rng.random() * 0.6, rng.random() * 0.6
            objects.append((k, rng.choice((0, 0, 15)), [x, y, x + 0.3, y + 0.3], unit(rng), rng.random() < 0.9))
        rows += [(2 * p, *o) for o in objects]
        for k, c, b, v, ok in objects:
            if rng.random() < 0.9:
                s = rng.choice((0.0, 0.02, 0.2))
                rows.append((2 * p + 1, k, c if rng.random() < 0.95 else 16, [b[0] + s, b[1], b[2] + s, b[3]], unit(rng, v, rng.choice((0.01, 0.05, 0.5))), ok))
        if objects and rng.random() < 0.3:
            rows.append((2 * p + 1, 9, *objects[0][1:]))
    return rows, [(2 * p, 2 * p + 1) for p in range(pairs)]


def by_frame(rows, f):
    return sorted(r[1:] for r in rows if r[0] == f)


@pytest.mark.parametrize("seed", [1, 2])
def test_match_by_place(spark, seed):
    rows, pairs = frames_of(random.Random(seed))
    got = {tuple(r) for r in K.match_by_place(spark.createDataFrame(pairs, "left long, right long"), spark.createDataFrame(rows, SCHEMA)).select("left", "right", "side", "object", "partner", "state").collect()}
    want = set()
    for a, b in pairs:
        x, y = by_frame(rows, a), by_frame(rows, b)
        s = [[plain_iou(o[2], p[2]) if o[1] == p[1] else 0.0 for p in y] for o in x]
        taken = {}
        for i, o in enumerate(x):
            j = max(range(len(y)), key=lambda j: (s[i][j], -j), default=None)
            if j is None or s[i][j] < 0.5:
                want.add((a, b, "left", o[0], None, "unmatched"))
                continue
            rivals = [s[i][k] for k in range(len(y)) if k != j] + [s[k][j] for k in range(len(x)) if k != i] + [0.0]
            if s[i][j] - max(rivals) < 0.15:
                want.add((a, b, "left", o[0], None, "ambiguous"))
            else:
                taken[j] = o[0]
                want.add((a, b, "left", o[0], y[j][0], "matched"))
        want |= {(a, b, "right", p[0], taken.get(j), "matched" if j in taken else "unmatched") for j, p in enumerate(y)}
    assert got == want and {w[-1] for w in want} == {"matched", "unmatched", "ambiguous"}


def test_match_by_looks_and_uniqueness(spark):
    rows, pairs = frames_of(random.Random(3), 60)
    objects, links = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(pairs, "left long, right long")
    got = {(r.left, r.object): (r.partner, r.reason) for r in K.match_by_looks(links, objects).collect()}
    unique = {(r.left, r.object, r.partner): (round(r.margin, 9), r.eligible) for r in K.appearance_unique(links, objects).collect()}
    want, apart = {}, {}
    for a, b in pairs:
        x, y = by_frame(rows, a), by_frame(rows, b)
        if not x or not y:
            continue
        s = np.array([[sum(p * q for p, q in zip(o[3], t[3], strict=True)) for t in y] for o in x])
        for i, o in enumerate(x):
            j = int(np.argmax(s[i]))
            row, col = np.delete(s[i], j), np.delete(s[:, j], i)
            margin = min(s[i, j] - row.max() if row.size else 2.0, s[i, j] - col.max() if col.size else 2.0)
            why = "FOREGROUND_APPEARANCE_BELOW_FLOOR" if s[i, j] < 0.9 else "FOREGROUND_APPEARANCE_NOT_UNIQUE" if margin < 0.03 or int(np.argmax(s[:, j])) != i else None
            why = why or ("OBSERVATION_GEOMETRY_UNCONFIRMED" if plain_iou(o[2], y[j][2]) < 0.5 else "INDEPENDENT_VIEW_UNCONFIRMED" if not (o[4] and y[j][4]) else "MATCHED")
            want[(a, o[0])] = (y[j][0], why)
        z = np.array([[s[i, j] if o[1] == t[1] else -2.0 for j, t in enumerate(y)] for i, o in enumerate(x)])
        for i, j in itertools.product(range(len(x)), range(len(y))):
            if x[i][1] == y[j][1]:
                row, col = np.delete(z[i], j), np.delete(z[:, j], i)
                m = min(z[i, j] - row.max() if row.size else 2.0, z[i, j] - col.max() if col.size else 2.0)
                apart[(a, x[i][0], y[j][0])] = (round(float(m), 9), bool(z[i, j] >= 0.9 and m >= 0.03))
    assert got == want and len({w for _, w in want.values()}) == 5
    assert unique == apart


def test_match_sets(spark):
    v = [[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0]]
    left, right = [0.1, 0.1, 0.4, 0.9], [0.5, 0.1, 0.9, 0.9]
    face = [0.2, 0.2, 0.3, 0.3]
    base = [(1, "subject", 0, None, left, v[0]), (2, "subject", 0, None, right, v[1]), (3, "face", 0, 1, face, v[2])]
    shapes = {
        0: base, 1: base, 2: base[:2], 3: base[:1], 4: [(1, "subject", 0, None, left, v[1]), (2, "subject", 0, None, right, v[0])],
        5: [(1, "subject", 0, None, left, v[0]), (2, "subject", 0, None, right, unit(random.Random(1), v[0], 0.001))], 6: [(7, "subject", 15, None, left, v[0]), (8, "subject", 0, None, right, v[1])],
        7: base + [(4, "face", 0, 9, face, v[2])],
    }
    schema = "frame long, region long, kind string, class_id int, parent long, box array<double>, vector array<double>"
    regions = spark.createDataFrame([(f, r, k, c, p, [float(x) for x in b], [float(x) for x in u]) for f, rs in shapes.items() for r, k, c, p, b, u in rs], schema)
    pairs = spark.createDataFrame([(0, k) for k in (1, 2, 3, 4, 6, 7, 99)] + [(5, 5)], "left long, right long")
    verdicts, matches = K.match_sets(pairs, regions)
    assert {(r.left, r.right): r.reason for r in verdicts.collect()} == {
        (0, 1): "COMPLETE_SYMMETRIC_MATCH", (0, 2): "FACE_COVERAGE_UNSTABLE", (0, 3): "SET_COVERAGE_UNSTABLE", (0, 4): "ASSOCIATION_UNKNOWN", (0, 6): "SET_COVERAGE_UNSTABLE",
        (0, 7): "REGION_COVERAGE_UNSTABLE", (0, 99): "SET_COVERAGE_UNSTABLE", (5, 5): "IDENTITY_NOT_UNIQUE_WITHOUT_POSITION",
    }
    assert {tuple(r) for r in matches.collect()} == {(0, 1, 1, 1), (0, 1, 2, 2), (0, 1, 3, 3)}


def person(center=(0.5, 0.5), size=(0.3, 0.6), raised=0.0, sure=0.9):
    """A standing body; `raised` lifts wrists and elbows by that share of its height."""
    (cx, cy), (w, h) = center, size
    at = {5: (-0.3, -0.3), 6: (0.3, -0.3), 7: (-0.4, -0.1), 8: (0.4, -0.1), 9: (-0.4, 0.1), 10: (0.4, 0.1), 11: (-0.2, 0.1), 12: (0.2, 0.1), 13: (-0.2, 0.3), 14: (0.2, 0.3), 15: (-0.2, 0.45), 16: (0.2, 0.45)}
    lift = {7: 0.5, 8: 0.5, 9: 1, 10: 1}
    points = [[cx, cy, 0.0]] * 5 + [[cx + w * x, cy + h * (y - raised * lift.get(i, 0)), sure] for i, (x, y) in sorted(at.items())]
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2], points


def test_compare_poses(spark):
    shots = {
        0: [person()], 1: [person(raised=0.3)], 2: [person(center=(0.8, 0.5))], 3: [person(sure=0.5)], 4: [], 5: [person(center=(0.2, 0.5), size=(0.2, 0.4)), person(center=(0.7, 0.5), size=(0.2, 0.4))],
        6: [person(center=(0.2, 0.5), size=(0.2, 0.4), raised=0.3), person(center=(0.7, 0.5), size=(0.2, 0.4))], 7: [person(center=(0.2, 0.5), size=(0.2, 0.4), raised=0.3), person(center=(0.7, 0.5), size=(0.2, 0.4), raised=0.2)],
    }
    people = spark.createDataFrame([(f, i, b, 0.9, p) for f, ps in shots.items() for i, (b, p) in enumerate(ps)], "frame long, person long, box array<double>, confidence double, points array<array<double>>")
    frames = spark.createDataFrame([(f, "p", "ok", 1000, 800) for f in shots] + [(8, "q", "ok", 1000, 800), (9, "p", "failed", 1000, 800)], "frame long, producer string, status string, width int, height int")
    pairs = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (0, 8), (0, 9), (0, 77), (5, 6), (5, 7), (5, 5)], "left long, right long")
    got = {(r.left, r.right): r for r in K.compare_poses(pairs, frames, people).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        (0, 0): "MATCHED_LIMB_DISPLACEMENT", (0, 1): "MATCHED_LIMB_DISPLACEMENT", (0, 2): "BODY_ASSOCIATION_ABSTAIN", (0, 3): "BODY_ASSOCIATION_ABSTAIN", (0, 4): "NO_USABLE_BODY",
        (0, 8): "POSE_PRODUCER_MISMATCH", (0, 9): "POSE_EVIDENCE_INVALID", (0, 77): "POSE_EVIDENCE_MISSING", (5, 5): "MATCHED_LIMB_DISPLACEMENT", (5, 6): "MATCHED_LIMB_DISPLACEMENT", (5, 7): "MATCHED_LIMB_DISPLACEMENT",
    }
    # the torso is 0.4 of the height: wrists move 0.3 / 0.4, elbows half of that; the third largest is an elbow's
    assert got[(0, 0)].displacement == 0 and got[(0, 1)].displacement == pytest.approx(0.375) and got[(0, 1)].eligible
    # of two people, the second most moved one counts
    assert got[(5, 6)].displacement == 0 and got[(5, 7)].displacement == pytest.approx(0.25) and got[(5, 7)].matched_people == 2
    # with any visible one: the third largest way of a limb, or a turned forearm; these bodies are well resolved
    loose = {(r.left, r.right): r.displacement for r in K.compare_poses(pairs, frames, people, visible=True).collect()}
    assert loose[(5, 6)] == pytest.approx(0.375) and loose[(0, 4)] is None
    body = K.bodies(people.where("frame = 0").join(frames, "frame")).first()
    assert body.norm[11][1] == pytest.approx(0.5) and body.norm[5][1] == pytest.approx(-0.5) and body.scale == pytest.approx(0.6 * 800 * 0.4 / math.hypot(1000, 800))


def test_assign_poses(spark):
    box, points = person()
    other, far = person(center=(0.51, 0.5)), person(center=(0.2, 0.3), size=(0.05, 0.1))
    people = spark.createDataFrame([(0, 0, box, points, 0.9, 1000, 800), (1, 0, box, points, 0.9, 1000, 800), (1, 1, *other, 0.9, 1000, 800), (2, 0, *far, 0.9, 1000, 800), (3, 0, box, points, 0.4, 1000, 800)], "frame long, person long, box array<double>, points array<array<double>>, confidence double, width int, height int")
    regions = spark.createDataFrame([(f, 5, "subject", 0, b) for f, b in ((0, box), (1, box), (2, far[0]), (3, box))], "frame long, region long, kind string, class_id int, box array<double>")
    got = K.assign_poses(regions, people).collect()
    assert [(r.frame, r.region, r.person) for r in got] == [(0, 5, 0)]
    assert got[0].points[11][:2] == pytest.approx([0.3, 0.6])


def test_sound_sets(spark):
    schema = "frame long, region string, kind string, class_id int, parent string, box array<double>, vector array<double>, confidence double, native_w double, native_h double, musiq double, clipiqa double"
    good = ("s", "subject", 0, None, [0.1, 0.1, 0.9, 0.9], [1.0, 0.0], 0.9, 200.0, 200.0, 50.0, 0.5)
    face = ("f", "face", 0, "s", [0.2, 0.2, 0.3, 0.3], [0.0, 1.0], 0.9, 100.0, 100.0, 50.0, 0.5)
    put = lambda r, i, x: (*r[:i], x, *r[i + 1 :])
    sets = [[good], [good, face], [good, good], [good, face, put(face, 0, "g")], [good, put(face, 4, [0.9, 0.9, 1.0, 1.0])], [good, put(face, 3, "x")], [put(good, 6, 0.5)], [put(good, 5, [0.0, 0.0])], [put(good, 9, None)], [put(good, 2, 7)], [put(good, 0, f"s{i}") for i in range(13)], [face]]
    regions = spark.createDataFrame([(i, *r) for i, rs in enumerate(sets) for r in rs], schema)
    assert sorted(r.frame for r in K.sound_sets(regions).collect()) == [0, 1]
    assert K.sound_sets(regions.where(F.lit(False))).count() == 0
