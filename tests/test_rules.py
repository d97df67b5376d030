"""Fixed values and ordered rules, case by case, and operators without SQL against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import columns
from lodestrata.operators import audit, decision, selection


def test_risk_score_and_impact(spark):
    rows = [
        ("sha_exact", 2, 0.0, None, None, 1, 0.2, 1, [1], [1]),
        ("burst", 6, 9.0, 0.9, 0.94, 2, None, 2, [1, 2], [1]),
    ]
    df = spark.createDataFrame(rows, "group_type string, member_count int, time_span_seconds double, min_pair_similarity double, min_adjacent_similarity double, face_count_states int, quality_margin double, keeper_count int, baseline_keeper_ids array<bigint>, candidate_keeper_ids array<bigint>")
    reasons = audit.risk_reasons({c: F.col(c) for c in df.columns})
    score = audit.risk_score(reasons)
    got = df.select(score.alias("s"), audit.expected_value(score, audit.review_impact(F.col("member_count"), F.col("keeper_count"))).alias("e"), F.transform(reasons, lambda r: r["reason"]).alias("r")).collect()
    assert got[0].s == 0 and got[0].r == []
    want = 0.04 + 0.08 + 0.08 + 0.13 + 0.13 + 0.10 + 0.12 + 0.09 + 0.08
    assert got[1].s == pytest.approx(want) and got[1].e == pytest.approx(want * (1 + math.log2(5)), abs=1e-5)
    assert got[1].r[:2] == ["LOCAL_CHANGE_SIGNAL", "LOW_EMBEDDING_PURITY"] and len(got[1].r) == 9
    assert sum(audit.RISK_WEIGHTS.values()) > 1


@pytest.mark.parametrize(
    ("kind", "capability", "confidence", "mixed", "sensitive", "want"),
    [
        ("stage", "full", 0.9, False, False, (5, 2, False)), ("stage", "full", 0.9, False, True, (5, 2, True)), ("stage", "no_vlm", 0.9, False, False, (4, 2, True)),
        ("pet", "full", 0.64, False, False, (4, 2, True)), ("convention", "full", 0.65, False, False, (8, 1, True)), ("design_reference", "full", 1.0, True, False, (4, 2, True)),
        ("sports", "full", 0.9, False, False, (4, 2, True)), ("general", "full", 1.5, False, False, (4, 2, True)), (None, "full", None, None, None, (4, 2, True)),
    ],
)
def test_event_policy(spark, kind, capability, confidence, mixed, sensitive, want):
    df = spark.createDataFrame([(kind, capability, confidence, mixed, sensitive)], "k string, c string, f double, m boolean, s boolean")
    r = decision.compile_policy(df, "k", "c", "f", "m", "s").first()
    assert (r.max_group, r.keepers, r.identity_required) == want


def test_eye_states(spark):
    rows = [
        (0.1, 0.15, 200, 30, 0, 0, "OPEN"), (0.6, 0.7, 200, 30, 0.1, 0.9, "CLOSED"), (0.6, 0.7, 200, 30, 0.5, 0.5, "MAYBE"), (0.1, 0.7, 200, 30, 0, 0, "MAYBE"), (0.3, 0.3, 200, 30, 0, 0, "MAYBE"),
        (0.1, 0.1, 95, 30, 0, 0, "UNKNOWN"), (0.1, 0.1, 96, 23, 0, 0, "UNKNOWN"), (None, 0.1, 200, 30, 0, 0, "UNKNOWN"), (0.6, 0.9, 200, 30, None, None, "MAYBE"),
    ]
    df = spark.createDataFrame([tuple(float(x) if isinstance(x, int) else x for x in r) for r in rows], "l double, r double, w double, i double, s double, q double, want string")
    state, _ = decision.eye_state(*(F.col(c) for c in "lrwisq"))
    assert all(r.got == r.want for r in df.select(state.alias("got"), "want").collect())
    frames = [(["OPEN", "CLOSED"], 2, "HAS_CLOSED_EYES"), (["OPEN", "CLOSED"], 1, "UNKNOWN"), ([], None, "NO_FACE"), (["MAYBE", "UNKNOWN"], None, "UNKNOWN"), (["MAYBE", "OPEN"], 2, "HAS_MAYBE"), (["OPEN"], 1, "ALL_OPEN")]
    df = spark.createDataFrame(frames, "s array<string>, n int, want string")
    assert all(r.got == r.want for r in df.select(decision.frame_eyes(F.col("s"), F.col("n")).alias("got"), "want").collect())


def test_authorization(spark):
    rows = [
        ("held_out", "train", False, "HELD_OUT_IS_REPORT_ONLY"), ("held_out", "final_evaluation", True, "AUTHORIZED"), ("train", "train", True, "LABELS_NEED_FINAL_EVALUATION"),
        ("tune", "final_evaluation", False, "FINAL_EVALUATION_NEEDS_HELD_OUT"), ("tune", "threshold_search", False, "AUTHORIZED"), ("train", "copy", False, "UNKNOWN_PURPOSE"), ("train", None, False, "UNKNOWN_PURPOSE"),
    ]
    df = spark.createDataFrame(rows, "s string, p string, l boolean, want string")
    got = df.select(decision.authorize(F.col("s"), F.col("p"), F.col("l")).alias("a"), "want").collect()
    assert all(r.a.verdict == r.want for r in got)
    assert [r.a.labels_authorized for r in got] == [False, True, *[False] * 5] and [r.a.report_only for r in got] == [False, True, *[False] * 5]


def test_face_guards(spark):
    face = lambda x, score, identity=None, w=100.0: ([x, 10.0, w, 40.0], score, identity)
    rows = [
        ([face(0.0, 0.9, [1.0, 0.0])], [face(100.0, 0.9, [0.9, 0.1])], True, True), ([face(0.0, 0.9, [1.0, 0.0])], [face(20.0, 0.9, [0.0, 2.0])], False, False),
        ([], [], False, True), ([face(0.0, 0.9)], [], False, False), ([face(0.0, 0.2)], [face(300.0, 0.3)], False, True),
        ([face(0.0, 0.9, [1.0, 0.0], 10.0)], [face(0.0, 0.9, [1.0, 0.0])], False, False), (None, None, False, True),
        ([face(0.0, 0.6, [0.0, 1.0], 60.0), face(10.0, 0.9, [1.0, 0.0])], [face(20.0, 0.9, [1.0, 0.0])], False, True),
    ]
    kind = "array<struct<bbox:array<double>,score:double,identity:array<double>>>"
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}, moved boolean, same boolean")
    centre = lambda c: decision.dominant_center(F.col(c), F.lit(200), F.lit(100), 0.5)
    got = df.select(decision.displaced(centre("a"), centre("b"), 0.3).alias("m"), decision.identity_compatible(F.col("a"), F.col("b"), 0.5, 50.0, 0.8).alias("s"), "moved", "same").collect()
    assert [(r.m, r.s) for r in got] == [(r.moved, r.same) for r in got]


def test_scores_of_unknown_sizes(spark):
    df = spark.createDataFrame([(4000, 3000, 500.0), (None, 3000, 0.0), (0, 10, None), (10_000, 10_000, 1500.0)], "w int, h int, v double")
    got = df.select(columns.resolution_bonus(F.col("w"), F.col("h")), columns.normalize_sharpness(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 0.5), (0.0, 0.0), (0.0, 0.0), (1.0, 0.75)]


@pytest.mark.parametrize("size", [1, 3, 5, 9, 17, 40, 200])
def test_sample_allocation(spark, size):
    pools = {"a": 12, "b": 3, "c": 12, "d": 1, "e": 7}
    rows = [(s, i) for s, n in pools.items() for i in range(100 * ord(s), 100 * ord(s) + n)]
    left, want = dict(pools), dict.fromkeys(pools, 0)
    for s in sorted(pools):
        if sum(want.values()) < size:
            want[s], left[s] = 1, left[s] - 1
    while sum(want.values()) < size and any(left.values()):
        s = max((n, s) for s, n in left.items())[1]
        want[s], left[s] = want[s] + 1, left[s] - 1
    got = audit.stratified_sample(spark.createDataFrame(rows, "s string, id long"), "s", "id", size, 3).toPandas()
    assert got.groupby("s").size().to_dict() == {s: n for s, n in want.items() if n}
    assert all(r.weight == pytest.approx(pools[r.s] / want[r.s]) and r.inclusion == pytest.approx(want[r.s] / pools[r.s]) for r in got.itertuples())


def test_dominance_penalty_brute_force(spark):
    rng = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    regions = []
    for group, item, kind, c in itertools.product((1, 2), range(6), ("subject", "face"), (0, 1)):
        if rng.random() < 0.85:
            x, y = rng.uniform(0, 0.3, 2).tolist()
            regions.append((group, 10 * group + item, kind, c, [x, y, x + 0.5, y + 0.5], unit(rng.normal(1, 0.2, 4)), float(rng.uniform(0, 6)), float(rng.uniform(0, 0.3))))
    members = [(g, 10 * g + i, float(rng.uniform(0, 0.5))) for g in (1, 2) for i in range(7)]
    by = {(r[1], r[2], r[3]): r for r in regions}

    def iou(a, b):
        w, h = (max(0.0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
        return w * h / (0.5 - w * h)

    def beaten(item, other):
        for (i, kind, c), a in by.items():
            b = by.get((other, kind, c))
            if i != item or b is None or iou(a[4], b[4]) < 0.4 or b[6] - a[6] < 1 or b[7] - a[7] < 0.05:
                continue
            if kind == "face":
                a, b = by.get((item, "subject", c)), by.get((other, "subject", c))
                if a is None or b is None or iou(a[4], b[4]) < 0.4:
                    continue
            if np.dot(a[5], b[5]) >= 0.9:
                return True
        return False

    want = {i: max(0.0, s - 0.08) if any(g == g2 and i != j and beaten(i, j) for g2, j, _ in members) else s for g, i, s in members}
    m = spark.createDataFrame(members, "g int, id int, score double")
    r = spark.createDataFrame(regions, "g int, id int, kind string, class_id int, box array<double>, vector array<double>, musiq double, clipiqa double")
    got = {x.id: x.adjusted for x in selection.dominance_penalty(m, r, "g", "id", "score").collect()}
    assert got == pytest.approx(want) and 0 < sum(want[i] != s for _, i, s in members) < len(members)


def test_protected_variants_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(g, 100 * g + i, float(rng.integers(0, 9)), bool(i < 2), rng.uniform(0, 60, 2).tolist()) for g in range(8) for i in range(6)]
    want = {}
    for g in range(8):
        kept = [np.array(r[4]) for r in rows if r[0] == g and r[3]]
        far = [r for r in rows if r[0] == g and not r[3] and all(np.linalg.norm(np.array(r[4]) - k) > 15 for k in kept)]
        if far:
            want[g] = max(far, key=lambda r: (r[2], -r[1]))[1]
    df = spark.createDataFrame(rows, "g int, id int, score double, kept boolean, place array<double>")
    assert {r.g: r.id for r in selection.protect_variants(df, "g", "id", "score", "kept", "place", 15.0).collect()} == want
