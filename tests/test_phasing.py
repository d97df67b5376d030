"""Phases and their keepers, case by case and against plain Python."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import phasing as P

SCHEMA = "g long, id long, t long, v array<double>, f int, c array<double>, kind string"
V = {0: [1.0, 0.0], 1: [0.92, float(np.sqrt(1 - 0.92**2))], 2: [0.5, float(np.sqrt(0.75))]}


def phases(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    found = P.logical_phases(P.phase_edges(df, "g", "id", "t", "v", "f", "c", "kind", **kw), "g", "id")
    out = {}
    for r in found.collect():
        out.setdefault(r.g, {}).setdefault(r.phase, ([], tuple(r.reasons), tuple(r.doubts)))[0].append(r.id)
    return {g: [(sorted(ids), why, doubts) for _, (ids, why, doubts) in sorted(ps.items())] for g, ps in out.items()}


def test_logical_phases(spark):
    same = lambda g, ts, kind="burst", v=None, f=None, c=None: [(g, i, t, V[(v or {}).get(i, 0)] if (v or {}).get(i, 0) is not None else None, (f or {}).get(i, 0), (c or {}).get(i), kind) for i, t in enumerate(ts)]
    still = {i: [0.5, 0.5] for i in range(6)}
    got = phases(spark, [
        *same(1, [0, 1, 10, 11]),  # a jump in time
        *same(2, [0, 10]),  # two members are one phase
        *same(3, [0, 1, 2, 3, 4, 5], v={3: 2, 4: 2, 5: 2}),  # one very low similarity
        *same(4, [0, 1, 2, 3, 4, 5], v={3: 1, 4: 1, 5: 1}),  # odd for the group, but nothing backs it
        *same(5, [0, 1, 2, 3, 4, 5], v={3: 1, 4: 1, 5: 1}, f={i: 1 + (i > 2) for i in range(6)}, c=still),  # backed by a face
        *same(6, [0, 1, 2, 3, 4, 5], v={3: 1, 4: 1, 5: 1}, f={i: 5 + (i > 2) for i in range(6)}, c=still),  # faces of a crowd back nothing
        *same(7, [0, 1, 2, 3, 4, 5], "phash_near", v={3: 1, 4: 1, 5: 1}),  # another scene
        *same(8, [0, 1, 2, 3, 4, 5], v={3: 1, 4: 1, 5: 1}, c={i: [0.2 + 0.3 * (i > 2), 0.5] for i in range(6)}),  # backed by a moved subject
        *same(9, [0, 1, 2, 3, 4], v={2: 1}, f={2: 1}, c=still),  # a flicker of one member loses the first of two cuts that are as weak
        *same(10, [0, 1, None], v={1: None}, f={0: 1}),  # doubts
    ])
    odd = ("LOCAL_BASELINE_EMBEDDING_CHANGE",)
    start, two = ("LOGICAL_PHASE_START",), lambda why: [([0, 1, 2], ("LOGICAL_PHASE_START",), ()), ([3, 4, 5], why, ())]
    assert got[1] == [([0, 1], start, ()), ([2, 3], ("TIME_GAP",), ())] and got[2] == [([0, 1], start, ())]
    assert got[3] == two(odd) and got[4] == [([0, 1, 2, 3, 4, 5], start, ())]
    assert got[5] == two(odd) and len(got[6]) == 1 and got[7] == two(odd)
    assert got[8] == two(("DETECTED_SUBJECT_POSITION_CHANGE", *odd)) and got[9] == [([0, 1, 2], start, ()), ([3, 4], odd, ())]
    assert got[10] == [([0, 1, 2], start, ("EMBEDDING_MISSING", "FACE_POSITION_MISSING", "TIME_MISSING"))]


def test_diverse_order_equals_plain_search():
    rng = random.Random(4)
    for case in range(200):
        n, slack = rng.randrange(1, 8), rng.choice((None, 0.04, 0.3))
        unit = np.array([[np.cos(a), np.sin(a)] if rng.random() > 0.1 else [0, 0] for a in (rng.random() * 6 for _ in range(n))])
        scores, sizes, ids = np.array([rng.choice((0.5, 0.6, 0.62, 0.9)) for _ in range(n)]), np.array([float(rng.randrange(3)) for _ in range(n)]), np.arange(n)
        picks, want = P.diverse_order(scores, sizes, ids, unit, 4, 0.7, slack)[0], []
        has = [bool(u.any()) for u in unit]
        while len(want) < min(4, n):
            left = [i for i in range(n) if i not in want]
            near = {i: max((float(unit[i] @ unit[j]) for j in want if has[i] and has[j]), default=0.0) for i in left}
            best = max(left, key=lambda i: ((0.7 * scores[i] - 0.3 * near[i]) if want else scores[i], scores[i], sizes[i], -i))
            if want and slack is not None and all(has[i] for i in left + want):
                close = min((i for i in left if scores[i] >= max(scores[j] for j in left) - slack), key=lambda i: (near[i], -scores[i], -sizes[i], i))
                best = close if near[best] - near[close] > 1e-6 else best
            want.append(best)
        assert picks == want, case


def test_phase_keepers_and_coverage(spark):
    angle = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [
        # two phases of two, budget 3: one keeper each
        *[(1, i, i // 2, ["LOGICAL_PHASE_START"], [], 0.5 + i / 10, 1, angle(0.0), 0, False) for i in range(4)],
        # one varied phase of three: two keepers, the second the least alike
        (2, 0, 0, ["LOGICAL_PHASE_START"], [], 0.9, 1, angle(0.0), 0, False), (2, 1, 0, ["LOGICAL_PHASE_START"], [], 0.8, 1, angle(0.01), 0, False), (2, 2, 0, ["LOGICAL_PHASE_START"], [], 0.7, 1, angle(1.5), 0, False),
        # four phases of one: budget 3 leaves one out
        *[(3, i, i, ["TIME_GAP"], [], 0.9 - i / 10, 1, angle(i), 0, False) for i in range(4)],
        # critical doubt in a phase of two, which may not keep both
        *[(4, i, 0, ["LOGICAL_PHASE_START"], ["TIME_MISSING"], 0.5, i, None, 1, True) for i in range(2)],
    ]
    df = spark.createDataFrame(rows, "g long, id long, phase int, reasons array<string>, doubts array<string>, s double, size long, v array<double>, f int, o boolean")
    kept = P.phase_keepers(df, "g", "id", "s", "size", "v", "f", "o").cache()
    got = {(r.g, r.phase): r for r in kept.collect()}
    assert got[1, 0].keepers == [1] and got[1, 1].keepers == [3] and not got[1, 0].review and got[1, 0].budget == 3
    assert got[2, 0].keepers == [0, 2] and "OBSERVED_VARIATION_EXTRA_KEEPER" in got[2, 0].reasons and got[2, 0].budget == 2
    assert sorted(sum((got[3, p].keepers for p in range(4)), [])) == [0, 1, 2] or sum(len(got[3, p].keepers) for p in range(4)) == 3
    assert all(got[3, p].limited for p in range(4)) and sum("LOGICAL_PHASE_ANNOTATED_NOT_SEPARATELY_RETAINED" in got[3, p].reasons for p in range(4)) == 1
    assert got[4, 0].keepers == [1] and got[4, 0].limited and got[4, 0].review and {"TIME_MISSING", "OPTIONAL_EVIDENCE_LOW_MARGIN_REVIEW"} <= set(got[4, 0].reasons)
    c = {r.g: r for r in P.coverage(kept, "g", "phase", F.col("members"), F.col("keepers"), F.col("budget")).collect()}
    assert c[1].codes == [] and c[1].extra_all == 2
    assert c[3].codes == ["PHASE_COVERAGE_BUDGET_CONFLICT"] and c[3].extra_needed == 1 and len(c[3].uncovered) == 1
    assert P.phase_keepers(df.limit(0), "g", "id", "s", "size", "v", "f", "o").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_protect_poses(spark, seed):
    rng = random.Random(seed)
    members, compared = [], []
    for g in range(60):
        ids = [10 * g + i for i in range(rng.randrange(1, 8))]
        members += [(g, i, rng.choice((0.5, 0.7, 0.9)), rng.random() < 0.4) for i in ids]
        compared += [(a, b, ok, 0.2 + rng.random() * 0.6 if ok else None) for a, b in itertools.permutations(ids, 2) if rng.random() < 0.95 for ok in [rng.random() < 0.9]]
    far = {(a, b) for a, b, ok, d in compared if ok and d >= 0.4}
    want = {}
    for g in range(60):
        m = [x for x in members if x[0] == g]
        keep = [x[1] for x in m if x[3]]
        fit = [x for x in m if not x[3] and keep and all((x[1], k) in far for k in keep)]
        if 2 <= len(m) <= 6 and fit:
            want[g] = max(fit, key=lambda x: (x[2], -x[1]))[1]
    got = P.protect_poses(spark.createDataFrame(members, "g long, id long, s double, kept boolean"), spark.createDataFrame(compared, "left long, right long, eligible boolean, displacement double"), "g", "id", "s", "kept")
    assert {r.g: r.id for r in got.collect()} == want and want
