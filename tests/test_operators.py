"""Operators against plain Python and hand-made cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import columns as C
from lodestrata.operators import audit, decision, evaluate, evidence, grouping, joins, phasing, review, selection, upsert
from lodestrata.sources import inventory, records
from lodestrata.streaming import journal


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def brute_groups(rows, window, least):
    """Greedy union over the whole timeline, without islands."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    sets = grouping.SpanUnion([r[1] for r in rows])
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = rows[i], rows[j]
        if a[1] is not None and b[1] is not None and b[1] - a[1] <= window and float(np.dot(a[2], b[2])) >= least:
            sets.union(i, j, window)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(sets.find(i), []).append(r[0])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_groups_equal_global_search(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        angle = rng.choice((0.0, 0.1, 1.2)) + rng.random() / 10
        rows.append((i, None if rng.random() < 0.1 else rng.randrange(400), [float(np.cos(angle)), float(np.sin(angle))]))
    df = spark.createDataFrame(rows, "id long, ts long, v array<double>")
    want = brute_groups(rows, 30, 0.99)
    for parts in (1, 7):
        got = {}
        for r in grouping.greedy_groups(df.repartition(parts), "id", "ts", "v", 30, 0.99).collect():
            got.setdefault(r.group_id, set()).add(r.id)
            assert min(got[r.group_id] | {r.group_id}) == r.group_id
        assert {frozenset(g) for g in got.values()} == want


def brute_layers(rows, window, bits, least, loose):
    """All layers over the whole timeline, pair by pair. Rows: (id, ts, sha, h, v)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    n = len(rows)
    twin = [r[2] and sum(x[2] == r[2] for x in rows) > 1 for r in rows]
    sets, kind = grouping.SpanUnion([r[1] for r in rows]), []
    for layer, span in ((2, window), (3, window), (4, loose[0])):
        for i, j in itertools.combinations(range(n), 2):
            a, b = rows[i], rows[j]
            if twin[i] or twin[j] or a[1] is None or b[1] is None or b[1] - a[1] > span:
                continue
            if layer == 2:
                fits = a[3] is not None and b[3] is not None and bin(a[3] ^ b[3]).count("1") <= bits
            else:
                fits = a[4] is not None and b[4] is not None and float(np.dot(a[4], b[4])) >= (least if layer == 3 else loose[1])
            if fits and sets.union(i, j, span):
                kind.append((layer, i))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(("sha", r[2]) if twin[i] else sets.find(i), []).append(r[0])
    best = {}
    for layer, i in kind:
        best[sets.find(i)] = min(layer, best.get(sets.find(i), layer))
    return {(frozenset(g), "sha_exact" if isinstance(k, tuple) else grouping.LAYERS[best[k]]) for k, g in groups.items() if len(g) > 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_layered_groups_equal_global_search(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(90):
        angle = rng.choice((0.0, 0.2, 1.2)) + rng.random() / 10
        sha = rng.choice((None, "", "same")) if rng.random() < 0.2 else f"s{i}"
        h = rng.choice((0, 1, 3, 7, 1 << 40, None))
        v = None if rng.random() < 0.05 else [float(np.cos(angle)), float(np.sin(angle))]
        rows.append((i, None if rng.random() < 0.1 else rng.randrange(900), sha, h, v))
    df = spark.createDataFrame(rows, "id long, ts long, sha string, h long, v array<double>")
    want = brute_layers(rows, 30, 2, 0.999, (60, 0.9995))
    got = {}
    for r in grouping.layered_groups(df.repartition(5), "id", "ts", "sha", "h", "v", window=30, bits=2, least=0.999, loose=(60, 0.9995)).collect():
        got.setdefault((r.group_id, r.group_type, r.member_count), set()).add(r.id)
    assert all(min(g) == k[0] and len(g) == k[2] for k, g in got.items())
    assert {(frozenset(g), k[1]) for k, g in got.items()} == want
    assert {k for _, k in want} >= {"sha_exact", "phash_near", "burst"}


def test_layered_groups_guards_and_empty_tables(spark):
    rows = [(1, 0, "a", 0, [1.0, 0.0], 1, 0.1), (2, 5, "b", 9, [1.0, 0.0], 2, 0.1), (3, 10, "c", 0, [0.0, 1.0], 1, 0.9), (4, 12, "d", 99, [0.0, 1.0], 1, 0.2)]
    df = spark.createDataFrame(rows, "id long, ts long, sha string, h long, v array<double>, who int, x double")
    args = dict(same_person=lambda x, y: F.col(f"{x}who") == F.col(f"{y}who"), moved=lambda x, y: F.abs(F.col(f"{x}x") - F.col(f"{y}x")) > 0.3, guard=["who", "x"])
    groups = lambda **kw: {(r.id, r.group_type) for r in grouping.layered_groups(df, "id", "ts", "sha", "h", "v", **kw).collect()}
    assert groups() == {(1, "phash_near"), (2, "phash_near"), (3, "phash_near"), (4, "phash_near")}
    assert groups(**args) == {(1, "phash_near"), (3, "phash_near")}
    assert grouping.layered_groups(df.limit(0), "id", "ts", "sha", "h", "v").collect() == []
    with pytest.raises(ValueError):
        grouping.layered_groups(df, "id", "ts", "sha", "h", "v", bits=3)


def test_group_trust_refuses_chains(spark):
    v = {1: 0.0, 2: 0.3, 3: 0.6, 4: None}
    vectors = spark.createDataFrame([(i, None if a is None else [float(np.cos(a)), float(np.sin(a))]) for i, a in v.items()], "id long, v array<double>")
    rows = [(10, 1, 1, "burst"), (10, 2, 1, "burst"), (10, 3, 1, "burst"), (11, 1, 2, "burst"), (11, 2, 2, "burst"), (12, 1, 4, "sha_exact"), (12, 4, 4, "sha_exact"), (13, 1, 1, "phash_near")]
    members = spark.createDataFrame(rows, "g long, id long, k long, kind string")
    got = {r.g: (round(r.purity, 4), r.trusted) for r in grouping.group_trust(members, vectors, "g", "id", "k", "kind", "v").collect()}
    assert got == {10: (round(float(np.cos(0.6)), 4), False), 11: (round(float(np.cos(0.3)), 4), True), 12: (-1.0, True), 13: (1.0, False)}


def test_ranged_islands_equal_plain_ones(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.randrange(5000)) for i in range(300)], "id long, t long")
    plain = grouping.islands(df, ["t", "id"], "t", 25).groupBy("island").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.collect_list("id").alias("ids"))
    want = {i: (r.a, r.b) for r in plain.collect() for i in r.ids}
    for slices in (1, 5, 64):
        assert {r.id: (r.first_ts, r.last_ts) for r in grouping.ranged_islands(df, "id", "t", 25, slices).collect()} == want


@pytest.mark.parametrize("by", [None, "g"])
def test_range_pairs_deal_hot_buckets(spark, by, monkeypatch):
    monkeypatch.setattr(joins, "HOT_BUCKET", 7)
    rng = random.Random(8)
    rows = [(i, rng.choice((None, 5, 5, rng.randrange(100))), rng.randrange(2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, t long, g int")
    got = sorted((r.x_id, r.y_id, r.gap) for r in joins.range_pairs(df, "id", "t", 10, ["g"] if not by else [], by).collect())
    known = [r for r in rows if r[1] is not None]
    want = sorted((a[0], b[0], b[1] - a[1]) for a in known for b in known if 0 <= b[1] - a[1] <= 10 and (b[1], b[0]) > (a[1], a[0]) and (not by or a[2] == b[2]))
    assert got == want and len(want) > 500


def test_dense_index(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("k")).repartition(5)
    assert all(r.k == r.position for r in review.dense_index(df, [F.col("k")]).collect())
    with pytest.raises(ValueError):
        review.page(df, 0, 51)


def test_band_pairs_find_all_near_hashes(spark):
    rng = random.Random(3)
    base = rng.getrandbits(63)
    hashes = [base] + [base ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(0, 63, 7), 2)] + [rng.getrandbits(63) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, h long")
    want = {(i, j) for i, j in itertools.combinations(range(len(hashes)), 2) if bin(hashes[i] ^ hashes[j]).count("1") <= 2}
    assert {(r.a, r.b) for r in joins.band_pairs(df, "id", "h", 2).collect()} == want


def test_reciprocal_best_needs_margin(spark):
    pairs = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.6), (2, 2, 0.8), (2, 1, 0.75), (3, 3, 0.4)], "a long, b long, s double")
    assert [(r.a, r.b) for r in joins.reciprocal_best(pairs, "a", "b", "s", 0.5, 0.15).collect()] == [(1, 1)]


def test_mmr_prefers_what_differs():
    unit = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    assert selection.mmr_order(np.array([1.0, 0.99, 0.6]), np.ones(3), np.arange(3), unit, 2) == [0, 2]


def test_short_segments_lose_weak_boundaries():
    assert selection.suppress_short(5, {1: (0.5, False), 3: (0.2, True)}) == [3]
    assert selection.suppress_short(3, {1: (0.5, True)}) == [1]


def test_phases_cut_at_time_gaps(spark):
    rows = [(1, i, t, [1.0, 0.0], 0, None, "burst") for i, t in enumerate((0, 1, 20, 21))]
    df = spark.createDataFrame(rows, "g long, id long, ts long, v array<double>, f int, c array<double>, k string")
    out = phasing.logical_phases(phasing.phase_edges(df, "g", "id", "ts", "v", "f", "c", "k"), "g", "id").collect()
    assert [r.phase for r in sorted(out, key=lambda r: r.id)] == [0, 0, 1, 1]


def test_batches_do_not_depend_on_the_split(spark):
    rng = random.Random(2)
    rows = [(b, i, rng.choice((1, 5, 40, None))) for b in (0, 1) for i in range(b * 100, b * 100 + 60)]
    want = []
    for b in (0, 1):
        batch, n, held = 0, 0, 0
        for _, i, s in sorted(r for r in rows if r[0] == b):
            if n and (n >= 4 or held + (s or 0) > 30):
                batch, n, held = batch + 1, 0, 0
            n, held = n + 1, held + (s or 0)
            want.append((b, i, batch))
    df = spark.createDataFrame(rows, "b long, id long, size long")
    for parts in (1, 6):
        assert sorted(tuple(r) for r in grouping.pack_batches(df.repartition(parts), "b", "id", "size", 4, 30).collect()) == want


def test_leaders_and_tracks(spark):
    rows = [(1, 1, 0.9, [1.0, 0.0]), (1, 2, 0.8, [0.95, 0.31]), (1, 3, 0.7, [0.81, 0.59])]
    got = {r.id: r.leader for r in grouping.leader_clusters(spark.createDataFrame(rows, "g long, id long, q double, v array<double>"), "g", "id", "q", "v", 0.9).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    links = [(1, 0, 0, 1, 0), (1, 1, 0, 2, 0), (1, 0, 0, 2, 0), (1, 0, 1, 1, 1), (1, 1, 1, 2, 1)]
    out = grouping.verified_tracks(spark.createDataFrame(links, "group_id long, frame_a long, object_a long, frame_b long, object_b long")).collect()
    assert {(r.frame, r.object) for r in out} == {(0, 0), (1, 0), (2, 0)}


def test_missing_features_beat_byte_identity(spark):
    row = spark.range(1).select(
        F.lit(True).alias("missing"), F.lit(True).alias("same_sha"), F.lit(True).alias("trusted"), F.lit("burst").alias("group_type"), F.lit(False).alias("face_conflict"),
        F.lit("ok").alias("exposure"), F.lit("ok").alias("keeper_exposure"), F.lit(0.5).alias("margin"),
    )
    what, why = decision.member_decision()
    assert tuple(row.select(what, why).first()) == ("UNKNOWN", "FEATURE_MISSING")
    assert tuple(row.withColumn("missing", F.lit(None).cast("boolean")).select(what, why).first()) == ("AUTO_REMOVE", "BYTE_IDENTICAL")


def test_first_decisive_face(spark):
    face = lambda hi, y: F.struct(F.lit(hi).alias("clip_hi"), F.lit(0.0).alias("clip_lo"), F.lit(y).alias("ymean"))
    dark = F.struct(*(F.lit(v).alias(k) for k, v in {"clip_hi": 0.0, "clip_lo": 0.9, "blob_hi": 0.0, "anchor_mass": 0.0, "entropy_nonclip": 5.0, "mass_usable": 0.5}.items()))
    assert one(spark, decision.exposure_class(dark)) == "reject"
    assert one(spark, decision.exposure_class(dark, F.array(face(0.5, 0.5), face(0.1, 0.5)))) == "ok"
    assert one(spark, decision.exposure_class(dark, F.array(face(0.7, 0.5), face(0.1, 0.5)))) == "reject"


def test_bounds(spark):
    assert one(spark, audit.zero_event_bound(F.lit(59))) == pytest.approx(0.0495, abs=1e-3)
    assert one(spark, audit.zero_event_bound(F.lit(15))) == pytest.approx(0.1810, abs=1e-4)
    assert one(spark, audit.wilson_upper(F.lit(0), F.lit(0))) == 1.0


def test_stratified_sample(spark):
    rows = spark.createDataFrame([(i, "abc"[min(2, i // 4)]) for i in range(40)], "id long, s string")
    got = [sorted(r.id for r in audit.stratified_sample(rows.repartition(p), "s", "id", 10, 1).collect()) for p in (1, 6)]
    assert got[0] == got[1] and len(got[0]) == 10
    total = audit.stratified_sample(rows, "s", "id", 10, 1).agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(40)


def test_columns(spark):
    assert one(spark, C.normalize_path(F.lit("a\\\\b//c/"))) == "a/b/c"
    assert one(spark, C.in_scope(F.lit("/x/ab"), "/x/a")) is False and one(spark, C.in_scope(F.lit("/x/a/b"), "/x/a")) is True
    assert one(spark, C.time_from_name(F.lit("IMG_20240229_101112.jpg"))) == 1709201472
    assert one(spark, C.time_from_name(F.lit("IMG_20240230_101112.jpg"))) is None
    assert one(spark, C.time_from_exif(F.lit("2024:02:29 10:11:12\0"))) == 1709201472
    assert [one(spark, C.keeper_budget(F.lit(n))) for n in (1, 2, 3, 4, 8, 100)] == [1, 1, 2, 3, 3, 3]
    assert one(spark, C.utility(quality=F.lit(0.5), exposure=F.lit(None).cast("double"))) == pytest.approx(0.5)
    assert one(spark, C.unit(F.array(F.lit(0.0), F.lit(0.0)))) is None


def test_json(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": 1, "a": 2}',), ('{"a": NaN}',), ('{"a": "NaN"}',), ("{",)], "t string")
    assert [r.x for r in rows.select(evidence.strict_json(F.col("t")).isNotNull().alias("x")).collect()] == [True, False, False, True, False]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "k long, v string")
    assert {tuple(r) for r in upsert.insert_ignore(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert {tuple(r) for r in upsert.upsert(old, upsert.latest(new, ["k"], ["v"]), ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "e")}
    assert {r.k: r.state for r in upsert.changes(old, new.where("v <> 'e'"), ["k"], ["v"]).collect()} == {1: "gone", 2: "changed", 3: "new"}


def test_evaluation(spark):
    rows = spark.createDataFrame([([1, 2], [1, 2], "x"), ([1], [1, 3], "y")], "ai array<long>, human array<long>, s string")
    got = {(r.by, r.value): (r.exact_rate, r.precision, r.recall) for r in evaluate.set_metrics(rows, "ai", "human", ["s"]).collect()}
    assert got["all", None] == (0.5, 1.0, 0.75) and got["s", "x"] == (1.0, 1.0, 1.0)


EVENTS = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "z")]


def test_journal_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(EVENTS, "key string, seq long, body string")
    want = {(r.key, r.seq): r.status for r in journal.dedupe_batch(df, "key", "seq", ["body"]).collect()}
    assert want == {("a", 1): "accepted", ("a", 2): "repeat", ("a", 3): "conflict", ("b", 4): "accepted"}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = journal.dedupe_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "key", "seq", ["body"])
    q = out.writeStream.format("memory").queryName("journal").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.key, r.seq): r.status for r in spark.table("journal").collect()} == want


def test_bursts_and_folds(spark):
    ts = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:20"), (1, "2024-01-01 00:05:00")]
    df = spark.createDataFrame(ts, "u long, t string").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted(r.n for r in journal.bursts(df, "t", "u").collect()) == [1, 2]
    folds = spark.createDataFrame([(1, 1, "ok"), (1, 2, "no"), (2, 1, "ok")], "g long, s long, st string")
    assert [r.g for r in journal.latest_fold(folds, "g", "s", "st", "ok").collect()] == [2]
    undo = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, None)], "g long, s long, v string")
    assert [(r.current, r.depth) for r in journal.undo_history(undo, "g", "s", "v").collect()] == [("a", 1)]


def test_inventory(spark, tmp_path):
    sof = b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x10\x00\x20\x01\x01\x11\x00\xff\xd9"
    (tmp_path / "IMG_20240229_101112.JPG").write_bytes(sof)
    (tmp_path / "bad.jpg").write_bytes(b"nothing")
    (tmp_path / "m.jpg").write_bytes(sof + b"\0\0\0\x18ftypisom")
    (tmp_path / "x.txt").write_text("no")
    got = {r.name: r for r in inventory.inventory(inventory.scan(spark, str(tmp_path), content=True)).collect()}
    first = got["IMG_20240229_101112.JPG"]
    assert set(got) == {"IMG_20240229_101112.JPG", "bad.jpg", "m.jpg"}
    assert (first.width, first.height, first.ts, first.kind, first.status) == (32, 16, 1709201472, "jpg", "ok")
    assert got["bad.jpg"].status == "error" and got["m.jpg"].kind == "jpg_motion"
    assert abs(np.linalg.norm(inventory.stub_embedding(np.arange(4800).reshape(60, 80))) - 1) < 1e-9
    assert inventory.exposure_metrics(np.full((8, 8, 3), 255))["clip_hi"] == 1.0


def test_records(spark, tmp_path):
    for n, name in ((1, "a"), (2, "b"), (4, "b")):
        (tmp_path / f"{n:012d}-{name}.json").write_text("{}")
    assert {r.fault: r.n for r in records.log_faults(records.event_log(spark, str(tmp_path))).collect()} == {"SEQUENCE_GAP": 1, "REPEATED_ID": 1}
    a = spark.range(10).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert records.manifest(a, "k", ["v"]).first() == records.manifest(a.repartition(4), "k", ["v"]).first()
    with pytest.raises(ValueError):
        records.Config.load('{"cluster": {"hamming": 3}}')
    assert records.Config.load('{"cluster": {"hamming": 1}}').cluster["cosine"] == 0.92


@pytest.mark.parametrize(("block", "by"), [(4096, None), (5, None), (5, "g")])
def test_near_pairs_brute_force(spark, monkeypatch, block, by):
    """Equal times, null times, vectors of other lengths, zero, infinite and null ones, and many parts a bucket."""
    monkeypatch.setattr(joins, "BLOCK", block)
    monkeypatch.setattr(joins, "CELLS", 40)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 60)), rng.normal(size=3).tolist(), int(rng.integers(0, 16)), int(rng.integers(0, 2))) for i in range(80)]
    rows += [(90, 5, [0.0, 0.0, 0.0], 1, 0), (91, 5, [1.0, 2.0], 2, 0), (92, 6, [1.0, 2.0], None, 0), (93, None, [1.0, 1.0, 1.0], 1, 0), (94, 7, None, 3, 1), (95, 7, [1.0, float("inf"), 0.0], 3, 1), (96, 8, [], 3, 1)]
    df = spark.createDataFrame(rows, "id long, t long, v array<double>, h long, g long")
    got = joins.near_pairs(df, "id", "t", "v", [(0.7, 10), (0.95, 25)], h="h", bits=(1, 3), by=by)
    got = {(r.x_id, r.y_id): r.c for r in got.collect()}
    pairs = joins.range_pairs(df.withColumn("u", C.unit(F.col("v"))), "id", "t", 25, ["u", "h"], by).withColumn("c", C.dot(F.col("x_u"), F.col("y_u")))
    want = pairs.where("(c >= 0.7 AND gap <= 10) OR c >= 0.95 OR (bit_count(x_h ^ y_h) <= 1 AND gap <= 3)")
    want = {(r.x_id, r.y_id): r.c for r in want.collect()}
    assert got == want and (91, 92) in got and len(got) > 100


def test_span_stream_is_the_union_in_order():
    """Batches of any size give what one union after another gives; the second layer may be wider."""
    rng = random.Random(5)
    times = [rng.randrange(300) for _ in range(120)]
    window = {2: 20, 4: 60}
    edges = sorted((rng.choice((2, 4)), times[a], a, times[b], b) for a in range(120) for b in range(120) if (times[a], a) < (times[b], b) and rng.random() < 0.1)
    edges = [e for e in edges if e[3] - e[1] <= window[e[0]]]
    sets = grouping.SpanUnion(times)
    done = [(a, layer) for layer, _, a, _, b in edges if sets.union(a, b, window[layer])]
    best = {r: min(n for a, n in done if sets.find(a) == r) for r in {sets.find(a) for a, _ in done}}
    want = {i: (min(j for j in range(120) if sets.find(j) == sets.find(i)), str(best[sets.find(i)])) for i in range(120) if sets.find(i) in best}
    for size in (1, 7, len(edges)):
        stream = grouping.SpanStream()
        for k in range(0, len(edges), size):
            layer, ta, a, tb, b = (np.array(c) for c in zip(*edges[k : k + size], strict=True))
            stream.feed(layer, a, b, ta, tb, window)
        got = stream.groups({2: "2", 4: "4"})
        assert {r.item: (r.group_id, r.group_type) for r in got.itertuples()} == want and len(want) > 50


@pytest.mark.parametrize("slices", [1, 5, 64])
def test_next_in_queue_brute_force(spark, slices):
    """Repeated and null items, long runs without a queued one, and an empty queue."""
    rng = random.Random(6)
    rows = [(rng.randrange(60), rng.random() < 0.5, rng.random() < 0.2) for _ in range(90)] + [(None, True, True), (None, True, None), (70, True, False), (70, None, False)]
    queue = [i for i, _, q in rows if q and i is not None]
    asks = {i: sum(1 for j, a, _ in rows if a and i == j) for i, a, _ in rows if a}
    want = {(i, min((q for q in queue if i is not None and q > i), default=max(queue)), n * sum(1 for q in queue if i is not None and q < i)) for i, n in asks.items()}
    df = spark.createDataFrame(rows, "id long, asks boolean, queued boolean")
    got = selection.next_in_queue(df, "id", "asks", "queued", slices).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert selection.next_in_queue(df.where("NOT queued"), "id", "asks", "queued", slices).count() == 0


def test_unit_works_out_its_norm_once(spark):
    plan = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(C.unit(F.col("v")).alias("u"))
    assert plan.first().u == [0.6, 0.8] and plan._jdf.queryExecution().optimizedPlan().toString().upper().count("SQRT(") == 1
