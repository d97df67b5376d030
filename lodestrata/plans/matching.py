"""Correspondence, phases, routes and sinks over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import correspond as K
from ..operators import grouping as G
from ..operators import phasing as P
from ..operators import routing as R
from ..session import checkpointed, table
from ..sources import sinks
from .common import items
from .registry import query

#: Vectors as objects: four make a frame, frames meet the next one.
_OBJECTS = "SELECT vec_id // 4 AS f, vec_id % 4 AS object, label % 2 AS class_id, ((vec_id * 37) % 11)::DOUBLE AS x, ((vec_id * 53) % 7)::DOUBLE AS y, embedding, vec_id % 9 <> 0 AS confirmed FROM embeddings"
_MET = """SELECT a.f AS l, b.f AS r, a.object AS i, b.object AS j, {score} AS s, {both} / (240 - {both}) AS overlap, a.confirmed AND b.confirmed AS confirmed FROM o a JOIN o b ON b.f = a.f + 1 {more}"""
_BOTH = "(greatest(0, 12 - abs(a.x - b.x)) * greatest(0, 10 - abs(a.y - b.y)))"
_NORM = "sqrt(list_sum(list_transform(range(1, 65), lambda i: {a}.embedding[i]::DOUBLE * {a}.embedding[i]::DOUBLE)))"
_COS = "list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / " + _NORM.format(a="a") + " / " + _NORM.format(a="b")
_RIVAL = """SELECT p.*, (SELECT max(q.s) FROM p q WHERE q.l = p.l AND q.i = p.i AND q.j <> p.j) AS row_next, (SELECT max(q.s) FROM p q WHERE q.l = p.l AND q.j = p.j AND q.i <> p.i) AS col_next,
    row_number() OVER (PARTITION BY l, i ORDER BY s DESC, j) AS row_rank, row_number() OVER (PARTITION BY l, j ORDER BY s DESC, i) AS col_rank FROM p"""


def _objects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = F.col("vec_id")
    x, y = (v * 37 % 11).cast("double"), (v * 53 % 7).cast("double")
    o = table(spark, d, "embeddings").select(
        F.floor(v / 4).alias("frame"), (v % 4).alias("object"), (F.col("label") % 2).alias("class_id"), F.array(x, y, x + 12, y + 10).alias("box"), C.unit(F.col("embedding")).alias("vector"), (v % 9 != 0).alias("confirmed"),
    )
    f = o.select("frame").distinct()
    pairs = f.select(F.col("frame").alias("left"), (F.col("frame") + 1).alias("right")).join(f.select(F.col("frame").alias("right")), "right", "left_semi").select("left", "right")
    return o, pairs


@query(
    "jn15_place_matches",
    f"""WITH o AS ({_OBJECTS}), frames AS (SELECT DISTINCT f FROM o), pairs AS (SELECT a.f AS l, b.f AS r FROM frames a JOIN frames b ON b.f = a.f + 1),
    p AS ({_MET.format(score=f"{_BOTH} / (240 - {_BOTH})", both=_BOTH, more="AND a.class_id = b.class_id")}), z AS ({_RIVAL}),
    best AS (SELECT *, s >= 0.5 AND s - coalesce(row_next, -9) >= 0.15 AND s - coalesce(col_next, -9) >= 0.15 AS ok FROM z WHERE row_rank = 1),
    lefts AS (SELECT pairs.l, pairs.r, o.object, best.j, best.s, CASE WHEN coalesce(best.s, 0) < 0.5 THEN 'unmatched' WHEN best.ok THEN 'matched' ELSE 'ambiguous' END AS state FROM pairs JOIN o ON o.f = pairs.l LEFT JOIN best ON best.l = pairs.l AND best.i = o.object)
    SELECT l AS "left", r AS "right", 'left' AS side, object, CASE WHEN state = 'matched' THEN j END AS partner, CASE WHEN state = 'matched' THEN s END AS overlap, state FROM lefts
    UNION ALL SELECT pairs.l, pairs.r, 'right', o.object, t.object, t.s, CASE WHEN t.object IS NULL THEN 'unmatched' ELSE 'matched' END
    FROM pairs JOIN o ON o.f = pairs.r LEFT JOIN lefts t ON t.state = 'matched' AND t.l = pairs.l AND t.j = o.object""",
)
def jn15p(spark: SparkSession, d: str) -> DataFrame:
    o, pairs = _objects(spark, d)
    return K.match_by_place(pairs, o)


@query(
    "jn17_appearance_matches",
    f"""WITH o AS ({_OBJECTS}), p AS ({_MET.format(score=_COS, both=_BOTH, more="")}), z AS ({_RIVAL}),
    m AS (SELECT *, least(s - coalesce(row_next, s - 2), s - coalesce(col_next, s - 2)) AS margin FROM z WHERE row_rank = 1)
    SELECT l AS "left", r AS "right", i AS object, j AS partner, round(s, 6) AS similarity, round(margin, 6) AS margin, CASE WHEN s < 0.9 THEN 'FOREGROUND_APPEARANCE_BELOW_FLOOR' WHEN margin < 0.03 OR col_rank <> 1 THEN 'FOREGROUND_APPEARANCE_NOT_UNIQUE'
    WHEN overlap < 0.5 THEN 'OBSERVATION_GEOMETRY_UNCONFIRMED' WHEN NOT confirmed THEN 'INDEPENDENT_VIEW_UNCONFIRMED' ELSE 'MATCHED' END AS reason FROM m""",
)
def jn17(spark: SparkSession, d: str) -> DataFrame:
    o, pairs = _objects(spark, d)
    return K.match_by_looks(pairs, o).withColumn("similarity", F.round("similarity", 6)).withColumn("margin", F.round("margin", 6))


def _regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Objects as regions: the last of a frame is a face in the first, which is a person."""
    o, pairs = _objects(spark, d)
    face = (F.col("object") == 3) & (F.col("frame") % 2 == 0)
    b = F.col("box")
    inner = F.array((b[0] + 1) / 24, (b[1] + 1) / 24, (b[0] + 2) / 24, (b[1] + 2) / 24)
    r = o.select(
        "frame", F.col("object").alias("region"), F.when(face, "face").otherwise("subject").alias("kind"), F.when(face | (F.col("object") == 0), 0).otherwise(F.col("class_id") * 15).cast("int").alias("class_id"),
        F.when(face, F.lit(0)).cast("long").alias("parent"), F.when(face, inner).otherwise(F.transform("box", lambda x: x / 24)).alias("box"), "vector",
    )
    return r, pairs


@query("jn16_set_matches")
def jn16(spark: SparkSession, d: str) -> DataFrame:
    r, pairs = _regions(spark, d)
    # frames also meet themselves, which must match wherever looks are unique
    same = pairs.select("left", F.col("left").alias("right"))
    return K.match_sets(pairs.union(same), r)[0]


@query("ms18_sound_sets")
def ms18(spark: SparkSession, d: str) -> DataFrame:
    r, _ = _regions(spark, d)
    return K.sound_sets(r.select("*", F.lit(0.9).alias("confidence"), F.lit(200).alias("native_w"), F.lit(200).alias("native_h"), F.lit(50.0).alias("musiq"), F.lit(0.5).alias("clipiqa")))


#: A standing body, joints 5 to 16 from its centre in shares of its size.
_BODY = ((-0.3, -0.3), (0.3, -0.3), (-0.4, -0.1), (0.4, -0.1), (-0.4, 0.1), (0.4, 0.1), (-0.2, 0.1), (0.2, 0.1), (-0.2, 0.3), (0.2, 0.3), (-0.2, 0.45), (0.2, 0.45))


def _people(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events as people, two in a frame; the higher the value, the higher their arms."""
    e = table(spark, d, "events").select(F.floor(F.col("event_id") / 2).alias("frame"), (F.col("event_id") % 2).alias("person"), (F.col("value") % 50 / 100).alias("up"))
    x, y, w, h = 0.25 + 0.5 * F.col("person"), F.lit(0.5), 0.3, 0.6
    joint = lambda i, a, b: F.array(x + w * a, y + h * (b - F.col("up") * {7: 0.5, 8: 0.5, 9: 1.0, 10: 1.0}.get(i, 0.0)), F.lit(0.9))
    points = F.array(*[F.array(x, y, F.lit(0.0))] * 5, *(joint(i, a, b) for i, (a, b) in enumerate(_BODY, 5)))
    people = e.select("frame", "person", F.array(x - w / 2, y - h / 2, x + w / 2, y + h / 2).alias("box"), F.lit(0.9).alias("confidence"), points.alias("points"))
    f = e.select("frame").distinct()
    frames = f.select("frame", F.lit("p").alias("producer"), F.lit("ok").alias("status"), F.lit(1000).alias("width"), F.lit(800).alias("height"))
    pairs = f.select(F.col("frame").alias("left"), (F.col("frame") + 1).alias("right")).join(f.select(F.col("frame").alias("right")), "right", "left_semi").select("left", "right")
    return people, frames, pairs


@query("jn18_pose_moves")
def jn18(spark: SparkSession, d: str) -> DataFrame:
    people, frames, pairs = _people(spark, d)
    return K.compare_poses(pairs, frames, people)


@query("ms19_assigned_poses")
def ms19(spark: SparkSession, d: str) -> DataFrame:
    people, frames, _ = _people(spark, d)
    regions = people.select("frame", F.col("person").alias("region"), F.lit("subject").alias("kind"), F.lit(0).alias("class_id"), "box")
    return K.assign_poses(regions, people.join(frames.select("frame", "width", "height"), "frame")).select("frame", "region", "person", F.size("points").alias("joints"))


# ---- phases --------------------------------------------------------------------------------------


def _bursts(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    place = F.when(F.col("id") % 9 != 0, F.array(F.col("value") % 10 / 10, F.col("value") % 7 / 7))
    return i.select("user_id", "id", "ts", "embedding", "size", (F.col("value") / 100).alias("score"), (F.col("id") % 3).cast("int").alias("faces"), place.alias("center"), F.when(F.col("user_id") % 2 == 0, "burst").otherwise("phash_near").alias("kind"))


@query("gr9_phases")
def gr9(spark: SparkSession, d: str) -> DataFrame:
    edges = P.phase_edges(_bursts(spark, d), "user_id", "id", "ts", "embedding", "faces", "center", "kind", gap=86_400, boundary=0.3)
    return P.logical_phases(edges, "user_id", "id")


def _phase_keepers(spark: SparkSession, d: str, slack: float | None) -> DataFrame:
    m = _bursts(spark, d).withColumn("optional", F.col("id") % 4 == 0)
    return P.phase_keepers(m.join(gr9(spark, d), ["user_id", "id"]), "user_id", "id", "score", "size", "embedding", "faces", "optional", slack=slack)


@query("gr10_phase_keepers")
def gr10(spark: SparkSession, d: str) -> DataFrame:
    return _phase_keepers(spark, d, None)


@query("tk4_quality_banded")
def tk4(spark: SparkSession, d: str) -> DataFrame:
    return _phase_keepers(spark, d, 0.04)


@query("dc4_phase_coverage")
def dc4p(spark: SparkSession, d: str) -> DataFrame:
    return P.coverage(gr10(spark, d), "user_id", "phase", F.col("members"), F.col("keepers"), F.col("budget"))


@query("gr11_pose_variants")
def gr11p(spark: SparkSession, d: str) -> DataFrame:
    people, frames, pairs = _people(spark, d)
    members = frames.select(F.floor(F.col("frame") / 4).alias("g"), "frame", (F.col("frame") % 7 / 7).alias("score"), (F.col("frame") % 4 == 0).alias("kept"))
    inside = members.where("NOT kept").select("g", F.col("frame").alias("left")).join(members.where("kept").select("g", F.col("frame").alias("right")), "g").select("left", "right")
    return P.protect_poses(members, K.compare_poses(inside, frames, people), "g", "frame", "score", "kept")


@query("gr3_group_trust")
def gr3t(spark: SparkSession, d: str) -> DataFrame:
    from .timeline import gr3_layers

    # read several times each; groups and items are dear to work out
    i, m = checkpointed(items(spark, d).select("id", "value", "embedding")), checkpointed(gr3_layers(spark, d))
    keep = m.join(i.select("id", "value"), "id").groupBy("group_id").agg(F.max_by("id", F.struct("value", -F.col("id"))).alias("keep_id"))
    return G.group_trust(m.join(keep, "group_id"), i, "group_id", "id", "keep_id", "group_type", "embedding", 0.25)


# ---- routes --------------------------------------------------------------------------------------


@query("dc7_exposure_routes")
def dc7(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    shade = 0.5 + F.col("label") / 400
    rgb = F.array_repeat(shade, 64 * 64 * 3)
    e = table(spark, d, "embeddings").select(F.floor(v / 4).alias("g"), v.alias("id"), (10.0 + 5 * (v % 4 == 0).cast("int")).alias("quality"), F.floor(v / 4).alias("time"), F.lit(1.5).alias("aspect"), (v % 2).alias("hash"), rgb.alias("rgb"))
    return R.route_exposure(e, "g", "id").select("g", "route", "members", "selected", "exposed", "bits")


@query("dc11_ownership")
def dc11(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("frame"), "value")
    k = F.col("frame")
    tag = F.element_at(F.array(*map(F.lit, R.SUBJECTS)), (k % 6 + 1).cast("int"))
    frames = e.select("frame", F.when(k % 11 != 0, "KNOWN").otherwise("UNKNOWN").alias("state"), F.array(tag).alias("tags"), F.lit(2000).alias("width"), F.lit(1000).alias("height"), (k % 13 == 0).alias("printed"), F.when(k % 17 != 0, F.lit(False)).alias("nonhuman"))
    box = F.array(F.lit(100.0), F.lit(100.0), 60 + F.col("value"), 60 + F.col("value"))
    faces = e.select("frame", F.lit(0).alias("face"), box.alias("box"), F.when(k % 19 != 0, 20 + F.col("value") / 2).alias("iod"))
    subjects = e.select("frame", F.lit(0).alias("subject"), F.array(*map(F.lit, (50.0, 50.0, 400.0, 900.0))).alias("box"))
    seen = F.when(k % 5 == 0, "MAYBE").otherwise("OPEN")
    crops = e.select("frame", F.lit(0).alias("face"), F.explode(F.array(*map(F.lit, R.CROPS))).alias("context"), box.alias("box"), F.lit(30.0).alias("iod"), seen.alias("observation"), F.lit(False).alias("profile"), (k % 23 == 0).alias("occluded"), F.lit(True).alias("eyes_visible"))
    return R.ownership(frames, faces, subjects, crops).select("frame", "applicability", "reason", F.size("accepted").alias("accepted"))


@query(
    "ms9_pair_deltas",
    """WITH s AS (SELECT l_orderkey AS k, round(avg(l_quantity), 6) AS q, count(*) FILTER (WHERE l_returnflag = 'A') AS a, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY l_orderkey)
    SELECT x.o_custkey, x.o_orderkey AS "left", y.o_orderkey AS "right", round(t.q - s.q, 6) AS q_delta, coalesce(t.a, 0) - coalesce(s.a, 0) AS a, coalesce(t.r, 0) - coalesce(s.r, 0) AS r
    FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey LEFT JOIN s ON s.k = x.o_orderkey LEFT JOIN s t ON t.k = y.o_orderkey""",
)
def ms9(spark: SparkSession, d: str) -> DataFrame:
    flags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.avg("l_quantity"), 6).alias("q"), *(F.count_if(F.col("l_returnflag") == f).alias(f) for f in "AR"))
    sums = flags.select("o_orderkey", "q", F.create_map(F.lit("A"), F.col("A"), F.lit("R"), F.col("R")).alias("n"))
    p = R.pair_deltas(table(spark, d, "orders"), sums, "o_custkey", "o_orderkey", ["q"], ["n"])
    one = lambda f: F.coalesce(F.try_element_at("n_deltas", F.lit(f)), F.lit(0))
    return p.select("o_custkey", "left", "right", F.round("q_delta", 6).alias("q_delta"), one("A").alias("a"), one("R").alias("r"))


# ---- sinks ---------------------------------------------------------------------------------------


@query(
    "snk6_decided_members",
    "SELECT o_custkey, o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'AUTO_REMOVE' ELSE o_orderstatus END AS decision, CASE WHEN o_totalprice > 200000 THEN 0.9::DOUBLE END AS confidence FROM orders",
)
def snk6(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    late = o.where("o_totalprice > 200000").select("o_custkey", "o_orderkey", F.lit("AUTO_REMOVE").alias("decision"), F.lit(0.9).alias("confidence"))
    return sinks.decided(o.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("decision")), late, "o_custkey", "o_orderkey")


@query("snk7_groups_left", "SELECT c_custkey AS g FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def snk7g(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("g"))
    return sinks.clear_groups(groups, o.select(F.col("o_custkey").alias("g"), "o_orderkey"), o, "g", "o_orderkey", F.col("o_orderpriority") == "1-URGENT")[0]


@query(
    "snk14_dry_run",
    """SELECT line, CASE WHEN n > 1 THEN 'REPEATED' WHEN c_name IS NULL THEN 'MISSING' WHEN c_acctbal < 0 THEN 'PROTECTED' ELSE 'PLANNED' END AS state
    FROM (SELECT line, count(*) AS n FROM (SELECT c_name AS line FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer WHERE c_acctbal > 9000) GROUP BY line) LEFT JOIN customer ON c_name = line""",
)
def snk14(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    lines = c.select(F.col("c_name").alias("line")).union(table(spark, d, "supplier").select("s_name")).union(c.where("c_acctbal > 9000").select("c_name"))
    return sinks.dry_run(lines, c, "c_name", F.col("c_acctbal") < 0)


@query(
    "str7_recovered_journal",
    """SELECT o_orderkey AS k, o_orderstatus AS body, o_orderkey AS n FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) + (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'F') FROM orders WHERE o_orderstatus <> 'F'""",
)
def str7(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("body"))
    return sinks.recover(o.where("body = 'F'").withColumn("n", F.col("k")), o, "k", "n", ["body"])[0]
