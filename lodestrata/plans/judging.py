"""Decisions, risk, audits, evaluation and evidence over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import audit as A
from ..operators import decision as D
from ..operators import evaluate as E
from ..operators import evidence as V
from ..operators import review as R
from ..session import table
from .common import ITEMS_SQL, items
from .registry import query

_M = """SELECT event_id, user_id, event_id % 13 = 0 AS missing, event_id % 11 = 0 AS same_sha, event_id % 3 <> 0 AS trusted,
    ['burst', 'sha_exact', 'phash_near', 'similar_scene'][1 + event_id % 4] AS group_type, event_id % 5 = 0 AS face_conflict,
    ['ok', 'maybe', 'reject'][1 + event_id % 3] AS exposure, ['dark', 'burnt'][1 + user_id % 2] AS exposure_reason, ['ok', 'reject'][1 + event_id % 2] AS keeper_exposure, value / 100 AS margin FROM events"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    nth = lambda n, *x: F.element_at(F.array(*map(F.lit, x)), (i % n + 1).cast("int"))
    return table(spark, d, "events").select(
        "event_id", "user_id", (i % 13 == 0).alias("missing"), (i % 11 == 0).alias("same_sha"), (i % 3 != 0).alias("trusted"),
        nth(4, "burst", "sha_exact", "phash_near", "similar_scene").alias("group_type"), (i % 5 == 0).alias("face_conflict"),
        nth(3, "ok", "maybe", "reject").alias("exposure"), F.when(F.col("user_id") % 2 == 0, "dark").otherwise("burnt").alias("exposure_reason"), nth(2, "ok", "reject").alias("keeper_exposure"), (F.col("value") / 100).alias("margin"),
    )


_REASON = """CASE WHEN missing THEN 'FEATURE_MISSING' WHEN same_sha THEN 'BYTE_IDENTICAL'
    WHEN NOT trusted THEN CASE group_type WHEN 'phash_near' THEN 'PHASH_NEAR_UNTRUSTED' WHEN 'similar_scene' THEN 'SIMILAR_SCENE_UNTRUSTED' ELSE 'GROUP_IMPURE' END
    WHEN group_type = 'sha_exact' THEN 'SHA_GROUP_NO_MATCH' WHEN group_type = 'phash_near' THEN 'PHASH_NEAR_DUP_ONLY' WHEN group_type = 'similar_scene' THEN 'SUBJECTIVE_ONLY: similar_scene'
    WHEN face_conflict THEN 'FACE_COUNT_MISMATCH' WHEN exposure = 'reject' AND keeper_exposure <> 'reject' THEN 'EXPOSURE_UNCALIBRATED_BALANCED: ' || exposure_reason WHEN margin < 0.08 THEN 'LOW_MARGIN'
    WHEN exposure = 'maybe' THEN 'EXPOSURE_BORDERLINE: ' || exposure_reason ELSE 'RELATIVE_ONLY' END"""
_DECIDED = f"SELECT *, CASE WHEN missing THEN 'UNKNOWN' WHEN same_sha THEN 'AUTO_REMOVE' ELSE 'MAYBE' END AS decision, {_REASON} AS reason FROM ({_M})"


def _decided(spark: SparkSession, d: str) -> DataFrame:
    decision, reason = D.member_decision(exposure_reason=F.col("exposure_reason"))
    return _cases(spark, d).withColumn("decision", decision).withColumn("reason", reason)


@query("dc1_member_decisions", f"SELECT event_id, decision, reason FROM ({_DECIDED})")
def dc1(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("event_id", "decision", "reason")


@query("dc1_group_state", f"SELECT user_id, CASE WHEN bool_or(decision IN ('MAYBE', 'UNKNOWN')) THEN 'REVIEW_REQUIRED' ELSE 'AUTO_READY' END AS state FROM ({_DECIDED}) GROUP BY user_id")
def dc1g(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).groupBy("user_id").agg(D.group_state(F.col("decision")).alias("state"))


@query("ag4_reason_counts", f"SELECT split_part(reason, ':', 1) AS reason, count(*) AS n FROM ({_DECIDED}) GROUP BY 1")
def ag4(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).groupBy(F.split("reason", ":")[0].alias("reason")).agg(F.count("*").alias("n"))


@query("ag4_auto_coverage", f"SELECT count(*) FILTER (WHERE decision = 'AUTO_REMOVE') / count(*) AS coverage FROM ({_DECIDED})")
def ag4c(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).agg(F.try_divide(F.count_if(F.col("decision") == "AUTO_REMOVE"), F.count("*")).alias("coverage"))


_X = "SELECT event_id, (value % 10) / 10 AS hi, (value % 7) / 7 AS lo, (value % 3) / 3 AS blob, (value % 9) / 9 AS anchor, value % 6 AS ent, (value % 8) / 8 AS mass FROM events"


@query(
    "dc2_exposure_classes",
    f"""SELECT event_id, CASE WHEN (hi > 0.35 AND blob > 0.20 AND anchor < 0.10) OR (lo > 0.60 AND anchor < 0.05) OR (ent < 3.0 AND mass < 0.25) THEN 'reject'
    WHEN hi > 0.15 OR lo > 0.35 OR (anchor < 0.25 AND mass < 0.45) THEN 'maybe' ELSE 'ok' END AS exposure FROM ({_X})""",
)
def dc2(spark: SparkSession, d: str) -> DataFrame:
    v = lambda n, name: (F.col("value") % n / n).alias(name)
    m = F.struct(v(10, "clip_hi"), v(7, "clip_lo"), v(3, "blob_hi"), v(9, "anchor_mass"), (F.col("value") % 6).alias("entropy_nonclip"), v(8, "mass_usable"))
    return table(spark, d, "events").select("event_id", D.exposure_class(m).alias("exposure"))


@query(
    "dc5_event_policy",
    """WITH e AS (SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'stage' WHEN 'BUILDING' THEN 'pet' WHEN 'AUTOMOBILE' THEN 'convention' WHEN 'HOUSEHOLD' THEN 'design_reference' ELSE c_mktsegment END AS kind,
      CASE WHEN c_custkey % 3 = 0 THEN 'no_vlm' ELSE 'full' END AS capability, c_acctbal / 8000 AS confidence, c_custkey % 5 = 0 AS mixed, c_custkey % 7 = 0 AS sensitive FROM customer),
    v AS (SELECT *, kind IN ('stage', 'pet', 'convention', 'design_reference') AND confidence BETWEEN 0 AND 1 AS valid FROM e),
    p AS (SELECT *, CASE WHEN valid THEN kind ELSE 'general' END AS k, NOT valid OR capability <> 'full' OR confidence < 0.65 OR mixed AS weak FROM v),
    l AS (SELECT *, CASE k WHEN 'stage' THEN 5 WHEN 'pet' THEN 6 WHEN 'design_reference' THEN 4 ELSE 8 END AS g, CASE WHEN k IN ('general', 'convention') THEN 1 ELSE 2 END AS n FROM p)
    SELECT c_custkey, CASE WHEN weak THEN least(g, 4) ELSE g END AS max_group, CASE WHEN weak THEN greatest(n, 2) ELSE n END AS keepers, weak OR sensitive OR k IN ('general', 'convention') AS identity_required FROM l""",
)
def dc5(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"MACHINERY": "stage", "BUILDING": "pet", "AUTOMOBILE": "convention", "HOUSEHOLD": "design_reference"}
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("c_mktsegment")), F.col("c_mktsegment"))
    nth = lambda n: F.col("c_custkey") % n == 0
    e = table(spark, d, "customer").select("c_custkey", kind.alias("kind"), F.when(nth(3), "no_vlm").otherwise("full").alias("capability"), (F.col("c_acctbal") / 8000).alias("confidence"), nth(5).alias("mixed"), nth(7).alias("sensitive"))
    return D.compile_policy(e, "kind", "capability", "confidence", "mixed", "sensitive").select("c_custkey", "max_group", "keepers", "identity_required")


@query(
    "dc6_group_routes",
    "SELECT source AS g, CASE WHEN count(DISTINCT sha256(text)) = 1 AND bool_and(lang IN ('en', 'fr')) THEN 'cv_only' ELSE 'vlm' END AS route FROM documents GROUP BY source",
)
def dc6(spark: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("lang").isin("en", "fr"), "KEEP").otherwise("MAYBE")
    m = table(spark, d, "documents").select(F.col("source").alias("g"), F.sha2("text", 256).alias("sha"), decision.alias("decision"))
    return D.route_group(m, "g", "sha", "decision")


@query(
    "dc8_family_votes",
    """WITH v AS (SELECT user_id, event_id % 7 AS family, CASE WHEN value > 60 THEN 1 WHEN value < 40 THEN -1 ELSE 0 END AS s FROM events),
    f AS (SELECT user_id, family, min(s) AS lo, max(s) AS hi FROM v WHERE s <> 0 GROUP BY user_id, family),
    g AS (SELECT user_id, coalesce(sum(CASE WHEN lo = hi THEN lo ELSE 0 END), 0)::BIGINT AS balance, count(*) FILTER (WHERE lo = hi) AS votes, count(*) FILTER (WHERE lo <> hi) AS conflicts FROM f GROUP BY user_id)
    SELECT user_id, votes, conflicts, balance, CASE WHEN votes >= 3 AND abs(balance) >= 2 THEN sign(balance)::INTEGER END AS side,
    CASE WHEN votes < 3 THEN 'TOO_FEW_VOTES' WHEN abs(balance) < 2 THEN 'LOW_MARGIN' ELSE 'RESOLVED' END AS reason FROM g""",
)
def dc8(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("value") > 60, 1).when(F.col("value") < 40, -1).otherwise(0)
    v = table(spark, d, "events").select("user_id", (F.col("event_id") % 7).alias("family"), sign.alias("s"))
    return D.pair_verdict(v, "user_id", "family", "s", least=3, margin=2)


@query(
    "dc9_eye_states",
    """WITH f AS (SELECT event_id, user_id, CASE WHEN event_id % 17 <> 0 THEN value / 100 END AS l, (value * 7 % 100) / 100 AS r, 80 + event_id % 60 AS w, 20 + event_id % 30 AS iod, (event_id % 10) / 10 AS smile, (event_id % 9) / 9 AS squint FROM events),
    s AS (SELECT *, CASE WHEN l IS NULL OR r IS NULL THEN 'UNKNOWN' WHEN w < 96 OR iod < 24 THEN 'UNKNOWN' WHEN l <= 0.15 AND r <= 0.15 THEN 'OPEN'
      WHEN l >= 0.5 AND r >= 0.5 AND abs(l - r) <= 0.25 THEN CASE WHEN smile >= 0.45 AND squint >= 0.45 THEN 'MAYBE' ELSE 'CLOSED' END ELSE 'MAYBE' END AS eyes FROM f)
    SELECT event_id, eyes, CASE WHEN l IS NULL OR r IS NULL THEN 'MISSING_EVIDENCE' WHEN w < 96 OR iod < 24 THEN 'SMALL_FACE' WHEN eyes = 'OPEN' THEN 'BOTH_EYES_OPEN' WHEN eyes = 'CLOSED' THEN 'BOTH_EYES_CLOSED'
      WHEN l >= 0.5 AND r >= 0.5 AND abs(l - r) <= 0.25 THEN 'SMILE_SQUINT' WHEN (l >= 0.5) <> (r >= 0.5) OR abs(l - r) > 0.25 THEN 'WINK_OR_ASYMMETRIC' ELSE 'BLINK_GRAY_ZONE' END AS reason FROM s""",
)
def dc9(spark: SparkSession, d: str) -> DataFrame:
    i, v = F.col("event_id"), F.col("value")
    state, reason = D.eye_state(F.when(i % 17 != 0, v / 100), (v * 7 % 100) / 100, 80 + i % 60, 20 + i % 30, (i % 10) / 10, (i % 9) / 9)
    return table(spark, d, "events").select("event_id", state.alias("eyes"), reason.alias("reason"))


@query(
    "dc10_ordered_gates",
    "SELECT doc_id, CASE WHEN NOT coalesce(n_chars > 40, false) THEN 'METADATA' WHEN NOT coalesce(lang = 'en', false) THEN 'DECODE' WHEN NOT coalesce(source <> 'src3', false) THEN 'DISABLED' ELSE 'PASS' END AS gate FROM documents",
)
def dc10(spark: SparkSession, d: str) -> DataFrame:
    gates = [(F.col("n_chars") > 40, "METADATA"), (F.col("lang") == "en", "DECODE"), (F.col("source") != "src3", "DISABLED")]
    return table(spark, d, "documents").select("doc_id", D.ordered_gates(gates).alias("gate"))


#: Notes that show every rule, and what part keys make of them.
_NOTES = ("构图更完整", "缩略图有点糊看不清", "主体完整但无法判断", "动作不确定", "留这张？", "nice light", "")


@query(
    "dc16_note_rules",
    f"""WITH n AS (SELECT p_partkey, ({list(_NOTES)})[1 + p_partkey % {len(_NOTES)}] || ' ' || p_name AS note, CASE WHEN p_partkey % 11 = 0 THEN 'open' ELSE 'reviewed' END AS status, p_partkey % 13 <> 0 AS phased FROM part),
    m AS (SELECT *, regexp_matches(note, '{D.NOTE_ABSTAIN}') AS a, regexp_matches(note, '{D.NOTE_ASSESSED}') AS b FROM n)
    SELECT p_partkey, CASE WHEN status <> 'reviewed' OR NOT phased THEN 'needs_review_nonreviewed' WHEN regexp_matches(note, '[?？]') THEN 'needs_review_question'
    WHEN regexp_matches(note, '{D.NOTE_PHASE_UNCERTAIN}') THEN 'needs_review_phase_uncertain' WHEN a AND b THEN 'needs_review_conflicting_quality' WHEN a THEN 'quality_abstain_explicit'
    WHEN b THEN 'assessed_explicit' ELSE 'needs_review_no_explicit_quality_rule' END AS kind FROM m""",
)
def dc16(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    note = F.concat(F.element_at(F.array(*map(F.lit, _NOTES)), (k % len(_NOTES) + 1).cast("int")), F.lit(" "), "p_name")
    phases = F.when(k % 13 != 0, F.array(F.lit("p1"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select("p_partkey", D.note_rule(note, F.when(k % 11 == 0, "open").otherwise("reviewed"), phases).alias("kind"))


@query("dc19_uniform_packets", "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1 AND count(*) > 1")
def dc19(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"), F.count("*").alias("n"))
    return g.where("a = b AND n > 1").select("l_orderkey")


_G = """SELECT l_orderkey AS g, count(*) AS members, epoch(max(l_shipdate))::BIGINT - epoch(min(l_shipdate))::BIGINT AS span, 1 - max(l_tax) AS pair, 1 - min(l_tax) AS adj,
    count(DISTINCT l_returnflag) AS faces, min(l_discount) AS margin, count(*) FILTER (WHERE l_quantity < 2) AS missing, count(DISTINCT l_linestatus) AS keepers, 1 AS phases FROM lineitem GROUP BY l_orderkey"""
_W = """CASE WHEN g % 4 <> 0 THEN 0.04 ELSE 0 END + CASE WHEN members >= 5 THEN 0.08 ELSE 0 END + CASE WHEN span > 8 THEN 0.08 ELSE 0 END + CASE WHEN pair < 0.94 THEN 0.13 ELSE 0 END + CASE WHEN adj < 0.95 THEN 0.13 ELSE 0 END
    + CASE WHEN faces > 1 THEN 0.10 ELSE 0 END + CASE WHEN g % 5 = 0 THEN 0.12 ELSE 0 END + CASE WHEN margin < 0.06 THEN 0.12 ELSE 0 END + CASE WHEN missing > 0 THEN 0.10 ELSE 0 END + CASE WHEN g % 6 = 0 THEN 0.13 ELSE 0 END
    + CASE WHEN keepers > 1 THEN 0.09 ELSE 0 END + CASE WHEN g % 7 = 0 THEN 0.10 ELSE 0 END + CASE WHEN g % 9 = 0 THEN 0.08 ELSE 0 END + CASE WHEN g % 8 = 0 THEN 0.08 ELSE 0 END"""


@query("dc3_risk_scores", f"SELECT g, round(least(1, s), 6)::DOUBLE AS score, round(round(least(1, s), 6)::DOUBLE * (1 + log2(greatest(1, members - keepers) + 1)), 6) AS expected FROM (SELECT g, members, keepers, ({_W}) AS s FROM ({_G}))")
def dc3(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    g = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("g")).agg(
        F.count("*").alias("member_count"), (F.max(C.seconds(c("l_shipdate"))) - F.min(C.seconds(c("l_shipdate")))).alias("time_span_seconds"),
        (1 - F.max("l_tax")).alias("min_pair_similarity"), (1 - F.min("l_tax")).alias("min_adjacent_similarity"), F.count_distinct("l_returnflag").alias("face_count_states"),
        F.min("l_discount").alias("quality_margin"), F.count_if(c("l_quantity") < 2).alias("critical_missing_count"), F.count_distinct("l_linestatus").alias("keeper_count"),
    )
    evidence = {x: c(x) for x in g.columns if x != "g"} | {
        "group_type": F.when(c("g") % 4 == 0, "sha_exact").otherwise("burst"), "position_conflict": c("g") % 5 == 0, "v2_v3_disagreement": c("g") % 6 == 0,
        "logical_phase_count": F.when(c("g") % 7 == 0, 2).otherwise(1), "changed": c("g") % 9 == 0,
        "baseline_keeper_ids": F.array(c("g"), c("g") + 1), "candidate_keeper_ids": F.when(c("g") % 8 == 0, F.array(c("g"))).otherwise(F.array(c("g"), c("g") + 1, c("g") + 2)),
    }
    scored = g.select("g", A.review_impact(c("member_count"), c("keeper_count")).alias("impact"), A.risk_score(A.risk_reasons(evidence)).alias("score"))
    return scored.select("g", "score", A.expected_value(c("score"), c("impact")).alias("expected"))


@query("tk9_top_reasons", "SELECT e AS event_id, list_aggregate(list_slice(list_sort(list_filter([CASE WHEN v > 50 THEN 'B' END, CASE WHEN v > 20 THEN 'A' END, CASE WHEN v > 80 THEN 'C' END, CASE WHEN v > 90 THEN 'D' END], lambda x: x IS NOT NULL)), 1, 3), 'string_agg', ',') AS reasons FROM (SELECT event_id AS e, value AS v FROM events)")
def tk9(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    found = F.array(F.when(v > 50, "B"), F.when(v > 20, "A"), F.when(v > 80, "C"), F.when(v > 90, "D"))
    top = F.slice(F.array_sort(F.filter(found, lambda x: x.isNotNull())), 1, 3)
    return table(spark, d, "events").select("event_id", F.when(F.size(top) > 0, F.array_join(top, ",")).alias("reasons"))


_SETS = "SELECT o_custkey AS g, min(o_orderstatus) AS status, list(DISTINCT o_orderkey) FILTER (WHERE o_totalprice > 100000) AS ai, list(DISTINCT o_orderkey) FILTER (WHERE o_totalprice < 250000) AS human FROM orders GROUP BY o_custkey"


def _sets(spark: SparkSession, d: str) -> DataFrame:
    key = lambda w: F.collect_set(F.when(w, F.col("o_orderkey")))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("g")).agg(F.min("o_orderstatus").alias("status"), key(F.col("o_totalprice") > 100000).alias("ai"), key(F.col("o_totalprice") < 250000).alias("human"))


@query(
    "ag12_set_metrics",
    f"""WITH s AS (SELECT g, status, coalesce(ai, []) AS ai, coalesce(human, []) AS human FROM ({_SETS})), o AS (SELECT status, len(list_intersect(ai, human)) AS b, len(ai) AS a, len(human) AS h FROM s)
    SELECT CASE WHEN grouping(status) = 1 THEN 'all' ELSE 'status' END AS by, status AS value, count(*) AS groups, round(count(*) FILTER (WHERE a = b AND h = b) / count(*), 6) AS exact_rate, round(count(*) FILTER (WHERE b > 0) / count(*), 6) AS overlap_rate,
    round(sum(b) / nullif(sum(a), 0), 6) AS precision, round(sum(b) / nullif(sum(h), 0), 6) AS recall, round(2 * sum(b) / nullif(sum(a) + sum(h), 0), 6) AS f1 FROM o GROUP BY GROUPING SETS ((), (status))""",
)
def ag12(spark: SparkSession, d: str) -> DataFrame:
    return E.set_metrics(_sets(spark, d), "ai", "human", ["status"])


@query(
    "st2_set_relations",
    f"""WITH s AS (SELECT g, coalesce(ai, []) AS ai, coalesce(human, []) AS human FROM ({_SETS})), o AS (SELECT g, len(list_filter(human, lambda x: NOT list_contains(ai, x))) AS a, len(list_filter(ai, lambda x: NOT list_contains(human, x))) AS r FROM s)
    SELECT g, CASE WHEN a > 0 AND r > 0 THEN 'changed' WHEN a > 0 THEN 'human_added' WHEN r > 0 THEN 'human_removed' ELSE 'exact' END AS relation, a AS n_added, r AS n_removed FROM o""",
)
def st2(spark: SparkSession, d: str) -> DataFrame:
    s = _sets(spark, d)
    return s.select("g", E.set_relation(F.col("ai"), F.col("human")).alias("relation"), F.size(F.array_except("human", "ai")).cast("long").alias("n_added"), F.size(F.array_except("ai", "human")).cast("long").alias("n_removed"))


@query("st3_partition_validity", "SELECT o_custkey, count(*) = count(DISTINCT o_totalprice) AS valid FROM orders GROUP BY o_custkey")
def st3(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.collect_list("o_totalprice").alias("p"))
    g = g.groupBy("o_custkey").agg(F.collect_list("p").alias("parts"))
    return g.select("o_custkey", E.valid_partition(F.flatten("parts"), F.col("parts")).alias("valid"))


@query("st4_event_leakage", "SELECT user_id, count(DISTINCT event_type) AS splits FROM events WHERE value > 90 GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def st4(spark: SparkSession, d: str) -> DataFrame:
    return E.leaked_events(table(spark, d, "events").where("value > 90"), "user_id", "event_type")


@query("st5_holdout_blocks", "SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) OR sha256(d.text) IN (SELECT sha256(x.text) FROM documents x JOIN labels l USING (doc_id) WHERE l.quality = 0)")
def st5(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    held = docs.join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    by_sha = docs.join(held.select("sha"), "sha", "left_semi").select("doc_id")
    return by_sha.union(held.select("doc_id")).distinct()


@query("st7_exposed_recall", f"SELECT round(sum(len(list_intersect(coalesce(ai, []), coalesce(human, [])))) / sum(len(coalesce(human, []))), 6) AS recall FROM ({_SETS})")
def st7(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d).agg(F.round(F.sum(F.size(F.array_intersect("ai", "human"))) / F.sum(F.size("human")), 6).alias("recall"))


@query(
    "st8_pair_labels",
    "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b, CASE WHEN a.l_tax < 0.04 AND b.l_tax < 0.04 THEN 'both' WHEN a.l_tax < 0.04 THEN 'a' WHEN b.l_tax < 0.04 THEN 'b' ELSE 'neither' END AS label FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber",
)
def st8(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import member_pairs

    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_tax") < 0.04).alias("kept"))
    p = member_pairs(lines, "l_orderkey", "l_linenumber", ["kept"])
    label = F.when(F.col("x_kept") & F.col("y_kept"), "both").when(F.col("x_kept"), "a").when(F.col("y_kept"), "b").otherwise("neither")
    return p.select("l_orderkey", F.col("x_l_linenumber").alias("a"), F.col("y_l_linenumber").alias("b"), label.alias("label"))


@query(
    "ag13_phase_metrics",
    """WITH l AS (SELECT l_orderkey AS g, l_linenumber AS m, l_returnflag AS phase, l_tax < 0.05 AS ok, l_discount < 0.06 AS kept FROM lineitem),
    p AS (SELECT g, phase, bool_or(ok AND kept) AS hit FROM l WHERE ok GROUP BY g, phase), k AS (SELECT * FROM l WHERE kept), w AS (SELECT g FROM l GROUP BY g HAVING bool_or(kept) AND bool_or(ok))
    SELECT round((SELECT count(*) FILTER (WHERE hit) / count(*) FROM p JOIN w USING (g)), 6) AS phase_recall, round((SELECT count(*) FILTER (WHERE ok) / count(*) FROM k JOIN w USING (g)), 6) AS keeper_precision,
    round((SELECT count(*) FROM k JOIN w USING (g)) / (SELECT count(*) FROM l JOIN w USING (g)), 6) AS retention""",
)
def ag13(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.xxhash64("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice").alias("m"), F.col("l_returnflag").alias("phase"), (F.col("l_tax") < 0.05).alias("ok"), (F.col("l_discount") < 0.06).alias("kept"))  # noqa: E741
    annotated = l.groupBy("g", "phase").agg(F.collect_list("m").alias("ms"), F.collect_list(F.when(F.col("ok"), F.col("m"))).alias("good"))
    annotated = annotated.groupBy("g").agg(F.flatten(F.collect_list("ms")).alias("members"), F.filter(F.collect_list("good"), lambda x: F.size(x) > 0).alias("phases")).where("size(phases) > 0")
    predicted = l.where("kept").groupBy("g").agg(F.collect_list("m").alias("keepers"))
    return E.phase_metrics(annotated, predicted, "g")


@query("ag11_risk_frontier", """WITH r AS (SELECT o_orderkey, o_orderstatus = 'F' AS bad, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER () AS n FROM orders)
    SELECT b AS budget, count(*) FILTER (WHERE k <= floor(n * b)) AS reviewed, round(count(*) FILTER (WHERE bad AND k <= floor(n * b)) / count(*) FILTER (WHERE bad), 6) AS recall FROM r CROSS JOIN (SELECT unnest([0.05, 0.1, 0.2, 0.5])::DOUBLE AS b) GROUP BY b""")
def ag11(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("bad"), "o_totalprice")
    ranked = R.dense_index(rows, [F.desc("o_totalprice"), F.col("o_orderkey")])
    n = rows.agg(F.count("*").alias("n"))
    budgets = F.explode(F.array(*(F.lit(b) for b in (0.05, 0.1, 0.2, 0.5)))).alias("budget")
    inside = F.col("position") < F.floor(F.col("n") * F.col("budget"))
    g = ranked.join(F.broadcast(n)).select("bad", "position", "n", budgets).groupBy("budget")
    return g.agg(F.count_if(inside).alias("reviewed"), F.round(F.count_if(inside & F.col("bad")) / F.count_if("bad"), 6).alias("recall"))


@query("ag15_stratum_bounds", "SELECT c_nationkey, count(*) AS n, round(least(1, count(*) FILTER (WHERE c_acctbal < 0) / count(*) + sqrt(ln(25 / 0.05) / (2 * count(*)))), 6) AS bound FROM customer GROUP BY c_nationkey")
def ag15(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("e"))
    bound = A.stratum_bound(F.col("e") / F.col("n"), F.col("n"), F.lit(1_000_000), F.lit(25))
    return g.select("c_nationkey", "n", F.round(bound, 6).alias("bound"))


@query("ag31_wilson_bounds", "SELECT source, round(least(1, (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)), 6) AS upper, round(1 - pow(0.05, 1 / n), 6) AS no_event FROM (SELECT source, count(*)::DOUBLE AS n, avg((quality = 0)::INTEGER) AS p, 1.6448536269514715 AS z FROM documents JOIN labels USING (doc_id) GROUP BY source)")
def ag31(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    g = j.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("e"))
    return g.select("source", F.round(A.wilson_upper(F.col("e"), F.col("n")), 6).alias("upper"), F.round(A.zero_event_bound(F.col("n")), 6).alias("no_event"))


@query("au1_stratified_sample")
def au1(spark: SparkSession, d: str) -> DataFrame:
    return A.stratified_sample(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 100, 7)


@query("au3_blinded_plan", "SELECT sha256('plan:7:' || doc_id) AS task_id, 'M' || row_number() OVER (PARTITION BY source ORDER BY sha256('plan:7:' || doc_id)) AS alias FROM documents")
def au3(spark: SparkSession, d: str) -> DataFrame:
    task = F.sha2(F.concat(F.lit("plan:7:"), F.col("doc_id").cast("string")), 256)
    docs = table(spark, d, "documents").select("source", task.alias("task_id"))
    return docs.select("task_id", F.concat(F.lit("M"), F.row_number().over(Window.partitionBy("source").orderBy("task_id"))).alias("alias"))


@query("au8_review_counts", "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS pending, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS accepted, count(*) FILTER (WHERE toxic = 1) AS issues FROM documents d LEFT JOIN labels l USING (doc_id)")
def au8(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.agg(F.count_if(F.col("quality").isNull()).alias("pending"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("accepted"), F.count_if(F.col("toxic") == 1).alias("issues"))


@query("ag1_guarded_stats", "SELECT event_type, sum((value > 50)::INTEGER)::BIGINT AS n_high, coalesce(sum(value) FILTER (WHERE value > 50) / nullif(count(*) FILTER (WHERE value > 50), 0), 0) AS mean_high FROM events GROUP BY event_type")
def ag1(spark: SparkSession, d: str) -> DataFrame:
    high = F.col("value") > 50
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(high).alias("n_high"), F.coalesce(F.try_divide(F.sum(F.when(high, F.col("value"))), F.count_if(high)), F.lit(0.0)).alias("mean_high"))


@query("ag2_independent_minima", "SELECT user_id, min(event_id) AS group_id, min(event_type) AS decision FROM events GROUP BY user_id")
def ag2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("group_id"), F.min("event_type").alias("decision"))


@query("ag3_inventory_rollup", "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang <> 'en') AS other, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def ag3(spark: SparkSession, d: str) -> DataFrame:
    en = F.col("lang") == "en"
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(en).alias("en"), F.count_if(~en).alias("other"), F.sum("n_chars").alias("bytes"))


_U = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


@query(
    "ag5_purity_to_keeper",
    f"""WITH i AS (SELECT user_id, id, ts, {_U} AS u, value FROM ({ITEMS_SQL})), k AS (SELECT user_id, arg_max(u, struct_pack(a := value, b := -id)) AS ku, max(ts) - min(ts) AS span FROM i GROUP BY user_id)
    SELECT user_id, any_value(span) AS span, round(min(list_sum(list_transform(range(1, 65), lambda j: u[j] * ku[j]))), 6) AS purity FROM i JOIN k USING (user_id) GROUP BY user_id""",
)
def ag5(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d).select("user_id", "id", "ts", C.unit(F.col("embedding")).alias("u"), "value")
    k = i.groupBy("user_id").agg(F.max_by("id", F.struct("value", -F.col("id"))).alias("k"), (F.max("ts") - F.min("ts")).alias("span"))
    k = k.join(i.select(F.col("id").alias("k"), F.col("u").alias("ku")), "k")
    return i.join(k, "user_id").groupBy("user_id").agg(F.first("span").alias("span"), F.round(F.min(C.dot(F.col("u"), F.col("ku"))), 6).alias("purity"))


@query("ag7_queue_tally", "SELECT CASE WHEN l.doc_id IS NULL THEN 'PENDING' WHEN quality = 0 THEN 'LATER' ELSE 'DONE' END AS queue, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def ag7(spark: SparkSession, d: str) -> DataFrame:
    state = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "LATER").otherwise("KEEP").alias("decision"))
    return R.queue_tally(table(spark, d, "documents").select("doc_id"), state, "doc_id", "decision")


@query("ag8_member_fingerprints", "SELECT o_custkey, substr(sha256(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)), 1, 16) AS mark FROM orders GROUP BY o_custkey")
def ag8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(C.fingerprint(F.collect_list("o_orderkey")).alias("mark"))


@query("dc14_stale_decisions", "SELECT o_custkey, 'MEMBERS_CHANGED' AS reason FROM orders GROUP BY o_custkey HAVING count(*) FILTER (WHERE o_totalprice > 400000) > 0")
def dc14(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    old = o.groupBy("o_custkey").agg(C.fingerprint(F.collect_list(F.when(F.col("o_totalprice") <= 400000, F.col("o_orderkey")))).alias("mark"))
    return R.stale(old, o, "o_custkey", "o_orderkey", "mark")


@query("ag16_json_stats", "SELECT k AS path, count(*) AS n, sum(v) AS total, min(v) AS low, max(v) AS high, avg(v) AS mean, median(v) AS median, round(stddev_pop(v), 6) AS spread FROM (SELECT unnest(json_keys(props)) AS k, json_extract(props, unnest(json_keys(props)))::DOUBLE AS v FROM events) GROUP BY k")
def ag16(spark: SparkSession, d: str) -> DataFrame:
    s = V.summaries(V.json_numbers(table(spark, d, "events"), "event_id", "props"), ["path"], "value")
    return s.withColumn("spread", F.round("spread", 6))


@query("ag17_quantiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, max(value) - min(value) AS span FROM events GROUP BY event_type")
def ag17(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("p50"), F.round(F.percentile("value", 0.95), 4).alias("p95"), (F.max("value") - F.min("value")).alias("span"))


@query("ag18_top_categories", "SELECT source, lang, n, place FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS place FROM documents GROUP BY source, lang) WHERE place <= 2")
def ag18(spark: SparkSession, d: str) -> DataFrame:
    return V.top_categories(table(spark, d, "documents"), "source", "lang", 2)


@query("ag20_context_sizes", "SELECT source, sum(ceil(strlen(text) / 3))::BIGINT AS tokens, max(n_chars) AS largest, bool_and(n_chars < 20000) AS fits FROM documents GROUP BY source")
def ag20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum(C.token_estimate(F.col("text"))).cast("long").alias("tokens"), F.max("n_chars").alias("largest"), F.bool_and(F.col("n_chars") < 20000).alias("fits"))


@query("ag22_throughput_eta", "SELECT user_id, count(*) / ((max(t) - min(t)) / 3600.0) AS per_hour, (1000 - count(*)) / (count(*) / ((max(t) - min(t)) / 3600.0)) AS hours_left FROM (SELECT user_id, epoch_us(ts) // 1000000 AS t FROM events) GROUP BY user_id HAVING max(t) > min(t)")
def ag22(spark: SparkSession, d: str) -> DataFrame:
    t = C.seconds(F.col("ts"))
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.max(t) - F.min(t)).alias("s")).where("s > 0")
    rate = F.col("n") / (F.col("s") / 3600)
    return g.select("user_id", rate.alias("per_hour"), ((1000 - F.col("n")) / rate).alias("hours_left"))


@query(
    "ag24_mean_vectors",
    "WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i) SELECT label, round(sqrt(sum(x * x)), 6) AS norm, round(sum(CASE WHEN i = 1 THEN x END) / sqrt(sum(x * x)), 6) AS first FROM m GROUP BY label",
)
def ag24(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    flat = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"))
    return V.mean_vector(e, "label", "embedding").join(flat, "label").select("label", "norm", F.round(F.col("centre")[0], 6).alias("first"))


@query("ag25_cost_ledger", "SELECT l_returnflag, l_linestatus, sum(l_quantity * 3 + l_extendedprice * 0.015) AS cost, count(*) AS calls FROM lineitem GROUP BY 1, 2")
def ag25(spark: SparkSession, d: str) -> DataFrame:
    cost = F.col("l_quantity") * 3 + F.col("l_extendedprice") * 0.015
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(cost).alias("cost"), F.count("*").alias("calls"))


@query("ag26_pair_quantiles", "SELECT l_returnflag = 'R' AS same, quantile_cont(l_discount, 0.1) AS q10, quantile_cont(l_discount, 0.5) AS q50, quantile_cont(l_discount, 0.9) AS q90 FROM lineitem GROUP BY 1")
def ag26(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("l_discount", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    g = table(spark, d, "lineitem").groupBy((F.col("l_returnflag") == "R").alias("same")).agg(q.alias("q"))
    return g.select("same", F.col("q")[0].alias("q10"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q90"))


@query("ag28_leave_one_out", "SELECT f.event_type AS fold, count(*) AS n, avg(e.value) AS mean FROM (SELECT DISTINCT event_type FROM events) f JOIN events e ON e.event_type <> f.event_type GROUP BY f.event_type")
def ag28(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("fold")).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    whole = g.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    return g.join(F.broadcast(whole)).select("fold", (F.col("all_n") - F.col("n")).alias("n"), ((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))).alias("mean"))


@query("ms26_capped_export", "SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 20000")
def ms26(spark: SparkSession, d: str) -> DataFrame:
    return V.packed_within(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 20_000).select("source", "doc_id", "used")


@query("ms14_mixed_identities", "SELECT source, CASE WHEN count(DISTINCT lang) > 1 THEN 'REJECTED_MIXED' WHEN count(lang) = 0 THEN 'REJECTED_MISSING' ELSE 'OK' END AS status FROM documents GROUP BY source")
def ms14(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("source").agg(F.min("lang").alias("a"), F.max("lang").alias("b"))
    return g.select("source", F.when(F.col("a").isNull(), "REJECTED_MISSING").when(F.col("a") != F.col("b"), "REJECTED_MIXED").otherwise("OK").alias("status"))


@query("ms33_run_identity", "SELECT doc_id, sha256(source || '|' || lang || '|' || n_chars::VARCHAR) AS run_key FROM documents")
def ms33(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(F.concat_ws("|", "source", "lang", F.col("n_chars").cast("string")), 256).alias("run_key"))
