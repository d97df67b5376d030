"""Further queries: evidence, coverage, ledgers, folds and guards over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import decision as D
from ..operators import evaluate as E
from ..operators import evidence as V
from ..operators import selection as S
from ..session import table
from ..streaming import journal as S_J
from .common import items
from .registry import query

_PRIORITY = "CASE group_type WHEN 'sha_exact' THEN 4 WHEN 'phash_near' THEN 3 WHEN 'burst' THEN 2 ELSE 1 END"
_KIND = "['similar_scene', 'burst', 'phash_near', 'sha_exact'][1 + event_id % 4]"


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("similar_scene", "burst", "phash_near", "sha_exact"))), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", "user_id", "value", kind.alias("group_type"))


@query("ag6_component_label", f"SELECT user_id, arg_max(group_type, {_PRIORITY}) AS label FROM (SELECT user_id, {_KIND} AS group_type FROM events WHERE value > 80) GROUP BY user_id")
def ag6(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("group_type") == "sha_exact", 4).when(F.col("group_type") == "phash_near", 3).when(F.col("group_type") == "burst", 2).otherwise(1)
    return _kinds(spark, d).where("value > 80").groupBy("user_id").agg(F.max_by("group_type", rank).alias("label"))


@query("ag9_phase_variation", "SELECT l_orderkey, l_returnflag, min(l_tax) AS least, count(DISTINCT l_linestatus) AS states, max(l_quantity) - min(l_quantity) AS span FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 3")
def ag9(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag")
    out = g.agg(F.min("l_tax").alias("least"), F.count_distinct("l_linestatus").alias("states"), (F.max("l_quantity") - F.min("l_quantity")).alias("span"), F.count("*").alias("n"))
    return out.where("n >= 3").drop("n")


@query(
    "ag10_margins",
    "SELECT user_id, round(max(v) - max(v) FILTER (WHERE r = 2), 6) AS margin FROM (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) GROUP BY user_id",
)
def ag10(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    top = table(spark, d, "events").select("user_id", "value", F.row_number().over(w).alias("r")).where("r <= 2")
    second = F.max(F.when(F.col("r") == 2, F.col("value")))
    return top.groupBy("user_id").agg(F.round(F.max("value") - second, 6).alias("margin"))


@query("ag14_deltas", "SELECT source, round(avg(quality) FILTER (WHERE toxic = 0) - avg(quality) FILTER (WHERE toxic = 1), 6) AS delta FROM documents JOIN labels USING (doc_id) GROUP BY source")
def ag14(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    p = j.groupBy("source").pivot("toxic", [0, 1]).agg(F.avg("quality"))
    return p.select("source", F.round(F.col("0") - F.col("1"), 6).alias("delta"))


_B = "SELECT event_id, user_id, value % 50 AS x0, value % 30 AS y0, 20 AS w, 20 AS h FROM events"


@query("ag19_box_summaries", f"SELECT user_id, count(*) AS boxes, count(*) FILTER (WHERE x0 < 1 OR y0 < 1) AS touching, round(sum(w * h) / 3500.0, 6) AS covered FROM ({_B}) GROUP BY user_id")
def ag19(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("value") % 50, F.col("value") % 30
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("boxes"), F.count_if((x < 1) | (y < 1)).alias("touching"), F.round(F.count("*") * 400 / 3500.0, 6).alias("covered"))


@query("ag21_telemetry", "SELECT event_type, count(*) AS n, sum(value) AS seconds, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, sum(value) / (SELECT sum(value) FROM events) AS share FROM events GROUP BY event_type")
def ag21(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    p = lambda q: F.round(F.percentile("value", q), 4)
    g = e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("seconds"), p(0.5).alias("p50"), p(0.95).alias("p95"))
    return g.join(F.broadcast(e.agg(F.sum("value").alias("w")))).withColumn("share", F.col("seconds") / F.col("w")).drop("w")


@query("ag23_delete_manifest", "SELECT count(DISTINCT sha256(text)) AS contents, count(*) AS paths, sum(n_chars)::BIGINT AS bytes FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(*) > 1)")
def ag23(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.sha2("text", 256).alias("sha"), "n_chars")
    g = docs.groupBy("sha").agg(F.count("*").alias("n"), F.sum("n_chars").alias("b")).where("n > 1")
    return g.agg(F.count("*").alias("contents"), F.coalesce(F.sum("n"), F.lit(0)).alias("paths"), F.sum("b").alias("bytes"))


@query("ag27_ab_counters", "SELECT count(*) FILTER (WHERE a) AS kept_a, count(*) FILTER (WHERE b) AS kept_b, count(*) FILTER (WHERE a AND b) AS kept_both, count(*) FILTER (WHERE a <> b) AS differ FROM (SELECT l_tax < 0.04 AS a, l_discount < 0.05 AS b FROM lineitem)")
def ag27(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_tax") < 0.04, F.col("l_discount") < 0.05
    return table(spark, d, "lineitem").agg(F.count_if(a).alias("kept_a"), F.count_if(b).alias("kept_b"), F.count_if(a & b).alias("kept_both"), F.count_if(a != b).alias("differ"))


@query("ag29_regimes", "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS regime, count(*) AS n, round(avg(quality), 6) AS good FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def ag29(spark: SparkSession, d: str) -> DataFrame:
    regime = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long")
    j = table(spark, d, "documents").select("doc_id", regime.alias("regime")).join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("regime").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("good"))


@query("ag30_faithfulness", "SELECT round(avg((len(list_filter(c, lambda x: x > 5)) = 0)::INTEGER), 6) AS ratio FROM (SELECT list(l_linenumber) AS c FROM lineitem GROUP BY l_orderkey)")
def ag30(spark: SparkSession, d: str) -> DataFrame:
    known = F.array(*(F.lit(i) for i in range(0, 6)))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("c"))
    return g.agg(F.round(F.avg(E.faithful(F.col("c"), known).cast("int")), 6).alias("ratio"))


@query("jn2_left_chain", "SELECT d.doc_id, l.quality, e.label FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def jn2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").join(e, "doc_id", "left")


@query("jn21_total_join", "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, count(*) FILTER (WHERE e.vec_id IS NULL) AS extra FROM embeddings e FULL JOIN labels l ON l.doc_id = e.vec_id")
def jn21(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("a"))
    j = e.join(table(spark, d, "labels").select("doc_id", F.lit(1).alias("b")), "doc_id", "full_outer")
    return j.agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("extra"))


@query("jn22_version_join", "SELECT a.o_custkey, a.n AS n_v2, b.n AS n_v3 FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b USING (o_custkey)")
def jn22(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    a = o.groupBy("o_custkey").agg(F.count("*").alias("n_v2"), F.count_if(F.col("o_orderstatus") == "F").alias("n"))
    return a.select("o_custkey", "n_v2", F.when(F.col("n") > 0, F.col("n")).alias("n_v3"))


@query("st1_added_removed", "SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS added, count(*) FILTER (WHERE role = 'system') AS removed, bool_or(role = 'user') AND bool_or(role = 'system') AS replaced FROM conversations GROUP BY conv_id")
def st1(spark: SparkSession, d: str) -> DataFrame:
    u, s = F.col("role") == "user", F.col("role") == "system"
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(u).alias("added"), F.count_if(s).alias("removed"), (F.bool_or(u) & F.bool_or(s)).alias("replaced"))


@query("st6_identical_sets", "SELECT sha256(text) AS sha, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def st6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")


@query("tk6_risk_queue", "SELECT event_id, greatest(0, 1 - abs(value / 100), (value % 7) / 7) AS risk FROM events ORDER BY risk DESC, event_id LIMIT 50")
def tk6(spark: SparkSession, d: str) -> DataFrame:
    risk = F.greatest(F.lit(0.0), 1 - F.abs(F.col("value") / 100), F.col("value") % 7 / 7)
    return table(spark, d, "events").select("event_id", risk.alias("risk")).orderBy(F.desc("risk"), "event_id").limit(50)


@query("tk11_worst_regions", "SELECT l_orderkey, l_linenumber, r FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, l_partkey, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def tk11(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_quantity", "l_extendedprice", "l_partkey", "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("r")).where("r <= 2")


@query("tk13_gated_plan", "SELECT s_nationkey, s_suppkey, r FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier WHERE s_acctbal > 1000) WHERE r <= 3")
def tk13(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, d, "supplier").where("s_acctbal > 1000").select("s_nationkey", "s_suppkey", F.row_number().over(w).alias("r")).where("r <= 3")


@query("dc4_coverage_gaps", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS phases, count(DISTINCT l_returnflag) FILTER (WHERE l_tax < 0.04) AS covered, count(DISTINCT l_returnflag) > 2 AS over_budget FROM lineitem GROUP BY l_orderkey")
def dc4(spark: SparkSession, d: str) -> DataFrame:
    kept = F.when(F.col("l_tax") < 0.04, F.col("l_returnflag"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("phases"), F.count_distinct(kept).alias("covered"))
    return g.withColumn("over_budget", F.col("phases") > 2)


_PURPOSES = ("train", "threshold_search", "prompt_selection", "preset_selection", "final_evaluation", "browse")


@query(
    "dc12_authorization",
    f"""WITH a AS (SELECT doc_id, ['train', 'tune', 'held_out'][1 + doc_id % 3] AS split, ({list(_PURPOSES)})[1 + doc_id // 3 % 6] AS purpose, doc_id // 18 % 2 = 0 AS labels FROM documents),
    v AS (SELECT *, CASE WHEN purpose = 'browse' THEN 'UNKNOWN_PURPOSE' WHEN split = 'held_out' AND purpose <> 'final_evaluation' THEN 'HELD_OUT_IS_REPORT_ONLY' WHEN labels AND purpose <> 'final_evaluation' THEN 'LABELS_NEED_FINAL_EVALUATION'
      WHEN purpose = 'final_evaluation' AND split <> 'held_out' THEN 'FINAL_EVALUATION_NEEDS_HELD_OUT' ELSE 'AUTHORIZED' END AS verdict FROM a)
    SELECT doc_id, verdict, verdict = 'AUTHORIZED' AND labels AS labels_authorized, verdict = 'AUTHORIZED' AND split = 'held_out' AS report_only FROM v""",
)
def dc12(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    nth = lambda at, *x: F.element_at(F.array(*map(F.lit, x)), (at % len(x) + 1).cast("int"))
    use = D.authorize(nth(i, "train", "tune", "held_out"), nth(F.floor(i / 3), *_PURPOSES), F.floor(i / 18) % 2 == 0)
    return table(spark, d, "documents").select("doc_id", use.alias("use")).select("doc_id", "use.*")


@query("dc13_valid_actions", "SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'BAD_ACTION' WHEN value < 0 THEN 'BAD_VALUE' WHEN user_id NOT IN (SELECT c_custkey FROM customer) THEN 'OUT_OF_SCOPE' ELSE 'OK' END AS verdict FROM events")
def dc13(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value").join(c, "user_id", "left")
    verdict = F.when(~F.col("event_type").isin("click", "view", "purchase"), "BAD_ACTION").when(F.col("value") < 0, "BAD_VALUE").when(F.col("known").isNull(), "OUT_OF_SCOPE").otherwise("OK")
    return e.select("event_id", verdict.alias("verdict"))


@query("dc15_rival_margins", "SELECT user_id, arg_max(event_id, struct_pack(v := value, i := -event_id)) AS best, round(max(value) - median(value), 6) AS margin, CASE WHEN count(*) < 2 THEN 'ABSTAIN' WHEN max(value) - median(value) < 8 THEN 'CLOSE' ELSE 'CLEAR' END AS verdict FROM events GROUP BY user_id")
def dc15(spark: SparkSession, d: str) -> DataFrame:
    margin = F.max("value") - F.median("value")
    verdict = F.when(F.count("*") < 2, "ABSTAIN").when(margin < 8, "CLOSE").otherwise("CLEAR")
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.round(margin, 6).alias("margin"), verdict.alias("verdict"))


@query("au2_replay_diff", "SELECT doc_id, 'ONLY_PLAN' AS fault FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT DISTINCT doc_id, 'ONLY_REPLAY' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def au2(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "documents").select("doc_id", F.lit(1).alias("p"))
    made = table(spark, d, "labels").where("doc_id IS NOT NULL").select("doc_id", F.lit(1).alias("m")).distinct()
    j = plan.join(made, "doc_id", "full_outer").where("p IS NULL OR m IS NULL")
    return j.select("doc_id", F.when(F.col("m").isNull(), "ONLY_PLAN").otherwise("ONLY_REPLAY").alias("fault"))


@query("au7_budget_checks", "SELECT source, sum(n_chars)::BIGINT AS bytes, sum(n_chars) <= 100000 AS fits FROM documents GROUP BY source")
def au7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.sum("n_chars").alias("bytes")).withColumn("fits", F.col("bytes") <= 100_000)


@query("au9_evidence_layers", "SELECT event_id, k AS path, v AS value, rank() OVER (PARTITION BY k ORDER BY v DESC) AS place FROM (SELECT event_id, unnest(json_keys(props)) AS k, json_extract(props, unnest(json_keys(props)))::DOUBLE AS v FROM events)")
def au9(spark: SparkSession, d: str) -> DataFrame:
    flat = V.json_numbers(table(spark, d, "events"), "event_id", "props")
    return flat.withColumn("place", F.rank().over(Window.partitionBy("path").orderBy(F.desc("value"))))


@query("ms1_root_relations", "SELECT page_id, CASE WHEN h = r THEN 'same' WHEN starts_with(r, h || '/') THEN 'child' WHEN starts_with(h, r || '/') THEN 'parent' ELSE 'disjoint' END AS relation FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS h, 'www.example.com' AS r FROM pages)")
def ms1(spark: SparkSession, d: str) -> DataFrame:
    host = F.regexp_extract("url", r"://([^/?#]*)", 1)
    return table(spark, d, "pages").select("page_id", C.relation(host, F.lit("www.example.com")).alias("relation"))


@query("ms2_mark_seen", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'run-2' ELSE 'run-1' END AS last_run_id FROM documents d LEFT JOIN labels l USING (doc_id)")
def ms2(spark: SparkSession, d: str) -> DataFrame:
    seen = table(spark, d, "labels").select("doc_id", F.lit("run-2").alias("now"))
    return table(spark, d, "documents").select("doc_id").join(seen, "doc_id", "left").select("doc_id", F.coalesce("now", F.lit("run-1")).alias("last_run_id"))


@query("ms10_representation", "SELECT doc_id, CASE WHEN strlen(text) > 4096 OR len(string_split(text, ' ')) > 600 THEN 'summary' ELSE 'exact' END AS form FROM documents")
def ms10(spark: SparkSession, d: str) -> DataFrame:
    large = (F.octet_length("text") > 4096) | (F.size(F.split("text", " ")) > 600)
    return table(spark, d, "documents").select("doc_id", F.when(large, "summary").otherwise("exact").alias("form"))


@query("ms12_fresh_sidecars", "SELECT a.doc_id FROM documents a JOIN (SELECT doc_id, sha256(text) AS k FROM documents WHERE doc_id % 3 = 0) b ON a.doc_id = b.doc_id AND sha256(a.text) = b.k")
def ms12(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("k"))
    return docs.join(docs.where("doc_id % 3 = 0"), ["doc_id", "k"], "left_semi").select("doc_id")


@query("ms17_consistent_boxes", f"SELECT a.event_id AS a, b.event_id AS b FROM ({_B}) a JOIN ({_B}) b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE sqrt((a.x0 - b.x0) ** 2 + (a.y0 - b.y0) ** 2) <= 0.35 * 20")
def ms17(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.joins import member_pairs

    b = table(spark, d, "events").select("user_id", "event_id", (F.col("value") % 50).alias("x"), (F.col("value") % 30).alias("y"))
    p = member_pairs(b, "user_id", "event_id", ["x", "y"])
    near = F.sqrt(F.pow(F.col("x_x") - F.col("y_x"), F.lit(2)) + F.pow(F.col("x_y") - F.col("y_y"), F.lit(2))) <= 0.35 * 20
    return p.where(near).select(F.col("x_event_id").alias("a"), F.col("y_event_id").alias("b"))


@query("ms29_phase_shares", "SELECT user_id, event_type, round(100 * sum(value) / sum(sum(value)) OVER (PARTITION BY user_id), 4) AS percent FROM events GROUP BY user_id, event_type")
def ms29(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("s"))
    return g.select("user_id", "event_type", F.round(100 * F.col("s") / F.sum("s").over(Window.partitionBy("user_id")), 4).alias("percent"))


@query("ms35_bounded_numbers", "SELECT event_id, least(1, greatest(0, value / 90)) AS bounded FROM events WHERE isfinite(value)")
def ms35(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(C.finite(F.col("value"))).select("event_id", C.clip(F.col("value") / 90).alias("bounded"))


_J = "SELECT conv_id, turn, role FROM conversations"


@query("str3_idempotent_journal", f"SELECT conv_id, turn, CASE WHEN turn = f THEN 'accepted' WHEN role = first_role THEN 'repeat' ELSE 'conflict' END AS status FROM ({_J}) JOIN (SELECT conv_id, min(turn) AS f, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id) USING (conv_id)")
def str3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return S_J.dedupe_batch(e, "conv_id", "turn", ["role"]).select("conv_id", "turn", "status")


@query("str4_latest_fold", "SELECT conv_id, turn FROM (SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role FROM conversations GROUP BY conv_id) WHERE role = 'assistant'")
def str4(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return S_J.latest_fold(e, "conv_id", "turn", "role", "assistant").select("conv_id", "turn")


@query(
    "str_session_bursts",
    """WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), s AS (SELECT *, CASE WHEN t - lag(t) OVER w < 1800000000 THEN 0 ELSE 1 END AS st FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, min(t) // 1000000 AS first_t, max(t) // 1000000 AS last_t, count(*) AS n FROM i GROUP BY user_id, g""",
)
def str_bursts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    b = S_J.bursts(e, "ts", "user_id", "30 minutes")
    return b.select("user_id", F.unix_seconds("first").alias("first_t"), F.unix_seconds("last").alias("last_t"), "n")


@query("str5_undo_history")
def str5(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("v"))
    return S_J.undo_history(e, "user_id", "event_id", "v")


@query("gr11_protected_variants")
def gr11(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select("user_id", "event_id", "value", (F.col("value") > 90).alias("kept"), F.array(F.col("value") % 50, F.col("value") % 30).alias("place"))
    return S.protect_variants(m, "user_id", "event_id", "value", "kept", "place", 15.0)


@query("gr12_dominance_penalty")
def gr12(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d)
    v = F.col("value")
    box = F.array(v % 50 / 100, v % 30 / 100, v % 50 / 100 + 0.4, v % 30 / 100 + 0.4)
    kinds = F.explode(F.array(F.lit("subject"), F.lit("face"))).alias("kind")
    regions = i.select("user_id", "id", kinds, F.lit(0).alias("class_id"), box.alias("box"), "embedding", "value", "ts")
    vector = F.transform("embedding", lambda x: x / F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, y: s + y * y)))
    regions = regions.select("user_id", "id", "kind", "class_id", "box", vector.alias("vector"), F.col("value").alias("musiq"), (F.col("ts") % 100 / 100).alias("clipiqa"))
    return S.dominance_penalty(i.select("user_id", "id", (v / 100).alias("score")), regions, "user_id", "id", "score", least=0.1)
