"""Windows, rankings, limits and groups over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import decision as D
from ..operators import grouping as G
from ..operators import selection as S
from ..session import table
from .common import ITEMS_SQL, items
from .registry import query

_EV = "SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS t FROM events"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", C.seconds(F.col("ts")).alias("t"))


@query("wn1_row_numbers", "SELECT page_id, row_number() OVER (PARTITION BY length(url) ORDER BY url, page_id) - 1 AS position FROM pages")
def wn1(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy(F.length("url")).orderBy("url", "page_id")
    return table(spark, d, "pages").select("page_id", (F.row_number().over(w) - 1).cast("long").alias("position"))


@query(
    "wn2_adjacent_evidence",
    f"SELECT user_id, event_id, lag(event_id) OVER w AS before, t - lag(t) OVER w AS gap, round(abs(value - lag(value) OVER w), 6) AS delta FROM ({_EV}) WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id) QUALIFY before IS NOT NULL",
)
def wn2(spark: SparkSession, d: str) -> DataFrame:
    values = {"gap": F.col("t") - F.col("prev_t"), "delta": F.round(F.abs(F.col("value") - F.col("prev_value")), 6)}
    return G.adjacent(_events(spark, d).drop("event_type"), "user_id", [F.col("t"), F.col("event_id")], "event_id", values)


@query(
    "wn3_median_outliers",
    "SELECT event_id FROM (SELECT *, median(value) OVER (PARTITION BY user_id) AS m FROM events) WHERE value < 20 AND value < m - 10",
)
def wn3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    usual = e.groupBy("user_id").agg(F.median("value").alias("m"))
    return e.join(usual, "user_id").where("value < 20 AND value < m - 10").select("event_id")


@query(
    "wn5_budget_rank",
    """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS risk_rank, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderkey, risk_rank, risk_rank <= floor(n * 0.1) OR o_orderstatus = 'P' AS selected FROM r""",
)
def wn5(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.audit import within_budget

    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    r = within_budget(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 0.1, F.col("o_orderstatus") == "P", ["o_orderpriority"])
    return r.select("o_orderkey", "risk_rank", "selected")


@query(
    "wn6_deciles",
    "SELECT c_custkey, least(10, 1 + ((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1) * 10) // count(*) OVER (PARTITION BY c_nationkey))::INTEGER AS decile FROM customer",
)
def wn6(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.audit import deciles

    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return deciles(c, [F.desc("c_acctbal"), F.col("c_custkey")], ["c_nationkey"]).select("c_custkey", "decile")


@query(
    "wn7_competition_rank",
    """SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS place, round(max(value) OVER (PARTITION BY user_id) - value, 6) AS to_best,
    round(value - median(value) OVER (PARTITION BY user_id), 6) AS to_median FROM events""",
)
def wn7(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "value")
    stats = e.groupBy("user_id").agg(F.max("value").alias("best"), F.median("value").alias("mid"))
    ranked = e.withColumn("place", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value")))).join(stats, "user_id")
    return ranked.select("event_id", "place", F.round(F.col("best") - F.col("value"), 6).alias("to_best"), F.round(F.col("value") - F.col("mid"), 6).alias("to_median"))


@query(
    "wn8_next_in_queue",
    "SELECT l.doc_id, coalesce(min(q.doc_id) FILTER (WHERE q.doc_id > l.doc_id), max(q.doc_id)) AS next_id, count(*) FILTER (WHERE q.doc_id < l.doc_id) AS place FROM labels l CROSS JOIN (SELECT doc_id FROM labels WHERE quality = 0) q WHERE l.toxic = 1 GROUP BY l.doc_id",
)
def wn8(spark: SparkSession, d: str) -> DataFrame:
    every = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("asks"), (F.col("quality") == 0).alias("queued"))
    return S.next_in_queue(every, "doc_id", "asks", "queued")


_ISLANDS = f"""WITH e AS ({_EV}), s AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1800 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS st FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    i AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s)"""


@query("wn9_gap_islands", f"{_ISLANDS} SELECT user_id, island::BIGINT AS island, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM i GROUP BY user_id, island HAVING count(*) BETWEEN 2 AND 20")
def wn9(spark: SparkSession, d: str) -> DataFrame:
    i = G.islands(_events(spark, d), ["t", "event_id"], "t", 1800, ["user_id"])
    return i.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).where("n BETWEEN 2 AND 20")


@query("wn10_closed_islands", f"{_ISLANDS} SELECT event_id FROM i QUALIFY island < max(island) OVER (PARTITION BY user_id)")
def wn10(spark: SparkSession, d: str) -> DataFrame:
    i = G.islands(_events(spark, d), ["t", "event_id"], "t", 1800, ["user_id"])
    tail = i.groupBy("user_id").agg(F.max("island").alias("tail"))
    return i.join(tail, "user_id").where("island < tail").select("event_id")


@query(
    "wn9_global_islands",
    """WITH e AS (SELECT event_id, epoch_us(ts) // 1000000 AS t FROM events), s AS (SELECT *, CASE WHEN t - lag(t) OVER (ORDER BY t, event_id) > 300 OR lag(t) OVER (ORDER BY t, event_id) IS NULL THEN 1 ELSE 0 END AS st FROM e),
    i AS (SELECT *, sum(st) OVER (ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS island FROM s) SELECT event_id, t, min(t) OVER (PARTITION BY island) AS first_ts, max(t) OVER (PARTITION BY island) AS last_ts FROM i""",
)
def wn9g(spark: SparkSession, d: str) -> DataFrame:
    return G.ranged_islands(_events(spark, d).select("event_id", "t"), "event_id", "t", 300)


@query(
    "wn11_round_robin",
    """SELECT p_partkey, p_brand, turn FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS turn FROM part) ORDER BY turn, p_brand LIMIT 24""",
)
def wn11(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").select("p_partkey", "p_brand", F.row_number().over(w).alias("turn")).orderBy("turn", "p_brand").limit(24)


@query("tk1_page", "SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position FROM documents) WHERE position BETWEEN 100 AND 149")
def tk1(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.review import dense_index, page

    return page(dense_index(table(spark, d, "documents").select("doc_id", "n_chars"), [F.desc("n_chars"), F.col("doc_id")]), 2, 50).select("doc_id", "position")


@query("tk2_keeper_argmax", "SELECT l_orderkey, arg_max(l_linenumber, struct_pack(a := l_quantity, b := l_extendedprice, c := -l_linenumber)) AS keep_id FROM lineitem GROUP BY l_orderkey")
def tk2(spark: SparkSession, d: str) -> DataFrame:
    return S.keeper(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("tk5_keeper_budget", "SELECT user_id, greatest(1, least(3, 1 + floor(log2(count(*)))::INTEGER, count(*)::INTEGER - 1)) AS budget FROM events GROUP BY user_id")
def tk5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(C.keeper_budget(F.count("*")).alias("budget"))


@query("tk7_first_failures", "SELECT event_id, event_type FROM events WHERE value < 1 ORDER BY value, event_id LIMIT 20")
def tk7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("value < 1").orderBy("value", "event_id").select("event_id", "event_type").limit(20)


@query("tk8_top3_by_priority", "SELECT user_id, event_id, r FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def tk8(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("r")).where("r <= 3")


@query(
    "tk10_nearest_and_extreme",
    "SELECT user_id, arg_min(event_id, struct_pack(a := abs(value - 50), b := event_id)) AS nearest, arg_max(event_id, struct_pack(a := abs(value - 50), b := -event_id)) AS farthest FROM events GROUP BY user_id HAVING count(*) > 6",
)
def tk10(spark: SparkSession, d: str) -> DataFrame:
    off = F.abs(F.col("value") - 50)
    g = table(spark, d, "events").groupBy("user_id")
    out = g.agg(F.min_by("event_id", F.struct(off, "event_id")).alias("nearest"), F.max_by("event_id", F.struct(off, -F.col("event_id"))).alias("farthest"), F.count("*").alias("n"))
    return out.where("n > 6").drop("n")


@query(
    "tk12_bounded_selection",
    "SELECT doc_id, CASE WHEN quality = 0 THEN 'LOW_QUALITY' WHEN sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY toxic ORDER BY doc_id) <= 30 THEN 'SELECTED' ELSE 'LIMIT' END AS state FROM labels",
)
def tk12(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("toxic").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((F.col("quality") == 1).cast("int")).over(w)
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 0, "LOW_QUALITY").when(n <= 30, "SELECTED").otherwise("LIMIT").alias("state"))


@query("tk3_mmr_keepers")
def tk3(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d).select(F.col("user_id"), "id", F.col("value").alias("score"), "size", "embedding")
    return S.mmr_keepers(i, "user_id", "id", "score", "size", "embedding")


@query("gr3_greedy_span_groups")
def gr3(spark: SparkSession, d: str) -> DataFrame:
    return G.greedy_groups(items(spark, d), "id", "ts", "embedding", 6 * 3600, 0.2)


@query("gr3_layered_groups")
def gr3_layers(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d).withColumn("h", C.sign_bits(F.col("embedding")))
    return G.layered_groups(i, "id", "ts", "sha", "h", "embedding", window=6 * 3600, least=0.25, loose=(24 * 3600, 0.35))


@query("gr6_leader_clusters")
def gr6(spark: SparkSession, d: str) -> DataFrame:
    i = items(spark, d).select(F.col("label").cast("long").alias("label"), "id", "value", "embedding")
    return G.leader_clusters(i, "label", "id", "value", "embedding", 0.25)


@query("gr8_packed_batches")
def gr8(spark: SparkSession, d: str) -> DataFrame:
    return G.pack_batches(table(spark, d, "documents").withColumn("block", F.floor(F.col("doc_id") / 10_000)), "block", "doc_id", "n_chars", 32, 40_000)


@query("gr7_verified_tracks")
def gr7(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).alias("frame"), (F.col("event_id") % 3).alias("object"), "value")
    pairs = e.alias("a").join(e.alias("b"), (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.frame") < F.col("b.frame")) & (F.abs(F.col("a.value") - F.col("b.value")) < 0.2))
    links = pairs.select(F.col("a.user_id").alias("group_id"), F.col("a.frame").alias("frame_a"), F.col("a.object").alias("object_a"), F.col("b.frame").alias("frame_b"), F.col("b.object").alias("object_b"))
    return G.verified_tracks(links)


@query(
    "gr4_displacement_guard",
    """WITH p AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t, CASE WHEN event_id % 9 <> 0 THEN value % 50 / 50 END AS x, CASE WHEN event_id % 9 <> 0 THEN value % 30 / 30 END AS y FROM events),
    n AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(event_id) OVER w AS before FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
    SELECT event_id, coalesce(CASE WHEN x IS NOT NULL AND px IS NOT NULL THEN greatest(abs(x - px), abs(y - py)) > 0.30 END, false) AS blocked FROM n WHERE before IS NOT NULL""",
)
def gr4(spark: SparkSession, d: str) -> DataFrame:
    seen = lambda x: F.when(F.col("event_id") % 9 != 0, x)
    p = _events(spark, d).select("event_id", "user_id", "t", F.array(seen(F.col("value") % 50 / 50), seen(F.col("value") % 30 / 30)).alias("c"))
    moved = D.displaced(F.col("c"), F.col("prev_c"), 0.30)
    return G.adjacent(p, "user_id", [F.col("t"), F.col("event_id")], "event_id", {"blocked": moved}).select("event_id", "blocked")
