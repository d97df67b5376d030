"""Scopes, filters and joins over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import joins as J
from ..operators.review import dense_index
from ..session import table
from .common import HASHED_SQL, ITEMS_SQL, PAGES_SQL, hashed, items, pages
from .registry import query

ROOT = "blog.tionsh.example.com/en"
_IN = f"(coalesce(path_key, '') = '{ROOT}' OR starts_with(coalesce(path_key, ''), '{ROOT}/'))"


@query("flt1_scope_rows", f"SELECT page_id, path_key FROM ({PAGES_SQL}) WHERE {_IN}")
def flt1(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).where(C.in_scope(F.col("path_key"), ROOT))


@query("flt8_scope_summary", f"SELECT count(*) FILTER (WHERE {_IN}) AS inside, count(*) AS total, count(*) FILTER (WHERE NOT {_IN}) AS outside FROM ({PAGES_SQL})")
def flt8(spark: SparkSession, d: str) -> DataFrame:
    inside = C.in_scope(F.col("path_key"), ROOT)
    return pages(spark, d).agg(F.count_if(inside).alias("inside"), F.count("*").alias("total"), F.count_if(~inside).alias("outside"))


@query("flt7_out_of_scope_examples", f"SELECT page_id, path_key FROM ({PAGES_SQL}) WHERE NOT {_IN} ORDER BY path_key, page_id LIMIT 20")
def flt7(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).where(~C.in_scope(F.col("path_key"), ROOT)).orderBy("path_key", "page_id").limit(20)


@query("flt2_conditional_counts", "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_high, count(*) FILTER (WHERE user_id IS NULL) AS n_nameless FROM events GROUP BY event_type")
def flt2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_high"), F.count_if(F.col("user_id").isNull()).alias("n_nameless"))


@query("flt3_still_count", "SELECT count(*) AS n FROM documents WHERE lang IN ('de', 'fr')")
def flt3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("lang").isin("de", "fr")).agg(F.count("*").alias("n"))


@query(
    "flt4_pending_work",
    """SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id
    WHERE l.doc_id IS NULL OR coalesce(l.quality, -1) NOT IN (0, 1) OR (l.quality = 1 AND e.label IS DISTINCT FROM 3)""",
)
def flt4(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "labels").select("doc_id", "quality")
    made = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    joined = table(spark, d, "documents").select("doc_id").join(done, "doc_id", "left").join(made, "doc_id", "left")
    pending = F.col("quality").isNull() | ~F.col("quality").isin(0, 1) | ((F.col("quality") == 1) & ~F.col("label").eqNullSafe(F.lit(3)))
    return joined.where(pending).select("doc_id")


@query(
    "flt5_admission",
    """WITH s AS (SELECT p_partkey, p_size * 100 AS w, p_retailprice AS h FROM part)
    SELECT p_partkey, CASE WHEN w * h > 4000000 THEN 'PIXEL_LIMIT' ELSE 'ASPECT_RATIO' END AS reason
    FROM s WHERE w * h > 4000000 OR greatest(w / h, h / w) > 4""",
)
def flt5(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), F.col("p_retailprice").alias("h"))
    large = F.col("w") * F.col("h") > 4_000_000
    wide = F.greatest(F.try_divide("w", "h"), F.try_divide("h", "w")) > 4
    return s.where(large | wide).select("p_partkey", F.when(large, "PIXEL_LIMIT").otherwise("ASPECT_RATIO").alias("reason"))


@query("flt6_point_lookup", "SELECT doc_id, source, n_chars FROM documents WHERE doc_id = 42")
def flt6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id = 42").select("doc_id", "source", "n_chars")


@query("flt9_key_mismatches", "SELECT count(*) FILTER (WHERE a.l IS DISTINCT FROM a.q) AS n FROM (SELECT e.label AS l, b.quality AS q FROM embeddings e LEFT JOIN labels b ON b.doc_id = e.vec_id) a")
def flt9(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    joined = e.join(table(spark, d, "labels"), "doc_id", "left")
    return joined.agg(F.count_if(~F.col("label").eqNullSafe(F.col("quality"))).alias("n"))


@query("flt11_public_projection", "SELECT event_id, coalesce(event_type, 'none') AS kind, floor(value * 10 + 0.5) / 10 AS score FROM events")
def flt11(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.coalesce("event_type", F.lit("none")).alias("kind"), (F.floor(F.col("value") * 10 + 0.5) / 10).alias("score"))


@query("flt12_extensions", "SELECT lower(regexp_extract(path_key, '\\.[^./]+$')) AS extension, count(*) AS n FROM (" + PAGES_SQL + ") GROUP BY 1")
def flt12(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).groupBy(F.lower(F.regexp_extract("path_key", r"\.[^./]+$", 0)).alias("extension")).agg(F.count("*").alias("n"))


@query("flt13_private_values", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[\\w.]+@[\\w.]+\\.[a-z]+')")
def flt13(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").rlike(r"[\w.]+@[\w.]+\.[a-z]+")).select("doc_id")


@query("flt14_finite_range", "SELECT event_id FROM events WHERE value IS NOT NULL AND isfinite(value) AND value BETWEEN 0 AND 100")
def flt14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(C.finite(F.col("value")) & F.col("value").between(0, 100)).select("event_id")


@query("jn1_timeline", f"SELECT id, ts, row_number() OVER (ORDER BY ts, id) - 1 AS position FROM ({ITEMS_SQL})")
def jn1(spark: SparkSession, d: str) -> DataFrame:
    return dense_index(items(spark, d).select("id", "ts"), [F.col("ts"), F.col("id")]).select("id", "ts", "position")


@query(
    "jn3_member_rows",
    """SELECT o.o_orderkey, l.l_linenumber, p.p_name, s.s_name FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey
    JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0 WHERE o.o_orderpriority = '1-URGENT'""",
)
def jn3(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    s = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    return o.join(lines, "o_orderkey").join(p, "l_partkey").join(s, "l_suppkey", "left").select("o_orderkey", "l_linenumber", "p_name", "s_name")


@query("jn4_groups_in_scope", "SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    large = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(large, "c_custkey", "left_semi")


@query("jn5_orphans", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def jn5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    "jn6_null_safe_page",
    """WITH p AS (SELECT doc_id AS position, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 5 END AS g FROM documents),
    m AS (SELECT vec_id, CASE WHEN label = 9 THEN NULL ELSE label END AS g FROM embeddings)
    SELECT p.position, min(m.vec_id) AS first_id FROM p LEFT JOIN m ON m.g IS NOT DISTINCT FROM p.g GROUP BY p.position""",
)
def jn6(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select(F.col("doc_id").alias("position"), F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") % 5).alias("g"))
    m = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") != 9, F.col("label").cast("long")).alias("h"))
    first = m.groupBy("h").agg(F.min("vec_id").alias("first_id"))  # one row per key before the join
    return p.join(first, F.col("g").eqNullSafe(F.col("h")), "left").select("position", "first_id")


@query(
    "jn7_nested_page",
    """WITH page AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50)
    SELECT o_orderkey, count(*) AS member_count, list(l_linenumber ORDER BY l_linenumber)::VARCHAR AS members FROM page JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
)
def jn7(spark: SparkSession, d: str) -> DataFrame:
    page = F.broadcast(table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").join(page, "o_orderkey")
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")), ", "), F.lit("]"))
    return rows.groupBy("o_orderkey").agg(F.count("*").alias("member_count"), listed.alias("members"))


@query(
    "jn8_unique_partner",
    """WITH p AS (SELECT vec_id, (vec_id * 7) % 500 AS partner FROM embeddings WHERE label < 5), n AS (SELECT partner, count(*) AS owners FROM p GROUP BY partner)
    SELECT p.vec_id, p.partner FROM p JOIN n USING (partner) JOIN embeddings e ON e.vec_id = p.partner WHERE owners = 1 AND p.partner NOT IN (SELECT vec_id FROM p)""",
)
def jn8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    p = e.where("label < 5").select("vec_id", (F.col("vec_id") * 7 % 500).alias("partner"))
    single = p.groupBy("partner").agg(F.count("*").alias("owners")).where("owners = 1").select("partner")
    found = p.join(single, "partner").join(e.select(F.col("vec_id").alias("partner")), "partner", "left_semi")
    return found.join(p.select(F.col("vec_id").alias("partner")), "partner", "left_anti").select("vec_id", "partner")


@query(
    "jn10_band_hamming_pairs",
    f"SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM ({HASHED_SQL}) a JOIN ({HASHED_SQL}) b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 2",
)
def jn10(spark: SparkSession, d: str) -> DataFrame:
    return J.band_pairs(hashed(spark, d), "id", "h", 2)


@query(
    "jn10_nearest_hamming",
    f"""SELECT id, other, distance FROM (SELECT a.id, b.id AS other, bit_count(xor(a.h, b.h))::INTEGER AS distance,
    row_number() OVER (PARTITION BY a.id ORDER BY bit_count(xor(a.h, b.h)), b.id) AS r FROM ({HASHED_SQL}) a JOIN ({HASHED_SQL}) b ON a.id <> b.id AND a.label = b.label AND a.id % 20 = 0) WHERE r = 1""",
)
def jn10n(spark: SparkSession, d: str) -> DataFrame:
    h = hashed(spark, d)
    return J.nearest(h.where("id % 20 = 0"), h, "id", "h", "label").select(F.col("query").alias("id"), F.col("item").alias("other"), "distance")


@query(
    "jn10_range_join_pairs",
    """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 AS t FROM events)
    SELECT a.event_id AS a, b.event_id AS b, b.t - a.t AS gap FROM e a JOIN e b ON a.user_id = b.user_id AND b.t - a.t BETWEEN 0 AND 1800 AND (b.t > a.t OR b.event_id > a.event_id)""",
)
def jn10r(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", C.seconds(F.col("ts")).alias("t"))
    return J.range_pairs(e, "event_id", "t", 1800, [], by="user_id").select(F.col("x_event_id").alias("a"), F.col("y_event_id").alias("b"), "gap")


_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}.embedding[i]::DOUBLE * {b}.embedding[i]::DOUBLE))"


@query(
    "jn11_cosine_window_pairs",
    f"""WITH i AS ({ITEMS_SQL}), p AS (SELECT a.id AS a, b.id AS b, {_DOT.format(a='a', b='b')} / sqrt({_DOT.format(a='a', b='a')}) / sqrt({_DOT.format(a='b', b='b')}) AS c
    FROM i a JOIN i b ON abs(a.ts - b.ts) <= 86400 AND a.id <> b.id AND (a.ts, a.id) < (b.ts, b.id)) SELECT a, b, round(c, 6) AS similarity FROM p WHERE c >= 0.3""",
)
def jn11(spark: SparkSession, d: str) -> DataFrame:
    p = J.near_pairs(items(spark, d), "id", "ts", "embedding", [(0.3, 86_400)])
    return p.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.round("c", 6).alias("similarity"))


@query(
    "jn12_member_pairs",
    f"""WITH i AS ({ITEMS_SQL}) SELECT a.user_id, a.id AS a, b.id AS b, round({_DOT.format(a='a', b='b')}, 6) AS product, a.sha = b.sha AS same_sha, b.ts - a.ts AS gap
    FROM i a JOIN i b ON a.user_id = b.user_id AND a.id < b.id""",
)
def jn12(spark: SparkSession, d: str) -> DataFrame:
    p = J.member_pairs(items(spark, d), "user_id", "id", ["embedding", "sha", "ts"])
    return p.select(
        "user_id", F.col("x_id").alias("a"), F.col("y_id").alias("b"), F.round(C.dot(F.col("x_embedding"), F.col("y_embedding")), 6).alias("product"),
        (F.col("x_sha") == F.col("y_sha")).alias("same_sha"), (F.col("y_ts") - F.col("x_ts")).alias("gap"),
    )


@query(
    "jn13_bijection_faults",
    """WITH l AS (SELECT vec_id AS k FROM embeddings), r AS (SELECT doc_id AS k FROM labels) SELECT k, coalesce(a, 0) AS n_left, coalesce(b, 0) AS n_right
    FROM (SELECT k, count(*) AS a FROM l GROUP BY k) FULL JOIN (SELECT k, count(*) AS b FROM r GROUP BY k) USING (k) WHERE coalesce(a, 0) <> 1 OR coalesce(b, 0) <> 1""",
)
def jn13(spark: SparkSession, d: str) -> DataFrame:
    left, right = table(spark, d, "embeddings").select(F.col("vec_id").alias("k")), table(spark, d, "labels").select(F.col("doc_id").alias("k"))
    return J.bijection_faults(left, right, "k")


@query(
    "jn14_frozen_sets",
    """WITH s AS (SELECT o_custkey, sha256(string_agg(o_orderpriority, ',' ORDER BY o_orderpriority)) AS h FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY o_custkey)
    SELECT a.o_custkey, count(*) AS twins FROM s a JOIN s b ON a.h = b.h GROUP BY a.o_custkey""",
)
def jn14(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ","), 256).alias("h"))
    return s.join(s.groupBy("h").agg(F.count("*").alias("twins")), "h").select("o_custkey", "twins")


@query(
    "jn15_reciprocal_best",
    f"""WITH e AS ({ITEMS_SQL}), p AS (SELECT a.id AS a, b.id AS b, {_DOT.format(a='a', b='b')} AS s FROM e a JOIN e b ON a.user_id = b.user_id AND a.id % 2 = 0 AND b.id % 2 = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY s DESC, a) AS rb,
    lead(s) OVER (PARTITION BY a ORDER BY s DESC, b) AS na, lead(s) OVER (PARTITION BY b ORDER BY s DESC, a) AS nb FROM p)
    SELECT a, b, round(s, 6) AS similarity FROM r WHERE ra = 1 AND rb = 1 AND s >= 0.05 AND coalesce(s - na >= 0.01, true) AND coalesce(s - nb >= 0.01, true)""",
)
def jn15(spark: SparkSession, d: str) -> DataFrame:
    e = items(spark, d)
    a = e.where("id % 2 = 0").select("user_id", F.col("id").alias("a"), F.col("embedding").alias("u"))
    b = e.where("id % 2 = 1").select("user_id", F.col("id").alias("b"), F.col("embedding").alias("v"))
    pairs = a.join(b, "user_id").select("a", "b", C.dot(F.col("u"), F.col("v")).alias("s"))
    return J.reciprocal_best(pairs, "a", "b", "s", 0.05, 0.01).select("a", "b", F.round("s", 6).alias("similarity"))


_BOX = "SELECT event_id, user_id, [value % 50, value % 30, value % 50 + 20, value % 30 + 20] AS box FROM events"


@query(
    "jn19_containment",
    f"""WITH b AS ({_BOX}) SELECT f.event_id AS face, s.event_id AS subject FROM b f JOIN b s ON f.user_id = s.user_id AND f.event_id <> s.event_id
    WHERE (f.box[1] + f.box[3]) / 2 BETWEEN s.box[1] AND s.box[3] AND (f.box[2] + f.box[4]) / 2 BETWEEN s.box[2] AND s.box[4]""",
)
def jn19(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    pairs = b.alias("f").join(b.alias("s"), (F.col("f.user_id") == F.col("s.user_id")) & (F.col("f.event_id") != F.col("s.event_id")))
    return pairs.where(C.contains_center(F.col("s.box"), F.col("f.box"))).select(F.col("f.event_id").alias("face"), F.col("s.event_id").alias("subject"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", "user_id", F.array(v % 50, v % 30, v % 50 + 20, v % 30 + 20).alias("box"))


_SIDE = "greatest(0, least(l.box[{j}], r.box[{j}]) - greatest(l.box[{i}], r.box[{i}]))"
_BOTH = _SIDE.format(i=1, j=3) + " * " + _SIDE.format(i=2, j=4)


@query("jn20_novel_boxes", f"""WITH b AS ({_BOX}) SELECT l.event_id FROM b l WHERE NOT EXISTS (SELECT 1 FROM b r WHERE r.user_id = l.user_id AND r.event_id < l.event_id AND {_BOTH} / (800 - {_BOTH}) >= 0.5)""")
def jn20(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    return J.novel(b, b, "user_id", (F.col("r.event_id") < F.col("l.event_id")) & (C.iou(F.col("l.box"), F.col("r.box")) >= 0.5)).select("event_id")


@query(
    "jn23_topk_retrieval",
    f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query, e.vec_id, round({_DOT.format(a='q', b='e')}, 6) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id AND e.label IS DISTINCT FROM q.label)
    SELECT query, vec_id, rank, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
)
def jn23(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return J.retrieve(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "label", 5)


@query("jn24_label_tasks", "SELECT d.doc_id, d.source, l.quality, l.toxic, l.doc_id IS NOT NULL AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn24(spark: SparkSession, d: str) -> DataFrame:
    marks = table(spark, d, "labels").withColumn("labelled", F.lit(True))
    return table(spark, d, "documents").select("doc_id", "source").join(marks, "doc_id", "left").withColumn("labelled", F.coalesce("labelled", F.lit(False)))


@query(
    "snk1_insert_ignore",
    "SELECT doc_id, 'old' AS origin FROM labels UNION ALL SELECT doc_id, 'new' FROM (SELECT DISTINCT doc_id FROM documents) WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def snk1(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.upsert import insert_ignore

    old = table(spark, d, "labels").select("doc_id", F.lit("old").alias("origin"))
    return insert_ignore(old, table(spark, d, "documents").select("doc_id", F.lit("new").alias("origin")), ["doc_id"])


@query(
    "snk2_refresh_identity",
    """WITH o AS (SELECT doc_id AS k, n_chars AS size FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id AS k, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS size FROM documents WHERE doc_id % 4 <> 0)
    SELECT k, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'gone' WHEN o.size IS DISTINCT FROM n.size THEN 'changed' ELSE 'same' END AS state FROM (SELECT k, size FROM o) o FULL JOIN (SELECT k, size FROM n) n USING (k)""",
)
def snk2(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.upsert import changes

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("n_chars").alias("size"))
    new = docs.where("k % 4 <> 0").withColumn("size", F.when(F.col("k") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return changes(docs.where("k % 3 <> 0"), new, ["k"], ["size"])


@query("snk3_latest_wins", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def snk3(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.upsert import latest

    return latest(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value")


@query("snk7_scoped_clear", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def snk7(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(gone, "o_custkey", "left_anti").select("o_orderkey")


@query("ms3_missing_artifacts", "SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT vec_id FROM embeddings)")
def ms3(spark: SparkSession, d: str) -> DataFrame:
    there = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "labels").where("quality = 1").select("doc_id").join(there, "doc_id", "left_anti")


@query("ms4_usage", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS bytes, avg(n_chars) * 1000 AS estimate FROM documents GROUP BY source")
def ms4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"), (F.avg("n_chars") * 1000).alias("estimate"))
