"""The supplied tables in the roles of the domain, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import seconds, sign_bits
from ..session import table

#: Items: a vector with a capture time (event of the same id), a text hash and a size (document of that id).
ITEMS_SQL = """
SELECT e.vec_id AS id, e.embedding, e.label, v.user_id, epoch_us(v.ts) // 1000000 AS ts, v.value, sha256(d.text) AS sha, d.n_chars AS size, d.source
FROM embeddings e JOIN events v ON v.event_id = e.vec_id JOIN documents d ON d.doc_id = e.vec_id"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    v = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", seconds(F.col("ts")).alias("ts"), "value")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("sha"), F.col("n_chars").alias("size"), "source")
    return e.join(v, "id").join(d, "id")


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", sign_bits(F.col("embedding")).alias("h"))


#: The same 64-bit sign hash in SQL, as a bit string.
HASHED_SQL = "SELECT vec_id AS id, label, list_reduce(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), lambda a, b: a || b)::BIT AS h FROM embeddings"
#: Page addresses as paths: what follows the scheme, up to a query or fragment.
PAGES_SQL = "SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/$', '') AS path_key FROM pages"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/$", "")
    return table(spark, sf_dir, "pages").select("page_id", key.alias("path_key"))
