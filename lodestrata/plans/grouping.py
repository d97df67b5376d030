"""Grouping queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exact import exact_groups, star_edges
from ..session import table
from .registry import query

_SHA = "SELECT doc_id, sha256(text) AS sha, n_chars FROM documents"


@query(
    "sha_exact_groups",
    f"""
    WITH h AS ({_SHA}), g AS (
      SELECT sha, count(*) AS member_count, arg_max(doc_id, struct_pack(a := n_chars, b := -doc_id)) AS keep_id
      FROM h GROUP BY sha HAVING count(*) > 1)
    SELECT g.sha, h.doc_id, g.member_count, g.keep_id, CASE WHEN h.doc_id = g.keep_id THEN 1 ELSE 0 END AS is_keep,
      CASE WHEN h.doc_id = g.keep_id THEN 'KEEP' ELSE 'AUTO_REMOVE' END AS decision,
      CASE WHEN h.doc_id = g.keep_id THEN 'KEEPER' ELSE 'BYTE_IDENTICAL' END AS reason
    FROM h JOIN g USING (sha)""",
)
def sha_exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), "n_chars")
    return exact_groups(docs, "doc_id", "sha", "n_chars")


@query(
    "sha_star_edges",
    f"""
    WITH h AS ({_SHA}), f AS (SELECT sha, min(doc_id) AS hub FROM h GROUP BY sha)
    SELECT f.hub, h.doc_id AS member FROM h JOIN f USING (sha) WHERE h.doc_id <> f.hub""",
)
def sha_star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return star_edges(docs, "doc_id", "sha")
