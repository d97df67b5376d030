"""The corpus pipeline: five stages over documents, each over all that the one before kept.

Every stage takes any rows with the columns of documents, in any partitioning. A null text is a text
without words or letters: language ID drops it, the later stages keep it as it is. Rows with a null doc_id
are never taken for copies or contaminated, and null sources are one source. Ties go to the smaller
doc_id, else to a hash. Repeated rows: near-dedup keeps one of those that agree in doc_id and text; all
other stages treat them alike. Other columns, whatever their names, come through, except that the last
stage replaces columns named size, source_size, target, copies, taken or draws by its own. An empty
table passes through all stages as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontaminate, langid, mixing, neardup, secrets
from lodestrata.llm.common import discard, materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no letter, or no text) go; lang becomes the predicted one."""
    found = langid.identify(docs)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    return neardup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; n_chars follows the text. No document goes."""
    clean = secrets.redact(docs, path="source")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often, and the shard and place of each copy."""
    return mixing.mix(docs).where("copies > 0")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
]
#: The stages learn models and draw by hash, which SQL has no words for; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder and read again; a table
    goes as soon as the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
