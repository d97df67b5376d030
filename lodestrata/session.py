"""SparkSession factory with the settings the engine expects."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str = "local[*]", app: str = "lodestrata", **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow switched on; `conf` overrides any of it."""
    return SparkSession.builder.master(master).appName(app).config(map=DEFAULTS | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the supplied parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` worked out once and kept in the checkpoint folder that the cluster names in spark.checkpoint.dir, so that
    later steps read it, also after an executor is lost. Without one a local session takes a temporary folder; on a
    cluster, where each machine would write to a disk of its own, that is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestrata-"))
    return df.checkpoint()
