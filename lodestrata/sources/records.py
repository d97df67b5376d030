"""Record sources and sinks: JSON lines with bad rows kept, event logs, manifests, configuration."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import strict_json


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value, bad): each line as a variant; bad JSON, repeated keys and NaN tokens keep their text in
    `bad` and have a null value."""
    text = spark.read.text(path)
    value = strict_json(F.col("value"))
    return text.select(F.col("value").alias("line"), value.alias("value"), F.when(value.isNull() & (F.trim("value") != ""), F.col("value")).alias("bad"))


def event_log(spark: SparkSession, root: str) -> DataFrame:
    """Events of files named NNNNNNNNNNNN-ID.json: sequence, event_id, body."""
    files = spark.read.text(root, wholetext=True).withColumn("path", F.input_file_name())
    pattern = r"(\d{12})-([^/]+)\.json$"
    return files.select(F.regexp_extract("path", pattern, 1).try_cast("long").alias("sequence"), F.regexp_extract("path", pattern, 2).alias("event_id"), F.col("value").alias("body"))


def log_faults(events: DataFrame) -> DataFrame:
    """What is wrong with a log: names that don't fit, gaps in the sequence, repeated ids (fault, n)."""
    n = events.agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("s"), F.max("sequence").alias("m"), F.count_distinct("event_id").alias("i"), F.count_if(F.col("sequence").isNull()).alias("bad"))
    one = F.explode(F.array(
        F.struct(F.lit("BAD_NAME").alias("fault"), F.col("bad").alias("n")), F.struct(F.lit("SEQUENCE_GAP").alias("fault"), (F.coalesce("m", F.lit(0)) - F.col("s")).alias("n")),
        F.struct(F.lit("REPEATED_ID").alias("fault"), (F.col("n") - F.col("i")).alias("n")),
    ))
    return n.select(one.alias("f")).select("f.*").where("n <> 0")


def manifest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: number of rows and a digest of their hashes that doesn't depend on their order."""
    h = F.xxhash64(key, *columns)
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(":", F.sum(h.cast("decimal(38,0)")).cast("string"), F.bit_xor(h).cast("string")), 256).alias("digest"))


def union_snapshots(parts: dict[str, DataFrame], column: str = "date") -> DataFrame:
    """Tables by name (a date), under one another with the name as a column."""
    out = None
    for name in sorted(parts):
        part = parts[name].withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no snapshots")
    return out


#: Defaults of the configuration: fixed values.
DEFAULTS = {
    "cluster": {"burst_window_seconds": 30, "cosine": 0.92, "hamming": 2, "face_shift": 0.30, "face_score": 0.6, "identity_cosine": 0.45, "identity_width_px": 80, "loose_window_seconds": 300, "loose_cosine": 0.96, "loose": False},
    "phases": {"gap_seconds": 4, "boundary": 0.93, "position": 0.22, "keepers": 1, "max_keepers": 3, "diversity": 0.965, "mmr_weight": 0.7, "margin": 0.06, "slack": 0.04},
    "decision": {"profile": "balanced"},
}


def merged(base: dict, over: dict) -> dict:
    """`base` with `over` laid on top, section by section."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


@dataclass(frozen=True)
class Config:
    cluster: dict
    phases: dict
    decision: dict

    @classmethod
    def load(cls, text: str = "{}") -> Config:
        """From JSON laid over the defaults; unknown sections and impossible values are errors."""
        whole = merged(DEFAULTS, json.loads(text))
        if unknown := set(whole) - set(DEFAULTS):
            raise ValueError(f"unknown sections: {sorted(unknown)}")
        config = cls(**whole)
        for section, name, low, high in (("cluster", "cosine", -1, 1), ("cluster", "hamming", 0, 2), ("phases", "mmr_weight", 0, 1), ("cluster", "burst_window_seconds", 1, 86_400)):
            value = getattr(config, section)[name]
            if isinstance(value, bool) or not low <= value <= high:
                raise ValueError(f"{section}.{name} must lie between {low} and {high}")
        if config.decision["profile"] not in ("conservative", "balanced", "aggressive"):
            raise ValueError("unknown decision profile")
        return config
