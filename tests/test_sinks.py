"""Sinks: whole or nothing, exact bytes, refusal of what has changed, and resuming."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import sinks


def test_staged_tables_appear_whole(spark, tmp_path):
    groups, members = spark.createDataFrame([(1, "a"), (2, "b")], "g long, kind string"), spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "g long, id long")
    path = str(tmp_path / "out")
    with pytest.raises(ValueError):
        sinks.publish_groups(spark, path, groups.where("g = 1"), members, "g")
    with pytest.raises(ValueError):
        sinks.publish_groups(spark, path, groups.union(groups), members, "g")
    assert os.listdir(tmp_path) == []
    sinks.publish_groups(spark, path, groups, members, "g")
    assert spark.read.parquet(f"{path}/members").count() == 3 and os.listdir(tmp_path) == ["out"]
    with pytest.raises(FileExistsError):
        sinks.publish_groups(spark, path, groups, members, "g")


def test_decisions_and_scoped_clear(spark):
    members = spark.createDataFrame([(1, 10, "KEEP"), (1, 11, "MAYBE"), (2, 12, "KEEP"), (2, 13, None)], "g long, id long, decision string")
    late = spark.createDataFrame([(1, 11, "AUTO_REMOVE", 0.9), (2, 13, None, 0.1), (9, 9, "KEEP", 1.0)], "g long, id long, decision string, confidence double")
    got = {(r.g, r.id): (r.decision, r.confidence) for r in sinks.decided(members, late, "g", "id").collect()}
    assert got == {(1, 10): ("KEEP", None), (1, 11): ("AUTO_REMOVE", 0.9), (2, 12): ("KEEP", None), (2, 13): (None, 0.1)}
    groups = spark.createDataFrame([(1,), (2,), (3,)], "g long")
    files = spark.createDataFrame([(10, "a/x"), (11, "b/x"), (12, "b/y"), (13, "b/z")], "id long, path string")
    g, m = sinks.clear_groups(groups, members, files, "g", "id", F.col("path").startswith("a/"))
    assert sorted(r.g for r in g.collect()) == [2] and sorted(r.id for r in m.collect()) == [12, 13]
    g, m = sinks.clear_groups(groups, members, files, "g", "id")
    assert g.count() == m.count() == 0


def test_manifest_has_exact_bytes_and_refuses_changes(spark, tmp_path):
    rows = spark.createDataFrame([("b/é.jpg",), ("a/1.jpg",), (None,), ("B.jpg",)], "path string").repartition(3)
    folder = str(tmp_path)
    meta = sinks.write_manifest(spark, folder, rows, "path", "run1", "p1")
    data = (tmp_path / "manifest.txt").read_bytes()
    assert data == "B.jpg\na/1.jpg\nb/é.jpg\n".encode() and meta["paths_sha256"] == hashlib.sha256(data).hexdigest() and meta["count"] == 3
    assert json.loads((tmp_path / "manifest.json").read_text()) == meta and not [f for f in os.listdir(tmp_path) if "pending" in f and not f.endswith(".crc")]
    lines = sinks.verify_manifest(spark, folder, "run1", "p1")
    files = spark.createDataFrame([("B.jpg", False), ("a/1.jpg", True)], "path string, keep boolean")
    assert {r.line: r.state for r in sinks.dry_run(lines, files, "path", F.col("keep")).collect()} == {"B.jpg": "PLANNED", "a/1.jpg": "PROTECTED", "b/é.jpg": "MISSING"}
    for run, policy in (("run2", "p1"), ("run1", "p2")):
        with pytest.raises(RuntimeError, match="another run"):
            sinks.verify_manifest(spark, folder, run, policy)
    for name in os.listdir(tmp_path):
        if name.endswith(".crc"):
            os.remove(tmp_path / name)
    (tmp_path / "manifest.txt").write_bytes(data + b"c\n")
    with pytest.raises(RuntimeError, match="changed"):
        sinks.verify_manifest(spark, folder, "run1", "p1")
    os.remove(tmp_path / "manifest.json")
    with pytest.raises(RuntimeError, match="description"):
        sinks.verify_manifest(spark, folder, "run1", "p1")
    with pytest.raises(ValueError):
        sinks.write_manifest(spark, folder, spark.createDataFrame([("a\nb",)], "path string"), "path", "r", "p")
    assert (tmp_path / "manifest.txt").read_bytes() == data + b"c\n"
    assert sinks.write_manifest(spark, folder, rows.limit(0), "path", "r", "p")["count"] == 0


def test_exports(spark, tmp_path):
    rows = spark.range(50).select("id", F.when(F.col("id") % 2 == 0, F.lit("x")).alias("note")).repartition(4)
    out = sinks.export_records(spark, str(tmp_path / "e"), rows, ["id"])
    text = b"".join((tmp_path / "e" / "records" / f["name"]).read_bytes() for f in out["files"])
    assert out["count"] == 50 and [json.loads(x)["id"] for x in text.splitlines()] == list(range(50)) and json.loads(text.splitlines()[1]) == {"id": 1, "note": None}
    assert all(hashlib.sha256((tmp_path / "e" / "records" / f["name"]).read_bytes()).hexdigest() == f["sha256"] for f in out["files"])
    assert sinks.export_csv(spark, str(tmp_path / "r.csv"), rows.where("id < 2"), ["id"]) == 2
    assert (tmp_path / "r.csv").read_text() == "id,note\n0,x\n1,\n"
    with pytest.raises(ValueError):
        sinks.export_csv(spark, str(tmp_path / "r.csv"), rows, ["id"], most=10)


def test_fold_resumes_and_starts_anew(spark, tmp_path):
    root, state, reads = tmp_path / "log", str(tmp_path / "state"), []
    root.mkdir()

    def read(names):
        reads.append(names)
        return spark.read.text([str(root / n) for n in names]).withColumnRenamed("value", "k")

    def counts():
        return {r.k: r.n for r in sinks.fold(spark, str(root), state, read, "k").collect()}

    (root / "01").write_text("a\nb\n")
    (root / "02").write_text("a\n")
    assert counts() == {"a": 2, "b": 1} and reads[-1] == ["01", "02"]
    (root / "03").write_text("b\n")
    assert counts() == {"a": 2, "b": 2} and reads[-1] == ["03"]
    n = len(reads)
    assert counts() == {"a": 2, "b": 2} and len(reads) == n
    (root / "01").write_text("a\nc\n")  # a prefix that has changed
    assert counts() == {"a": 2, "b": 1, "c": 1} and reads[-1] == ["01", "02", "03"]
    (root / "00").write_text("z\n")  # something before the prefix's end
    assert counts()["z"] == 1 and reads[-1] == ["00", "01", "02", "03"]
    latest = tmp_path / "state" / "latest.json"
    for name in os.listdir(tmp_path / "state"):
        if name.endswith(".crc"):
            os.remove(tmp_path / "state" / name)
    latest.write_text(json.dumps(json.loads(latest.read_text()) | {"rows": 99}))  # forged
    assert counts() == {"z": 1, "a": 2, "b": 1, "c": 1} and len(reads[-1]) == 4


def test_recover_is_idempotent(spark):
    journal = spark.createDataFrame([("k1", "x", 1), ("k2", "y", 2)], "key string, body string, n long")
    outbox = spark.createDataFrame([("k2", "y"), ("k4", "w"), ("k3", "v"), ("k1", "other"), ("k3", "v")], "key string, body string")
    after, conflicts = sinks.recover(journal, outbox, "key", "n", ["body"])
    want = {("k1", "x", 1), ("k2", "y", 2), ("k3", "v", 3), ("k4", "w", 4)}
    assert {tuple(r) for r in after.collect()} == want and [tuple(r) for r in conflicts.collect()] == [("k1", "other")]
    again, _ = sinks.recover(after, outbox, "key", "n", ["body"])
    assert {tuple(r) for r in again.collect()} == want
