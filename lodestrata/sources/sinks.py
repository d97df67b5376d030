"""Sinks that publish whole results or none: staged tables, exact manifests, exports, and refusal of stale plans."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def write_bytes(spark: SparkSession, path: str, parts) -> tuple[str, int]:
    """Write `parts` (pieces of bytes) as one file that appears whole or not at all, in place of one that is there:
    (hex SHA-256 of its exact bytes, their number). Only one piece is held at a time."""
    fs, target, make = _fs(spark, path)
    pending = make(f"{path}.pending-{uuid.uuid4().hex}")
    digest, size = hashlib.sha256(), 0
    try:
        out = fs.create(pending, True)
        for part in parts:
            out.write(bytearray(part))
            digest.update(part)
            size += len(part)
        out.hsync()
        out.close()
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(pending, target):
            raise OSError(f"could not publish {path}")
    finally:
        if fs.exists(pending):
            fs.delete(pending, False)
    return digest.hexdigest(), size


def canonical(value) -> bytes:
    """JSON with sorted keys and no spaces; NaN is an error."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()


def write_json(spark: SparkSession, path: str, value) -> None:
    write_bytes(spark, path, [canonical(value) + b"\n"])


def read_json(spark: SparkSession, path: str):
    row = spark.read.text(path, wholetext=True).first()
    return json.loads(row[0])


def staged(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Run `write` on a new folder beside `path` and rename it to `path` when that is done. A path that exists is an
    error, before and after; a failure leaves nothing behind, a lost driver a folder whose name holds .staging-."""
    fs, target, make = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    stage = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        write(stage)
        if fs.exists(target) or not fs.rename(make(stage), target):
            raise FileExistsError(path)
    finally:
        if fs.exists(make(stage)):
            fs.delete(make(stage), True)


# ---- groups --------------------------------------------------------------------------------------


def publish_groups(spark: SparkSession, path: str, groups: DataFrame, members: DataFrame, group: str) -> None:
    """Groups and their members as two tables that appear together. Members without a group, groups without a
    member and repeated groups are errors, and then nothing appears."""

    def write(stage: str) -> None:
        groups.write.parquet(f"{stage}/groups")
        members.write.parquet(f"{stage}/members")
        g, m = spark.read.parquet(f"{stage}/groups"), spark.read.parquet(f"{stage}/members")
        names = g.groupBy(group).agg(F.count("*").alias("n"))
        seen = m.groupBy(group).agg(F.lit(1).alias("m"))
        faults = names.join(seen, names[group].eqNullSafe(seen[group]), "full_outer").where("n IS NULL OR n <> 1 OR m IS NULL").count()
        if faults:
            raise ValueError(f"{faults} groups are repeated, or lack members or a header")

    staged(spark, path, write)


def decided(members: DataFrame, decisions: DataFrame, group: str, item: str) -> DataFrame:
    """Members with the columns of later decisions in place of their own, where there are any; decisions of rows that
    are no members are left out."""
    new = [c for c in decisions.columns if c not in (group, item)]
    late = decisions.select(group, item, F.struct(*new).alias("__new"))
    out = members.join(late, [group, item], "left")
    pick = lambda c: F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c) if c in members.columns else F.lit(None)).alias(c)
    return out.select(*(c for c in members.columns if c not in new), *map(pick, new))


def clear_groups(groups: DataFrame, members: DataFrame, files: DataFrame, group: str, item: str, inside: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """What stays of groups and members when those of a scope go: all members of each group with a member among the
    files where `inside` holds, then groups that have no member left. Without a scope, nothing stays."""
    if inside is None:
        return groups.limit(0), members.limit(0)
    gone = members.join(files.where(inside).select(item), item, "left_semi").select(group).distinct()
    left = members.join(gone, group, "left_anti")
    return groups.join(left.select(group), group, "left_semi"), left


# ---- manifests -----------------------------------------------------------------------------------


def write_manifest(spark: SparkSession, folder: str, rows: DataFrame, line: str, run: str, policy: str) -> dict:
    """The lines of `rows` in code point order as manifest.txt, one after another, and manifest.json with their count, the SHA-256 of
    the exact bytes, run and policy. Sorting is Spark's; the driver passes on one partition at a time. The list of
    what to act on comes before its description, so an interrupted write is refused later."""
    count = 0

    def parts():
        nonlocal count
        for r in rows.where(F.col(line).isNotNull()).select(line).orderBy(line).toLocalIterator():
            if "\n" in r[0]:
                raise ValueError("a line may not hold a line feed")
            count += 1
            yield r[0].encode() + b"\n"

    digest, size = write_bytes(spark, f"{folder}/manifest.txt", parts())
    meta = {"count": count, "paths_sha256": digest, "bytes": size, "run": run, "policy": policy}
    write_json(spark, f"{folder}/manifest.json", meta)
    return meta


def verify_manifest(spark: SparkSession, folder: str, run: str, policy: str) -> DataFrame:
    """The lines of a manifest, if it is as it was written and of this run and policy; else an error. Nothing is done
    with files here."""
    fs, meta_path, make = _fs(spark, f"{folder}/manifest.json")
    if not fs.exists(meta_path):
        raise RuntimeError("the manifest has no description")
    meta = read_json(spark, f"{folder}/manifest.json")
    digest, count = hashlib.sha256(), 0
    stream = fs.open(make(f"{folder}/manifest.txt"))
    try:
        while chunk := bytes(stream.readNBytes(1 << 20)):
            digest.update(chunk)
            count += chunk.count(b"\n")
    finally:
        stream.close()
    if digest.hexdigest() != meta.get("paths_sha256") or count != meta.get("count"):
        raise RuntimeError("the manifest has changed since it was written")
    if (run, policy) != (meta.get("run"), meta.get("policy")):
        raise RuntimeError("the manifest is of another run or policy")
    return spark.read.text(f"{folder}/manifest.txt").withColumnRenamed("value", "line")


def dry_run(lines: DataFrame, files: DataFrame, key: str, protected: Column) -> DataFrame:
    """What acting on a manifest would do, line by line: (line, state), PLANNED, PROTECTED (a keeper or the like), MISSING or REPEATED.
    `files` has one row a key."""
    n = lines.groupBy("line").agg(F.count("*").alias("__n"))
    known = files.select(F.col(key).alias("line"), F.coalesce(protected, F.lit(True)).alias("__p"))
    j = n.join(known, "line", "left")
    state = F.when(F.col("__n") > 1, "REPEATED").when(F.col("__p").isNull(), "MISSING").when(F.col("__p"), "PROTECTED").otherwise("PLANNED")
    return j.select("line", state.alias("state"))


def export_records(spark: SparkSession, path: str, rows: DataFrame, order: list[str]) -> dict:
    """Rows as JSON lines in `order`, in files, with export.json that holds their number and, per file in order, the
    SHA-256 of its exact bytes. All appears together. Digests are worked out where the files are."""
    out: dict = {}

    def write(stage: str) -> None:
        rows.orderBy(*order).write.json(f"{stage}/records", ignoreNullFields=False)
        files = spark.read.format("binaryFile").load(f"{stage}/records/*.json")
        name = F.regexp_extract("path", r"([^/]+)$", 1)
        listed = sorted(tuple(r) for r in files.select(name, F.sha2("content", 256), "length").collect())  # one short row a file
        n = spark.read.text(f"{stage}/records").count()
        out.update({"count": n, "files": [{"name": a, "sha256": b, "bytes": c} for a, b, c in listed]})
        write_json(spark, f"{stage}/export.json", out)

    staged(spark, path, write)
    return out


def export_csv(spark: SparkSession, path: str, report: DataFrame, order: list[str], most: int = 100_000) -> int:
    """Aggregate statistics as one CSV file with a header, whole or not at all: the number of rows. A report is small by
    nature; one of more than `most` rows is an error, not cut."""
    rows = report.orderBy(*order).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of more than {most} rows is no report; write it as a table")
    text = io.StringIO()
    writer = csv.writer(text, lineterminator="\n")
    writer.writerow(report.columns)
    writer.writerows([["" if v is None else v for v in r] for r in rows])
    write_bytes(spark, path, [text.getvalue().encode()])
    return len(rows)


# ---- resuming ------------------------------------------------------------------------------------


def segments(spark: SparkSession, root: str) -> DataFrame:
    """Files under `root` with the SHA-256 of their bytes: (name, digest). A segment must fit into a task's memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("digest"))


def resume(found: DataFrame, saved: DataFrame | None) -> tuple[bool, DataFrame]:
    """Whether a checkpoint still holds, and the segments that remain. `saved` has the names and digests that were folded. It holds if all of
    them are there unchanged and come before all others by name; else everything is to be folded anew."""
    if saved is None:
        return False, found
    last = saved.agg(F.max("name").alias("last"), F.count("*").alias("n"))
    # the checkpoint's own rows, matched by name
    both = found.join(saved.withColumnRenamed("digest", "__old"), "name", "full_outer").crossJoin(F.broadcast(last))  # one row
    broken = both.where("n > 0").where(
        (F.col("__old").isNotNull() & ~F.col("digest").eqNullSafe(F.col("__old"))) | (F.col("__old").isNull() & (F.col("name") < F.col("last")))
    )
    if not broken.isEmpty():
        return False, found
    return True, found.join(saved.select("name"), "name", "left_anti")


def fold(spark: SparkSession, root: str, checkpoint: str, read: Callable[[list[str]], DataFrame], key: str) -> DataFrame:
    """Counts of `key` over all segments, taken up from a checkpoint: only new segments are read if the old ones are
    unchanged, else all. `read` gives the rows of the named segments. The checkpoint, counts and digests together, is
    a new folder each time, named by a pointer that changes last; a damaged one is worth nothing."""
    found = segments(spark, root)
    saved = counts = None
    fs, pointer, make = _fs(spark, f"{checkpoint}/latest.json")
    if fs.exists(pointer):
        try:
            at = read_json(spark, f"{checkpoint}/latest.json")
            saved, counts = spark.read.parquet(f"{checkpoint}/{at['name']}/segments"), spark.read.parquet(f"{checkpoint}/{at['name']}/counts")
            if (saved.count(), counts.agg(F.sum("n")).first()[0] or 0) != (at["segments"], at["rows"]):
                saved = counts = None
        except Exception:  # noqa: BLE001  whatever is wrong with a checkpoint, the fold starts anew
            saved = counts = None
    valid, rest = resume(found, saved)
    names = [r["name"] for r in rest.select("name").orderBy("name").collect()]  # names of files
    new = read(names).groupBy(key).agg(F.count("*").alias("n")) if names else None
    total = counts if valid else None
    if new is not None:
        total = new if total is None else total.unionByName(new).groupBy(key).agg(F.sum("n").alias("n"))
    if total is None:
        return spark.createDataFrame([], f"{key} string, n long")
    name = f"state-{uuid.uuid4().hex}"

    def write(stage: str) -> None:
        found.write.parquet(f"{stage}/segments")
        total.write.parquet(f"{stage}/counts")

    staged(spark, f"{checkpoint}/{name}", write)
    out = spark.read.parquet(f"{checkpoint}/{name}/counts")
    write_json(spark, f"{checkpoint}/latest.json", {"name": name, "segments": found.count(), "rows": out.agg(F.sum("n")).first()[0] or 0})
    return out


def recover(journal: DataFrame, outbox: DataFrame, key: str, order: str, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """The journal with every pending event of the outbox in it, once, and the events that can't go in since another payload has
    their key: (journal, conflicts). New events follow the last in the order of their keys, numbered without gaps.
    Doing it again changes nothing, so a crash between append and clearing is harmless."""
    digest = F.sha2(F.to_json(F.struct(*payload)), 256)
    known = journal.select(key, digest.alias("__k"))
    pending = outbox.withColumn("__d", digest)
    first = pending.groupBy(key).agg(F.min("__d").alias("__f"))
    pending = pending.join(first, key).join(known, key, "left")
    clash = F.coalesce(F.col("__k"), F.col("__f")) != F.col("__d")
    conflicts = pending.where(clash).select(key, *payload)
    new = pending.where(~clash & F.col("__k").isNull()).dropDuplicates([key]).select(key, *payload)
    last = journal.agg(F.coalesce(F.max(order), F.lit(0)).alias("__last"))
    from ..operators.review import dense_index

    numbered = dense_index(new, [F.col(key)]).crossJoin(F.broadcast(last))  # one row
    add = numbered.select(key, *payload, (F.col("__last") + F.col("position") + 1).alias(order))
    return journal.select(key, *payload, order).unionByName(add), conflicts
