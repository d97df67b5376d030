"""Shared pieces of the training-data operators: scratch tables, tokens, hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = str.maketrans(UPPER, LOWER)
_roots: dict[str, object] = {}
_LIBC = ctypes.CDLL(None)


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, a temporary folder stands in if the master is local; on a cluster each
    machine would write to a disk of its own, so that is an error.
    """
    app = spark.sparkContext.applicationId
    for root in _roots:
        if root.endswith(app):
            return root
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {key} to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="lodestrata-")
    root = f"{base.rstrip('/')}/lodestrata-{app}"
    _roots[root] = spark
    return root


#: Bytes of rows that travel to a Python worker at once, unless the session says otherwise.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a worker's memory doesn't follow the length of texts. A bound
    that the session has set itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf._jconf.contains(key):
        spark.conf.set(key, BATCH_BYTES)


def materialize(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Write `df` as a parquet table in the scratch folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    trim_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


#: A written table of at most so many bytes of files may be broadcast.
BROADCAST_BYTES = 16 << 20


def broadcast_small(df: DataFrame) -> DataFrame:
    """A table that materialize() wrote, to be broadcast if its files are small enough; else a join with it
    shuffles. No job runs for that."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    size = path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing reads it any more."""
    _delete(df.sparkSession, getattr(df, "_scratch_path", None))


def _delete(spark: SparkSession, path: str | None) -> None:
    if path:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage between the steps of a long operator, so that Spark lets go of the
    broadcasts and shuffle files of finished jobs, on executors too, and not only once the heap is full."""
    spark.sparkContext._jvm.System.gc()
    trim_driver(spark)


def trim_driver(spark: SparkSession) -> None:
    """Hand memory that is free in the C heap of the driver's JVM back to the machine. The compiler of the JVM works
    there; with many plans what it has freed is more than the Java heap, and is kept otherwise. JVMs that
    don't know how (not on Linux, or before 17.0.9) are left as they are."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        # by its interface: the server's own class is closed to other modules
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = array(jvm.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass


#: What a Python worker keeps from task to task: one object at most, so that workers that are used again by
#: other kernels don't hold what nobody needs.
_held: dict[str, object] = {}


def held(key: str, make):
    """The object of this key, made anew if the worker holds another one."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """Let go of what the worker holds for another kernel, and hand free memory back to the machine."""
    _held.clear()
    trim()


def trim() -> None:
    """Hand memory that is free inside this worker back to the machine: Arrow's pool, and the C library's heap
    where it can. A worker lives on between tasks, and what its largest batch took stays its own otherwise."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


@atexit.register
def _clean() -> None:
    for root, spark in _roots.items():
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001  the session may be gone already
            pass


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """Words of a text as a native array; null gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != F.lit(""))


def words_of(text: str | None) -> list[str]:
    """The same words in Python. str.split() also cuts at U+001C..U+001F, U+0085, U+00A0 and other
    Unicode spaces, so those stay inside words by going through bytes, whose split() is ASCII only."""
    return [] if not text else [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def word_bytes(text: str | None, lower: bool = True) -> list[bytes]:
    """Words as UTF-8 bytes; with `lower`, A-Z alone become lower case."""
    if not text:
        return []
    b = text.encode("utf-8", "surrogatepass")
    return (b.lower() if lower else b).split()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, longer on demand."""

    base = 0x5851F42D4C957F2D

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = max(n, 1 << 20)
            inverse = pow(self.base, -1, 1 << 64)
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (self.base, inverse))
        return self.up, self.down


_powers = _Powers()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64)) * ~_SPACE
_VALUE_LOWER = _VALUE.copy()
_VALUE_LOWER[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]


#: ASCII punctuation (fixed value).
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def hash_words(texts, lower: bool = True, drop: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of several texts, and where each text's words begin (one bound more than
    texts). A word's hash is a polynomial in its UTF-8 bytes modulo 2**64 with random coefficients, mixed;
    A-Z count as a-z with `lower`, and the ASCII characters of `drop` as nothing. Null is the empty text."""
    parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    if drop:
        parts = [p.translate(None, drop) for p in parts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    a = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    space = _SPACE[a]
    before = np.empty_like(space)
    if len(a):
        before[0] = True
        before[1:] = space[:-1]
    starts = np.flatnonzero(before & ~space)
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return np.empty(0, np.uint64), first
    up, down = _powers.get(len(a))
    weighted = (_VALUE_LOWER if lower else _VALUE)[a] * up[: len(a)]
    return mix64(np.add.reduceat(weighted, starts) * down[starts]), first


def hash_word_starts(texts, widths: tuple[int, ...], drop: bytes | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Per width, a hash of the first bytes of each word that is longer than the width (0 for other words),
    and where each text's words begin. A-Z count as a-z, characters of `drop` as nothing."""
    parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    if drop:
        parts = [p.translate(None, drop) for p in parts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    a = np.frombuffer(b"\n".join([*parts, b"\n" * (max(widths) + 1)]), np.uint8)
    space = _SPACE[a]
    starts = np.flatnonzero(np.concatenate([[True], space[:-1]]) & ~space)
    first = np.searchsorted(starts, bounds)
    up, _ = _powers.get(max(widths) + 1)
    whole, sums, out = np.ones(len(starts), bool), np.zeros(len(starts), np.uint64), []
    for i in range(max(widths) + 1):
        at = starts + i
        whole &= ~space[at]
        if i in widths:
            out.append(np.where(whole, mix64(sums + np.uint64(i)), np.uint64(0)))
        sums += _VALUE_LOWER[a[at]] * up[i] * whole
    return out, first


def groups_of_texts(texts, most: int = 1 << 20):
    """Cut a series of texts into runs of about `most` characters (a longer text is a run of its own)."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t) if isinstance(t, str) else 0
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def hash_shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of several texts, in order, and where each text's shingles begin. Each equals what
    shingle_hashes() gives for the text alone."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    out = np.zeros(begin[-1], np.uint64)
    if len(words) >= k:
        runs = shingle_hashes(words, k)
        out = runs[np.minimum(at, len(runs) - 1)]
    for i in np.flatnonzero((n > 0) & (n < k)):
        out[begin[i]] = shingle_hashes(words[first[i] : first[i + 1]], k)[0]
    return out, begin


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, in order; with fewer than k words, one hash of the whole sequence;
    without words, none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h, width = np.zeros(max(n - k + 1, 1), np.uint64), min(k, n)
    for j in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + len(h)] + np.uint64(j + 1))
    return mix64(h + np.uint64(width))
