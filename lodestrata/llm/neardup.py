"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, connected components.

Circulant MinHash (Li and Li, 2021) needs two permutations of a universe of D slots: the first, sigma,
scatters a shingle; the second, pi, is shifted circularly by k places for signature coordinate k. Thus
coordinate k of a set is min(pi[(sigma(x) + k) mod D]), and all coordinates of one shingle lie side by
side in pi, so a signature is a running minimum over contiguous slices.

Bands only propose pairs. Sets that are equal are one class and need no pairs. Within a band bucket the
classes are first linked to one hub, and only classes that are still in different components after that
are compared with each other, so a bucket of g copies costs about g comparisons, and every pair of a
bucket ends up compared, already connected, or ruled out by set sizes, sketches or the hub. The hub is the
class that shares buckets with most others: the original of a group of edited copies, as a rule.

The hub rules out pairs exactly. Once x and y are compared with hub h, what each has in common with h and
what it has beyond h is known. If x and y share nothing beyond h, their intersection lies in h and is no
larger than the smaller of theirs with h; so a pair needs comparing only if it shares a shingle beyond h,
or if that bound lets the sizes reach the threshold. Thousands of copies with edits of their own thus stay
few pairs, even those that are too far from the original to be linked with it. How many shingles beyond h a
pair must share at least follows from the sizes, so only the rarest of each member's shingles beyond h are
joined (Xiao et al., 2008: "Efficient similarity joins for near duplicate detection"); a passage that all
members have beyond h thus proposes pairs only where it can decide them. Each comparison is exact, over the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, broadcast_small, discard, groups_of_texts, hash_shingles, hash_words, materialize, mix64, release, tidy, trim
from .components import components

UNIVERSE_BITS = 20
#: Bands times rows is the signature length. A pair at the threshold of 0.8 escapes all 42 bands of 6
#: with a probability of 3e-6, one at 0.9 with 4e-14.
BANDS, ROWS = 42, 6
#: Four bits of each of so many coordinates are kept as a sketch. A pair at the threshold differs in 48 of
#: them on average (deviation 6.2); one in 700,000 such pairs differs in more than SKETCH_MOST.
SKETCH, SKETCH_MOST = 256, 77
_MASK = np.uint64((1 << UNIVERSE_BITS) - 1)


class Circulant:
    """Signature coordinates of a set of shingle hashes from two permutations."""

    def __init__(self, coordinates: int, seed: int = 20) -> None:
        pi = np.random.default_rng(seed).permutation(1 << UNIVERSE_BITS).astype(np.int32)
        self.k, self._odd = coordinates, np.uint64(0x9E3779B97F4A7C15 | 1)
        self._slices = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates]]), coordinates)

    def sigma(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the universe: a bijection (odd multiplier and xor-shift, modulo D) of folded hashes."""
        x = (hashes ^ (hashes >> np.uint64(32))) & _MASK
        x = (x * self._odd) & _MASK
        return ((x ^ (x >> np.uint64(UNIVERSE_BITS // 2))) & _MASK).astype(np.int64)

    def __call__(self, hashes: np.ndarray, step: int = 2048) -> np.ndarray:
        low = None
        slots = np.unique(self.sigma(hashes))
        for i in range(0, len(slots), step):
            part = self._slices[slots[i : i + step]].min(axis=0)
            low = part if low is None else np.minimum(low, part)
        return low


def _sets(texts: Iterator, k: int) -> Iterator[np.ndarray]:
    for run in groups_of_texts(texts):
        shingles, begin = hash_shingles(*hash_words(run), k)
        for i in range(len(run)):
            s = np.sort(shingles[begin[i] : begin[i + 1]])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def _signing(k: int, bands: int, rows: int):
    """Per document: set size, a 128-bit digest of the set, band keys and the sketch."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        circulant = Circulant(max(bands * rows, SKETCH))
        salt = mix64(np.arange(1, bands + 1, dtype=np.uint64))
        weigh = mix64(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)
        for pdf in it:
            out = []
            for doc_id, s in zip(pdf["doc_id"], _sets(pdf["text"], k), strict=True):
                if not len(s):
                    out.append((doc_id, 0, None, None, None))
                    continue
                sig = circulant(s)
                keys = mix64((mix64(sig[: bands * rows].astype(np.uint64).reshape(bands, rows) + np.uint64(1)) * weigh).sum(axis=1, dtype=np.uint64) ^ salt)
                low = (mix64(sig[:SKETCH].astype(np.uint64)) & np.uint64(15)).astype(np.uint8)
                sketch = (low[::2] | (low[1::2] << 4)).view(np.int64)
                out.append((doc_id, len(s), _digest(s), keys.view(np.int64), sketch))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "digest", "keys", "sketch"]).astype({"doc_id": "Int64"})
        trim()

    return run


def _digest(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _packing(k: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for pdf in it:
            for part in groups_of_texts(pdf["text"]):
                sets = list(_sets(part, k))
                yield pd.DataFrame({"digest": [_digest(s) for s in sets], "members": [s.tobytes() for s in sets]})

    return run


def _overlaps(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Of two packed sets, each sorted and without repeats: how much they share, and what `b` has beyond."""
    shared, beyond = [], []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        common = x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y
        shared.append(int(common.sum()))
        beyond.append(y[~common].view(np.int64))
    return pd.DataFrame({"shared": pd.Series(shared, dtype="int64"), "beyond": pd.Series(beyond, dtype="object")})


def _plausible(x: str, y: str, percent: int) -> Column:
    """Sizes that allow the similarity, and sketches that don't rule it out."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = []
    for i in range(SKETCH // 16):
        z = f"({x}.sketch[{i}] ^ {y}.sketch[{i}])"
        differ.append(f"bit_count(({z} | shiftrightunsigned({z}, 1) | shiftrightunsigned({z}, 2) | shiftrightunsigned({z}, 3)) & {0x1111111111111111}L)")
    # the bound is stated for 80 percent; for others it moves with the expected number of differences
    most = SKETCH_MOST + max(0, 80 - percent) * SKETCH * 15 // 1600
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & F.expr(f"{' + '.join(differ)} <= {most}")


def _compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of classes with shared (size of the intersection of the full sets), n and m (their
    sizes) and beyond (what b has and a has not). Sets are rebuilt from the texts of just the documents
    that stand for a class of a pair."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    wanted = materialize(wanted.join(classes, "cls").select("cls", "digest", F.col("rep").alias("doc_id")))
    texts = docs.join(broadcast_small(materialize(wanted.select("doc_id").distinct())), "doc_id", "left_semi")
    packed = texts.mapInPandas(_packing(k), "digest binary, members binary").join(wanted.select("cls", "digest"), "digest")
    sets = materialize(packed.select("cls", "members").dropDuplicates(["cls"]))
    discard(wanted)
    overlap = F.pandas_udf(_overlaps, "shared long, beyond array<long>")
    both = (
        pairs.join(sets.select(F.col("cls").alias("b"), F.col("members").alias("y")), "b")
        .join(sets.select(F.col("cls").alias("a"), F.col("members").alias("x")), "a")
        .select("a", "b", overlap("x", "y").alias("o"), (F.octet_length("x") / 8).cast("long").alias("n"), (F.octet_length("y") / 8).cast("long").alias("m"))
    )
    out = materialize(both.select("a", "b", "o.shared", "n", "m", "o.beyond"))
    discard(sets)
    return out


def _similar(shared: str, n: str, m: str, percent: int) -> str:
    return f"{shared} * 100 >= ({n} + {m} - {shared}) * {percent}"


def _by_shingle(member: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one hub, in different components, that sizes alone don't make candidates
    and that can be similar by what they share beyond the hub.

    A similar pair shares t = percent * (n + m) / (100 + percent) shingles at least, and no more than
    min(s, s') of them in the hub, so t - min(s, s') or more beyond it. With each member's shingles beyond in
    one order, rare ones first, the first one that both have comes early enough in both to leave so many.
    For the smaller of two t is at least what it is for equal sizes, for the larger percent of its own size:
    that bounds how far each is read before any partner is known. Nothing that can be similar is lost.
    """
    own = member.select("hub", "cls", F.explode("beyond").alias("shingle"))
    # a shingle that one member alone has comes first in its order, and is no link
    common = own.groupBy("hub", "shingle").agg(F.count("*").alias("many")).where("many > 1")
    w = Window.partitionBy("hub", "cls")
    place = own.join(common, ["hub", "shingle"]).select("hub", "cls", "shingle", F.row_number().over(w.orderBy("many", "shingle")).alias("at"), F.count("*").over(w).alias("several"))
    more = F.size("beyond").cast("long")
    known = member.select("hub", "cls", "n", "s", "comp", more.alias("more"))
    place = place.join(known, ["hub", "cls"]).withColumn("at", F.col("at") + F.col("more") - F.col("several"))
    # what is left from here on, itself included, must reach what is needed beyond the hub
    left = F.col("more") - F.col("at") + 1
    place = place.withColumn("left", left).where(f"left >= 1 AND (s + left) * 100 >= n * {percent}")
    early = f"(s + left) * {100 + percent} >= 2 * n * {percent}"
    x, y = place.where(early).alias("x"), place.alias("y")
    ordered = F.struct("x.n", "x.cls") < F.struct("y.n", "y.cls")
    sizes = F.col("x.n") * 100 >= F.col("y.n") * percent
    enough = F.expr(_similar("(least(x.s, y.s) + least(x.left, y.left))", "x.n", "y.n", percent)) & ~F.expr(_similar("least(x.s, y.s)", "x.n", "y.n", percent))
    pairs = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.shingle") == F.col("y.shingle")) & ordered & sizes & enough & (F.col("x.comp") != F.col("y.comp")))
    return pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))


def _leftovers(star: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that were compared with one hub and lie in different components, as far as
    the hub doesn't rule them out."""
    member = star.select(F.col("a").alias("hub"), F.col("b").alias("cls"), F.col("m").alias("n"), F.col("shared").alias("s"), "beyond")
    member = member.join(comp.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
    split = member.groupBy("hub").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("hub")
    member = materialize(member.join(split, "hub").select("hub", "cls", "n", "s", "comp", "beyond"))

    by_shingle = _by_shingle(member, percent)

    # by sizes: first for each kind (n, s) of member of a hub, of which there are few, then for members
    kind = member.groupBy("hub", "n", "s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    reach = F.expr(_similar("least(p.s, q.s)", "p.n", "q.n", percent))
    several = (F.least("p.lo", "q.lo") < F.greatest("p.hi", "q.hi")) & (F.struct("p.n", "p.s") <= F.struct("q.n", "q.s"))
    kinds = kind.alias("p").join(kind.alias("q"), (F.col("p.hub") == F.col("q.hub")) & reach & several)
    kinds = kinds.select("p.hub", "p.n", "p.s", F.col("q.n").alias("n2"), F.col("q.s").alias("s2"))
    slim = member.select("hub", "n", "s", "cls", "comp")
    x = slim.join(kinds, ["hub", "n", "s"]).select("hub", "n2", "s2", F.col("cls").alias("c1"), F.col("comp").alias("comp1"))
    y = slim.select("hub", F.col("n").alias("n2"), F.col("s").alias("s2"), "cls", "comp")
    by_size = x.join(y, ["hub", "n2", "s2"]).where("comp1 <> comp")
    return materialize(by_shingle.union(by_size.select(F.least("c1", "cls").alias("a"), F.greatest("c1", "cls").alias("b"))).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of `docs` with doc_id, n_shingles, component_id and kept.

    Shingles are runs of `shingle` words, words being split at ASCII white space with A-Z lower-cased; a
    text with fewer words has its whole sequence as its one shingle. Documents are linked where
    100 * intersection >= percent * union of their sets; component_id is the smallest doc_id that can be
    reached, kept says that it is the document's own.

    Null, empty and blank texts have no shingles: such a document is linked with nothing and kept. Rows
    whose doc_id is null are returned with a null component_id and kept. Rows that repeat doc_id and
    text get the same result; rows that repeat a doc_id with another text are placed by their own text. Only doc_id and
    text are read, whatever other columns there are. An empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, digest binary, keys array<long>, sketch array<long>"
    signed = materialize(docs.mapInPandas(_signing(shingle, bands, rows), schema))
    full = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # one class for each 128-bit digest; its number is drawn once, as the table is written
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()))
    reps = full.join(classes, "digest").where("doc_id = rep").dropDuplicates(["cls"])
    reps = materialize(reps.select("cls", F.col("n_shingles").alias("n"), "sketch", "keys"))
    keyed = reps.select("cls", F.explode("keys").alias("key"))
    shared_keys = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    member = materialize(keyed.join(shared_keys, "key"))
    company = member.groupBy("cls").agg(F.sum("size").alias("company"))
    hub = member.join(company, "cls").groupBy("key").agg(F.max(F.struct("company", "cls"))["cls"].alias("hub"))

    sized = reps.select("cls", "n", "sketch")
    spokes = member.join(hub, "key").where("cls <> hub").select("cls", "hub").distinct()
    star = spokes.join(sized, "cls").alias("p").join(sized.withColumnRenamed("cls", "hub").alias("h"), "hub").where(_plausible("p", "h", percent))
    tried = materialize(star.select(F.col("hub").alias("a"), F.col("p.cls").alias("b")).distinct())
    star = _compared(tried, classes, docs, shingle)
    similar = _similar("shared", "n", "m", percent)
    first = materialize(components(star.where(similar), "a", "b"))
    tidy(docs.sparkSession)

    at = member.join(hub, "key").join(first.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
    at = materialize(at.select("key", "hub", "cls", "comp"))
    mixed = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    known = tried.select(F.col("a").alias("hub"), F.col("b").alias("cls"), F.lit(False).alias("far"))
    open_ = at.join(mixed, "key", "left_semi").join(known, ["hub", "cls"], "left").join(sized, "cls")
    # far: not compared with the hub of its bucket, so only sizes and sketches can rule its pairs out
    far = F.coalesce("far", F.col("cls") != F.col("hub"))
    open_ = materialize(open_.select("key", "cls", "comp", "n", "sketch", far.alias("far")).where(F.col("far") | (F.col("cls") != F.col("hub"))))
    x, y = open_.where("far").alias("x"), open_.alias("y")
    apart = (F.col("x.comp") != F.col("y.comp")) & (~F.col("y.far") | (F.col("x.cls") < F.col("y.cls")))
    cross = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & _plausible("x", "y", percent))
    cross = cross.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).union(_leftovers(star, first, percent)).distinct()
    cross = materialize(cross)
    tidy(docs.sparkSession)
    more = _compared(cross, classes, docs, shingle).where(similar).select("a", "b")
    whole = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "a", "b")

    placed = materialize(classes.join(whole.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    named = placed.groupBy("component").agg(F.min("rep").alias("found"))
    named = placed.join(named, "component").select("digest", "found")
    named = materialize(named)
    for t in (member, at, open_, tried, star, first, reps, cross, classes, placed):
        discard(t)
    tidy(docs.sparkSession)
    # rows without words have no digest; kept out of the join, they don't meet in one task
    brief = signed.select("doc_id", "n_shingles", "digest")
    out = brief.where("digest IS NOT NULL").join(named, "digest", "left").select("doc_id", "n_shingles", "found")
    out = out.union(brief.where("digest IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", kept)


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without the near copies of an earlier document: of each group the one with the
    smallest doc_id stays. Every column is kept as it is. Rows with a null doc_id stay; of rows that
    repeat both doc_id and text one stays; texts that share a doc_id stay or go together, and stay if one
    of them does."""
    found = materialize(near_duplicates(docs, shingle, percent).select("doc_id", "kept"))
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    gone = broadcast_small(materialize(ids.where("NOT kept").select(F.col("doc_id").alias("__gone"))))
    # only rows whose doc_id repeats are compared by text, so other texts aren't shuffled
    again = broadcast_small(materialize(ids.where("n > 1").select(F.col("doc_id").alias("__again"))))
    stay = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    same = docs["doc_id"] == again["__again"]
    return stay.join(again, same, "left_anti").union(stay.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
