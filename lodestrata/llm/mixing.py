"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, natively.

Documents of a source stand in an order drawn by hash, cut into blocks by the leading bits of that hash.
A source's target decides how many whole rounds of its blocks the mix takes and where the last round
stops. The block draws of all sources are then dealt to the output shards: a binary tree splits the
vector of quotas at each node, the left half being a multivariate-hypergeometric sample, as if all draws
had been shuffled and cut in two. A leaf's quota of a source is the next run of its blocks, so runs are
disjoint and permuted, and inside a shard the documents are put in an order drawn by hash again.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_small, discard, materialize, tidy

WEIGHTS = (5, 2, 1)
#: Hash bits that order documents (13 hex digits), and the bits that each level of blocks takes of them.
ORDER_BITS, LEVEL_BITS = 52, 12
#: Documents that may be added to bring a source's last round nearer to its target.
FILLS = 4


def _draw(*parts: Column) -> Column:
    """A number from 0 to 2**52 - 1 drawn by hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, ORDER_BITS // 4), 16, 10).cast("long")


def _let(name: str, value: str, then: str) -> str:
    """SQL for `then`, in which `name` stands for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _ln_factorial(x: str) -> str:
    """SQL for ln(x!), by Stirling's series at z = x + 9 brought back by eight divisions; good to 1e-10."""
    low = " * ".join(f"(z - {i}D)" for i in range(1, 9))
    series = f"(z - 0.5D) * ln(z) - z + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * z) - 1D / (360D * z * z * z) - ln({low})"
    return _let("z", f"{x} + 9D", series)


def _ln_choose(n: str, k: str) -> str:
    return f"({_ln_factorial(n)} - {_ln_factorial(k)} - {_ln_factorial(f'({n} - {k})')})"


def hypergeometric(total: str, good: str, drawn: str, u: str) -> str:
    """SQL for how many of `good` among `total` are in a sample of `drawn`, from a uniform number u by the
    inverse distribution function. Counts more than ten deviations from the mean (1e-22) are never drawn."""
    given = f"struct(double({total}) AS n, double({good}) AS k, double({drawn}) AS d, double({u}) AS u)"
    mean = "(v.d * v.k / v.n)"
    spread = f"(10D * sqrt(greatest(0D, {mean} * (v.n - v.k) * (v.n - v.d) / (v.n * greatest(v.n - 1D, 1D)))) + 2D)"
    lo = f"greatest(0D, v.d - (v.n - v.k), double(floor({mean} - {spread})))"
    hi = f"least(v.k, v.d, double(ceil({mean} + {spread})))"
    first = f"exp({_ln_choose('v.k', 'w.lo')} + {_ln_choose('(v.n - v.k)', '(v.d - w.lo)')} - {_ln_choose('v.n', 'v.d')})"
    under = "(v.n - v.k - v.d + i + 1D)"
    ratio = f"IF({under} > 0D, (v.k - i) * (v.d - i) / ((i + 1D) * {under}), 0D)"
    step = f"struct(acc.p * {ratio} AS p, acc.sum + acc.p AS sum, acc.past + IF(acc.sum + acc.p < v.u, 1L, 0L) AS past)"
    past = f"aggregate(sequence(bigint(w.lo), bigint(w.hi)), struct({first} AS p, 0D AS sum, 0L AS past), (acc, i) -> {step}, acc -> acc.past)"
    count = _let("w", f"struct({lo} AS lo, {hi} AS hi)", f"least(bigint(w.lo) + {past}, bigint(w.hi))")
    return _let("v", given, f"IF(v.n > 0D, {count}, 0L)")


def _split(seed: int) -> Column:
    """The left child's share of a node's quotas: half of all draws, source by source."""
    begin = _let("n", "aggregate(quotas, 0L, (a, q) -> a + q)", "struct(n AS pop, (n + 1L) DIV 2L AS want, cast(array() AS array<bigint>) AS out)")
    u = f"bigint(conv(substring(md5(concat_ws(':', 'split:{seed}', level, node, size(acc.out))), 1, {ORDER_BITS // 4}), 16, 10)) / {float(1 << ORDER_BITS)!r}D"
    step = _let("x", hypergeometric("acc.pop", "q", "acc.want", u), "struct(acc.pop - q AS pop, acc.want - x AS want, concat(acc.out, array(x)) AS out)")
    return F.expr(f"aggregate(quotas, {begin}, (acc, q) -> {step}, acc -> acc.out)")


def split_tree(quotas: DataFrame, shards: int, seed: int = 8) -> DataFrame:
    """Deal quotas to shards. `quotas` is one row with the array `quotas` (draws per source, in order);
    the result has shard and that shard's `quotas`, which add up to the given ones. `shards` is a power of
    two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = quotas.select(F.lit(0).alias("level"), F.lit(0).alias("node"), "quotas")
    for level in range(shards.bit_length() - 1):
        halves = nodes.withColumn("left", _split(seed)).withColumn("right", F.zip_with("quotas", "left", lambda a, b: a - b))
        child = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("left").alias("quotas")), F.struct(F.lit(1).alias("side"), F.col("right").alias("quotas"))))
        halves = halves.select("node", child.alias("c"))
        nodes = halves.select(F.lit(level + 1).alias("level"), (F.col("node") * 2 + F.col("c.side")).alias("node"), F.col("c.quotas").alias("quotas"))
    return nodes.select(F.col("node").alias("shard"), "quotas")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Per source (columns source, source_size in code-point order with null last) the target size.

    Weights repeat over the sources; targets share the sum of all sizes by weight, none above `most` times
    its source's size, the excess going to the others by weight. If level L gives each open source L times
    its weight, L is the largest of the levels that come from closing sources in order of size by weight.
    One row per source is all that meets in one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_ = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left.cast("double") / open_.cast("double"))
    target = F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight"))
    return ranked.withColumn("target", target).select("source", "source_size", "rank", "target")


def _cut(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source with a part round: documents whose hash is below `bar`, those up to `last` in order,
    and those in `fill` are in it.

    Documents go in as long as they fit whole; then, FILLS times, the document among the others whose size
    comes nearest to what is still wanted is added to `fill`, if that is better than stopping (only the last
    of them may go over). Two levels of blocks narrow the
    end down, so that only a 2**24th of a source's hashes is ever put in order document by document.
    """
    wanted = materialize(sources.where("rest > 0").select(F.col("source").alias("__s"), "rest"), partitions=1)
    same = F.col("source").eqNullSafe(F.col("__s"))
    docs = sized.join(broadcast_small(wanted), same).select("source", "doc_id", "size", "h", "rest", F.lit(0).cast("long").alias("base"))
    for level in (1, 2):
        shift = ORDER_BITS - level * LEVEL_BITS
        block = docs.withColumn("block", F.shiftright("h", shift))
        sums = block.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("base").alias("base"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) + F.col("base")
        sums = sums.withColumn("upto", upto).where("upto > rest")
        stop = sums.groupBy("source").agg(F.min(F.struct("block", (F.col("upto") - F.col("words")).alias("from"))).alias("at"))
        stop = materialize(stop.select(F.col("source").alias("__s"), F.col("at.block").alias("__b"), F.col("at.from").alias("__f")), partitions=1)
        docs = block.join(broadcast_small(stop), same & (F.col("block") == F.col("__b"))).withColumn("base", F.col("__f")).drop("__s", "__b", "__f", "block")
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = docs.withColumn("upto", F.sum("size").over(order) + F.col("base")).where("upto <= rest")
    last = inside.groupBy("source").agg(F.max(F.struct("h", "doc_id", "size")).alias("last"), F.max("upto").alias("upto"))
    ends = stop.join(wanted.withColumnRenamed("__s", "__w"), F.col("__s").eqNullSafe(F.col("__w")))
    ends = ends.join(last, F.col("__s").eqNullSafe(F.col("source")), "left")
    gap = F.col("rest") - F.coalesce("upto", "__f")
    none = F.array().cast("array<struct<h:bigint,doc_id:bigint,size:bigint>>")
    ends = materialize(ends.select("__s", F.shiftleft("__b", shift).alias("bar"), "last", gap.alias("gap"), none.alias("fill")), partitions=1)
    for i in range(FILLS):
        off = F.abs(F.col("gap") - F.col("size"))
        others = sized.join(broadcast_small(ends), same).where(~_in_part("h", "size")).where("size > 0").where(off < F.abs("gap"))
        if i < FILLS - 1:
            others = others.where("size <= gap")
        best = others.groupBy("source").agg(F.min(F.struct(off.alias("off"), "h", "doc_id", "size")).alias("f"))
        best = ends.join(best, F.col("__s").eqNullSafe(F.col("source")), "left")
        more = F.when(F.col("f").isNull(), F.col("fill")).otherwise(F.concat("fill", F.array(F.struct("f.h", "f.doc_id", "f.size"))))
        ends = materialize(best.select("__s", "bar", "last", (F.col("gap") - F.coalesce("f.size", F.lit(0))).alias("gap"), more.alias("fill")), partitions=1)
    return ends.drop("gap")


def _in_part(h: str, size: str) -> Column:
    here = F.struct(F.col(h).alias("h"), "doc_id", F.col(size).alias("size"))
    within = (F.col(h) < F.col("bar"), here <= F.col("last"), F.array_contains("fill", here))
    return reduce(or_, (F.coalesce(x, F.lit(False)) for x in within))


def n_words(text: Column) -> Column:
    """The size of a text: its number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, shards: int = 16, seed: int = 8, size: Column | None = None) -> DataFrame:
    """Every row of `docs` with its size, source_size, target, copies, taken and draws.

    Size is the number of words of the column text (null: 0), unless `size` gives it. `draws` has one
    (shard, place) per copy that the mix takes of the document, from 0 to `most`: the shard that the copy
    is dealt to and its place there (sort by it, then by doc_id). `copies` is their number, and `taken` is
    copies times size. The same rows give the same result, in any partitioning. Documents are ordered by
    a hash of doc_id; ties and repeated rows follow doc_id and size, and rows alike in those are taken
    alike. A null source is a source of its own; a source without words has target 0. Columns of `docs`
    with one of the new names are replaced. Empty tables give empty ones.

    A source's quota counts its blocks, once for each whole round, then those that the part round begins,
    then one block for the documents that fill the part round up. The splitting tree deals these quotas to
    the shards, so every copy lies in just one shard's run of blocks.
    """
    size = n_words(F.col("text")) if size is None else size
    h = _draw(F.lit(f"mix:{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = materialize(docs.select("source", "doc_id", size.alias("size"), h.alias("h")))
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size"))
    sources = materialize(targets, partitions=1)
    cut = materialize(_cut(sized, sources), partitions=1)
    tidy(docs.sparkSession)

    top = ORDER_BITS - LEVEL_BITS
    blocks = sized.select("source", F.shiftright("h", top).alias("block")).distinct().join(broadcast_small(cut), F.col("source").eqNullSafe(F.col("__s")), "left")
    part = F.coalesce(F.col("block") <= F.shiftright(F.coalesce(F.col("last.h"), F.col("bar") - 1), top), F.lit(False))
    per = blocks.groupBy("source").agg(F.sort_array(F.collect_list("block")).alias("blocks"), F.count_if(part).alias("begun"))
    plan = sources.alias("s").join(per.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).join(cut.alias("c"), F.col("s.source").eqNullSafe(F.col("c.__s")), "left")
    fills = F.coalesce((F.size("fill") > 0).cast("long"), F.lit(0))
    quota = F.col("rounds") * F.size("blocks") + F.when(F.col("rest") > 0, F.col("begun") + fills).otherwise(0)
    plan = materialize(plan.select("s.source", "rank", "source_size", "target", "rounds", "blocks", "begun", "bar", "last", "fill", quota.alias("quota")), partitions=1)
    quotas = plan.agg(F.array_sort(F.collect_list(F.struct("rank", "quota"))).alias("all")).select(F.transform("all", lambda x: x["quota"]).alias("quotas"))
    leaves = split_tree(quotas, shards, seed).select("shard", F.posexplode("quotas").alias("rank", "quota"))
    share = leaves.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"]).alias("share"))
    running = F.transform("share", lambda q, i: F.aggregate(F.slice("share", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    plan = plan.join(share.select("rank", running.alias("ends")), "rank")
    plan = materialize(plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__all"), F.col("target").alias("__target"), "rounds", "blocks", "begun", "bar", "last", "fill", "ends"), partitions=1)

    new = ("size", "source_size", "target", "copies", "taken", "draws")
    kept = [c for c in docs.columns if c not in new]
    wide = docs.select(*kept, size.alias("__size"), h.alias("__h"))
    wide = wide.join(broadcast_small(plan), F.col("source").eqNullSafe(F.col("__source")))
    wide = wide.withColumn("__times", (F.col("rounds") + _in_part("__h", "__size").cast("int")).cast("int"))
    fills_up = F.coalesce(F.array_contains("fill", F.struct(F.col("__h").alias("h"), "doc_id", F.col("__size").alias("size"))), F.lit(False))
    nth = F.array_position("blocks", F.shiftright("__h", top)) - 1

    def draw(e: Column) -> Column:
        at = e * F.size("blocks") + F.when((e == F.col("rounds")) & fills_up, F.col("begun")).otherwise(nth)
        place = _draw(F.lit(f"place:{seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), e.cast("string"))
        return F.struct(F.size(F.filter("ends", lambda x: x <= at)).alias("shard"), place.alias("place"))

    dealt = F.filter(F.transform(F.sequence(F.lit(0), F.col("__times") - 1), draw), lambda d: d["shard"] < shards)
    wide = wide.withColumn("draws", F.when(F.col("__times") > 0, dealt).otherwise(F.array().cast("array<struct<shard:int,place:bigint>>")))
    for t in (sources, cut, sized):
        discard(t)
    tidy(docs.sparkSession)
    copies = F.size("draws")
    return wide.select(*kept, F.col("__size").alias("size"), F.col("__all").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).cast("long").alias("taken"), "draws")
