"""Quality rules: text statistics and a learned decision list, all in native expressions.

The list is learned by sequential covering (grow and prune, as in IREP): a rule is a conjunction of
thresholds on statistics that picks out low-quality documents; it grows on two thirds of the labelled
documents by information gain (FOIL), is pruned on the last third, and what it covers is set aside before
the next rule. Growing needs only counts of labels per statistic and bin, so each step is one aggregate
over the labelled statistics, whatever their number. The result is an ordered list of conditions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
#: Statistics that rules may test, as SQL over the columns of text_statistics().
FEATURES = {
    "n_words": "double(n_words)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_rate": "n_symbols / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
}
#: Cut points per statistic, at even quantiles of the labelled documents.
BINS = 32
#: Quantiles are exact up to so many labelled documents, and off by one part in so many ranks beyond.
ACCURACY = 100_000


def text_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns `keep` and, for every row's whole text: n_words, word_chars (code points in words),
    n_symbols, n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words inside a
    window of three words that is found twice or more, every occurrence counting), and n_lines (with a
    word) and n_upper (upper-case letters) for rules. Null is the empty text: all zero.

    Windows are compared by a 64-bit hash. Only a text with a repeated hash goes further: its hashes are
    sorted with their places, the places of equal neighbours are put in order, and each covers up to three
    words that the one before didn't. Nothing is shuffled.
    """
    blank = r"[ \\t-\\r]"
    words = f"filter(split(coalesce(text, ''), '{blank}+'), w -> w <> '')"
    lines = f"filter(split(coalesce(text, ''), '\\n'), l -> l RLIKE '[^ \\\\t-\\\\r]')"
    base = docs.select(*keep, F.coalesce("text", F.lit("")).alias("t"), F.expr(words).alias("ws"), F.expr(lines).alias("ls"))
    base = base.select("*", F.array_join("ws", "").alias("cs"))
    hashes = "IF(size(ws) >= 3, transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2])), array())"
    twice = "size(array_distinct(h)) < size(h)"
    starts = "transform(filter(s, (x, j) -> (j > 0 AND s[j - 1].h = x.h) OR (j < size(s) - 1 AND s[j + 1].h = x.h)), x -> x.i)"
    spans = "aggregate(transform(p, (x, j) -> IF(j < size(p) - 1, least(3, p[j + 1] - x), 3)), 0, (a, b) -> a + b)"
    covered = _let("s", "sort_array(transform(h, (x, i) -> struct(x AS h, i AS i)))", _let("p", f"sort_array({starts})", spans))
    repeat = _let("h", hashes, f"IF({twice}, {covered}, 0)")
    count = lambda pattern, of: F.length(of) - F.length(F.regexp_replace(of, pattern, ""))
    return base.select(
        *keep,
        F.size("ws").cast("long").alias("n_words"),
        F.length("cs").cast("long").alias("word_chars"),
        count(f"[{SYMBOLS}]+", "t").cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat).cast("long").alias("n_repeat_words"),
        F.size("ls").cast("long").alias("n_lines"),
        count(r"\p{Lu}+", "t").cast("long").alias("n_upper"),
    )


def _let(name: str, value: str, then: str) -> str:
    """SQL for `then`, in which `name` stands for a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def base_failed() -> Column:
    """Too short, or more than half of its words repeated."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def condition(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Test, ...]


def rule_condition(rule: Rule) -> Column:
    return reduce(and_, (t.condition() for t in rule))


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(map(str, r)) + " -> drop" for r in rules]


def verdict(rules: list[Rule]) -> Column:
    """The ordered conditional: the first rule that fits drops the document, none keeps it."""
    out = None
    for r in rules:
        out = (F if out is None else out).when(rule_condition(r), False)
    return F.lit(True) if out is None else out.otherwise(True)


def decided_by(rules: list[Rule]) -> Column:
    """The first rule that fits, as text; null if none does."""
    out = F
    for r, text in zip(rules, describe(rules), strict=True):
        out = out.when(rule_condition(r), text)
    return out if rules else F.lit(None).cast("string")


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn_rules(labelled: DataFrame, most_rules: int = 8, most_tests: int = 3, least_precision: float = 0.9, least_covered: int = 5) -> list[Rule]:
    """A decision list from rows with statistics, a long `key` and `bad` (boolean).

    `key` decides which third prunes, so the same rows give the same list. Rows whose label is null count
    for nothing; without both labels the list is empty. Memory on the driver is bounded by statistics
    times bins, whatever the number of rows.
    """
    rows = labelled.where("bad IS NOT NULL")
    q = [i / BINS for i in range(1, BINS)]
    cuts = rows.agg(*(F.expr(f"percentile_approx({sql}, array({', '.join(map(str, q))}), {ACCURACY})").alias(f) for f, sql in FEATURES.items())).first()
    if cuts is None or cuts[0] is None:
        return []
    cuts = {f: sorted(set(cuts[f])) for f in FEATURES}
    # bin b of a statistic: how many cut points lie below the value, so value <= cuts[b] and > cuts[b - 1]
    bins = [F.expr(f"size(filter(array({', '.join(f'{c!r}D' for c in cuts[f])}), c -> {FEATURES[f]} > c))").alias(f) for f in FEATURES]
    prune = (F.pmod(F.xxhash64("key"), F.lit(3)) == 0).alias("prune")
    binned = materialize(rows.groupBy(*bins, prune).agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")), partitions=8)

    def test_on_bins(t: Test) -> Column:
        b = cuts[t.feature].index(t.cut)
        return F.col(t.feature) > b if t.above else F.col(t.feature) <= b

    def on_bins(rule: Rule) -> Column:
        return reduce(and_, map(test_on_bins, rule), F.lit(True))

    def histogram(df: DataFrame) -> dict[str, dict[int, tuple[int, int]]]:
        long_ = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).alias("b")) for f in FEATURES))).alias("x")
        got = df.select(long_, "p", "n").groupBy("x.f", "x.b").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()
        out: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in FEATURES}
        for f, b, p, n in got:
            out[f][b] = (p, n)
        return out

    def grow(open_: DataFrame) -> Rule:
        rule: Rule = ()
        while len(rule) < most_tests:
            h = histogram(open_.where(on_bins(rule)))
            p0, n0 = (sum(x[i] for x in next(iter(h.values())).values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best, most = None, 1e-9
            for f, cut in cuts.items():
                p = n = 0
                for b, c in enumerate(cut):
                    p, n = (x + y for x, y in zip((p, n), h[f].get(b, (0, 0)), strict=True))
                    for above, (pp, nn) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        gain = _gain(pp, nn, p0, n0)
                        if pp >= least_covered and gain > most + 1e-9:
                            best, most = Test(f, above, c), gain
            if best is None or best in rule:
                break
            rule = (*rule, best)
        return rule

    def precision(df: DataFrame, rules: list[Rule]) -> list[tuple[float, int]]:
        sums = [F.sum(F.when(on_bins(r), F.col(x)).otherwise(0)) for r in rules for x in ("p", "n")]
        got = [x or 0 for x in df.agg(*sums).first()]
        return [((p - n) / (p + n) if p + n else -1.0, p + n) for p, n in zip(got[::2], got[1::2], strict=True)]

    rules: list[Rule] = []
    left = binned
    while len(rules) < most_rules:
        rule = grow(left.where("NOT prune"))
        if not rule:
            break
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        held = precision(left.where("prune"), prefixes)
        # the shortest prefix among the best
        rule = max(zip(held, prefixes, strict=True), key=lambda x: (x[0][0], -len(x[1])))[1]
        (worth, covered), = precision(left, [rule])
        if covered < least_covered or (worth + 1) / 2 < least_precision:
            break
        rules.append(rule)
        left = left.where(~on_bins(rule))
    discard(binned)
    return rules


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per row of `docs`: doc_id, the statistics, base_failed, kept, and in `rule` the learned rule that fits
    first, if any does.

    Learns a decision list from the documents that `labels` (doc_id, quality 0 or 1) covers, and applies
    it to all. A document that fails the base checks isn't kept. Labels of a doc_id that disagree count as
    low quality; null labels count for nothing, and without labels only the base checks decide. Null and
    empty texts have no words and fail. Repeated rows are judged alike; an empty table gives an empty one.
    """
    stats = materialize(text_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id"))
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("key")).agg((F.min("quality") == 0).alias("bad"))
    rules = learn_rules(stats.join(known, stats["doc_id"] == known["key"]), **options)
    out = stats.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules)).withColumn("rule", decided_by(rules))
