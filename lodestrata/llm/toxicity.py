"""Toxicity scores by a counterfactually regularised logistic regression.

Features are words and word beginnings (hashed), each by its presence and by its rate in the text. Those
that tell the labels apart are kept. While fitting, identity terms are swapped in labelled sentences (put
in where there are none) and the squared change of the score is penalised, so a neutral mention of a
group moves the score of a text as little as possible, whatever the group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, bound_batches, broadcast_small, groups_of_texts, hash_word_starts, hash_words, materialize

#: Terms that name groups of people: fixed values.
IDENTITY = (
    "women", "men", "gay", "straight", "lesbian", "transgender", "muslim", "christian", "jewish", "hindu", "buddhist", "atheist",
    "black", "white", "asian", "latino", "african", "european", "immigrant", "refugee", "deaf", "blind", "elderly", "young",
)
#: At most so many labelled documents of each label are learned from, drawn by hash of doc_id.
TRAIN_TOXIC, TRAIN_OTHER = 1500, 2500
FEATURES, PAIRS = 4000, 600
WIDTHS = (4, 5, 6, 7, 8)


def _tokens(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings, the text that each belongs to, and words per text."""
    words, first = hash_words(texts, drop=PUNCTUATION)
    starts, _ = hash_word_starts(texts, WIDTHS, PUNCTUATION)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    hashes, owners = np.concatenate([words, *starts]), np.tile(owner, 1 + len(WIDTHS))
    known = hashes != 0
    return hashes[known], owners[known], np.diff(first)


class Model:
    """Feature hashes in order, their weights for presence and rate, and a bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.hashes, self.weights, self.bias = hashes, weights, bias
        self._filter = np.zeros(1 << 20, bool)
        self._filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def rows(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, rate) of each feature that a text has."""
        hashes, owner, n = _tokens(texts)
        if not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        maybe = self._filter[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]
        hashes, owner = hashes[maybe], owner[maybe]
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        key, count = np.unique(owner[hit] * len(self.hashes) + at[hit], return_counts=True)
        text, feature = np.divmod(key, max(len(self.hashes), 1))
        return text, feature, np.log1p(200 * count / (n[text] + 20))

    def all_rows(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """rows() of many texts, worked out a piece at a time."""
        parts, base = [], 0
        for part in groups_of_texts(texts):
            text, feature, rate = self.rows(part)
            parts.append((text + base, feature, rate))
            base += len(part)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        text, feature, rate = self.rows(texts)
        z = np.bincount(text, self.weights[0, feature] + self.weights[1, feature] * rate, len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _select(texts: Sequence[str], toxic: np.ndarray) -> np.ndarray:
    """Hashes of the features whose share of documents differs most between the labels, and of all identity
    terms."""
    unique, t, all_ = np.empty(0, np.uint64), np.empty(0), np.empty(0)
    base = 0
    for part in groups_of_texts(texts):  # one piece at a time, so that only counts add up in memory
        hashes, owner, _ = _tokens(part)
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order] + base
        base += len(part)
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]) if len(hashes) else np.empty(0, bool)
        hashes, hit = hashes[new], toxic[owner[new]]
        merged, at = np.unique(np.concatenate([unique, hashes]), return_inverse=True)
        t = np.bincount(at, np.concatenate([t, hit]), len(merged))
        all_ = np.bincount(at, np.concatenate([all_, np.ones(len(hashes))]), len(merged))
        unique = merged
    n1, n0 = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    p1, p0 = (t + 0.5) / (n1 + 1), (all_ - t + 0.5) / (n0 + 1)
    z = np.abs(p1 - p0) / np.sqrt(p1 * (1 - np.minimum(p1, 0.999)) / n1 + p0 * (1 - np.minimum(p0, 0.999)) / n0)
    often = all_ >= 4
    chosen = np.lexsort((unique[often], -z[often]))[:FEATURES]
    return np.union1d(unique[often][chosen], hash_words([" ".join(IDENTITY)])[0])


def counterfactuals(texts: Sequence[str], terms: Sequence[str] = IDENTITY, seed: int = 5) -> tuple[list[str], list[str]]:
    """Pairs of texts that differ in an identity term alone. A text that has a term gets it swapped for
    another one; other texts get two different terms put in at one place."""
    rng, a, b = np.random.default_rng(seed), [], []
    known = set(terms)
    for text in texts:
        words = text.split(" ")
        at = next((i for i, w in enumerate(words) if w.lower().strip(".,;:!?") in known), None)
        one, two = (terms[i] for i in rng.permutation(len(terms))[:2])
        if at is None:
            at = int(rng.integers(len(words) + 1))
            a.append(" ".join([*words[:at], one, *words[at:]]))
            b.append(" ".join([*words[:at], two, *words[at:]]))
        else:
            other = one if words[at].lower().strip(".,;:!?") != one else two
            a.append(text)
            b.append(" ".join([*words[:at], other, *words[at + 1 :]]))
    return a, b


def fit(texts: Sequence[str], toxic: Sequence[int], weight: Sequence[float] | None = None, penalty: float = 2.0, decay: float = 1e-3, steps: int = 400) -> Model:
    """Fit by full-batch Adam: log loss, weight decay, and `penalty` times the mean squared change of the
    score under swapped identity terms. Without both labels the model is a constant."""
    y = np.asarray(toxic, bool)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    if not len(y) or y.all() or not y.any():
        return Model(np.empty(0, np.uint64), np.zeros((2, 0)), -3.0 if not len(y) or not y.any() else 3.0)
    model = Model(hashes := _select(texts, y), np.zeros((2, len(hashes))), 0.0)
    pick = np.random.default_rng(7).permutation(len(texts))[:PAIRS]
    a, b = counterfactuals([texts[i] for i in pick])
    (ti, fi, xi), (ta, fa, xa), (tb, fb, xb) = (model.all_rows(t) for t in (texts, a, b))
    n, k, m = len(y), len(hashes), len(a)
    theta, mean, var = np.zeros(2 * k + 1), np.zeros(2 * k + 1), np.zeros(2 * k + 1)
    w = w / w.sum()

    def logits(theta, t, f, x, n):
        return np.bincount(t, theta[f] + theta[k + f] * x, n)

    for step in range(1, steps + 1):
        off = w * (1 / (1 + np.exp(-(logits(theta, ti, fi, xi, n) + theta[-1]))) - y)
        change = (logits(theta, ta, fa, xa, m) - logits(theta, tb, fb, xb, m)) * (2 * penalty / max(m, 1))
        grad = decay * theta
        grad[-1] = off.sum()
        for t, f, x, g in ((ti, fi, xi, off), (ta, fa, xa, change), (tb, fb, xb, -change)):
            grad[:k] += np.bincount(f, g[t], k)
            grad[k : 2 * k] += np.bincount(f, g[t] * x, k)
        mean, var = 0.9 * mean + 0.1 * grad, 0.999 * var + 0.001 * grad**2
        theta -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    return Model(hashes, theta[:-1].reshape(2, k), float(theta[-1]))


def learn(docs: DataFrame, labels: DataFrame, train: Column) -> Model:
    """Learn from the labelled documents where `train` (over doc_id) holds; the documents drawn are weighed
    so that each label keeps its share. Labels that disagree on a doc_id count as toxic."""
    known = labels.where(F.col("toxic").isNotNull() & train).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic IN (0, 1)")
    totals = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    draw = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    chosen = None
    for label, most in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER)):
        some = known.where(F.col("toxic") == label).orderBy(draw).limit(most)
        chosen = some if chosen is None else chosen.union(some)
    rows = docs.select("doc_id", "text").join(broadcast_small(materialize(chosen)), "doc_id").where("text IS NOT NULL").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (r[0], r[1]))
    toxic = [r[2] for r in rows]
    share = {t: totals[t] / max(toxic.count(t), 1) for t in totals}
    return fit([r[1] for r in rows], toxic, [share[t] for t in toxic])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs` with score (0 to 1) and predicted (1 if the score is 0.5 or more, else 0).

    Only the text counts. Null and empty texts get the score of a text without features. Whole texts are
    scored; repeated rows alike; columns named like a new one are replaced; empty tables give empty ones.
    """

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.concatenate([model.scores(part) for part in groups_of_texts(batch)] or [np.empty(0)]), dtype="float64")

    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*kept, F.pandas_udf(scored, "double")(F.col("text").cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
