"""Language-model scores: masked pseudo-likelihood of a bidirectional window network, trained in numpy.

Every word is predicted from WINDOW words on both sides, itself hidden; the sum of these conditional
log-probabilities scores a document. The output is factored by classes (words in order of frequency, cut
at equal sums of square roots of counts): the network gives the class, the corpus counts give the word in
its class. The vocabulary is every word that occurs twice or more, and no less often than one in RARE
words, so it grows with the corpus up to RARE words at the very most; all rarer words are one token, each
charged its equal share of them, and so is a word that never occurs: letters at random are worth no more
than the rarest word.

Counts cover all words of all documents. Training covers them too. Documents are dealt to shards of about
SHARD characters by a hash of their columns; each shard's network starts from the same parameters and
descends once on every word of its documents, in the order of that hash, and the parameters are averaged,
weighted by words (parallelised stochastic gradient descent, Zinkevich et al. 2010). Neither the shards nor
the order depend on the partitioning, and sums run over groups of MERGE shards level by level in a fixed
order, so the same rows give the same scores on any cluster, and no task holds more than MERGE models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, bound_batches, discard, groups_of_texts, hash_words, materialize

#: Size of the network. The OWN most frequent words have an embedding each as context, the others share
#: SHARED of them.
OWN, SHARED, CLASSES, DIMENSION, HIDDEN, WINDOW = 4096, 1024, 64, 16, 32, 2
BATCH, RATE = 512, 0.006
#: Words that a counting task holds before it hands on their counts.
HELD = 4_000_000
#: A word that is rarer than one in RARE is not of the vocabulary. By Zipf's law a corpus of 100 TB has some
#: four million words that are not (12 bytes each).
RARE = 1 << 26
#: Characters of a shard's documents, and models that are averaged at once.
SHARD, MERGE = 6_000_000, 32


def _count_words(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def counted(parts):
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        return pd.DataFrame({"h": h.view(np.int64), "n": n})

    held, size = [], 0
    for pdf in it:
        for part in groups_of_texts(pdf["text"]):
            held.append(hash_words(part, drop=PUNCTUATION)[0])
            size += len(held[-1])
            if size >= HELD:
                yield counted(held)
                held, size = [], 0
    if size:
        yield counted(held)


class Vocabulary:
    """Token numbers: 0 is a rare word, 1 the padding at the ends of a text, then the other words by
    frequency. `total` counts all words of the corpus, `rare` how many different words are rare."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, rare: int) -> None:
        order = np.argsort(hashes)
        self._hashes, self._ids = hashes[order], (np.arange(len(hashes), dtype=np.int32) + 2)[order]
        self.size = len(hashes) + 2
        mass = np.cumsum(np.sqrt(counts)) if len(counts) else np.empty(0)
        middle = (mass - np.sqrt(counts) / 2) / mass[-1] if len(mass) else mass
        self.classes = np.concatenate([[0, 0], 1 + np.minimum((middle * (CLASSES - 1)).astype(int), CLASSES - 2)]).astype(np.int8)
        weight = np.concatenate([[max(total - int(counts.sum()), 1), 0], counts]).astype(float)
        with np.errstate(divide="ignore"):
            self.in_class = np.log(weight / np.bincount(self.classes, weight, CLASSES)[self.classes]).astype(np.float32)
        self.in_class[0] = -np.log(max(rare, 1))

    def tokens(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of texts, WINDOW paddings before and after each, and where each text begins."""
        hashes, first = hash_words(texts, drop=PUNCTUATION)
        ids = np.zeros(len(hashes), np.int64)
        if len(self._hashes):
            words, which = np.unique(hashes, return_inverse=True)
            slot = np.minimum(np.searchsorted(self._hashes, words), len(self._hashes) - 1)
            ids = np.where(self._hashes[slot] == words, self._ids[slot], 0).astype(np.int64)[which]
        shift = np.arange(1, len(first)) * 2 * WINDOW - WINDOW
        out = np.ones(len(ids) + 2 * WINDOW * (len(first) - 1), np.int64)
        n = np.diff(first)
        out[np.arange(len(ids)) + np.repeat(shift, n)] = ids
        return out, first[:-1] + shift


_AROUND = np.array([*range(-WINDOW, 0), *range(1, WINDOW + 1)])


class Network:
    """Embeddings of the words around, one tanh layer, and class logits; parameters in one flat array."""

    def __init__(self, words: int, flat: np.ndarray | None = None) -> None:
        rows = words if words <= OWN + 2 else OWN + 2 + SHARED
        shapes = ((rows, DIMENSION), (len(_AROUND) * DIMENSION, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
        sizes = [int(np.prod(s)) for s in shapes]
        if flat is None:
            rng = np.random.default_rng(4)
            flat = np.concatenate([rng.normal(0, s, n) for n, s in zip(sizes, (0.3, 0.15, 0, 0.15, 0), strict=True)])
        self.flat = flat.astype(np.float32)
        self.e, self.w1, self.b1, self.w2, self.b2 = (p.reshape(s) for p, s in zip(np.split(self.flat, np.cumsum(sizes)[:-1]), shapes, strict=True))

    @staticmethod
    def _around(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Embedding rows of the words around each place."""
        around = tokens[at[:, None] + _AROUND]
        return np.where(around < OWN + 2, around, OWN + 2 + around % SHARED)

    def _forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = self.e[around].reshape(len(around), -1)
        hidden = np.tanh(x @ self.w1 + self.b1)
        z = hidden @ self.w2 + self.b2
        z -= z.max(axis=1, keepdims=True)
        return x, hidden, z

    def log_classes(self, tokens: np.ndarray, at: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log-probability of the class at each place."""
        _, _, z = self._forward(self._around(tokens, at))
        return z[np.arange(len(at)), classes] - np.log(np.exp(z).sum(axis=1))

    def train(self, tokens: np.ndarray, at: np.ndarray, classes: np.ndarray, state: dict) -> None:
        """One Adam step on the mean log loss at some places; embeddings move by plain scaled gradients of
        the rows that take part."""
        around = self._around(tokens, at)
        x, hidden, z = self._forward(around)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(at)), classes] -= 1
        p /= len(at)
        back = (p @ self.w2.T) * (1 - hidden**2)
        grads = {"w2": hidden.T @ p, "b2": p.sum(axis=0), "w1": x.T @ back, "b1": back.sum(axis=0)}
        wide = (back @ self.w1.T).reshape(-1, DIMENSION)
        rows = around.ravel().astype(np.int16)  # sorted by radix
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        edge = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        rows = rows[edge].astype(np.int64)
        e_grad = np.add.reduceat(wide[order], edge)
        scale = state.setdefault("e", np.zeros(len(self.e), np.float32))
        scale[rows] += (e_grad**2).mean(axis=1)
        self.e[rows] -= 0.05 * e_grad / np.sqrt(scale[rows] + 1e-8)[:, None]
        t = state["t"] = state.get("t", 0) + 1
        for name, g in grads.items():
            m, v = state.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[name] = (m, v)
            getattr(self, name)[...] -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def _places(first: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words, and how many words each text has."""
    n = np.diff(np.append(first, len(tokens) + WINDOW)) - 2 * WINDOW
    begin = np.cumsum(n) - n
    return np.repeat(first - begin, n) + np.arange(n.sum()), n


def _train(vocabulary: Vocabulary, texts) -> tuple[Network, int]:
    """A network that has descended on every word of some texts, piece by piece, and how many words."""
    net, state, seen = Network(vocabulary.size), {}, 0
    for part in groups_of_texts(texts):
        tokens, first = vocabulary.tokens(part)
        at, _ = _places(first, tokens)
        mine = np.random.default_rng(len(tokens)).permutation(at)
        for i in range(0, len(mine), BATCH):
            some = mine[i : i + BATCH]
            net.train(tokens, some, vocabulary.classes[tokens[some]], state)
        seen += len(mine)
    return net, seen


def _trainer(vocabulary):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        net, seen = _train(vocabulary.value, pdf.sort_values(["h", "text"])["text"])
        return pd.DataFrame({"node": pdf["shard"].iloc[:1], "words": [seen], "flat": [net.flat.tobytes()]}) if seen else pd.DataFrame({"node": [], "words": [], "flat": []})

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The average of some models by words, in the order of their numbers."""
    pdf = pdf.sort_values("node")
    total = int(pdf["words"].sum())
    mean = sum(np.frombuffer(f, np.float32).astype(float) * (n / total) for f, n in zip(pdf["flat"], pdf["words"], strict=True))
    return pd.DataFrame({"node": [int(pdf["node"].iloc[0]) // MERGE], "words": [total], "flat": [mean.astype(np.float32).tobytes()]})


class Model:
    """A vocabulary and a trained network."""

    def __init__(self, vocabulary: Vocabulary, network: Network) -> None:
        self.vocabulary, self.network = vocabulary, network

    def scores(self, texts, step: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probability and number of words of each text."""
        tokens, first = self.vocabulary.tokens(texts)
        at, n = _places(first, tokens)
        owner = np.repeat(np.arange(len(n)), n)
        out = np.zeros(len(n))
        for i in range(0, len(at), step):
            some = at[i : i + step]
            ids = tokens[some]
            log_p = self.network.log_classes(tokens, some, self.vocabulary.classes[ids]) + self.vocabulary.in_class[ids]
            out += np.bincount(owner[i : i + step], log_p, len(n))
        return out, n


def learn(docs: DataFrame) -> Model:
    """Counts and network from all texts of `docs`. Of an empty corpus, a model that knows no word. All
    columns together tell to which shard a row goes; rows that agree in all of them go to one shard."""
    bound_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    counts = materialize(docs.select(text.alias("text")).mapInPandas(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(2, -(-total // RARE))
    rare = counts.where(~often).count()
    known = counts.where(often).toArrow()
    discard(counts)
    hashes, n = (known[c].to_numpy() for c in ("h", "n"))
    order = np.lexsort((hashes, -n))
    vocabulary = Vocabulary(hashes[order].view(np.uint64), n[order], total, rare)
    if not total:
        return Model(vocabulary, Network(vocabulary.size))

    shards = max(1, -(-(docs.agg(F.sum(F.length(text).cast("long"))).first()[0]) // SHARD))
    h = F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))))
    dealt = docs.where("text IS NOT NULL").select(F.pmod(h, F.lit(shards)).alias("shard"), h.alias("h"), text.alias("text"))
    schema = "node long, words long, flat binary"
    models = dealt.groupBy("shard").applyInPandas(_trainer(docs.sparkSession.sparkContext.broadcast(vocabulary)), schema)
    while True:
        merged = materialize(models.groupBy(F.expr(f"node DIV {MERGE}")).applyInPandas(_merge, schema))
        shards = -(-shards // MERGE)
        if shards == 1:
            break
        models = merged
    flat = merged.first()["flat"]
    return Model(vocabulary, Network(vocabulary.size, np.frombuffer(flat, np.float32)))


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The columns of `docs` with n_words, log_prob (the sum) and mean_log_prob (per word).

    Words are split at ASCII white space, A-Z count as a-z, ASCII punctuation as nothing. Null texts and
    texts without a word get n_words 0, log_prob 0 and a null mean. Without `model` one is learned from
    `docs`. Whole texts are scored; repeated rows alike; columns named like a new one are replaced; an
    empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [model.value.scores(part) for part in groups_of_texts(batch)] or [(np.empty(0), np.empty(0, int))]
            yield pd.DataFrame({"log_prob": np.concatenate([p for p, _ in parts]), "n_words": np.concatenate([n for _, n in parts]).astype(np.int64)})

    kept = [c for c in docs.columns if c not in ("n_words", "log_prob", "mean_log_prob")]
    out = docs.withColumn("__s", F.pandas_udf(scored, "log_prob double, n_words long")(F.col("text").cast("string")))
    return out.select(*kept, "__s.n_words", "__s.log_prob", F.when(F.col("__s.n_words") > 0, F.col("__s.log_prob") / F.col("__s.n_words")).alias("mean_log_prob"))
