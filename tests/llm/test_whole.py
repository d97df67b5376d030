"""Results that are only right when an operator takes in all of its input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import lmscore, secrets


def test_lm_vocabulary_grows_with_the_corpus(spark):
    often, once = [f"word{i:x}q" for i in range(6000)], [f"rare{i:x}z" for i in range(50)]
    docs = spark.createDataFrame([(1, " ".join(often)), (2, " ".join(often + once))], "doc_id long, text string")
    vocabulary = lmscore.learn(docs).vocabulary
    assert vocabulary.size == len(often) + 2
    tokens, first = vocabulary.tokens([" ".join(often), " ".join(once), "neverseen"])
    assert len(set(tokens[first[0] : first[0] + len(often)].tolist()) - {0}) == len(often)
    assert not tokens[first[1] : first[1] + len(once)].any() and not tokens[first[2]]
    # a word that occurs once has its share of such words, not their whole mass
    assert vocabulary.in_class[0] == pytest.approx(-np.log(len(once)))


def test_lm_training_descends_on_every_word(monkeypatch):
    seen = []
    monkeypatch.setattr(lmscore.Network, "train", lambda self, tokens, at, classes, state: seen.extend(tokens[at].tolist()))
    hashes, first = lmscore.hash_words([" ".join(f"w{i}x" for i in range(700))])
    vocabulary = lmscore.Vocabulary(hashes, np.full(len(hashes), 2), 2 * len(hashes), 0)
    texts = [" ".join(f"w{i}x" for i in range(k)) for k in (3, 5, 700)]
    _, words = lmscore._train(vocabulary, texts)
    assert sorted(seen) == sorted(t for k in (3, 5, 700) for t in range(2, k + 2))
    assert words == 708


def test_lm_scores_dont_depend_on_the_partitioning(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "SHARD", 20_000)  # many shards, merged over two levels
    monkeypatch.setattr(lmscore, "MERGE", 4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = [{r.doc_id: r.log_prob for r in lmscore.score(d).collect()} for d in (docs, docs.repartition(7).orderBy(F.desc("doc_id")))]
    assert got[0] == got[1] and len(got[0]) == docs.count()


def test_lm_training_averages_all_shards(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "SHARD", 20_000)
    monkeypatch.setattr(lmscore, "MERGE", 4)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = lmscore.learn(docs)
    shards = -(-docs.agg(F.sum(F.length("text"))).first()[0] // 20_000)
    h = F.xxhash64("doc_id", "text")
    parts = docs.select(F.pmod(h, F.lit(shards)).alias("k"), h.alias("h"), "text").toPandas().sort_values(["h", "text"]).groupby("k")
    nets = [lmscore._train(model.vocabulary, g["text"]) for _, g in parts]
    want = sum(net.flat.astype(float) * n for net, n in nets) / sum(n for _, n in nets)
    # neural kernels may round in another order in another process
    assert np.abs(model.network.flat - want).max() < 1e-3 and len(nets) > 4


def test_lm_letters_at_random_are_worth_less_than_text(spark):
    rng = np.random.default_rng(1)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    noise = [(1_000_000 + i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(100))) for i in range(5)]
    got = lmscore.score(docs.union(spark.createDataFrame(noise, "doc_id long, text string"))).where("n_words > 20").toPandas()
    real, made = (got[(got.doc_id >= 1_000_000) == x].mean_log_prob for x in (False, True))
    assert made.max() < real.quantile(0.02) and made.max() < real.median() - 3


def test_secrets_without_a_digit_or_under_the_least_length():
    scanner = secrets.Scanner()
    texts = ['set password = "CorrectHorseBatteryStaple" here', "api_key=QwXrTbnMkLpZsDfGhJvY end", "passwd: x7Kq2ZrT9b now", "author: Johnson wrote", "token: string", "a token of thanks"]
    assert {c for _, _, _, c, _, _ in scanner.candidates(texts)} >= {"CorrectHorseBatteryStaple", "QwXrTbnMkLpZsDfGhJvY", "x7Kq2ZrT9b"}
    found = scanner.scan(texts, [""] * len(texts))
    assert [(i, s) for i, _, _, s, _ in found] == [(0, "CorrectHorseBatteryStaple"), (1, "QwXrTbnMkLpZsDfGhJvY"), (2, "x7Kq2ZrT9b")]
