"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import chat, decontaminate, langid, lmscore, mixing, neardup, quality, secrets, toxicity, urls

LONG = "alpha beta gamma delta epsilon zeta eta theta " * 3000
DOCS = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
    (4, " \t\n", "en", None), (None, "no id here", None, "b"), (5, LONG, "en", "b"), (6, LONG, "en", "b"), (6, LONG, "en", "b"),
    (7, "mot français très simple écrit pour le modèle de langue", "fr", "c"), (8, "123 456 !!!", "fr", "c"), (9, "x", "en", "c"), (9, "another text", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    extra = ("size", "score", "lang_pred", "kept", "rule", "copies", "n_words")
    return spark.createDataFrame(DOCS, SCHEMA).select("*", *(F.lit(7).alias(c) for c in extra)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (9, 1, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")


def test_near_duplicates(spark, docs, empty):
    rows = neardup.near_duplicates(docs, shingle=2).collect()
    assert len(rows) == len(DOCS)
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert got[6, 8] == (5, False) and got[5, 8] == (5, True)
    assert got[2, 0] == (2, True) and got[None, 2] == (None, True)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7, 8, 9, 9]


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "x"), (None, "nothing like it here at all")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(docs, bench).collect()}
    assert got == {(1, 1), (9, 4)}
    assert decontaminate.find_contaminated(empty, bench).count() == 0
    assert decontaminate.find_contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == len(DOCS) - 3


def test_secrets(spark, docs, empty):
    assert secrets.find_secrets(docs).count() == 0 and secrets.find_secrets(empty).count() == 0
    out = secrets.redact(docs, path="source")
    assert out.columns == docs.columns and out.count() == len(DOCS)
    assert out.where("text IS NULL").count() == 1


def test_lm_score(docs, empty):
    out = lmscore.score(docs)
    assert out.count() == len(DOCS) and set(out.columns) == {*docs.columns, "log_prob", "mean_log_prob"}
    none = out.where("doc_id IN (2, 3, 4)").collect()
    assert all((r.n_words, r.log_prob, r.mean_log_prob) == (0, 0.0, None) for r in none)
    assert lmscore.score(empty).count() == 0


def test_toxicity(spark, docs, labels, empty):
    for known in (labels, labels.limit(0)):
        model = toxicity.learn(docs, known, F.lit(True))
        out = toxicity.score(docs, model).collect()
        assert len(out) == len(DOCS) and all(0 <= r.score <= 1 for r in out)
        assert toxicity.score(empty, model).count() == 0


def test_language(docs, empty):
    out = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert out[2, None] == out[3, ""] == out[8, "123 456 !!!"] == ("und", 0.0)
    assert out[7, DOCS[8][1]][0] == "fr" and out[1, DOCS[0][1]][0] == "en"
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, train=F.lit(False)).collect()} == {"und"}


def test_mixing(docs, empty):
    out = mixing.mix(docs).collect()
    assert len(out) == len(DOCS) and {*mixing.mix(docs).columns} == {*docs.columns, "source_size", "target", "taken", "draws"}
    assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 and len(r.draws) == r.copies for r in out)
    assert mixing.mix(empty).count() == 0


def test_quality(docs, labels, empty):
    out = quality.judge(docs, labels)
    rows = out.collect()
    assert len(rows) == len(DOCS)
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert quality.judge(empty, labels).count() == 0 and quality.judge(docs, labels.limit(0)).count() == len(DOCS)


def test_urls(spark):
    rows = [(1, "http://A.Com/x?y"), (2, None), (3, "no scheme"), (4, "https://"), (5, "x://h"), (1, "http://A.Com/x?y")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages, ["block com/"]).collect()}
    assert got[1] == ("a.com", "/x", "com/", "block")
    assert got[2] == got[3] == got[4] == ("", "", None, "allow") and got[5][:3] == ("h", "", None)
    assert urls.filter_urls(pages.limit(0), []).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a|<"), (1, 1, "assistant", "a|<"), (None, None, None, "x"), (2, 5, "sy\nstem~n", "<|im_start|>")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(chats).select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    got = {r.conv_id: r for r in out}
    assert [tuple(t) for t in got[1].back] == [("user", ""), ("assistant", "a|<"), ("assistant", "a|<")]
    assert got[1].loss == "a|<a|<" and not got[1].valid and got[1].bad_turn == 2
    assert [tuple(t) for t in got[None].back] == [("", "x")]
    assert [tuple(t) for t in got[2].back] == [("sy\nstem~n", "<|im_start|>")]
    assert chat.format_chats(chats.limit(0)).count() == 0
