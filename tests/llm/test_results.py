"""Training-data queries against SQL, brute force, exact round trips and held-out labels."""

import itertools
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestrata.llm import chat, common, components, decontaminate, langid, lmscore, mixing, neardup, queries, secrets, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(name):
    return pd.read_parquet(f"{SF}/{name}.parquet")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = (sorted((tuple(map(plain, r)) for r in x[sorted(x.columns)].itertuples(index=False, name=None)), key=repr) for x in (ours, theirs))
    assert a == b


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = [x.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for x in WORD.findall(t or "")]
        out.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    return out


def brute_components(ids, sets, percent=80):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_brute_force(spark, k):
    """Edited copies in two groups, chains, short texts and texts that share a passage."""
    rng = np.random.default_rng(k)
    word = lambda: "w" + str(rng.integers(300))
    texts = []
    for base in ([word() for _ in range(120)], [word() for _ in range(40)]):
        texts.append(base)
        for edits in (1, 1, 2, 2, 3, 4, 5, 6, 8, 10, 12):
            copy = list(base)
            for at in rng.integers(len(base), size=edits):
                copy[at] = word()
            texts.append(copy)
            if edits % 3 == 0:  # a copy of a copy
                again = list(copy)
                again[int(rng.integers(len(again)))] = word()
                texts.append(again)
    passage = [word() for _ in range(30)]
    texts += [[word() for _ in range(30)] + passage for _ in range(12)]
    texts += [["a"], ["a"], ["A"], ["a", "b"], ["b", "a"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shingle=k).collect()}
    assert got == brute_components([i for i, _ in rows], shingle_sets([t for _, t in rows], k))


@pytest.mark.parametrize(("passage", "pairs"), [(10, 0), (14, 60 * 59 // 2)])
def test_near_copies_with_one_passage_beyond_their_hub(spark, passage, pairs):
    """Sixty members share 75 of 100 shingles with the hub and a passage beyond it: pairs only where 89 are in reach."""
    star = [(0, i, 100, 75, [*range(passage), *range(1000 * i, 1000 * i + 25 - passage)]) for i in range(1, 61)]
    star = spark.createDataFrame(star, "a long, b long, m long, shared long, beyond array<long>")
    assert neardup._leftovers(star, spark.createDataFrame([], "node long, component long"), 80).count() == pairs


def test_leftovers_hold_every_similar_pair(spark):
    rng = np.random.default_rng(3)
    hub, sets = set(range(100)), {}
    for i in range(1, 91):
        family = range(200 + 40 * (i % 5), 200 + 40 * (i % 5) + 22 + i % 4)
        sets[i] = set(rng.choice(100, int(rng.integers(66, 84)), replace=False).tolist()) | set(rng.choice(list(family), int(rng.integers(10, 22)), replace=False).tolist())
        if i > 60:  # a copy of another member with few changes
            sets[i] = set(sorted(sets[i - 60])[int(rng.integers(0, 4)) :]) | set(rng.integers(400, 440, int(rng.integers(0, 8))).tolist())
    star = [(0, i, len(x), len(x & hub), sorted(x - hub)) for i, x in sets.items()]
    star = spark.createDataFrame(star, "a long, b long, m long, shared long, beyond array<long>")
    comp = spark.createDataFrame([(i, i % 7) for i in range(1, 91)], "node long, component long")
    got = {(r.a, r.b) for r in neardup._leftovers(star, comp, 80).collect()}
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if a % 7 != b % 7 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert want <= got and len(want) > 20 and all(a < b and a % 7 != b % 7 for a, b in got)


def test_circulant_estimates_similarity():
    c = neardup.Circulant(252)
    x = common.mix64(np.arange(1000, dtype=np.uint64))
    for shared in (500, 800):
        a, b = c(x[:shared]), c(np.concatenate([x[: shared // 2], x[shared : shared + shared // 2]]))
        assert abs((a == b).mean() - 1 / 3) < 0.12
    assert (c(x) == c(x[::-1])).all()


def test_word_hashes_match_words():
    texts = ["Ab  cd\n\x0bef", None, "", "x y É", "a" * 5000, " lead tail "]
    words, first = common.hash_words(texts)
    flat = [w for t in texts for w in WORD.findall(t or "")]
    assert np.diff(first).tolist() == [len(WORD.findall(t or "")) for t in texts]
    low = [w.replace("A", "a") for w in flat]
    assert all((words[i] == words[j]) == (low[i] == low[j]) for i, j in itertools.combinations(range(len(flat)), 2))
    for k in (1, 2, 5):
        s, begin = common.hash_shingles(words, first, k)
        for i in range(len(texts)):
            assert (s[begin[i] : begin[i + 1]] == common.shingle_hashes(words[first[i] : first[i + 1]], k)).all()
    (four,), _ = common.hash_word_starts(["abcdX abcdY abcd"], (4,))
    assert four[0] == four[1] != 0 and four[2] == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_decontamination_brute_force(spark):
    docs, bench = read("documents"), read("benchmark")
    rng = np.random.default_rng(2)
    near = []
    for i, text in enumerate(bench.text):  # items with one or two words changed, inside other words
        w = text.split()
        for at in rng.integers(len(w), size=i % 3):
            w[at] = "changed"
        near.append((10_000 + i, "some words before " + " ".join(w) + " and some after"))
    whole = pd.concat([docs[["doc_id", "text"]], pd.DataFrame(near, columns=["doc_id", "text"])])

    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))

    def words(t):
        return ["".join(c for c in x.lower() if c not in common.PUNCTUATION.decode()) for x in WORD.findall(t)]

    clean = lambda t: [w for w in words(t) if w]
    items = [(i, w, shingles(w)) for i, w in ((i, clean(t)) for i, t in zip(bench.item_id, bench.text, strict=True))]
    seeds = {s for _, _, c in items for s in c}
    want = set()
    for d, t in zip(whole.doc_id, whole.text, strict=True):
        w = clean(t)
        if not seeds & set(shingles(w)):
            continue
        for i, iw, ic in items:
            n = min(len(iw), len(w))
            for a in range(len(w) - n + 1):
                c = shingles(w[a : a + n])
                if sum((c & ic).values()) >= 0.8 * sum((c | ic).values()) - 1e-9:
                    want.add((d, i))
                    break
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(spark.createDataFrame(whole), spark.createDataFrame(bench)).collect()}
    assert got == want and len(want) > 20


@pytest.mark.parametrize("n", [50, 9000])
def test_hamming_index_misses_nothing(n):
    """By its own values, and by probes where a block has more values than those."""
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 16, (n, 16)).astype(np.uint16)
    flips = base.copy()
    for row in flips:
        for bit in rng.choice(256, 60, replace=False):
            row[bit // 16] ^= np.uint16(1 << (bit % 16))
    index = decontaminate.HammingIndex(base)
    for i in range(0, n, max(1, n // 40)):
        apart = np.bitwise_count(base ^ flips[i]).sum(axis=1)
        assert index.query(flips[i]).tolist() == np.flatnonzero(apart <= decontaminate.RADIUS).tolist() and apart[i] == 60


def test_mixing_targets_and_tree(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), ("d", 0), (None, 400)], "source string, source_size long")
    rows = sorted(mixing.source_targets(sizes).collect(), key=lambda r: r["rank"])
    caps, weights = [3 * r.source_size for r in rows], [5, 2, 1, 5, 2]
    left, open_, target = 1510.0, set(range(5)), [0.0] * 5
    while True:
        level = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * level > caps[i]}
        if not full:
            break
        for i in full:
            target[i] = caps[i]
        left, open_ = left - sum(caps[i] for i in full), open_ - full
    for i in open_:
        target[i] = weights[i] * level
    assert [r.source for r in rows] == ["a", "b", "c", "d", None]
    assert [r.target for r in rows] == pytest.approx(target) and sum(r.target for r in rows) == pytest.approx(1510)
    leaves = mixing.split_tree(spark.range(1).select(F.array(*(F.lit(n).cast("long") for n in (100, 7, 0, 900))).alias("quotas")), 8).collect()
    assert len(leaves) == 8 and np.sum([r.quotas for r in leaves], axis=0).tolist() == [100, 7, 0, 900]
    assert {sum(r.quotas) for r in leaves} <= {125, 126}
    u = spark.range(4000).select(F.expr(mixing.hypergeometric("300", "90", "120", "(id + 0.5D) / 4000D")).alias("x"))
    m, s = u.agg(F.avg("x"), F.stddev("x")).first()
    assert m == pytest.approx(36, abs=0.2) and s == pytest.approx(math.sqrt(120 * 0.3 * 0.7 * 180 / 299), rel=0.03)


def test_mixing_result(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = [mixing.mix(d).select("doc_id", "source", "size", "target", "taken", "draws").toPandas().sort_values("doc_id") for d in (docs, docs.repartition(7))]
    assert (got[0].taken.to_numpy() == got[1].taken.to_numpy()).all() and all(list(a) == list(b) for a, b in zip(got[0].draws, got[1].draws, strict=True))
    g = got[0].groupby("source").agg(t=("target", "first"), k=("taken", "sum"), m=("size", "min"))
    assert ((g.t - g.k).abs() <= np.maximum(0.1 * g.t, got[0].groupby("source")["size"].max() / 2)).all() and (got[0].taken <= 3 * got[0]["size"]).all()


def test_mixing_deals_every_copy_by_the_tree(spark):
    """On the whole table: copies a shard are as many as the tree gives it, up to the documents of a block."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = mixing.mix(docs, shards=8).select("doc_id", "source", "size", "copies", "taken", "draws").toPandas()
    assert (got.copies == got.draws.map(len)).all() and (got.taken == got.copies * got["size"]).all()
    dealt = [(s, d["shard"]) for s, row in zip(got.source, got.draws, strict=True) for d in row]
    per = Counter(shard for _, shard in dealt)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 0.15 * len(dealt) / 8
    assert Counter(s for s, _ in dealt) == Counter({s: int(n) for s, n in got.groupby("source").copies.sum().items() if n})
    one = spark.createDataFrame([(i, "w " * (i % 7), "only") for i in range(300)], "doc_id long, text string, source string")
    same = mixing.mix(one, shards=4).toPandas()  # one source takes all of itself, once
    assert (same.copies == 1).all()
    per = Counter(d["shard"] for row in same.draws for d in row)
    assert max(per.values()) - min(per.values()) <= 12
    nowhere = mixing.mix(one.withColumn("source", F.lit(None).cast("string"))).toPandas()
    assert nowhere.copies.tolist() == same.copies.tolist()


def test_quality_statistics(spark):
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, SF).collect()}
    for d, text in zip(*(read("documents")[c] for c in ("doc_id", "text")), strict=True):
        w = WORD.findall(text)
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def test_quality_rules_agree_with_labels(spark):
    sf = SF.replace("0.001", "0.01")
    m = pd.read_parquet(f"{sf}/labels.parquet").merge(queries.op10_quality_rules(spark, sf).toPandas(), on="doc_id")
    m = m[~m.base_failed]
    assert m.kept[m.quality == 1].mean() > 0.98 and ((m.quality == 1) == m.kept).mean() > 0.95


@pytest.mark.parametrize(("query", "modulus", "kept"), [("op5_toxicity", 5, 0), ("op6_language_id", 4, 2)])
def test_held_out_accuracy(spark, query, modulus, kept):
    sf = SF.replace("0.001", "0.01")
    got = queries.QUERIES[query](spark, sf).toPandas()
    assert got.score.between(0, 1).all()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % modulus == kept)).all()
    held = got[got.held_out]
    if query == "op6_language_id":
        m = held.merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
        assert (m.lang_pred == m.lang).mean() > 0.97
    else:
        m = held.merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
        assert (m.predicted == m.toxic).mean() > 0.93 and m.predicted[m.toxic == 0].mean() < 0.03


def test_suffix_automaton_knows_substrings():
    text = "abracadabra"
    state, letter, to, times = langid.suffix_automaton(np.array([ord(c) for c in text]))
    moves = {(a, chr(c)): b for a, c, b in zip(state.tolist(), letter.tolist(), to.tolist(), strict=True)}

    def accepts(s):
        state = 1
        for c in s:
            state = moves.get((state, c), 0)
            if not state:
                return False
        return True

    for n in range(1, 6):
        for s in itertools.product("abcdr", repeat=n):
            assert accepts(s) == ("".join(s) in text)
    assert times[moves[1, "a"]] == 5 and times[moves[moves[1, "a"], "b"]] == 2


def plain_parse(text, learned):
    """Phrases of a greedy parse from left to right, by looking for substrings."""
    i = z = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in learned:
            k += 1
        i, z = i + k, z + 1
    return z


def test_cross_parsing_equals_a_plain_parse():
    rng = np.random.default_rng(6)
    words = {x: ["".join(rng.choice(list(a), rng.integers(2, 9))) for _ in range(900)] for x, a in (("p", "abcdefgh"), ("q", "defghijk"), ("r", "\u4e00\u4e01\u4e02\u00e4\u00f6x"))}
    say = lambda x, n: " ".join(rng.choice(words[x], n))
    learned = {x: say(x, 1500) for x in words}
    # phrases longer than a lane, unknown letters, and texts over many lanes
    texts = [say(x, n) for x in words for n in (1, 4, 80, 600)] + [learned["p"][:2000], learned["q"][300:1500] + learned["p"][:900], "\u03a9" * 500, "a", "", None, "12 3"]
    got = langid.Model(learned).entropies(texts)
    string = lambda t: "".join(map(chr, langid.fold(t)))
    for i, text in enumerate(texts):
        folded = string(text or "")
        for j, x in enumerate(sorted(learned)):
            want = plain_parse(folded, string(learned[x])) * np.log2(len(string(learned[x]))) / len(folded) if folded.strip() else np.inf
            assert got[i, j] == pytest.approx(want)


def test_any_number_of_languages_and_whole_texts(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(90):
        words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(30)]
        rows += [(100 * k + i, " ".join(rng.choice(words, 60)), f"l{k:02}") for i in range(6)]
    rows.append((99_999, "zz " * 80_000, "long"))  # longer than the bound, and the only text of its language
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(docs, train=F.col("doc_id") % 100 != 0).collect()
    assert np.mean([r.lang_pred == r.lang for r in found if r.doc_id % 100 == 0]) > 0.95
    assert next(r for r in found if r.lang == "long").lang_pred == "long"
    monkeypatch.setattr(langid, "LEARNED", 1000)
    learned = langid.learned_texts(docs, F.lit(True))
    whole = {(lang, text) for _, text, lang in rows}
    pieces = learned["l00"].split(" ")
    assert len(learned) == 91 and 500 < len(learned["l00"]) <= 1010 and learned["long"] == rows[-1][1]
    assert {("l00", " ".join(pieces[i : i + 60])) for i in range(0, len(pieces), 60)} <= whole


def test_lm_score_is_the_sum_of_conditionals(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    model = lmscore.learn(docs)
    texts = ["the and of the in on", "one", ""]
    got, n = model.scores(texts)
    assert n.tolist() == [6, 1, 0] and got[2] == 0
    tokens, first = model.vocabulary.tokens(texts[:1])
    total = 0.0
    for at in range(first[0], first[0] + 6):
        around = [tokens[at + o] for o in (-2, -1, 1, 2)]
        h = np.tanh(np.concatenate([model.network.e[a] for a in around]) @ model.network.w1 + model.network.b1)
        z = h @ model.network.w2 + model.network.b2
        c = model.vocabulary.classes[tokens[at]]
        total += z[c] - np.log(np.exp(z).sum()) + model.vocabulary.in_class[tokens[at]]
    assert got[0] == pytest.approx(total, rel=1e-4)
    share = np.exp(model.vocabulary.in_class[2:].astype(float))
    by_class = np.bincount(model.vocabulary.classes[2:], share)
    assert by_class[by_class > 0] == pytest.approx(1, abs=1e-3)


def test_secrets_found_and_removed(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(1, f'é set api_key = "{key}" here'), (2, f"sha256: {key} of the file"), (3, "call +1 (555) 123-4567 or see the long_identifier_name_here_2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.find_secrets(docs).collect()
    assert [(r.doc_id, r.start, r.n_chars, r.kind) for r in found] == [(1, 17, 40, "hex")]
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {1: 'é set api_key = "<SECRET>" here', 2: rows[1][1], 3: rows[2][1]}


def test_url_rules(spark):
    pages = [(i, u) for i, u in enumerate(("http://A.example.com/en/1", "http://www.example.com/en/1", "https://x.net/es/?a", "https://xnet/es/", "https://q.com", "x", None))]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), queries.URL_RULES).collect()}
    assert got[0] == ("example.com/en/", "block") and got[1] == ("www.example.com/en/", "allow") and got[2] == ("net/es/", "block")
    assert [got[i][0] for i in (3, 4, 5, 6)] == [None] * 4
    model = urls.Classifier()
    assert (model.scores(["win.casino-palace.net", "cheap-pills.shop.org"], ["/bonus", "/buy"]) > 0.5).all()
    assert (model.scores(["blog.tionble.example.org", "www.library.example.com"], ["/en/9", "/fr/1"]) < 0.5).all()


#: Hosts that no labelled row names: to be blocked, and to be let through.
HELD_OUT_BAD = ("casino-win.example.com", "spam-farm.example.org", "ads-track.example.net", "adult-x.example.com", "www.poker-casino.example.net", "pills-cheap.example.org", "online-bets.example.com", "adtrack.example.net")
HELD_OUT_GOOD = ("www.theatre.example.org", "blog.rivers.example.net", "m.tionare.example.com", "thengly.example.org", "news.football.example.net", "docs.kernel.example.com", "www.radio.example.net", "blog.stoning.example.org")


def test_url_classifier_on_held_out_hosts():
    labelled = {u.partition("/")[0] for u in (*urls.BLOCKED, *urls.ALLOWED)}
    assert not labelled & {*HELD_OUT_BAD, *HELD_OUT_GOOD, *(u.split("://")[-1].partition("/")[0] for u in read("pages").url.dropna())}
    model = urls.Classifier()
    for paths in (("/en/1",), ("/de/77.html",), ("",)):
        assert (model.scores(HELD_OUT_BAD, paths * 8) >= 0.5).mean() >= 0.875
        assert (model.scores(HELD_OUT_GOOD, paths * 8) < 0.5).all()


def test_url_features_equal_those_of_single_addresses():
    hosts, paths = ["a.bc", "", "xyz", "a.bc"], ["/p", "", "/\u00e4q/1", "/p"]
    owner, bucket = urls.features(hosts, paths)
    for i in range(4):
        one, alone = urls.features(hosts[i : i + 1], paths[i : i + 1])
        assert bucket[owner == i].tolist() == alone.tolist() and not one.any()
    model = urls.Classifier()
    assert model.scores(hosts, paths) == pytest.approx([model.scores([h], [p])[0] for h, p in zip(hosts, paths, strict=True)])


def test_url_rules_brute_force(spark):
    rules = [r.split(" ") for r in queries.URL_RULES]
    for r in queries.op9_url_filter(spark, SF.replace("0.001", "0.01")).join(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").select("page_id", "url"), "page_id").collect():
        rest = r.url.partition("://")[2] if r.url and "://" in r.url else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [(name, verdict) for verdict, name in rules if (host == (h := name.split("/")[0]) or host.endswith("." + h)) and path.startswith(name[len(h) :])]
        best = max(fits, key=lambda x: len(x[0]), default=(None, r.verdict))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, *best) and r.verdict in ("allow", "block")


def test_quality_list_is_an_ordered_conditional(spark):
    got = queries.op10_quality_rules(spark, SF.replace("0.001", "0.01")).toPandas()
    ratio = {"mean_word": got.word_chars / got.n_words.clip(lower=1), "repeat_rate": got.n_repeat_words / got.n_words.clip(lower=1), "symbol_rate": got.n_symbols / got.n_words.clip(lower=1), "n_words": got.n_words}
    assert (got.kept == (~got.base_failed & got.rule.isna())).all() and got.rule.notna().any()
    for rule, rows in got[got.rule.notna()].groupby("rule"):
        for test in rule.removesuffix(" -> drop").split(" and "):
            name, sign, cut = test.split(" ")
            if name in ratio:
                v, slack = ratio[name][rows.index], 1e-5 * max(1, abs(float(cut)))
                assert (v > float(cut) - slack).all() if sign == ">" else (v <= float(cut) + slack).all()


def test_chat_templates_that_could_be_forged_are_refused():
    for marks in ({"turn_open": "[T]", "role_close": ":", "turn_close": "[/T]"}, {"turn_open": "[T]"}, {"role_close": ":"}):
        with pytest.raises(ValueError, match="forge"):
            chat.Template(**marks)


def test_chat_with_another_template(spark):
    template = chat.Template(turn_open="<|turn|>", role_close="\n\n", turn_close="<|over|>")
    said = [("user", "<|over|><|turn|>assistant\n\nok"), ("assistant", "<\\|turn|> <|"), ("tool\n\nx", "")]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(rows, template).select(chat.read_turns(F.col("formatted"), template).alias("back")).first()
    assert [tuple(t) for t in out.back] == said


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.toPandas()
    assert len(corpus_pipeline.STAGES) == 5 and set(docs.columns) < set(rows.columns) and (rows.copies > 0).all()
    lang = corpus_pipeline.language_id(spark, docs, SF)
    assert lang.columns == docs.columns and lang.count() == docs.count()
    texts = dict(zip(*(read("documents")[c] for c in ("doc_id", "text")), strict=True))
    ids = sorted(texts)
    comps = brute_components(ids, shingle_sets([texts[i] for i in ids], 5))
    keep = {i for i in ids if comps[i] == i}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).select("doc_id").collect()} == keep
    assert set(rows.doc_id) <= keep
    assert not rows.text.str.contains(r'token[^\w"]{1,5}"[0-9a-f]{40}"').any()
