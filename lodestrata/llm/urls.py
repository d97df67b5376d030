"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, mix64

#: Labelled addresses to learn from: fixed values. 1 is to be blocked.
BLOCKED = (
    "royal-casino.example.com/play", "www.casinos-online.example.net/bonus", "m.mega-casino.example.org/slots.html", "casino-vip.example.com/join/5",
    "free-bets.example.com/odds", "blog.best-bets.example.org/tips/9", "poker-bonus.example.net/spin", "win-jackpot.example.com/claim",
    "cheap-pills.example.com/order", "www.diet-pills.example.org/buy", "viagra-cheap.example.net/sale", "replica-watches.example.com/cheap",
    "link-farm.example.org/seo", "m.content-farm.example.net/tag/6", "spam-mail.example.com/list", "www.bulk-spam.example.org/send",
    "spam-links.example.net/out", "click-farm.example.com/pay", "adult-cams.example.com/live", "www.adult-video.example.net/watch",
    "free-adult.example.org/tube", "x-videos.example.com/hd", "xxx-tube.example.net/top", "hot-singles.example.org/join",
    "ads-server.example.com/banner", "pop-ads.example.net/click", "www.ads-network.example.org/serve", "m.mobile-ads.example.com/pixel",
    "ad-tracker.example.net/t.gif", "click-track.example.org/c", "track-user.example.com/beacon", "tracking-pixel.example.net/p.gif",
    "payday-loans.example.org/apply", "crypto-doubler.example.com/invest", "free-iphone.example.net/win", "prize-claim.example.org/winner",
    "warez-torrent.example.net/serial", "download-crack.example.com/keygen", "malware-dl.example.org/setup.exe", "phish-login.example.net/verify",
)
ALLOWED = (
    "www.library.example.org/en/1", "blog.garden.example.net/en/35", "news.city.example.com/fr/8", "m.weather.example.net/de/7.html",
    "docs.python.example.org/tutorial", "www.university.example.com/courses", "wiki.history.example.org/article/5", "blog.travel.example.com/es/9",
    "www.museum.example.net/visit", "recipes.kitchen.example.com/soup", "forum.cycling.example.org/thread/77", "maps.hiking.example.net/trail/3",
    "www.school.example.com/en/450", "m.journal.example.org/es/222", "blog.music.example.net/fr/150.html", "shop.books.example.com/item/12",
    "morvane.example.org/en/12", "www.keltora.example.org/en/75", "m.sunderby.example.net/en/25", "blog.halvering.example.com/es/533/",
    "brionest.example.com/en/676", "ostwick.example.com/de/474.html", "blog.pellion.example.org/en/777", "lanthered.example.net/es/797",
    "www.corvanish.example.org/fr/334/", "blog.entiron.example.net/de/612", "tessaly.example.net/en/785.html", "m.ranthorn.example.org/en/26",
    "dorending.example.org/en/1631", "www.ulvestor.example.org/es/388", "blog.thassing.example.net/de/7308", "m.istermond.example.org/fr/9662.html",
    "www.astronomy.example.com/stars", "m.bakery.example.net/de/40", "wiki.trains.example.org/fr/61", "blog.painting.example.com/en/903",
    "forum.chess.example.net/es/18", "www.hospital.example.org/de/2", "news.harbour.example.com/en/5120", "docs.compiler.example.net/guide",
)
#: Common English syllables, of which invented names are made that say nothing bad: fixed values.
SYLLABLES = ("al", "ar", "ble", "con", "der", "ed", "en", "er", "est", "ing", "ion", "is", "ly", "ment", "ness", "or", "pro", "ra", "re", "sha", "ta", "th", "ther", "ti", "tion", "ton", "un", "ver")
INVENTED = 150


def invented_hosts(n: int = INVENTED, seed: int = 9) -> list[str]:
    """Hosts with invented names of two or three syllables, to be let through."""
    rng = np.random.default_rng(seed)
    name = lambda: "".join(rng.choice(SYLLABLES, rng.integers(2, 4)))
    return [f"{rng.choice(['', 'www.', 'm.', 'blog.'])}{name()}.example.{rng.choice(['com', 'net', 'org'])}" for _ in range(n)]


#: First labels and paths that addresses of both kinds have. Every labelled host is learned from with them too,
#: so that they speak for neither side.
COMMON_LABELS = ("", "www.", "m.", "blog.")
COMMON_PATHS = ("", "/en/1", "/fr/20.html", "/de/333/", "/es/4444", "/index.html")
#: What a blocked address counts for in the loss.
BLOCKED_COST = np.float32(2.5)
BUCKETS, GRAMS = 1 << 14, (3, 4, 5)


def host_of(url: Column) -> Column:
    """What follows the first "://" up to "/", "?", "#" or the end, A-Z as a-z; empty without "://"."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; empty without "://"."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.endswith(F.col("host"), F.lit("." + self.host))
        return host & F.startswith(F.col("path"), F.lit(self.path))


def parse_rule(text: str) -> Rule:
    """A rule from "allow HOST/PATH" or "block HOST/PATH"; the path begins with its slash."""
    verdict, _, place = text.partition(" ")
    host, slash, path = place.partition("/")
    if verdict not in ("allow", "block") or not host or not slash:
        raise ValueError(f"not a rule: {text!r}")
    return Rule(verdict, host.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})), "/" + path)


def rule_for(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits host and path, as a struct (name, verdict); null if none does. Of rules of
    the same length the first in order of name wins. Rules are part of the plan, so keep them to hundreds."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        out = (F if out is None else out).when(r.fits(), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
    return F.lit(None).cast("struct<name:string,verdict:string>") if out is None else out


def _grams(places: Sequence[str], mark: int) -> tuple[np.ndarray, np.ndarray]:
    """For all character n-grams of "^place$", of many places at once: the place's number, and the bucket,
    a hash of the n-gram, its length and the mark."""
    code = np.frombuffer("".join(f"^{p}$" for p in places).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(places)), [len(p) + 2 for p in places])
    owners, buckets = [], []
    for n in GRAMS:
        k = max(len(code) - n + 1, 0)
        h = np.full(k, n * 4 + mark, np.uint64)
        for i in range(n):
            h = mix64(h ^ code[i : i + k])
        inside = owner[:k] == owner[n - 1 : n - 1 + k]
        owners.append(owner[:k][inside])
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(address, bucket) of the hashed character n-grams of host and path, each bucket of an address once."""
    (a, x), (b, y) = _grams(hosts, 0), _grams(paths, 1)
    key = np.unique(np.concatenate([a, b]) * BUCKETS + np.concatenate([x, y]))
    return key // BUCKETS, key % BUCKETS


class Classifier:
    """Logistic regression over hashed n-grams, by full-batch gradient descent with weight decay."""

    def __init__(self, blocked: Sequence[str] = BLOCKED, allowed: Sequence[str] = ALLOWED, steps: int = 1500, rate: float = 0.5, decay: float = 1e-3) -> None:
        rows = [(u.partition("/"), y) for urls, y in ((blocked, 1.0), ((*allowed, *invented_hosts()), 0.0)) for u in urls]
        bare = lambda host: next((host.removeprefix(x) for x in COMMON_LABELS[1:] if host.startswith(x)), host)
        more = [(COMMON_LABELS[(i + j) % len(COMMON_LABELS)] + bare(h), p, y) for i, ((h, _, _), y) in enumerate(rows) for j, p in enumerate(COMMON_PATHS)]
        rows = [(h, slash + path, y) for (h, slash, path), y in rows] + more
        x = np.zeros((len(rows), BUCKETS), np.float32)
        x[features([h for h, _, _ in rows], [p for _, p, _ in rows])] = 1
        x /= np.sqrt(x.sum(axis=1, keepdims=True))
        y = np.array([y for _, _, y in rows], np.float32)
        cost = np.where(y > 0, BLOCKED_COST, np.float32(1))  # there are fewer of these, and they must not pass
        # the weights stay a combination of the few labelled rows, so descent works on its coefficients
        gram, share, bias = x @ x.T, np.zeros(len(y), np.float32), np.float32(0)
        for _ in range(steps):
            off = (1 / (1 + np.exp(-(gram @ share + bias))) - y) * cost
            share -= np.float32(rate) * (off * np.float32(8 / len(y)) + np.float32(decay) * share)
            bias -= np.float32(rate) * off.mean()
        self.weights, self.bias = share @ x, bias

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Probability of being blocked for each address."""
        owner, bucket = features(hosts, paths)
        total = np.bincount(owner, self.weights[bucket], len(hosts))
        z = total / np.sqrt(np.maximum(np.bincount(owner, minlength=len(hosts)), 1)) + self.bias
        return 1 / (1 + np.exp(-z))


def filter_urls(pages: DataFrame, rules: Sequence[str], model: Classifier | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns of `pages` with host, path, rule, score and verdict (allow or block).

    The longest rule that fits decides, and score is null; where none fits, the classifier blocks at a score
    of `threshold` or more (a tie blocks). Null urls and urls without "://" have an empty host and path, fit no rule and are allowed
    with score 0, as there is nothing to judge. Repeated rows get the same verdict; columns named like a
    new one are replaced; an empty table gives an empty one.
    """
    model = model or Classifier()

    def scored(host: pd.Series, path: pd.Series) -> pd.Series:
        out, open_ = np.full(len(host), np.nan), host.notna().to_numpy()
        if open_.any():
            out[open_] = model.scores(host[open_].tolist(), path[open_].tolist())
        return pd.Series(out, dtype="float64")

    new = ("host", "path", "rule", "score", "verdict")
    kept = [c for c in pages.columns if c not in new]
    out = pages.select(*kept, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("__rule", rule_for([parse_rule(r) for r in rules]))
    # only addresses that no rule decides are looked at
    asked = F.when(F.col("__rule").isNull() & (F.col("host") != ""), F.col("host"))
    score = F.when(F.col("__rule").isNull(), F.when(F.col("host") == "", 0.0).otherwise(F.pandas_udf(scored, "double")(asked, F.col("path"))))
    out = out.withColumn("score", score)
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.select(*kept, "host", "path", F.col("__rule.name").alias("rule"), "score", F.coalesce("__rule.verdict", learned).alias("verdict"))
