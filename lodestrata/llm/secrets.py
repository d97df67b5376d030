"""Secret scans: candidate strings, and a random forest that removes false positives.

Candidates are long runs of token characters with a digit, quoted values with a digit after "=" or ":", and
any value, quoted or not, after "=" or ":" and a name that holds a secret word. The forest
looks at length, character classes and transitions, dictionary coverage, path and neighbouring words; it
is trained from labelled findings.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, groups_of_texts, release
from .forest import Forest

LEAST, LEAST_QUOTED, CONTEXT = 16, 8, 40
#: Words that go with secrets, words that go with harmless strings, signs of a harmless path,
#: and a small dictionary of words that identifiers are made of.
SECRET_WORDS = ("token", "secret", "password", "passwd", "pwd", "api_key", "apikey", "access_key", "private_key", "auth", "bearer", "credential")
HARMLESS_WORDS = ("sha1", "sha256", "md5", "checksum", "digest", "integrity", "commit", "revision", "uuid", "etag", "example", "placeholder", "order", "invoice", "phone", "isbn")
HARMLESS_PATHS = ("test", "example", "fixture", "mock", "sample", ".lock", ".min.", "vendor", "docs/")
DICTIONARY = (
    "about", "access", "account", "action", "active", "address", "after", "allow", "array", "based", "batch", "before", "block", "build", "button", "cache",
    "change", "check", "class", "client", "close", "cloud", "color", "column", "config", "connect", "content", "control", "count", "create", "current", "data",
    "date", "default", "delete", "detail", "device", "display", "document", "domain", "download", "enable", "error", "event", "example", "field", "file", "filter",
    "first", "folder", "format", "frame", "function", "group", "handle", "header", "height", "image", "index", "input", "insert", "item", "label", "last",
    "layout", "level", "library", "limit", "list", "local", "login", "manager", "mail", "message", "method", "mode", "model", "module", "name", "network",
    "node", "number", "object", "offset", "open", "option", "order", "output", "page", "parent", "password", "path", "point", "policy", "position", "process",
    "product", "profile", "project", "public", "query", "queue", "record", "region", "report", "request", "response", "result", "return", "root", "route", "sample",
    "schema", "screen", "search", "section", "select", "server", "service", "session", "setting", "shape", "single", "size", "source", "stack", "start", "state",
    "status", "storage", "stream", "string", "style", "submit", "system", "table", "target", "task", "template", "test", "text", "theme", "time", "title",
    "token", "tree", "type", "update", "upload", "user", "value", "version", "view", "width", "window", "worker", "write", "year",
)
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="]] = True
_DIGIT = np.zeros(256, np.int64)
_DIGIT[[*b"0123456789"]] = 1
#: What stands before and after the sign that assigns a value to a secret-like name.
_NAME = re.compile(rb"(?:" + "|".join(SECRET_WORDS).encode() + rb")[\w-]*[\"'`]?[ \t]*$", re.IGNORECASE)
_VALUE = re.compile(rb"[ \t]*[\"'`]?")
_ANY_WORD = re.compile("|".join(sorted(DICTIONARY, key=len, reverse=True)))
FEATURES = 16


def _bigrams() -> dict[str, float]:
    """Log-probabilities of letter pairs in the dictionary, add-one."""
    counts: dict[str, int] = {}
    for w in DICTIONARY:
        for a, b in zip(w, w[1:], strict=False):
            counts[a + b] = counts.get(a + b, 0) + 1
    total = sum(counts.values()) + 36 * 36
    return {k: float(np.log((v + 1) / total)) for k, v in counts.items()} | {"": float(np.log(1 / total))}


_PAIRS = _bigrams()


def describe(candidate: str, before: str, after: str, path: str) -> list[float]:
    """The FEATURES numbers that the forest sees of a candidate and its surroundings."""
    n, low, left, where = len(candidate), candidate.lower(), before.lower(), path.lower()
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in candidate]
    share = np.array([low.count(c) for c in set(low)]) / n
    pairs = [_PAIRS.get(low[i : i + 2], _PAIRS[""]) for i in range(n - 1)] or [_PAIRS[""]]
    return [
        n, kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("s") / n, len(share) / n,
        float(-(share * np.log2(share)).sum()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        float(np.mean(pairs)),
        sum(len(m) for m in _ANY_WORD.findall(low)) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        float(any(w in left for w in SECRET_WORDS)),
        float(any(w in left or w in after.lower() for w in HARMLESS_WORDS)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in "\"'`" and before[-1:] != "" and before[-1:] == after[:1]),
        float(any(w in where for w in HARMLESS_PATHS)) + 2 * float(before[-1:] in "/.@#-" and before[-1:] != ""),
    ]


def labelled_findings(n: int = 1600, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """A table of findings to learn from, built by rule: candidate, text before, text after, path, label.

    Label 1: random hex, base64 and key-like strings assigned to names that hold secrets. Label 0:
    checksums, ids and uuids under their own names, identifiers made of words, numbers, addresses in
    paths, placeholders, and repeated characters.
    """
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    text = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=k))
    hex_, digits = "0123456789abcdef", "0123456789"
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    words = lambda k: [pick(DICTIONARY) for _ in range(k)]
    paths = ("src0", "src7", "app/settings.py", "deploy/env.sh", "README.md", "server/config.yml", "web/index.ts")
    out = []
    for i in range(n):
        lead, tail, path = " ".join(words(3)), " ".join(words(3)), pick(paths)
        if i % 2:
            value = pick((text(hex_, pick((32, 40, 64))), text(hex_.upper(), 40), text(b64, pick((24, 32, 40, 44))), pick(("sk_live_", "ghp_", "AKIA", "xoxb-", "")) + text(b64[:62], pick((20, 28, 36)))))
            name = pick(SECRET_WORDS).upper() if rng.random() < 0.3 else pick(SECRET_WORDS)
            quote, sign = pick(("\"", "\"", "'", "")), pick((" = ", "=", ": ", ":"))
            out.append((value, f"{lead} {name}{sign}{quote}", f"{quote}{pick(('', '!!', '###', ';'))} {tail}", path, 1))
            continue
        kind = int(rng.integers(7))
        if kind == 0:
            row = (text(hex_, pick((32, 40, 64))), f"{lead} {pick(HARMLESS_WORDS)}{pick((': ', ' ', '='))}", f" {tail}", path)
        elif kind == 1:
            row = (str(uuid.UUID(bytes=rng.bytes(16))), f"{lead} id {pick(('', '= '))}", f" {tail}", path)
        elif kind == 2:
            row = ("_".join(words(3)) + str(int(rng.integers(100))), f"{lead} {pick(('', 'token = ', 'name: '))}", f" {tail}", path)
        elif kind == 3:
            row = (text(digits, pick((16, 19, 20))), f"{lead} ", f"{pick(('', '!!', '$$$'))} {tail}", path)
        elif kind == 4:
            row = ("/".join(words(3)) + f"/{int(rng.integers(10_000))}", f"{lead} https://", f" {tail}", path)
        elif kind == 5:
            row = (pick("x0a1") * int(rng.integers(16, 40)) + "1", f"{lead} {pick(SECRET_WORDS)} = \"", f"\" {tail}", path)
        else:
            row = (text(hex_, 40), f"{lead} {pick(SECRET_WORDS)} = \"", f"\" {tail}", pick(("test/fixture.json", "docs/example.md", "vendor/mock.lock")))
        out.append((*row, 0))
    # assigned values without a digit or under LEAST characters: random letters, passphrases and short keys
    # against words, names and types
    low = "abcdefghijklmnopqrstuvwxyz"
    for i in range(n // 2):
        lead, name = " ".join(words(3)), pick(SECRET_WORDS)
        quote, sign = pick(("\"", "'", "")), pick((" = ", "=", ": ", ":"))
        if i % 2:
            value = pick((text(b64[:52], pick((16, 20, 24, 32))), "".join(w.title() for w in words(pick((3, 4, 5)))), "".join(text(low, pick((4, 5, 6, 7))).title() for _ in range(4)), text(b64[:62], pick((8, 10, 12, 15)))))
        else:
            value = pick((pick(DICTIONARY), pick(DICTIONARY).title(), text(low, pick((2, 4, 6, 8, 11))), text(low, pick((5, 7, 9))).title(), "_".join(words(2)), "_".join(words(3)), text(digits, pick((1, 2, 4)))))
        out.append((value, f"{lead} {name}{sign}{quote}", f"{quote} {' '.join(words(2))}", "src0", i % 2))
    return out


class Scanner:
    """Finds candidates in texts and keeps those that the forest takes for secrets."""

    def __init__(self, findings: Sequence[tuple[str, str, str, str, int]] | None = None, threshold: float = 0.5) -> None:
        findings = labelled_findings() if findings is None else findings
        self.threshold = threshold
        self.forest = Forest(np.array([describe(*f[:4]) for f in findings]), np.array([f[4] for f in findings]))

    def candidates(self, texts: Sequence[str | None]) -> list[tuple[int, int, int, str, str, str]]:
        """(text, start, end, candidate, before, after), places being code points."""
        parts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        blob = b"\n".join([*parts, b""])
        a = np.frombuffer(blob, np.uint8)
        token = np.concatenate([[False], _TOKEN[a], [False]])
        edge = np.flatnonzero(token[1:] != token[:-1])
        begin, end = edge[::2], edge[1::2]
        if not len(begin):
            return []
        digits = np.add.reduceat(np.append(_DIGIT[a], 0), np.column_stack([begin, end]).ravel())[::2]
        size = end - begin
        quote = np.isin(a[np.maximum(begin - 1, 0)], np.frombuffer(b"\"'`", np.uint8)) & (begin > 0)
        wanted = (digits > 0) & ((size >= LEAST) | (quote & (size >= LEAST_QUOTED)))
        assigned: dict[int, int] = {}
        for at in np.flatnonzero((a == ord("=")) | (a == ord(":"))).tolist():
            if _NAME.search(blob[max(0, at - 4 * CONTEXT) : at].rpartition(b"\n")[2]):
                value_at = _VALUE.match(blob, at + 1).end()
                i = int(np.searchsorted(begin, value_at, side="right")) - 1
                if i >= 0 and value_at < end[i]:
                    assigned.setdefault(i, value_at)
        # what stands before an assigned value in its run stays a candidate of its own
        pieces = [(int(begin[k]), assigned.get(k, int(end[k])), False) for k in np.flatnonzero(wanted).tolist()]
        pieces += [(b, int(end[k]), True) for k, b in assigned.items()]
        out = []
        for b, e, sure in sorted(pieces):
            if e <= b:
                continue
            value = blob[b:e]
            lead = len(value) - len(value.lstrip(b"=-/+"))
            name = None if sure else re.match(rb"[A-Za-z_]+=(?=.)", value[lead:])
            lead += name.end() if name else 0
            b, e = b + lead, e - (len(value) - len(value.rstrip(b"-/+")))
            if e <= b:
                continue
            i = int(np.searchsorted(bounds, b, side="right")) - 1
            lo, hi = int(bounds[i]), int(bounds[i + 1]) - 1
            before = blob[max(lo, b - 4 * CONTEXT) : b].decode("utf-8", "ignore")[-CONTEXT:]
            after = blob[e : min(hi, e + 4 * CONTEXT)].decode("utf-8", "ignore")[:CONTEXT]
            if not sure and e - b < LEAST and not (e - b >= LEAST_QUOTED and re.search(r"[=:]\s*[\"'`]$", before)):
                continue
            start = len(blob[lo:b].decode("utf-8", "surrogatepass"))
            out.append((i, start, start + e - b, blob[b:e].decode(), before, after))
        return out

    def scan(self, texts: Sequence[str | None], paths: Sequence[str | None]) -> list[tuple[int, int, int, str, float]]:
        """(text, start, end, secret, score) for each candidate at or above the threshold, in order."""
        found = self.candidates(texts)
        if not found:
            return []
        scores = self.forest.scores(np.array([describe(c, b, a, paths[i] or "") for i, _, _, c, b, a in found]))
        return [(i, s, e, c, float(p)) for (i, s, e, c, _, _), p in zip(found, scores, strict=True) if p >= self.threshold]


_scanners: dict[float, Scanner] = {}


def _scanner(threshold: float) -> Scanner:
    """The scanner trained from labelled_findings(), once a worker."""
    if threshold not in _scanners:
        _scanners[threshold] = Scanner(threshold=threshold)
    return _scanners[threshold]


def _each(it: Iterator, threshold: float):
    """For batches of (texts, paths): the batch and its findings per text."""
    release()
    for texts, paths in it:
        rows: list[list[tuple[int, int, str, float]]] = []
        names = paths.tolist()
        for part in groups_of_texts(texts):
            found: list[list] = [[] for _ in part]
            for i, s, e, c, p in _scanner(threshold).scan(part, names[len(rows) : len(rows) + len(part)]):
                found[i].append((s, e, c, p))
            rows += found
        yield texts, rows


def find_secrets(docs: DataFrame, path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per secret: doc_id, start (code points from 0), n_chars, kind (hex, base64 or mixed), score
    and secret_sha256. `path` names a column that tells where a text comes from.

    Null and empty texts have none; whole texts are scanned; repeated rows each give theirs; a null doc_id
    or path is allowed; an empty table gives an empty one. The secrets themselves are not returned.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for _, rows in _each(batches, threshold):
            yield pd.Series([[{"start": s, "secret": c, "score": p} for s, e, c, p in row] for row in rows], dtype="object")

    bound_batches(docs.sparkSession)
    found = F.pandas_udf(run, "array<struct<start:long,secret:string,score:double>>")
    where = F.col(path).cast("string") if path else F.lit("")
    out = docs.select("doc_id", F.explode(found(F.col("text").cast("string"), where)).alias("f"))
    secret = F.col("f.secret")
    kind = F.when(secret.rlike("^[0-9a-fA-F]+$"), "hex").when(secret.rlike("^[A-Za-z0-9+/]+=*$"), "base64").otherwise("mixed")
    return out.select("doc_id", F.col("f.start").alias("start"), F.length(secret).cast("long").alias("n_chars"), kind.alias("kind"), "f.score", F.sha2(secret, 256).alias("secret_sha256"))


def redact(docs: DataFrame, path: str | None = None, mark: str = "<SECRET>", threshold: float = 0.5) -> DataFrame:
    """`docs` with `mark` in place of every secret in text. Rows, other columns and texts without a secret
    stay as they are."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, rows in _each(batches, threshold):
            out = []
            for text, row in zip(texts, rows, strict=True):
                for s, e, _, _ in reversed(row):
                    text = text[:s] + mark + text[e:]
                out.append(text)
            yield pd.Series(out, dtype="object")

    bound_batches(docs.sparkSession)
    where = F.col(path).cast("string") if path else F.lit("")
    return docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text").cast("string"), where)).select(*docs.columns)
