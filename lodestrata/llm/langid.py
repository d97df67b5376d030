"""Language identification by cross-parsing entropy over suffix automata.

A text is parsed greedily into the longest phrases that occur in a language's learned text; a language
that explains it needs few, long phrases. With z phrases over n characters and m learned characters,
z * log2(m) / n estimates the cross entropy in bits a character (Ziv and Merhav, 1993), and the language
with the least wins. A suffix automaton of the learned text answers "can the phrase go on?" in one step.

The driver builds the automata once and broadcasts their moves, (state, letter) to state, of which there
are at most three for each learned character, whatever the alphabet. A worker keeps the states whose
strings occur most often as rows of a dense table of bounded size. Most of the others have one move, so the
most frequent move of each is looked up by state and the rest in a hash table. Texts are cut into lanes so that numpy parses thousands of lanes at once, one character of each a
step. A lane is first parsed as if a phrase began with it; the state that the lane before ends in then
corrects it up to the place where both parses are in the same state, so phrases run on across lanes and
are exactly those of a parse from left to right.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, groups_of_texts, held, trim

#: Learned from per language: of up to SAMPLE_DOCS labelled documents, drawn by hash, whole texts up to
#: LEARNED characters in all; over all languages up to LEARNED_IN_ALL characters, shared evenly.
SAMPLE_DOCS, LEARNED, LEARNED_IN_ALL = 160, 80_000, 2_000_000
#: Characters that one step of numpy advances by are as many as there are lanes of so many characters.
LANE = 192
#: Moves in the dense tables of all languages together, four bytes each.
DENSE = 1 << 23
UNKNOWN = "und"
_SPACE, _OTHER = 0, 1


def _folded() -> np.ndarray:
    """For every code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: list[np.ndarray] = []


def fold(text: str) -> np.ndarray:
    """Code points of a text in lower case; each run of anything but letters becomes one space."""
    if not _table:
        _table.append(_folded())
    x = _table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    gap = x == 32
    return x[~(gap & np.concatenate([[False], gap[:-1]]))] if len(x) else x


def suffix_automaton(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Moves of the suffix automaton of a text of letter codes: arrays of state, letter and next state, by
    state; and for each state how often its longest string occurs. State 0 is dead, state 1 is the start,
    so a path from 1 exists for just the substrings of the text."""
    moves: list[dict[int, int]] = [{}, {}]
    link, length, times, last = [0, 0], [0, 0], [0, 0], 1
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(1)
        times.append(1)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                times.append(0)
                while p and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    for state in sorted(range(2, len(moves)), key=length.__getitem__, reverse=True):
        times[link[state]] += times[state]
    n = [len(m) for m in moves]
    letters = np.fromiter((c for m in moves for c in m), np.int32, sum(n))
    to = np.fromiter((t for m in moves for t in m.values()), np.int32, sum(n))
    return np.repeat(np.arange(len(moves), dtype=np.int32), n), letters, to, np.array(times, np.int32)


class _Moves:
    """The moves of one automaton, made complete: where the text can't go on, a phrase ends, and the next
    one begins with the same letter. States are numbered anew by how often their strings occur."""

    def __init__(self, letters: int, dense: int, state: np.ndarray, letter: np.ndarray, to: np.ndarray, times: np.ndarray) -> None:
        order = np.concatenate([[0, 1], 2 + np.argsort(-times[2:].astype(np.int64), kind="stable")])
        number = np.empty(len(times), np.int64)
        number[order] = np.arange(len(times))
        state, letter, to, often = number[state], letter.astype(np.int64), number[to], times[to].astype(np.int64)
        self._letters, self._rows = letters, min(len(times), max(2, dense // letters))
        root = np.zeros(letters, np.int32)
        root[letter[state == 1]] = to[state == 1]
        # a row for each of the first states, and an empty one that stands for all others
        table = np.tile(-root, (self._rows + 1, 1))
        low = state < self._rows
        table[state[low], letter[low]] = to[low]
        self._table = table.ravel()
        state, letter, to, often = state[~low], letter[~low], to[~low], often[~low]
        order = np.lexsort((letter, -often, state))
        state, letter, to = state[order], letter[order], to[order]
        first = np.concatenate([[True], state[1:] != state[:-1]]) if len(state) else np.empty(0, bool)
        self._first = np.full(len(times), -1, np.int64)
        self._first[state[first]] = letter[first] << 32 | to[first]
        key, to = state[~first] << 20 | letter[~first], to[~first]
        self._bits = max(4, (2 * len(key)).bit_length())
        self._mask = (1 << self._bits) - 1
        self._key, self._to = np.full(1 << self._bits, -1, np.int64), np.zeros(1 << self._bits, np.int32)
        while len(key):
            slot = self._slot(key)
            while (taken := self._key[slot] >= 0).any():
                slot[taken] = (slot[taken] + 1) & self._mask
            slot, put = np.unique(slot, return_index=True)
            self._key[slot], self._to[slot] = key[put], to[put]
            key, to = np.delete(key, put), np.delete(to, put)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def __call__(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase has begun. State 0 has read no phrase yet."""
        place = np.minimum(state, self._rows)
        place *= self._letters
        place += letter
        out = self._table.take(place)
        at = np.flatnonzero(state >= self._rows)
        if len(at):
            here, c = state[at], letter[at]
            first = self._first.take(here)
            hit = first >> 32 == c
            out[at] = np.where(hit, first & 0xFFFFFFFF, out[at])
            rest = np.flatnonzero(~hit)
            at, here, c = at[rest], here[rest], c[rest]
            key = here.astype(np.int64) << 20 | c
            slot = self._slot(key)
            while len(at):
                found = self._key.take(slot)
                hit = found == key
                out[at[hit]] = self._to.take(slot[hit])
                more = ~hit & (found >= 0)
                at, key, slot = at[more], key[more], (slot[more] + 1) & self._mask
        return np.abs(out), out <= 0


def automata(texts: dict[str, str]) -> dict:
    """What a Model is made of, in plain arrays: the languages in order, the alphabet, and for each language
    the number of learned characters and the moves."""
    languages = sorted(texts)
    folded = [fold(texts[x]) for x in languages]
    alphabet = np.unique(np.concatenate([np.array([32], np.uint32), *folded]))
    alphabet = alphabet[alphabet != 32]
    code = _codes(alphabet)
    return {"languages": languages, "alphabet": alphabet, "sizes": [len(f) for f in folded], "moves": [suffix_automaton(code[f]) for f in folded]}


def _codes(alphabet: np.ndarray) -> np.ndarray:
    code = np.full(0x110000, _OTHER, np.int32)
    code[32] = _SPACE
    code[alphabet] = np.arange(2, len(alphabet) + 2)
    return code


class Model:
    """Automata of several languages over one alphabet, from learned text per language or from automata()."""

    def __init__(self, texts: dict[str, str] | None = None, made: dict | None = None) -> None:
        made = automata(texts or {}) if made is None else made
        self.languages = made["languages"]
        self._code = _codes(made["alphabet"])
        self._moves = [_Moves(len(made["alphabet"]) + 2, DENSE // len(self.languages), *m) for m in made["moves"]]
        self._bits = np.array([np.log2(max(n, 2)) for n in made["sizes"]])

    def entropies(self, texts: list[str | None]) -> np.ndarray:
        """Bits a character for each text and language; infinite where a text has no letter."""
        codes = [self._code[fold(t)] if isinstance(t, str) and t else np.empty(0, np.int32) for t in texts]
        size = np.array([len(c) if (c != _SPACE).any() else 0 for c in codes], np.int64)
        lanes = -(-size // LANE)
        owner = np.repeat(np.arange(len(codes)), lanes)
        grid, length, row = np.zeros((len(owner), LANE), np.int32), np.full(len(owner), LANE), 0
        for c, n, k in zip(codes, size, lanes, strict=True):
            if k:
                grid[row : row + k].reshape(-1)[:n] = c[:n]
                length[row + k - 1] = n - (k - 1) * LANE
                row += k
        order = np.argsort(-length, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        before = np.full(len(owner), -1)
        before[1:][owner[1:] == owner[:-1]] = place[:-1][owner[1:] == owner[:-1]]
        columns, length, before, owner = np.ascontiguousarray(grid[order].T), length[order], before[order], owner[order]
        del grid, codes
        phrases = np.zeros((len(texts), len(self.languages)))
        for j, moves in enumerate(self._moves):
            phrases[:, j] = np.bincount(owner, _phrases(columns, length, before, moves), len(texts))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(size[:, None] > 0, phrases * self._bits / size[:, None], np.inf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text with a score from 0 to 1: the winner's share of 2 ** -4h over the
        languages. `und` with score 0 if there is no letter; ties go to the language that sorts first."""
        h = self.entropies(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        best = h.argmin(axis=1)
        known = np.isfinite(h[:, 0])
        low = np.where(known, h.min(axis=1), 0)
        with np.errstate(invalid="ignore", over="ignore"):
            share = 1 / np.exp2(-4 * np.where(known[:, None], h - low[:, None], 0)).sum(axis=1)
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, share, 0.0)


def _phrases(columns: np.ndarray, length: np.ndarray, before: np.ndarray, moves: _Moves) -> np.ndarray:
    """How many phrases begin in each lane. `columns` has a row of letters for each step, lanes stand by
    falling length, and `before` is the lane that each one goes on from (-1: none)."""
    states, breaks = np.zeros(columns.shape, np.int32), np.zeros(columns.shape, bool)
    live = np.searchsorted(-length, -np.arange(LANE), side="left")  # lanes longer than each step
    state = np.zeros(len(length), np.int32)
    for step, k in enumerate(live.tolist()):
        if not k:
            break
        state, breaks[step, :k] = moves(state[:k], columns[step, :k])
        states[step, :k] = state
    follows = np.flatnonzero(before >= 0)
    went_in = np.zeros(len(length), np.int32)
    while True:
        goes_in = states[length[before[follows]] - 1, before[follows]]
        at = follows[went_in[follows] != goes_in]
        if not len(at):
            return breaks.sum(axis=0)
        went_in[follows] = goes_in
        state = went_in[at]
        # anew from the state that the lane is entered in, up to where the parse meets the one before
        for step in range(LANE):
            inside = length[at] > step
            at, state = at[inside], state[inside]
            if not len(at):
                break
            state, breaks[step, at] = moves(state, columns[step, at])
            apart = states[step, at] != state
            states[step, at] = state
            at, state = at[apart], state[apart]


def learned_texts(docs: DataFrame, train: Column) -> dict[str, str]:
    """Text to learn from for each non-null lang among the rows where `train` holds: SAMPLE_DOCS documents
    by hash of doc_id, of which whole texts are taken in that order as long as they fit into LEARNED
    characters (of a language whose drawn texts are all longer, the shortest one). With more than
    LEARNED_IN_ALL / LEARNED languages, that bound is shared evenly, so any number of languages is learned."""
    known = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string")))
    order = Window.partitionBy("lang").orderBy("draw", "n")
    ranked = known.select("lang", draw.alias("draw"), F.length("text").alias("n")).withColumn("rank", F.row_number().over(order))
    drawn: dict[str, list] = {}
    for r in ranked.where(F.col("rank") <= SAMPLE_DOCS).toLocalIterator():
        drawn.setdefault(r["lang"], []).append((r["draw"], r["n"]))
    bound = min(LEARNED, LEARNED_IN_ALL // max(len(drawn), 1))
    wanted: dict[str, set] = {}
    for lang, rows in drawn.items():
        left = bound
        for key, n in sorted(rows):
            if n <= left and key not in wanted.get(lang, ()):
                wanted.setdefault(lang, set()).add(key)
                left -= n
        if lang not in wanted:
            wanted[lang] = {min(rows, key=lambda r: (r[1], r[0]))[0]}
    if not wanted:
        return {}
    pairs = [(lang, key) for lang, keys in wanted.items() for key in sorted(keys)]
    # from an Arrow table, as rows would go through Python workers
    chosen = docs.sparkSession.createDataFrame(pa.table({"lang": [x for x, _ in pairs], "draw": [x for _, x in pairs]}))
    # at most SAMPLE_DOCS short rows a language; repeated rows of a key are one text
    rows = known.select("lang", draw.alias("draw"), "text").join(F.broadcast(chosen), ["lang", "draw"], "left_semi").dropDuplicates(["lang", "draw"]).collect()
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(rows):
        out.setdefault(lang, []).append(text)
    return {lang: " ".join(texts) for lang, texts in out.items()}


def identify(docs: DataFrame, train: Column | None = None, model_texts: dict[str, str] | None = None) -> DataFrame:
    """The columns of `docs` with lang_pred and score (0 to 1).

    The model comes from `model_texts` (language to text), or from the text and lang of the rows where
    `train` holds. Null texts and texts without a letter get `und` and score 0. Rows with a null lang are
    predicted like others and not learned from; with nothing to learn from, every row is `und`. Repeated
    rows get the same result; columns named like a new one are replaced; an empty table gives an empty one.
    """
    bound_batches(docs.sparkSession)
    texts = model_texts if model_texts is not None else learned_texts(docs, F.lit(True) if train is None else train)
    made = docs.sparkSession.sparkContext.broadcast(automata(texts))
    # not to be worked out twice, once for a filter on the result and once for the result
    found = F.pandas_udf(_predictor(made, uuid.uuid4().hex), "lang_pred string, score double").asNondeterministic()
    return docs.drop("lang_pred", "score").withColumn("__found", found(F.col("text").cast("string"))).select(
        *(c for c in docs.columns if c not in ("lang_pred", "score")), "__found.lang_pred", "__found.score"
    )


def _predictor(made, key: str):
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = held(key, lambda: Model(made=made.value))
        for batch in batches:
            langs: list[str] = []
            scores: list[float] = []
            for part in groups_of_texts(batch, 2 << 20):
                lang, score = model.predict(part)
                langs += lang
                scores += score.tolist()
            yield pd.DataFrame({"lang_pred": pd.Series(langs, dtype="object"), "score": pd.Series(scores, dtype="float64")})
            trim()

    return predict
