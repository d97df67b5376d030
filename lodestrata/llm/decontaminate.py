"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

A document is contaminated by a benchmark item if some window of as many words as the item has (the whole
text, if it is shorter) is similar to it: weighted Jaccard (sum of least over sum of greatest counts) of
their five-word shingles of 0.8 or more. Such a window shares shingles with the item, and how many at
least follows from the two sizes; places without that many can't match, so windows are only opened where
they are. There, every window gets a SimHash fingerprint of 256 bits, and an index of the items'
fingerprints finds all items within a Hamming radius: the bits are cut into blocks, and two fingerprints
within the radius must be within radius / blocks in at least one block. Each item found is then compared
exactly. At a similarity of 0.8 the fingerprints differ in 39 bits on average (deviation 6), so a radius
of 72 loses none in practice.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, bound_batches, broadcast_small, groups_of_texts, hash_words, materialize, mix64, shingle_hashes

BITS, RADIUS, BLOCKS = 256, 72, 16
#: Bytes of item texts that travel to the workers at once (some five times as many in a worker); more are
#: taken in turns, each of which reads the documents.
SLICE = 16 << 20
_LANES = mix64(np.arange(11, 11 + BITS // 64, dtype=np.uint64))


def signs(shingles: np.ndarray) -> np.ndarray:
    """A row of BITS values +1 or -1 for each shingle hash."""
    wide = mix64(shingles[:, None] ^ _LANES[None, :])
    return np.unpackbits(wide.view(np.uint8), axis=1).astype(np.int16) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of BLOCKS unsigned numbers, from rows of summed signs."""
    return np.packbits((sums > 0).astype(np.uint8), axis=1).view(np.uint16)


class HammingIndex:
    """Fingerprints cut into blocks, with a table for each block from its value to the fingerprints that have
    it. Those within the radius of a query are within radius // blocks of it in one block at least, so all
    values that near are probed, 2,517 a block for 4 of 16 bits (or the block's own values, if there are fewer
    of those); what they hold is compared in full, so none is missed."""

    def __init__(self, fingerprints: np.ndarray, radius: int = RADIUS) -> None:
        self._rows, self._radius = fingerprints, radius
        near = radius // fingerprints.shape[1] if len(fingerprints) else 0
        every = np.arange(1 << 16, dtype=np.uint16)
        self._masks, self._near = every[np.bitwise_count(every) <= near], near
        self._tables = []
        for column in fingerprints.T:
            order = np.argsort(column, kind="stable")
            values, begin = np.unique(column[order], return_index=True)
            self._tables.append((values, np.append(begin, len(column)), order))

    def query(self, fingerprint: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(self._rows), bool)
        for (values, begin, rows), value in zip(self._tables, fingerprint, strict=True):
            if len(values) <= len(self._masks):
                at = np.flatnonzero(np.bitwise_count(values ^ value) <= self._near)
            else:
                probes = self._masks ^ value
                at = np.minimum(np.searchsorted(values, probes), len(values) - 1)
                at = at[values[at] == probes]
            for i in at.tolist():
                hit[rows[begin[i] : begin[i + 1]]] = True
        found = np.flatnonzero(hit)
        distance = np.bitwise_count(self._rows[found] ^ fingerprint).sum(axis=1)
        return found[distance <= self._radius]


def _counts(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets, each as sorted values and counts."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    shared = int(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


class Items:
    """Benchmark items, ready to be looked for in texts."""

    def __init__(self, ids: list[int], texts: list[str], shingle: int, least: float) -> None:
        self.least = least
        words, first = hash_words(texts, drop=PUNCTUATION)
        rows = [(i, words[a:b]) for i, a, b in zip(ids, first[:-1], first[1:], strict=True) if b > a]
        self.ids = [i for i, _ in rows]
        self.n_words = np.array([len(w) for _, w in rows], np.int64)
        self.width = np.minimum(self.n_words, shingle)
        shingles = [shingle_hashes(w, shingle) for _, w in rows]
        self.counts = [_counts(s) for s in shingles]
        self.n_shingles = np.array([len(s) for s in shingles], np.int64)
        self.index = HammingIndex(packed(np.stack([signs(s).sum(axis=0) for s in shingles])) if rows else np.empty((0, BLOCKS), np.uint16))
        self._seeds = {}
        for width in sorted(set(self.width.tolist())):
            of = [j for j in range(len(rows)) if self.width[j] == width]
            values = np.concatenate([self.counts[j][0] for j in of])
            owner = np.repeat(of, [len(self.counts[j][0]) for j in of])
            order = np.argsort(values, kind="stable")
            unique, begin = np.unique(values[order], return_index=True)
            filter_ = np.zeros(1 << 22, bool)
            filter_[(unique & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self._seeds[width] = (unique, np.append(begin, len(values)), owner[order], filter_)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, similarity, first word, words) of the most similar window, for each text and each
        item with one; the earliest of windows that tie."""
        words, first = hash_words(texts, drop=PUNCTUATION)
        for width, (unique, begin, owner, filter_) in self._seeds.items():
            if len(words) < width:
                continue
            runs = shingle_hashes(words, width)
            at = np.flatnonzero(filter_[(runs & np.uint64((1 << 22) - 1)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(unique, runs[at]), len(unique) - 1)
            at, slot = (x[unique[slot] == runs[at]] for x in (at, slot))
            text = np.searchsorted(first, at, side="right") - 1
            inside = at + width <= first[text + 1]
            at, slot, text = at[inside], slot[inside], text[inside]
            if not len(at):
                continue
            times = begin[slot + 1] - begin[slot]
            item = owner[np.repeat(begin[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            at, text = np.repeat(at, times), np.repeat(text, times)
            order = np.lexsort((at, item, text))
            at, text, item = at[order], text[order], item[order]
            edge = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1])]))
            found: dict[tuple[int, int], tuple[float, int, int]] = {}
            for a, b in zip(edge, np.append(edge[1:], len(at)), strict=True):
                j, t = int(item[a]), int(text[a])
                n = int(first[t + 1] - first[t])
                size = min(int(self.n_words[j]), n)
                need = ceil(self.least / (1 + self.least) * (size - width + 1 + int(self.n_shingles[j])) - 1e-9)
                if b - a < need:
                    continue
                self._windows(runs, int(first[t]), n, size, width, at[a:b], need, t, found)
            for (t, j), (s, start, size) in sorted(found.items()):
                yield t, j, s, start, size

    def _windows(self, runs, base, n, size, width, at, need, t, found) -> None:
        """Compare the windows of `size` words that hold at least `need` of the places `at`."""
        span = size - width + 1
        starts = np.unique(np.concatenate([at - i for i in range(span)]))
        starts = starts[(starts >= base) & (starts + size <= base + n)]
        starts = starts[np.searchsorted(at, starts + span) - np.searchsorted(at, starts) >= need]
        # runs of neighbouring windows share their sums
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1) if len(starts) else ():
            region = runs[part[0] : part[-1] + span]
            sums = np.concatenate([np.zeros((1, BITS), np.int32), signs(region).cumsum(axis=0, dtype=np.int32)])
            offset = part - part[0]
            for s, print_ in zip(part.tolist(), packed(sums[offset + span] - sums[offset]), strict=True):
                counts = None
                for j in self.index.query(print_).tolist():
                    if self.width[j] != width or min(self.n_words[j], n) != size:
                        continue
                    counts = counts or _counts(runs[s : s + span])
                    value = similarity(counts, self.counts[j])
                    if value >= self.least - 1e-12 and value > found.get((t, j), (0.0,))[0]:
                        found[t, j] = (value, s - base, size)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document and benchmark item that it contains: doc_id, item_id, similarity, first_word,
    n_words (the most similar window).

    Words are split at ASCII white space; A-Z count as a-z, and ASCII punctuation as nothing. An item with
    fewer words than a shingle is one shingle of all its words. Null, empty or wordless texts and items
    match nothing. Whole texts are searched. Repeated items or documents each give their own rows; a null
    doc_id or item_id comes out as null. Other columns are ignored. Empty tables give an empty one.

    Items reach the workers in slices of about SLICE bytes, so any number of them can be looked for.
    """
    bound_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slices = max(1, -(-(items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // SLICE))
    out = None
    for k in range(slices):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).collect()
        part = docs.mapInPandas(_searcher(mine, shingle, least), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = part if out is None else out.union(part)
    return out


def _searcher(rows: list, shingle: int, least: float):
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(ids, texts, shingle, least)
        for pdf in it:
            base, out = 0, []
            names = pdf["doc_id"].tolist()
            for part in groups_of_texts(pdf["text"]):
                out += [(names[base + t], items.ids[j], s, a, n) for t, j, s, a, n in items.search(part)]
                base += len(part)
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "similarity", "first_word", "n_words"]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of `docs` that contain no benchmark item, with all their columns. Rows with a null doc_id
    stay. Rows that share a doc_id go together."""
    bad = broadcast_small(materialize(find_contaminated(docs, benchmark, shingle, least).select(F.col("doc_id").alias("__bad")).distinct()))
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
