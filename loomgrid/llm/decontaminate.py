"""Benchmark decontamination by SimHash of item-sized windows.

For an item of n words every run of n words of a document is a window; both get a
64-bit SimHash over their words, weighted by word length. An index over
``RADIUS + 1`` blocks of the item fingerprints, one for each window size, returns
every item within ``RADIUS`` bits (if no block agreed, the distance would be larger).
Candidates are verified by the exact weighted Jaccard of their 3-word shingles, a
shingle weighing the bytes of its words; at ``threshold`` or above it is a match.
Windows that share no shingle with any item of their size have similarity 0 and are
not fingerprinted, which loses nothing. A document shorter than the item is one window. An
item of fewer than three words is one shingle itself, so its windows match if they are equal.

The items travel to the executors in slices of at most ``ITEM_BYTES`` of text, each
slice one more pass over the documents; documents never move.

Cases: null and empty texts hold no window. Items null or without words match nothing.
Repeated rows of either table give one row. Of windows that tie, the first is reported.
Null ids are kept as null; ids are of type long. Other columns are ignored. Texts of any
length are compared in pieces of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import slices
from loomgrid.llm.textkernel import _BITS, U, Words, mix, shingles, words

K = 3
RADIUS = 15
THRESHOLD = 0.5
ITEM_BYTES = 8 << 20
#: windows, words and shingles that are compared at a time
AT_ONCE, WORDS_AT_ONCE, SHINGLES_AT_ONCE = 50_000, 1 << 16, 1 << 19
MATCH = "doc_id long, item_id long, similarity double, start_word long, n_words long"


def _expand(lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges [lo, lo + n) and the range each belongs to."""
    which = np.repeat(np.arange(len(lo)), n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return lo[which] + at, which


def _lanes(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """(n, 64) weighted +-1 bits of each word."""
    byte = mix(h, 55)[:, None].view(np.uint8).reshape(len(h), 8)
    return (_BITS[byte].reshape(len(h), 64) * weight[:, None]).astype(np.int64)


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0] if len(sums) else np.zeros(0, np.uint64)


def shingle_weight(w: Words, at: np.ndarray) -> np.ndarray:
    n = w.end - w.start
    return sum(n[at + j] for j in range(K)).astype(np.int64)


class Index:
    """Fingerprints and shingles of a slice of the benchmark."""

    def __init__(self, ids: list, texts: list[str], radius: int):
        w = words(pa.array(texts, pa.string()))
        n = np.diff(w.bounds)
        self.ids, self.size, self.radius = ids, n, radius
        sh, at = shingles(w, K)
        item = w.doc[at]
        pair = mix(sh + item.astype(np.uint64) * U(0x9E3779B97F4A7C15))
        _, u = np.unique(pair, return_index=True)
        self.pair, wt = pair[u], shingle_weight(w, at)
        self.total = np.bincount(item[u], wt[u], len(ids)).astype(np.int64)
        o = u[np.argsort(sh[u], kind="stable")]
        self.shingle, head = np.unique(sh[o], return_index=True)
        self.items, self.head = item[o], np.append(head, len(o))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.shingle & U((1 << 20) - 1)).astype(np.int64)] = True
        cum = np.zeros((len(w.hash) + 1, 64), np.int64)
        np.cumsum(_lanes(w.hash, (w.end - w.start)), axis=0, out=cum[1:])
        self.fp = _pack(cum[w.bounds[1:]] - cum[w.bounds[:-1]])
        edge = np.linspace(0, 64, radius + 2).round().astype(int)
        self.blocks = [(U(a), U((1 << (b - a)) - 1)) for a, b in zip(edge[:-1], edge[1:])]
        self.short = {}
        for s in range(1, K):
            h, at = shingles(w, s)
            mine = n[w.doc[at]] == s
            o = np.argsort(h[mine], kind="stable")
            if len(o):
                self.short[s] = h[mine][o], w.doc[at][mine][o]
        self.by_size = {}
        for s in np.unique(n[n >= K]):
            mine = np.flatnonzero(n == s)
            tables = []
            for a, m in self.blocks:
                v = (self.fp[mine] >> a) & m
                order = np.argsort(v, kind="stable")
                tables.append((v[order], mine[order]))
            self.by_size[int(s)] = tables

    def lookup(self, size: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of this size within the radius, all of them."""
        found = []
        for (a, m), (v, item) in zip(self.blocks, self.by_size[size]):
            q = (fp >> a) & m
            lo, hi = np.searchsorted(v, q, "left"), np.searchsorted(v, q, "right")
            at, win = _expand(lo, hi - lo)
            found.append(win * len(self.ids) + item[at])
        key = np.unique(np.concatenate(found))
        win, item = key // len(self.ids), key % len(self.ids)
        ok = np.bitwise_count(fp[win] ^ self.fp[item]) <= self.radius
        return win[ok], item[ok]

    def matches(self, texts: pa.Array, threshold: float) -> dict[str, np.ndarray]:
        """Best window of each (document, item) whose similarity reaches the threshold."""
        w = words(texts)
        parts = [self._short(w), self._long(w, threshold)]
        return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}

    def _short(self, w: Words) -> dict[str, np.ndarray]:
        """First places of the items that are shorter than a shingle."""
        found = [np.zeros((0, 4), np.int64)]
        for s, (key, item) in self.short.items():
            h, at = shingles(w, s)
            lo, hi = np.searchsorted(key, h, "left"), np.searchsorted(key, h, "right")
            e, which = _expand(lo, hi - lo)
            found.append(np.stack([w.doc[at[which]], item[e], at[which] - w.bounds[w.doc[at[which]]], np.full(len(e), s)], 1))
        x = np.concatenate(found)
        x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
        x = x[np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)])] if len(x) else x
        return {"doc": x[:, 0], "item": x[:, 1], "similarity": np.ones(len(x)), "start": x[:, 2], "n": x[:, 3]}

    def _long(self, w: Words, threshold: float) -> dict[str, np.ndarray]:
        none = {k: np.zeros(0, np.int64) for k in ("doc", "item", "start", "n")} | {"similarity": np.zeros(0)}
        if not len(self.shingle):
            return none
        sh, at = shingles(w, K)
        i = np.flatnonzero(self.seen[(sh & U((1 << 20) - 1)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.shingle, sh[i]), len(self.shingle) - 1)
        ok = self.shingle[k] == sh[i]
        i, k = i[ok], k[ok]
        if not len(i):
            return none
        # window starts by size that hold a shared shingle, some places at a time
        found, base = [], int(self.size.max()) + 1
        for lo in range(0, len(i), 20_000):
            entry, which = _expand(self.head[k[lo : lo + 20_000]], self.head[k[lo : lo + 20_000] + 1] - self.head[k[lo : lo + 20_000]])
            pos, size = at[i[lo : lo + 20_000]][which], self.size[self.items[entry]]
            doc = w.doc[pos]
            left, right = w.bounds[doc], w.bounds[doc + 1]
            a = np.maximum(left, pos - size + K)
            b = np.maximum(a, np.minimum(pos, right - size))
            a = np.minimum(a, np.maximum(left, right - size))
            spans = np.unique(np.stack([size, a, b], 1), axis=0)
            start, which = _expand(spans[:, 1], spans[:, 2] - spans[:, 1] + 1)
            found.append(np.unique(start * base + spans[which, 0]))
        key = np.unique(np.concatenate(found))
        best: list[np.ndarray] = []
        shw, index = shingle_weight(w, at), np.full(len(w.hash) + 1, -1, np.int32)
        index[at] = np.arange(len(at))
        for lo in range(0, len(key), AT_ONCE):
            start, size = key[lo : lo + AT_ONCE] // base, key[lo : lo + AT_ONCE] % base
            stop = np.minimum(start + size, w.bounds[w.doc[start] + 1])
            best.append(self._windows(w, start, size, stop, sh, shw, index, threshold))
        x = np.concatenate(best)
        doc, item, start, n, sim = (x[:, 0].astype(np.int64), x[:, 1].astype(np.int64), x[:, 2].astype(np.int64), x[:, 3].astype(np.int64), x[:, 4])
        o = np.lexsort((start, -sim, item, doc))
        o = o[np.concatenate([[True], (doc[o][1:] != doc[o][:-1]) | (item[o][1:] != item[o][:-1])])] if len(o) else o
        return {"doc": doc[o], "item": item[o], "similarity": sim[o], "start": (start - w.bounds[doc])[o], "n": n[o]}

    def _windows(self, w: Words, start: np.ndarray, size: np.ndarray, stop: np.ndarray, sh: np.ndarray, shw: np.ndarray, index: np.ndarray, threshold: float) -> np.ndarray:
        """(document, item, start, words, similarity) of some windows that match; of a document
        and item the best one here."""
        # fingerprints from running sums over the words that lie in some window
        first = int(start[0])
        step = np.zeros(int(stop.max()) - first + 1, np.int64)
        np.add.at(step, start - first, 1)
        np.add.at(step, stop - first, -1)
        used = np.flatnonzero(np.cumsum(step)[:-1] > 0) + first
        fp = np.zeros(len(start), np.uint64)
        place, end = np.searchsorted(used, start), np.searchsorted(used, stop - 1) + 1
        done = 0
        while done < len(start):
            a = int(place[done])
            hi = max(done + 1, int(np.searchsorted(place, a + WORDS_AT_ONCE, "right")))
            b = int(end[done:hi].max())
            cum = np.zeros((b - a + 1, 64), np.int64)
            np.cumsum(_lanes(w.hash[used[a:b]], (w.end - w.start)[used[a:b]]), axis=0, out=cum[1:])
            fp[done:hi] = _pack(cum[end[done:hi] - a] - cum[place[done:hi] - a])
            done = hi
        wins, items = [], []
        for s in np.unique(size):
            g = np.flatnonzero(size == s)
            x, y = self.lookup(int(s), fp[g])
            wins.append(g[x])
            items.append(y)
        win, item = np.concatenate(wins), np.concatenate(items)
        sim = np.zeros(len(win))
        heavy = np.cumsum(size[win])
        lo = 0
        while lo < len(win):
            hi = max(lo + 1, int(np.searchsorted(heavy, (heavy[lo - 1] if lo else 0) + SHINGLES_AT_ONCE, "right")))
            c = slice(lo, hi)
            head, count = index[start[win[c]]].astype(np.int64), np.maximum(stop[win[c]] - start[win[c]] - K + 1, 0)
            count[head < 0] = 0
            j, who = _expand(head, count)
            o = np.lexsort((sh[j], who))
            if len(o):
                o = o[np.concatenate([[True], (who[o][1:] != who[o][:-1]) | (sh[j][o][1:] != sh[j][o][:-1])])]
            who, j = who[o], j[o]
            pair = mix(sh[j] + item[c][who].astype(np.uint64) * U(0x9E3779B97F4A7C15))
            hit = self.pair[np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)] == pair
            n = len(count)
            own, both = np.bincount(who, shw[j], n), np.bincount(who[hit], shw[j[hit]], n)
            sim[c] = both / np.maximum(own + self.total[item[c]] - both, 1)
            lo = hi
        good = sim >= threshold
        win, item, sim = win[good], item[good], sim[good]
        doc = w.doc[start[win]]
        o = np.lexsort((start[win], -sim, item, doc))
        o = o[np.concatenate([[True], (doc[o][1:] != doc[o][:-1]) | (item[o][1:] != item[o][:-1])])] if len(o) else o
        return np.stack([doc[o], item[o], start[win][o], (stop - start)[win][o], sim[o]], 1).astype(np.float64)


def indexes(benchmark: DataFrame, radius: int = RADIUS) -> list[Index]:
    """The benchmark as indexes of bounded size; a benchmark of any size is covered."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / ITEM_BYTES))
    out = []
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).distinct().collect()
        rows.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        if rows:
            out.append(Index([r[0] for r in rows], [r[1] for r in rows], radius))
    return out


def _reporter(index: Index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            m = index.matches(b.column("text"), threshold)
            yield pa.record_batch({
                "doc_id": b.column("doc_id").take(pa.array(m["doc"])),
                "item_id": pa.array([index.ids[i] for i in m["item"]], pa.int64()),
                "similarity": pa.array(m["similarity"]),
                "start_word": pa.array(m["start"].astype(np.int64)),
                "n_words": pa.array(m["n"].astype(np.int64)),
            })

    return run


def _cleaner(index: Index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            clean = np.ones(b.num_rows, bool)
            clean[index.matches(b.column("text"), threshold)["doc"]] = False
            yield b.filter(pa.array(clean))

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): the best window of each
    document and item that match, once however often the row repeats."""
    slim = docs.select("doc_id", "text")
    out = docs.sparkSession.createDataFrame([], MATCH)
    for index in indexes(benchmark, radius):
        out = out.unionByName(slim.mapInArrow(_reporter(index, threshold), MATCH))
    return out.distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """The documents in which no benchmark item occurs; one pass, nothing is shuffled."""
    for index in indexes(benchmark, radius):
        docs = docs.mapInArrow(_cleaner(index, threshold), docs.schema)
    return docs
