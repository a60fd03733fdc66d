"""SimHash near-dedup with pivot distance tables.

Each document gets a 128-bit SimHash over its distinct words and word pairs. Documents with
equal fingerprints are one point from then on. A point's row of the pivot table has its
distance to a reference fingerprint in each of ``BLOCKS`` blocks of bits. With these the
distances to all 2**``BLOCKS`` references that differ from it by whole blocks are known, and
the maximum difference of two points' distances over all these references is the sum of the
blocks' differences. If that is beyond the radius so is the distance; survivors are verified
by their true distance. Verified pairs are joined to groups by connected components.

Every pair of points within the radius is found. Of a pair within ``RADIUS`` bits one of the two
words of 64 bits differs by 13 at most; and of that word, cut into blocks, one block differs by so
few bits (3 of 16, say) that only points whose blocks lie in that small ball need be compared. The
points are dealt to chunks by their hash, and a task takes two chunks (or one with itself), so a
point is shuffled once a chunk, 16 bytes each. A task looks up the ball of each block in sorted
keys, compares the word, and verifies what is left. Points that it has connected already are not
connected again, so it gives fewer edges than it has points, however many near copies there are.
The pairs that are looked at are a share of all pairs (5 to 25 %, less with more points in a chunk):
the work grows with the square of the points, by small steps.

Cases: null and empty texts, and texts without any word, belong to no group. Repeated
rows (same id and text) are copies of each other. Ties go to the least doc_id, nulls
last. Of rows equal in id and text that differ elsewhere, one stays, any of them. Ids are of
type long. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import connected_components, materialize, row_key, sized_join, slices
from loomgrid.llm.textkernel import U, hamming, mix, shingles, simhash, words

BLOCKS = 32
RADIUS = 27
#: Points of a chunk; fewer points still make up to ``LEAST_CHUNKS``, of ``SMALL`` at least.
CELL = 1 << 18
LEAST_CHUNKS = 8
SMALL = 1 << 12
#: Points that share the bits of a block on average, at least; with fewer, blocks are narrower.
SHARE = 16
#: Fingerprints that are spread at a time, pairs of words that are compared at a time.
AT_ONCE = 1 << 16
COLUMNS = 1 << 12
MOST_TASKS = 20_000
PAIRS = 200_000
#: Words of which the features are taken at a time.
FEATURES = 1 << 18
_NIBBLE = np.bitwise_count(np.arange(16, dtype=np.uint8))


def chunks_for(points: int, cell: int = CELL) -> int:
    """Number of chunks; each two of them make a task, and each with itself."""
    return max(1, math.ceil(points / cell), min(LEAST_CHUNKS, points // min(SMALL, cell)))


def task_of(i: np.ndarray, j: int, chunks: int) -> np.ndarray:
    """Number of the task of two chunks, in any order."""
    return np.minimum(i, j) * chunks + np.maximum(i, j)


def share_out(most: int, parts: int) -> list[int]:
    """Bits by which each part may differ so that of any two points that differ by ``most`` at
    most, one part differs by no more than its own; -1 for parts that needn't be looked at."""
    least, more = divmod(most + 1, parts)
    return [least - 1 + (k < more) for k in range(parts)]


def blocks_for(points: int, most: int) -> list[tuple[int, int, int]]:
    """(shift, width, bits that may differ) of the blocks of a word; none to compare all pairs."""
    for n in range(4, 8):
        if points >> math.ceil(64 / n) >= SHARE:
            widths = [64 // n + (k < 64 % n) for k in range(n)]
            return [(sum(widths[:k]), w, r) for k, (w, r) in enumerate(zip(widths, share_out(most, n))) if r >= 0]
    return []


def pivot_rows(fp: np.ndarray) -> np.ndarray:
    """The pivot table: (n, BLOCKS) distances to the reference, by blocks of four bits."""
    x = (fp ^ np.random.Generator(np.random.PCG64(4)).integers(0, 2**64, (1, 2), dtype=np.uint64)).view(np.uint8).reshape(len(fp), 16)
    return np.concatenate([_NIBBLE[x & 15], _NIBBLE[x >> 4]], 1).astype(np.int8)


def differ(pv: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Maximum difference of the distances of points to all references; not above their distance."""
    return np.abs(pv[a] - pv[b]).sum(1, dtype=np.int16)


def fingerprint_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) fingerprints over distinct words and word pairs, and the word counts."""
    w = words(texts)
    two, at = shingles(w, 2)
    keys = [np.zeros(0, np.uint64)]
    for lo in range(0, len(w.hash), FEATURES):  # a text of many words gives its distinct ones in turn
        a, b = np.searchsorted(at, [lo, lo + FEATURES])
        feat = np.concatenate([w.hash[lo : lo + FEATURES], two[a:b]])
        own = np.concatenate([w.doc[lo : lo + FEATURES], w.doc[at[a:b]]]).astype(np.uint64)
        keys.append(_distinct((own << U(40)) | (feat >> U(24))))
        if len(keys) == 9:
            keys = [_distinct(np.concatenate(keys))]
    key = keys[1] if len(keys) == 2 else _distinct(np.concatenate(keys))
    fp = simhash(key & U((1 << 40) - 1), (key >> U(40)).astype(np.int64), len(texts))
    return fp, np.diff(w.bounds)


def _distinct(key: np.ndarray) -> np.ndarray:
    key = np.sort(key)
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def names_of(fp: np.ndarray) -> np.ndarray:
    """64-bit name of each fingerprint."""
    return mix(mix(fp[:, 0], 5) + fp[:, 1], 6).view(np.int64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        fp, n = fingerprint_arrays(b.column("text"))
        ok = pa.array(n > 0)
        yield pa.record_batch(
            {"rid": b.column("rid"), "doc_id": b.column("doc_id"), "p": pa.array(names_of(fp)), "hi": pa.array(fp[:, 0].view(np.int64)), "lo": pa.array(fp[:, 1].view(np.int64))}
        ).filter(ok)


def _spread(chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packs(fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Points by chunk, for each task of the chunk."""
            own = (names_of(fp).view(np.uint64) % U(chunks)).astype(np.int64)
            order = np.argsort(own, kind="stable")
            full, size = np.unique(own, return_counts=True)
            ends = np.concatenate([[0], np.cumsum(size) * 16]).astype(np.int32)
            fps = pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(ends), pa.py_buffer(fp[order])])
            for j in range(chunks):
                yield pa.record_batch({"task": pa.array(task_of(full, j, chunks)), "chunk": pa.array(full), "fps": fps})

        held, n = [], 0
        for b in batches:
            held.append(np.stack([b.column("hi").to_numpy().view(np.uint64), b.column("lo").to_numpy().view(np.uint64)], 1))
            n += b.num_rows
            if n >= AT_ONCE:
                yield from packs(np.concatenate(held))
                held, n = [], 0
        if n:
            yield from packs(np.concatenate(held))

    return run


class Forest:
    """Points of a task and what connects them so far."""

    def __init__(self, fp: np.ndarray, radius: int):
        self.fp, self.pivots, self.radius = fp, pivot_rows(fp), radius
        self.words = [np.ascontiguousarray(fp[:, k]) for k in (0, 1)]
        self.label = np.arange(len(fp))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs are within the radius: pivot rows first, then the distance."""
        i = np.flatnonzero(differ(self.pivots, a, b) <= self.radius)
        out = np.zeros(len(a), bool)
        out[i] = hamming(self.fp[a[i]], self.fp[b[i]]) <= self.radius
        return out

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect the pairs that are near, of those not yet connected."""
        for lo in range(0, len(a), PAIRS):
            x, y = a[lo : lo + PAIRS], b[lo : lo + PAIRS]
            i = np.flatnonzero(self.label[x] != self.label[y])
            i = i[self.near(x[i], y[i])]
            self.join(x[i], y[i])

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect near pairs: each takes the least label that its edges reach, until all agree."""
        kept = np.zeros(len(a), bool)
        while True:
            u, v = self.label[a], self.label[b]
            i = np.flatnonzero(u != v)
            if not len(i):
                break
            high, low = np.maximum(u[i], v[i]), np.minimum(u[i], v[i])
            # one edge for each label that gives way
            o = np.lexsort((low, high))
            o = o[np.concatenate([[True], high[o][1:] != high[o][:-1]])]
            kept[i[o]] = True
            to = np.arange(len(self.label))
            to[high[o]] = low[o]
            while (to[to] != to).any():
                to = to[to]
            self.label = to[self.label]
        if kept.any():
            self.edges.append((a[kept], b[kept]))

    def cross(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect all near pairs of a point of ``a`` and one of ``b``; both may be the same points."""
        for word, most in enumerate(share_out(self.radius, 2)):
            blocks = blocks_for(min(len(a), len(b)), most)
            for block in blocks:
                self.block(word, most, a, b, *block)
            if not blocks and most >= 0:
                self.meet(word, most, a, b)
        self.settle()

    def block(self, word: int, most: int, a: np.ndarray, b: np.ndarray, shift: int, width: int, bits: int) -> None:
        """Meet the points of which the block of the word differs by some bits at most."""
        key = ((self.words[word] >> U(shift)) & U((1 << width) - 1)).astype(np.int64)
        one = a is b
        a, b = a[np.argsort(key[a], kind="stable")], b[np.argsort(key[b], kind="stable")]
        start = np.searchsorted(key[b], np.arange((1 << width) + 1))
        ball = np.flatnonzero(np.bitwise_count(np.arange(1 << width)) <= bits)
        own, head = np.unique(key[a], return_index=True)
        for k, lo, hi in zip(own.tolist(), head.tolist(), [*head[1:].tolist(), len(a)]):
            near = k ^ ball
            if one:
                near = near[near >= k]  # the others met when it was their turn
            first = start[near]
            size = start[near + 1] - first
            ends = np.cumsum(size)
            if ends[-1]:
                self.meet(word, most, a[lo:hi], b[np.arange(ends[-1]) + np.repeat(first - ends + size, size)])

    def meet(self, word: int, most: int, a: np.ndarray, b: np.ndarray) -> None:
        """Note the pairs of which the word differs by ``most`` bits at most."""
        for lo in range(0, len(b), COLUMNS):
            other = b[lo : lo + COLUMNS]
            y = self.words[word][other]
            step = max(1, AT_ONCE // len(other))
            for at in range(0, len(a), step):
                mine = a[at : at + step]
                if self.edges and len(mine) > 1:
                    label = self.label[mine]
                    same = label == np.partition(label, len(mine) // 2)[len(mine) // 2]
                    if 2 * np.count_nonzero(same) > len(mine):  # most are connected: only others are new to them
                        new = self.label[other] != label[same.argmax()]
                        self.tile(word, most, mine[same], other[new], y[new])
                        mine = mine[~same]
                self.tile(word, most, mine, other, y)

    def tile(self, word: int, most: int, a: np.ndarray, b: np.ndarray, y: np.ndarray) -> None:
        """``meet`` of some points; ``y`` has the words of ``b``."""
        if not len(a) or not len(b):
            return
        ok = np.bitwise_count(self.words[word][a][:, None] ^ y) <= most
        n = np.count_nonzero(ok)
        if n > ok.size >> 4:  # near copies: one link of each connects most of them
            for axis in (1, 0):
                i, j = np.arange(len(a)), np.arange(len(b))
                i, j = (i, ok.argmax(1)) if axis else (ok.argmax(0), j)
                linked = ok[i, j]
                self.compare(a[i[linked]], b[j[linked]])
                ok &= self.label[a][:, None] != self.label[b]
            n = np.count_nonzero(ok)
        if n:
            i, j = np.divmod(np.flatnonzero(ok), len(b))
            self.found.append((a[i], b[j]))
            self.waiting += n
            if self.waiting >= AT_ONCE:
                self.settle()

    def settle(self) -> None:
        """Connect the noted pairs that are near."""
        for a, b in self.found and [[np.concatenate(x) for x in zip(*self.found)]]:
            self.compare(a, b)
        self.found, self.waiting = [], 0


def task_edges(fp: np.ndarray, first: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points within the radius that connect all that are, of one of the ``first`` points
    and one of the others; if there are no others, of any two."""
    forest, at = Forest(fp, radius), np.arange(len(fp))
    if first == len(fp):
        forest.cross(at, at)
    else:
        forest.cross(at[:first], at[first:])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(a for a, _ in forest.edges)]), np.concatenate([none, *(b for _, b in forest.edges)])


def _pairs(radius: int, chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        at = -1

        def settle() -> Iterator[pa.RecordBatch]:
            sides = [np.concatenate(x) for x in held if x]
            if len(sides) == 2 or at // chunks == at % chunks:  # a chunk may be empty
                fp = np.concatenate(sides)
                a, b = task_edges(fp, len(sides[0]), radius)
                names = names_of(fp)
                yield pa.record_batch({"a": pa.array(names[a]), "b": pa.array(names[b])})

        for batch in batches:
            fps = batch.column("fps")
            for k, (task, chunk) in enumerate(zip(batch.column("task").to_pylist(), batch.column("chunk").to_pylist())):
                if task != at and at >= 0:
                    yield from settle()
                    held = ([], [])
                at = task
                held[chunk != task // chunks].append(np.frombuffer(fps[k].as_buffer(), np.uint8).copy().view(np.uint64).reshape(-1, 2))
        if at >= 0:
            yield from settle()

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, p, hi, lo) of every document with a word; rid identifies id and text, p
    the fingerprint."""
    slim = docs.select(row_key("doc_id", "text").alias("rid"), "doc_id", "text").where("text is not null")
    return slim.mapInArrow(_fingerprints, "rid long, doc_id long, p long, hi long, lo long")


def near_groups(docs: DataFrame, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Groups of near copies: (rid, doc_id, group_id, copies, keep), one row a distinct
    (doc_id, text) that has a copy. ``group_id`` is the least doc_id of the group,
    ``copies`` its rows, ``keep`` marks the one that stays."""
    slim = fingerprints(docs).groupBy("rid", "doc_id", "p", "hi", "lo").agg(F.count("*").alias("n"))
    slim = materialize(slim, "fp")
    points = materialize(slim.select("hi", "lo").distinct(), "points")
    chunks = chunks_for(points.count(), cell)
    packs = points.mapInArrow(_spread(chunks), "task long, chunk long, fps binary")
    i, j = F.floor(F.col("task") / chunks), F.col("task") % chunks
    # the tasks of two chunks, numbered row by row, but not more tasks than a driver can keep
    parts = min(chunks * (chunks + 1) // 2, MOST_TASKS)
    packs = packs.repartitionById(parts, F.pmod(j * (j + 1) / 2 + i, F.lit(parts)).cast("int")).sortWithinPartitions("task")
    edges = packs.mapInArrow(_pairs(radius, chunks), "a long, b long")
    roots = materialize(connected_components(edges), "roots")
    named = slim.join(roots.withColumnRenamed("node", "p"), "p", "left")
    named = named.select("rid", "doc_id", "n", F.coalesce("root", "p").alias("root"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    best = named.groupBy("root").agg(F.min(order).alias("best"), F.sum("n").alias("copies")).where("copies > 1")
    out = named.join(best, "root").select("rid", "doc_id", F.col("best.doc_id").alias("group_id"), "copies", (F.col("rid") == F.col("best.rid")).alias("keep"), "n")
    return out


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each group of near copies, all columns kept."""
    groups = materialize(near_groups(docs, **options).select("rid", "keep", "n"), "groups")
    gone, twice = groups.where("not keep"), groups.where("keep and n > 1")
    counts = groups.agg(F.count_if(F.expr("not keep")), F.count_if(F.expr("keep and n > 1"))).first()
    mark = "__rid"
    while mark in docs.columns:
        mark += "_"
    keyed = docs.withColumn(mark, row_key("doc_id", "text"))
    left = sized_join(keyed, gone.select(F.col("rid").alias(mark)), mark, "left_anti", counts[0], 16)
    if counts[1]:
        reps = twice.select(F.col("rid").alias(mark))
        left = sized_join(left, reps, mark, "left_anti", counts[1], 16).unionByName(
            sized_join(left, reps, mark, "left_semi", counts[1], 16).dropDuplicates([mark])
        )
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
