"""Language-model scoring with Brown classes.

Words are counted over all documents. Every word that occurs ``MIN_COUNT`` times is a type
of its own, at any size of the corpus; rarer ones join others of like shape as one of
``KINDS`` types. The types with ``MIN_SHARE`` of all tokens, 1 / ``MIN_SHARE`` at most, are
the core: their bigrams are counted and exchange clustering assigns them to ``CLASSES``
classes, the other words counting as shapes meanwhile. In each round a third of the core is
tried in every class and moves to the one that raises the likelihood of the class bigrams
most; if the moves together lower it, the half with the lesser gains is taken back, again and
again; one pass counts for all these halves. Rounds
end when a cycle in which every type was tried moves none, or raises the likelihood by less
than ``MIN_GAIN`` a token. Then each other type goes to the class in which the words beside
it, by their classes, are most likely. The class bigrams are counted over all documents with
the classes of all types. A word's probability is that of its class after the class before
(Witten-Bell smoothing with the class unigrams) times its share of the class; a word of a
shape type has an equal share with all such words, one unseen word included, so the
probabilities of all words sum to one.

Cost: the core (a bounded number of types), class counts and moves reach the driver. The
neighbours of the core are packed arrays by type, parted by the third that is tried in a round, so a round
reads a third of them, and the class bigrams change by those of the types that move. The
other types stay in a table by word, which grows with the corpus: a row a token of theirs is
shuffled to class them, and a group of them has less than ``MIN_SHARE`` of the tokens. To
look them up, documents are hashed to parts of about ``PART_BYTES``; the answers for the words
of a part meet its texts, which are shuffled once.

Cases: null and empty texts and those without words have ``n_words`` 0 and null scores; they
do not count. Repeated rows count and are scored each. Ties go to the least class. Ids are of
type long. Other columns don't matter. An empty table gives no rows. Words and texts of any
length count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.common import materialize, slices
from loomgrid.llm.textkernel import U, Words, mix, words

MIN_COUNT = 3
MIN_SHARE = 2e-6
CLASSES = 64
TURNS = 3
#: nats a token
MIN_GAIN = 1e-2
PART_BYTES = 8 << 20
SCORE = "doc_id long, n_words long, log_prob double, perplexity double"
#: shapes: digits, ASCII letters, other letters; by length up to 4, 8, 16 and beyond
KINDS = 12
_LENGTH = np.searchsorted([4, 8, 16], np.arange(18))
EDGE = 0
FIRST = 1 + KINDS  #: id of the most frequent type; 0 is the edge of a text, then the shapes
#: bits of a type's id
_BITS = 21
#: Rows of a task that are counted or packed at a time.
AT_ONCE = 4_000_000
#: Bigrams of a part of the table of neighbours, about.
NEAR = 1 << 19
#: Types of which the neighbours are laid out by class at a time.
TYPES = 1 << 10
#: Trials of a round of which a task adds up the class bigrams.
TRIALS = 4
TINY = 1e-300
#: Prefixes of word hashes by which types are found.
_PREFIX = 20


def kinds(w: Words) -> np.ndarray:
    """Shape of each word, 0 to KINDS - 1."""
    if not len(w.hash):
        return np.zeros(0, np.int64)
    so_far = np.zeros(len(w.buf) + 1, np.int32)
    np.cumsum(w.buf >= 128, out=so_far[1:])
    group = np.where(so_far[w.end] > so_far[w.start], 8, 4)
    np.cumsum((w.buf >= 48) & (w.buf < 58), out=so_far[1:])
    group[so_far[w.end] > so_far[w.start]] = 0
    return group + _LENGTH[np.minimum(w.end - w.start, 17)]


def sums(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of ``n``, or how often they occur."""
    if n is None:
        key = np.sort(key)
    else:
        o = np.argsort(key)
        key, n = key[o], n[o]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[head], np.diff(np.append(head, len(key))) if n is None else np.add.reduceat(n, head) if len(key) else n


def _binary(x: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes of ``x``, an entry for each of the sizes."""
    ends = np.concatenate([[0], np.cumsum(size) * x.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _packs(parts: int, by: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows by a hash of ``by``: a row for each bucket, with the bytes of each column."""
    bucket = (mix(by.view(np.uint64), 31) % U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order, size = np.argsort(bucket, kind="stable"), np.bincount(bucket)
    full = np.flatnonzero(size)
    out = {"bucket": pa.array(full.astype(np.int32))}
    for name, x in columns.items():
        out[name] = _binary(x[order], size[full])
    return pa.record_batch(out)


def _unpacked(batches: Iterator[pa.RecordBatch], **kinds: type) -> list[np.ndarray]:
    """All rows of a bucket, by column."""
    held: dict[str, list[np.ndarray]] = {name: [np.zeros(0, kind)] for name, kind in kinds.items()}
    for b in batches:
        for name, kind in kinds.items():
            for x in b.column(name):
                held[name].append(np.frombuffer(x.as_buffer(), kind).copy())
    return [np.concatenate(x) for x in held.values()]


def _counted(rows: DataFrame, parts: int, finish, schema: str) -> DataFrame:
    """Sums by key of (bucket, key, n) from ``_packs``; a task holds one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield finish(*sums(*_unpacked(batches, key=np.int64, n=np.int64)))

    return rows.repartitionById(parts, F.col("bucket")).mapInArrow(run, schema)


def _counts(keys, parts: int):
    """Packs of the keys that ``keys`` finds in each batch and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packs() -> pa.RecordBatch:
            key, n = sums(np.concatenate(held))
            return _packs(parts, key, key=key, n=n.astype(np.int64))

        held: list[np.ndarray] = []
        for b in slices(batches, "text"):
            held.append(keys(words(b.column("text"))))
            if sum(map(len, held)) >= AT_ONCE:
                yield packs()
                held = []
        if held:
            yield packs()

    return run


@dataclass
class Model:
    key: np.ndarray  #: sorted keys of the words that are types
    ident: np.ndarray  #: their ids
    count: np.ndarray  #: tokens of each type by id
    distinct: np.ndarray  #: words of each shape that are no types
    group: np.ndarray  #: class of each type; that of the edge is the last
    pairs: np.ndarray  #: counts of class bigrams
    classes: int
    rest: DataFrame | None = None  #: (key, class, n) of the types beside the core
    rest_weight: np.ndarray | None = None  #: their weight in each class
    encoded: DataFrame | None = None  #: the training documents, from ``encode``
    index: tuple[np.ndarray, int] | None = field(default=None, repr=False)  #: of the keys, made where it is used

    def types(self, w: Words, key: np.ndarray | None = None) -> np.ndarray:
        """Type of each word; ``key`` has its ``keys_of``."""
        key = keys_of(w) if key is None else key
        out = 1 + (key & 15)
        if not len(self.key):
            return out
        first, most = self.starts()
        at = first[(key >> (64 - _PREFIX)) + (1 << (_PREFIX - 1))]
        ok = self.key.take(at, mode="clip") == key
        out, left = np.where(ok, self.ident.take(at, mode="clip"), out), np.flatnonzero(~ok)
        for step in range(1, most):
            ok = self.key.take(at[left] + step, mode="clip") == key[left]
            out[left[ok]] = self.ident.take(at[left[ok]] + step, mode="clip")
            left = left[~ok]
        return out

    def starts(self) -> tuple[np.ndarray, int]:
        """First key of each prefix, and how many keys have the same one at most."""
        if self.index is None:
            prefix = (self.key >> (64 - _PREFIX)) + (1 << (_PREFIX - 1))
            self.index = np.searchsorted(prefix, np.arange(1 << _PREFIX)).astype(np.int32), int(np.bincount(prefix).max())
        return self.index

    def slim(self) -> Model:
        """What executors need."""
        return replace(self, rest=None, encoded=None, index=None)

    def moves(self) -> np.ndarray:
        """Log probabilities of a class after a class."""
        n = self.pairs.astype(np.float64)
        into = n.sum(0)
        base = (into + 1) / (into.sum() + len(into))
        kinds_after = np.maximum((n > 0).sum(1, keepdims=True), 1)
        return np.log((n + kinds_after * base) / (n.sum(1, keepdims=True) + kinds_after))

    def weights(self) -> np.ndarray:
        """Total weight of the types of each class."""
        weight = self.count + 0.5
        weight[EDGE] = 1
        total = np.bincount(self.group, weight, self.classes + 1)
        return total if self.rest_weight is None else total + self.rest_weight

    def emissions(self) -> np.ndarray:
        """Log probabilities of a word of a core or shape type in its class."""
        weight = self.count + 0.5
        weight[EDGE] = 1
        emit = np.log(weight / self.weights()[self.group])
        emit[1:FIRST] -= np.log(self.distinct + 1)
        return emit


def likelihood(pairs: np.ndarray) -> float:
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    n = pairs.astype(np.float64)
    return f(n) - f(n.sum(0)) - f(n.sum(1))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, TINY))


def gains(pairs: np.ndarray, home, right: np.ndarray, left: np.ndarray, own) -> np.ndarray:
    """What the likelihood of the class bigrams gains if a type moves from its class to each:
    ``right`` and ``left`` are its neighbours' counts by class, without ``own``, itself. Of
    several types, each alone, the arguments have a row each."""
    if np.ndim(home) == 0:
        return gains(pairs, np.array([home]), right[None], left[None], np.array([own]))[0]
    n = np.maximum(pairs, TINY)  # so that no logarithm is of zero
    base, i = _xlogx(n), np.arange(len(home))
    whole, whole_base = n.copy(), base.copy()
    # row and column of its class, and the diagonal, without the type
    row, col, corner = n[home] - right, n.T[home] - left, n[home, home] - right[i, home] - left[i, home] - own
    row[i, home] = col[i, home] = corner
    row, col = np.maximum(row, TINY), np.maximum(col, TINY)
    row_base, col_base = _xlogx(row), _xlogx(col)
    own = own[:, None]
    diagonal, diagonal_base = (np.repeat(x.diagonal()[None], len(i), 0) for x in (n, base))
    diagonal[i, home], diagonal_base[i, home] = row[i, home], row_base[i, home]
    out, (x, y) = np.empty(right.shape), np.empty((2, *n.shape))
    for k, h in enumerate(home.tolist()):
        n[h], n[:, h], base[h], base[:, h] = row[k], col[k], row_base[k], col_base[k]
        for axis, more in ((1, right[k]), (0, left[k, :, None])):
            np.log(np.add(n, more, out=x), out=y)
            y *= x
            y -= base
            total = y.sum(axis) if axis else out[k] + y.sum(axis)
            out[k] = total - y.diagonal()
        n[h], n[:, h], base[h], base[:, h] = whole[h], whole[:, h], whole_base[h], whole_base[:, h]
    out += _xlogx(diagonal + right + left + own)
    out -= diagonal_base
    r, c = right.sum(1, keepdims=True) + own, left.sum(1, keepdims=True) + own
    rows, cols = (np.repeat(pairs.sum(axis, dtype=np.float64)[None], len(i), 0) for axis in (1, 0))
    rows[i, home] -= r[:, 0]
    cols[i, home] -= c[:, 0]
    out -= _xlogx(rows + r) - _xlogx(rows) + _xlogx(cols + c) - _xlogx(cols)
    return out - out[i, home][:, None]


def _pairs_of(model: Model):
    def run(w: Words) -> np.ndarray:
        seq, _ = sequence(w, model)
        pair = (seq[:-1] << _BITS) | seq[1:]
        return pair[pair != 0]  # edges of two texts meet

    return run


def sequence(w: Words, model: Model, key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Types of all texts with words, with an edge before and after each, and their documents; ``key`` has the
    ``keys_of`` the words."""
    size = np.diff(w.bounds)
    full = np.flatnonzero(size)
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = np.ones(len(w.hash), np.int64)
    step[w.bounds[full]] += 2
    step[0] = 1
    at = np.cumsum(step)
    out = np.full(at[-1] + 2, EDGE, np.int64)
    out[at] = model.types(w, key)
    doc = np.zeros(len(out), np.int64)
    doc[at] = w.doc
    doc[at[w.bounds[full + 1] - 1] + 1] = full
    doc[at[w.bounds[full]] - 1] = full
    return out, doc


def _sides(parts: int):
    """Packs, by type, of bigrams, each for both its types: (type, side, the other type) in a key,
    and the count. The side is 0 for the first type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _rows(batches):
            a, b = key >> _BITS, key & ((1 << _BITS) - 1)
            w, n = np.concatenate([a, b]), np.concatenate([n, n])
            yield _packs(parts, w, key=w << (_BITS + 1) | np.concatenate([b, a | 1 << _BITS]), n=n)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of each row of packs."""
    for batch in batches:
        for key, n in zip(batch.column("key"), batch.column("n")):
            yield np.frombuffer(key.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of a bucket to a pack, in order, for each turn."""
    key, n = sums(*_unpacked(batches, key=np.int64, n=np.int64))
    turn = mix((key >> (_BITS + 1)).astype(np.uint64), 77) % U(TURNS)
    for t in range(TURNS):
        i = np.flatnonzero(turn == U(t))
        if len(i):
            yield pa.record_batch({"turn": pa.array([t], pa.int32()), "key": _binary(key[i], [len(i)]), "n": _binary(n[i], [len(i)])})


def near_of(pairs: DataFrame, bigrams: int) -> DataFrame:
    """(key, n, turn): the types beside each type, both sides of a type in one row, from packs of bigrams."""
    parts = max(1, math.ceil(bigrams / NEAR))
    packs = pairs.select("key", "n").mapInArrow(_sides(parts), "bucket int, key binary, n binary")
    return packs.repartitionById(parts, F.col("bucket")).mapInArrow(_neighbours, "turn int, key binary, n binary")


def _split(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Type, whether it is the second one, and the other type."""
    return key >> (_BITS + 1), (key >> _BITS & 1).astype(bool), key & ((1 << _BITS) - 1)


def _matrix(group: np.ndarray, classes: int):
    """Class bigrams."""
    k = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k)
        for key, n in _rows(batches):
            w, second, other = _split(key)
            i = np.flatnonzero(~second)
            total += np.bincount(group[w[i]] * k + group[other[i]], n[i], k * k)
        i = np.flatnonzero(total)
        yield pa.record_batch({"at": pa.array(i), "n": pa.array(total[i].astype(np.int64))})

    return run


def _changes(group: np.ndarray, before: np.ndarray, level: np.ndarray, levels: int, classes: int):
    """Packs, by trial, of how the class bigrams change from the classes of ``before`` if in trial k the types
    of ``level`` k and more have those of ``group``. Only the rows of types that move are looked at, and a bigram
    of two such types counts for its first one."""
    k = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # at a level, what its trial has more than the next one, in which fewer types move
        more = np.zeros(levels * k * k)

        def add(at: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.bincount((at * k + a) * k + b, n, levels * k * k)

        for key, n in _rows(batches):
            i = np.flatnonzero(level[key >> (_BITS + 1)] >= 0)
            w, second, other = _split(key[i])
            o = np.flatnonzero(~(second & (level[other] >= 0)))
            w, second, other, n = w[o], second[o], other[o], n[i[o]]
            a, b = np.where(second, other, w), np.where(second, w, other)
            high, low = np.maximum(level[a], level[b]), np.minimum(level[a], level[b])
            one = np.where(level[a] == high, group[a], before[a]), np.where(level[b] == high, group[b], before[b])
            more += add(high, *one, n) - add(high, before[a], before[b], n)
            o = np.flatnonzero((low >= 0) & (low < high))  # both move in the trials up to the lower level
            if len(o):
                a, b, low, n = a[o], b[o], low[o], n[o]
                more += add(low, group[a], group[b], n) - add(low, one[0][o], one[1][o], n)
        more = more.reshape(levels, k * k)
        full = np.flatnonzero(more.any(1))
        yield pa.record_batch({"trial": pa.array(full.astype(np.int32)), "n": _binary(more[full].astype(np.int64), np.full(len(full), k * k))})

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs of a trial, added up."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for trial, n in zip(b.column("trial").to_pylist(), b.column("n")):
            total[trial] = total.get(trial, 0) + np.frombuffer(n.as_buffer(), np.int64)
    for trial, n in total.items():
        yield pa.record_batch({"trial": pa.array([trial], pa.int32()), "n": _binary(n, [len(n)])})


def _moves(group: np.ndarray, pairs: np.ndarray, classes: int):
    """The best move of each type that gains by one."""
    k = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_key, all_n in _rows(batches):
            w = all_key >> (_BITS + 1)
            head = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            ends = np.append(head, len(w))
            for lo in range(0, len(head), TYPES):
                own_head = ends[lo : lo + TYPES + 1]
                ids, at = w[own_head[:-1]], slice(own_head[0], own_head[-1])
                row, n = np.repeat(np.arange(len(ids)), np.diff(own_head)), all_n[at]
                mine, second, other = _split(all_key[at])
                cell = (2 * row + second) * k + group[other]
                out = mine != other
                side = np.bincount(cell[out], n[out], 2 * len(ids) * k).reshape(-1, 2, k)
                itself = ~out & ~second
                own = np.bincount(row[itself], n[itself], len(ids))
                i = np.flatnonzero(ids != EDGE)
                found = gains(pairs, group[ids[i]], side[i, 0], side[i, 1], own[i])[:, :classes]
                best = found.argmax(1)
                gain = found[np.arange(len(i)), best]
                ok = gain > 1e-6
                yield pa.record_batch({"w": pa.array(ids[i[ok]].astype(np.int32)), "to": pa.array(best[ok].astype(np.int32)), "gain": pa.array(gain[ok])})

    return run


def _class_pairs(near: DataFrame, group: np.ndarray, classes: int, before: np.ndarray | None = None) -> np.ndarray:
    """Class bigrams, or their change from the classes of ``before``."""
    if before is not None:
        return _trials(near, group, before, np.where(group != before, 0, -1), classes)[0]
    t = near.select("key", "n").mapInArrow(_matrix(group, classes), "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((classes + 1) ** 2, np.int64)
    out[t.column("at").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(classes + 1, classes + 1)


def _trials(near: DataFrame, group: np.ndarray, before: np.ndarray, level: np.ndarray, classes: int) -> np.ndarray:
    """Change of the class bigrams in each trial: in trial k the types of ``level`` k and more move from their
    class of ``before`` to that of ``group``. All trials take one pass."""
    levels, packed = max(1, int(level.max()) + 1), "trial int, n binary"
    rows = near.select("key", "n").mapInArrow(_changes(group, before, level, levels, classes), packed)
    t = rows.repartitionById(math.ceil(levels / TRIALS), (F.col("trial") / TRIALS).cast("int")).mapInArrow(_added, packed).toArrow()
    out = np.zeros((levels, classes + 1, classes + 1), np.int64)
    for trial, n in zip(t.column("trial").to_pylist(), t.column("n")):
        out[trial] = np.frombuffer(n.as_buffer(), np.int64).reshape(out.shape[1:])
    return out[::-1].cumsum(0)[::-1]


def exchange(near: DataFrame, group: np.ndarray, classes: int, rounds: int | None = None, min_gain: float = MIN_GAIN) -> tuple[np.ndarray, np.ndarray]:
    """Classes and their bigram counts after exchange from ``group``, to the end or for some rounds."""
    pairs = _class_pairs(near, group, classes)
    tokens = max(1, int(pairs.sum()))
    turn, at_cycle = 0, likelihood(pairs)
    while rounds is None or turn < rounds:
        mine = near.where(F.col("turn") == turn % TURNS)
        t = mine.select("key", "n").mapInArrow(_moves(group, pairs, classes), "w int, to int, gain double").toArrow()
        w, to, gain = (t.column(c).to_numpy() for c in ("w", "to", "gain"))
        order = np.lexsort([w, -gain])
        trial, level = group.copy(), np.full(len(group), -1)
        trial[w[order]] = to[order]
        halves = [len(order) >> k for k in range(len(order).bit_length())]
        for k, size in enumerate(halves):
            level[w[order[:size]]] = k
        for k, change in enumerate(_trials(mine, trial, group, level, classes) if halves else ()):
            if likelihood(pairs + change) > likelihood(pairs):
                group, pairs = np.where(level >= k, trial, group), pairs + change
                break
        turn += 1
        if rounds is None and turn % TURNS == 0:
            now = likelihood(pairs)
            if now - at_cycle < min_gain * tokens:
                break
            at_cycle = now
    return group, pairs


def train(docs: DataFrame, classes: int = CLASSES, rounds: int | None = None, min_share: float = MIN_SHARE, min_count: int = MIN_COUNT, part_bytes: int = PART_BYTES) -> Model:
    """Counts, classes and class bigrams of all documents."""
    slim = docs.select("text").where("text is not null")
    size = _size(docs)
    parts = max(1, math.ceil(size / part_bytes))
    packed = "bucket int, key binary, n binary"
    plain = lambda key, n: pa.record_batch({"key": pa.array(key), "n": pa.array(n)})
    counted = materialize(_counted(slim.mapInArrow(_counts(keys_of, parts), packed), parts, plain, "key long, n long"), "words")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(min_count, math.ceil(min_share * total))
    t = counted.where(F.col("n") >= least).toArrow()
    key, n = t.column("key").to_numpy(), t.column("n").to_numpy()
    order = np.lexsort([key, -n])
    ident = np.empty(len(key), np.int64)
    ident[order] = FIRST + np.arange(len(key))
    by_key = np.argsort(key)
    count = np.zeros(FIRST + len(key))
    count[FIRST:] = n[order]
    distinct = np.zeros(KINDS)
    kind = F.col("key").bitwiseAND(15).cast("int").alias("k")
    rare = F.col("n") < min_count
    loose = counted.where(F.col("n") < least).groupBy(kind).agg(F.sum("n").alias("all"), F.count_if(rare).alias("d"), F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("n")).collect()
    for r in loose:
        count[1 + r.k] = r.all
    rank = np.argsort(np.argsort(-count[1:], kind="stable"), kind="stable")
    group = np.append(classes, rank % classes)
    model = Model(key[by_key], ident[by_key], count, distinct, group, np.zeros((classes + 1, classes + 1), np.int64), classes)
    if not total:
        return model
    pack = lambda key, n: pa.record_batch({"size": pa.array([len(key)]), "key": _binary(key, [len(key)]), "n": _binary(n, [len(n)])})
    pairs = materialize(_counted(slim.mapInArrow(_counts(_pairs_of(model), parts), packed), parts, pack, "size long, key binary, n binary"), "pairs")
    near = near_of(pairs, pairs.agg(F.sum("size")).first()[0])
    group, matrix = exchange(materialize(near, "near", "turn"), group, classes, rounds)
    model = replace(model, group=group, pairs=matrix)
    parted = docs.select("doc_id", "text", _part(size, part_bytes).alias("part"))
    near = parted.select("part", "text").where("text is not null").mapInArrow(_contexts(model, parts), "bucket int, key binary, part binary, beside binary")
    near = near.repartitionById(parts, F.col("bucket")).mapInArrow(_classes(model, min_count), "part long, key long, class short, n long, first boolean")
    answers = materialize(near, "types")
    rest = answers.where("first").select("key", "class", "n")
    weight = np.zeros(classes + 1)
    for r in rest.groupBy("class").agg(F.sum(F.col("n") + 0.5).alias("w")).collect():
        weight[r["class"]] = r.w
    count = count.copy()
    for r in loose:
        count[1 + r.k], distinct[r.k] = r.n, r.d
    model = replace(model, count=count, distinct=distinct, rest=rest, rest_weight=weight)
    encoded = materialize(_encode(parted, answers.select("part", "key", "class", "n"), model), "encoded")
    return replace(model, pairs=_sequence_pairs(encoded, classes), encoded=encoded)


def _size(docs: DataFrame) -> int:
    """Bytes of the texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def _part(size: int, part_bytes: int) -> Column:
    """Part of a row, by its hash. Rows that repeat lie in many blocks of files, which parts them."""
    return F.pmod(F.xxhash64("doc_id", "text", F.input_file_name(), F.input_file_block_start()), F.lit(max(1, math.ceil(size / part_bytes))))


def _contexts(model: Model, parts: int):
    """Packs, by word, of each token of no core type: its part and word, and the classes beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packs() -> pa.RecordBatch:
            part, key, beside = (np.concatenate(x) for x in zip(*held))
            return _packs(parts, key, key=key, part=part, beside=beside)

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in slices(batches, "text"):
            w = words(b.column("text"))
            own = keys_of(w)
            seq, doc = sequence(w, model, own)
            c, at = model.group[seq], np.flatnonzero(seq != EDGE)
            i = np.flatnonzero(seq[at] < FIRST)
            beside = (c[at[i] - 1] << 8 | c[at[i] + 1]).astype(np.int16)
            held.append((b.column("part").to_numpy()[doc[at[i]]], own[i], beside))
            if sum(len(x) for x, _, _ in held) >= AT_ONCE:
                yield packs()
                held = []
        if held:
            yield packs()

    return run


def _classes(model: Model, min_count: int):
    """Packs of contexts, all those of a word in one task, to the types among the words, with their classes, a row
    for each part that has the word."""
    k = model.classes + 1
    n = model.pairs + 0.5
    after, before = np.log(n / n.sum(1, keepdims=True))[:-1], np.log(n / n.sum(0))[:, :-1]

    def settle(key: np.ndarray, left: np.ndarray, right: np.ndarray, owner: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        """``owner`` is the index of the word of each of the parts."""
        best = (right @ after.T + left @ before).argmax(1) if len(key) else np.zeros(0)
        size = left.sum(1)
        new = np.ones(len(owner), bool)
        new[1:] = owner[1:] != owner[:-1]
        i = np.flatnonzero(size[owner] >= min_count)
        o = owner[i]
        return pa.record_batch({"part": pa.array(part[i]), "key": pa.array(key[o]), "class": pa.array(best[o].astype(np.int16)), "n": pa.array(size[o].astype(np.int64)), "first": pa.array(new[i])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        open_key, open_left, open_right, open_parts = none, np.zeros((0, k)), np.zeros((0, k)), [none]
        all_key, all_part, all_beside = _unpacked(batches, key=np.int64, part=np.int64, beside=np.int16)
        order = np.lexsort((all_part, all_key))
        for lo in range(0, len(order), 10_000):
            i = order[lo : lo + 10_000]
            key, at = np.unique(all_key[i], return_inverse=True)
            part, beside = all_part[i], all_beside[i].astype(np.int64)
            left = np.bincount(at * k + (beside >> 8), minlength=len(key) * k).reshape(-1, k).astype(np.float64)
            right = np.bincount(at * k + (beside & 255), minlength=len(key) * k).reshape(-1, k).astype(np.float64)
            o = np.lexsort((part, at))
            o = o[np.concatenate([[True], (at[o][1:] != at[o][:-1]) | (part[o][1:] != part[o][:-1])])]
            owner, part = at[o], part[o]
            if len(open_key) and open_key[0] == key[0]:
                left[0] += open_left[0]
                right[0] += open_right[0]
                mine = np.unique(np.concatenate([*open_parts, part[owner == 0]]))
                owner, part = np.concatenate([np.zeros(len(mine), np.int64), owner[owner > 0]]), np.concatenate([mine, part[owner > 0]])
            elif len(open_key):
                yield settle(open_key, open_left, open_right, np.zeros(len(open_parts[0]), np.int64), open_parts[0])
            last = owner == len(key) - 1
            yield settle(key[:-1], left[:-1], right[:-1], owner[~last], part[~last])
            open_key, open_left, open_right, open_parts = key[-1:], left[-1:], right[-1:], [part[last]]
        yield settle(open_key, open_left, open_right, np.zeros(len(open_parts[0]), np.int64), open_parts[0])

    return run


def keys_of(w: Words) -> np.ndarray:
    """Word hashes; the shape takes the place of the last four bits."""
    return ((w.hash & U(2**64 - 16)) | kinds(w).astype(np.uint64)).view(np.int64)


def encode(docs: DataFrame, model: Model, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, emit, classes) of every row: log probability of the words in their
    classes, and the class of each word, a byte each. The documents may be new to the model."""
    parted = docs.select("doc_id", "text", _part(_size(docs), part_bytes).alias("part"))
    answers = parted.select("part", "text").mapInArrow(_unknown(model.slim()), "part long, key long")
    if model.rest is not None:
        answers = answers.join(model.rest, "key").select("part", "key", "class", "n")
    else:
        answers = answers.where("false").withColumns({"class": F.lit(0).cast("short"), "n": F.lit(0).cast("long")})
    return _encode(parted, answers, model)


def _encode(parted: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """``encode`` of (doc_id, text, part) with the types, beside the core, of each part's words."""
    core, total = model.slim(), model.weights()
    emit = model.emissions()

    def run(_, texts: pa.Table, known: pa.Table) -> pa.Table:
        key = known.column("key").to_numpy()
        o = np.argsort(key)
        key, cls = key[o], known.column("class").to_numpy()[o].astype(np.int64)
        log = np.log((known.column("n").to_numpy()[o] + 0.5) / total[cls])
        out = []
        for b in slices(iter(texts.select(["doc_id", "text"]).to_batches()), "text"):
            w = words(b.column("text"))
            own = keys_of(w)
            kind = core.types(w, own)
            c, e = core.group[kind], emit[kind]
            i = np.flatnonzero(kind < FIRST)
            if len(i) and len(key):
                mine = own[i]
                at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                ok = key[at] == mine
                c[i[ok]], e[i[ok]] = cls[at[ok]], log[at[ok]]
            n = np.diff(w.bounds)
            binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(w.bounds.astype(np.int32)), pa.py_buffer(c.astype(np.uint8))])
            out.append(pa.record_batch({"doc_id": b.column("doc_id"), "n_words": pa.array(n.astype(np.int64)), "emit": pa.array(np.bincount(w.doc, e, len(n))), "classes": binary}))
        return pa.Table.from_batches(out, _ENCODED)

    return parted.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(run, "doc_id long, n_words long, emit double, classes binary")


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("emit", pa.float64()), ("classes", pa.binary())])


def _unknown(model: Model):
    """Words of no core type, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"))
            own = keys_of(w)
            i = np.flatnonzero(model.types(w, own) < FIRST)
            x = np.stack([b.column("part").to_numpy()[w.doc[i]], own[i]], 1)
            x = x[np.lexsort((x[:, 1], x[:, 0]))]
            x = x[np.concatenate([[True], (x[1:] != x[:-1]).any(1)])] if len(x) else x
            yield pa.record_batch({"part": pa.array(x[:, 0]), "key": pa.array(x[:, 1])})

    return run


def _with_edges(classes: pa.Array, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all texts with words, an edge before and after each, and their rows."""
    off = np.frombuffer(classes.buffers()[1], np.int32)[classes.offset : classes.offset + len(classes) + 1].astype(np.int64)
    data = classes.buffers()[2]
    c = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    row = np.repeat(np.arange(len(classes)), np.diff(off))
    full = np.flatnonzero(np.diff(off))
    place = np.zeros(len(classes), np.int64)
    place[full] = 2 * np.arange(len(full))
    out, rows = np.full(len(c) + 2 * len(full), edge, np.int64), np.zeros(len(c) + 2 * len(full), np.int64)
    at = np.arange(len(c)) + place[row] + 1
    out[at], rows[at] = c, row
    rows[off[full] + place[full]], rows[off[full + 1] + place[full] + 1] = full, full
    return out, rows


def _sequence_pairs(encoded: DataFrame, classes: int) -> np.ndarray:
    k = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                c, row = _with_edges(b.column("classes").slice(lo, 512), classes)
                inside = row[1:] == row[:-1]
                total += np.bincount((c[:-1] * k + c[1:])[inside], minlength=k * k)
        i = np.flatnonzero(total)
        yield pa.record_batch({"at": pa.array(i), "n": pa.array(total[i])})

    t = encoded.select("classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(k * k, np.int64)
    out[t.column("at").to_numpy()] = t.column("n").to_numpy()
    return out.reshape(k, k)


def score_encoded(encoded: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row of ``encode``."""
    move, edge = model.moves(), model.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 512):
                b = big.slice(lo, 512)
                c, row = _with_edges(b.column("classes"), edge)
                inside = row[1:] == row[:-1]
                n = b.column("n_words").to_numpy()
                p = np.bincount(row[1:][inside], move[c[:-1], c[1:]][inside], b.num_rows) + b.column("emit").to_numpy()
                none = n == 0
                yield pa.record_batch({"doc_id": b.column("doc_id"), "n_words": b.column("n_words"), "log_prob": pa.array(p, mask=none), "perplexity": pa.array(np.exp(-p / (n + 1)), mask=none)})

    return encoded.mapInArrow(run, SCORE)


def score(docs: DataFrame, model: Model, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row; the model may be of other documents."""
    return score_encoded(encode(docs, model, part_bytes), model)


def train_and_score(docs: DataFrame, **options) -> DataFrame:
    """Scores of the documents by a model of them."""
    model = train(docs, **options)
    return score_encoded(model.encoded, model) if model.encoded is not None else score(docs, model)
