"""Substring dedup by recompression.

The words of a text are symbols. In each of ``ROUNDS`` rounds every run of one symbol, then
every pair of a left and a right symbol (a seeded bit of the symbol tells its side), gets a
new name. A name is the hash of what it stands for, so it is the same for all documents
without a dictionary: equal substrings get equal symbols but for a few at their ends, and
no round moves data. After the last round a symbol stands for some seven words. Symbols
that occur twice, and long runs, mark where long repeats may lie; a run of ``MIN_WORDS`` words in which they
cover ``COVER`` words is a candidate, and candidates are verified by two hashes (64 and 31
bits) that do not use the symbols. A word that lies in some run of ``MIN_WORDS`` words which
occurs twice is a repeat; it is to be dropped if it lies in one that isn't the first.

Cost: a row of some 30 bytes is shuffled for each symbol and each candidate. Those that
repeat inside a slice of a partition meet others as one row, so the hottest passage sends
one a slice. Texts are joined with their marks by broadcast when these are small, else by
a shuffle.

Cases: null and empty texts and those of fewer than ``MIN_WORDS`` words hold no repeats.
Rows equal in id and text are one document, which doesn't repeat itself. A passage that
repeats in one document counts. The first occurrence is that of the least row hash, then
the least position. Other columns stay as they are, whatever their names; the report has
columns of its own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomgrid.llm.common import free_name, materialize, row_key, sized_join, slices
from loomgrid.llm.textkernel import U, Words, mix, words

MIN_WORDS = 50
ROUNDS = 7
COVER = 12
#: a symbol of fewer words marks nothing
LEAST = 4
SPAN = "array<struct<start_word:int,n_words:int>>"


def recompress(sym: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols after some rounds and the index of each one's first word; first and last
    word (exclusive) of the runs of ``COVER`` words or more, which repeat themselves."""
    at, words_in = np.arange(len(sym)), len(sym)
    runs = [np.zeros((2, 0), np.int64)]
    for r in range(rounds):
        if len(sym) < 2:
            break
        same = np.concatenate([[False], (sym[1:] == sym[:-1]) & (doc[1:] == doc[:-1])])
        if same.any():
            head = np.flatnonzero(~same)
            n = np.diff(np.append(head, len(sym)))
            ends = np.append(at, words_in)[np.append(head[1:], len(sym))]
            sym, doc, at = sym[head], doc[head], at[head]
            long = (n > 1) & (ends - at >= COVER)
            runs.append(np.stack([at[long], ends[long]]))
            sym = np.where(n > 1, mix(sym + n.astype(np.uint64) * U(0x9E3779B97F4A7C15), 900 + r), sym)
        right = (mix(sym, 300 + r) >> U(17)) & U(1) == U(1)
        i = np.flatnonzero(~right[:-1] & right[1:] & (doc[1:] == doc[:-1]))
        sym = sym.copy()
        sym[i] = mix(mix(sym[i], 500 + r) + sym[i + 1], 700)
        keep = np.ones(len(sym), bool)
        keep[i + 1] = False
        sym, doc, at = sym[keep], doc[keep], at[keep]
    return sym, at, *np.concatenate(runs, 1)


ROW = "to long, key long, check int, rid long, value long, state byte"


def _rows(key: np.ndarray, check: np.ndarray, rid: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    """Occurrences of keys to rows of ROW. The least occurrence here of a key travels by key,
    to meet those of other slices, with state 1 if the key repeats here already and else 0;
    its others are known to repeat and not to be first: state 2, and they travel by rid."""
    o = np.lexsort([value, rid, check, key])
    key, check, rid, value = key[o], check[o], rid[o], value[o]
    other = np.ones(len(key), bool)
    other[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
    once = other.copy()
    once[1:] |= (rid[1:] != rid[:-1]) | (value[1:] != value[:-1])
    key, check, rid, value, head = key[once], check[once], rid[once], value[once], other[once]
    more = np.zeros(len(key), bool)
    more[:-1] = ~head[1:]
    state = np.where(head, more, 2).astype(np.int8)
    cols = {"to": np.where(head, key, rid), "key": key, "check": check.astype(np.int32), "rid": rid, "value": value, "state": state}
    return pa.record_batch({k: pa.array(v) for k, v in cols.items()})


#: the most words of a mark; a longer run has several
MOST_MARK = (1 << 24) - 1


def _marks(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of spans of words, and the span of each."""
    pieces = -(-n // MOST_MARK)
    which = np.repeat(np.arange(len(at)), pieces)
    k = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return (at[which] + k * MOST_MARK) << 24 | np.minimum(n[which] - k * MOST_MARK, MOST_MARK), which


def _symbols(rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"))
            sym, at, run_at, run_end = recompress(w.hash, w.doc, rounds)
            doc = w.doc[at]
            end = np.append(at[1:], len(w.hash))
            end = np.minimum(end, w.bounds[doc + 1])
            n, at = end - at, at - w.bounds[doc]
            i = np.flatnonzero(n >= LEAST)
            mark, which = _marks(at[i], n[i])
            i = i[which]
            rid = b.column("rid").to_numpy()[doc[i]]
            yield _rows(sym[i].view(np.int64), np.zeros(len(i), np.int64), rid, mark)
            if len(run_at):
                mark, which = _marks(run_at - w.bounds[w.doc[run_at]], run_end - run_at)
                rid = b.column("rid").to_numpy()[w.doc[run_at[which]]]
                yield pa.record_batch({"to": pa.array(rid), "key": pa.array(rid), "check": pa.array(np.zeros(len(rid), np.int32)), "rid": pa.array(rid), "value": pa.array(mark), "state": pa.array(np.full(len(rid), 2, np.int8))})

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by all of ROW but its state to (rid, value, first) of those that repeat. Of a
    key that goes on in the next batch only the first row is held."""
    head, known = np.zeros((0, 5), np.int64), False  # the open key's first row, and whether it was given out
    for b in batches:
        if not b.num_rows:
            continue
        x = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("key", "check", "rid", "value", "state")], 1)
        done = x[:, 4] == 2
        out = [np.stack([x[done, 2], x[done, 3], np.zeros(int(done.sum()), np.int64)], 1)]
        y = np.concatenate([head, x[~done]])
        if len(y):
            new = np.concatenate([[True], (y[1:, :2] != y[:-1, :2]).any(1)])
            same = np.concatenate([[False], (y[1:, 2:4] == y[:-1, 2:4]).all(1)]) & ~new
            group = np.cumsum(new) - 1
            hit = (np.bincount(group, ~same) > 1) | (np.bincount(group, y[:, 4] == 1) > 0)
            hit[0] |= known
            at = np.flatnonzero(new)
            first = (y[:, 2:4] == y[at[group], 2:4]).all(1)
            give = hit[group]
            if known:
                give[0] = False
            out.append(np.stack([y[give, 2], y[give, 3], first[give].astype(np.int64)], 1))
            head, known = y[at[-1:]], bool(hit[-1])
        z = np.concatenate(out)
        yield pa.record_batch({"rid": pa.array(z[:, 0]), "value": pa.array(z[:, 1]), "first": pa.array(z[:, 2].astype(np.int8))})


def find_repeated(rows: DataFrame) -> DataFrame:
    """(rid, value, first) of all rows whose key occurs at two places at least."""
    near = rows.repartition("to").sortWithinPartitions("to", "key", "check", "rid", "value")
    return near.mapInArrow(_repeated, "rid long, value long, first byte")


def window_hashes(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes of every run of ``size`` words inside a document, and its first word."""
    n = len(w.hash) - size + 1
    if n <= 0:
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, np.int64)
    out = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        pw, inv = _powers(base, len(w.hash) + 1)
        cum = np.concatenate([[U(0)], np.cumsum(mix(w.hash, base & 255) * pw[: len(w.hash)], dtype=np.uint64)])
        out.append(mix((cum[size:] - cum[:-size]) * inv[:n]))
    at = np.flatnonzero(w.doc[:n] == w.doc[size - 1 :])
    return out[0][at], out[1][at], at


_KEPT: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _KEPT or len(_KEPT[base][0]) < n:
        both = []
        for x in (base, pow(base, -1, 2**64)):
            a = np.full(1 << max(16, int(n).bit_length()), x, np.uint64)
            a[0] = 1
            both.append(np.cumprod(a, dtype=np.uint64))
        _KEPT[base] = (both[0], both[1])
    return _KEPT[base]


def _windows(size: int, cover: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column("text"))
            if len(w.hash) < size:
                continue
            marks = b.column("marks")
            d = np.repeat(np.arange(b.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
            v = marks.flatten().to_numpy()
            s = w.bounds[d] + (v >> 24)
            step = np.zeros(len(w.hash) + 1, np.int64)
            np.add.at(step, s, 1)
            np.add.at(step, s + (v & ((1 << 24) - 1)), -1)
            marked = np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])
            h, check, at = window_hashes(w, size)
            i = np.flatnonzero(marked[at + size] - marked[at] >= cover)
            at = at[i]
            rid = b.column("rid").to_numpy()[w.doc[at]]
            yield _rows(h[i].view(np.int64), (check[i] >> U(33)).astype(np.int64), rid, at - w.bounds[w.doc[at]])

    return run


def _spans(size: int):
    """Sorted (rid, value, first) to (rid, start, n, drop) spans of repeated words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[list[int] | None] = [None, None]  # open span [rid, start, end] of each kind
        for b in batches:
            if not b.num_rows:
                continue
            rid, at, first = (b.column(c).to_numpy().astype(np.int64) for c in ("rid", "at", "first"))
            out = []
            for drop in (0, 1):
                i = np.arange(len(rid)) if not drop else np.flatnonzero(first == 0)
                if not len(i):
                    continue
                r, a = rid[i], at[i]
                head = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (a[1:] > a[:-1] + size)]))
                tail = np.append(head[1:], len(r)) - 1
                spans = np.stack([r[head], a[head], a[tail] + size], 1)
                prev = last[drop]
                if prev is not None:
                    if prev[0] == spans[0, 0] and spans[0, 1] <= prev[2]:
                        spans[0, 1] = prev[1]
                    else:
                        spans = np.concatenate([[prev], spans])
                last[drop] = spans[-1].tolist()
                out.append(np.concatenate([spans[:-1], np.full((len(spans) - 1, 1), drop)], 1))
            if out:
                yield _span_rows(np.concatenate(out))
        rest = [[*x, k] for k, x in enumerate(last) if x is not None]
        if rest:
            yield _span_rows(np.array(rest))

    return run


def _span_rows(x: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"rid": pa.array(x[:, 0]), "start": pa.array(x[:, 1].astype(np.int32)), "n": pa.array((x[:, 2] - x[:, 1]).astype(np.int32)), "drop": pa.array(x[:, 3].astype(np.int8))})


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, rounds: int = ROUNDS, cover: int = COVER) -> DataFrame:
    """(rid, repeats, dropped): spans of repeated words of each document that has any, and
    those of them whose first occurrence is elsewhere."""
    slim = docs.where("text is not null").select(row_key("doc_id", "text").alias("rid"), "text")
    shared = find_repeated(slim.mapInArrow(_symbols(rounds), ROW)).select("rid", "value")
    enough = F.aggregate("marks", F.lit(0).cast("long"), lambda a, x: a + x.bitwiseAND((1 << 24) - 1)) >= cover
    marks = materialize(shared.groupBy("rid").agg(F.collect_set("value").alias("marks")).where(enough), "marks")
    n, width = marks.agg(F.count("*"), F.coalesce(F.avg(F.size("marks")), F.lit(0.0))).first()
    near = sized_join(slim, marks, "rid", "inner", n, int(8 * width) + 40)
    found = find_repeated(near.mapInArrow(_windows(min_words, cover), ROW))
    found = found.select("rid", F.col("value").cast("int").alias("at"), "first")
    spans = found.repartition("rid").sortWithinPartitions("rid", "at", "first").mapInArrow(_spans(min_words), "rid long, start int, n int, drop byte")
    span = F.struct(F.col("start").alias("start_word"), F.col("n").alias("n_words"))
    return spans.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when(F.col("drop") == 0, span))).alias("repeats"), F.array_sort(F.collect_list(F.when(F.col("drop") == 1, span))).alias("dropped")
    )


def report_repeats(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, repeats, dropped) of every row of the documents that hold a repeat."""
    found = materialize(repeats(docs, **options), "repeats")
    keyed = docs.select("doc_id", row_key("doc_id", "text").alias("rid"))
    n, width = found.agg(F.count("*"), F.coalesce(F.avg(F.size("repeats") + F.size("dropped")), F.lit(0.0))).first()
    return sized_join(keyed, found, "rid", "inner", n, int(24 * width) + 80).select("doc_id", "repeats", "dropped")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is what a text loses; it goes."""
    for b in slices(batches, "text"):
        names = b.schema.names
        t, g = names.index("text"), len(names) - 1
        text, spans = b.column(t), b.column(g)
        rows = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
        if len(rows):
            part = text.take(pa.array(rows))
            new = [_without(x, s) for x, s in zip(part.to_pylist(), spans.take(pa.array(rows)).to_pylist())]
            place = np.arange(b.num_rows)
            place[rows] = b.num_rows + np.arange(len(rows))
            text = pa.concat_arrays([text, pa.array(new, pa.string())]).take(pa.array(place))
        yield pa.record_batch([text if i == t else b.column(i) for i in range(g)], names=names[:g])


def _without(text: str, spans: list[dict]) -> str:
    """The text without some spans of its words, as ``textkernel.words`` counts them."""
    if not spans:
        return text
    w = words(pa.array([text], pa.string()))
    raw = text.encode()
    if len(raw) != len(w.buf):  # lower-casing moved the words
        raw = w.buf.tobytes()
    out, at = [], 0
    for s in spans:
        a, b = int(w.start[s["start_word"]]), int(w.end[s["start_word"] + s["n_words"] - 1])
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "replace")


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """All rows, their texts without the spans that repeat an earlier passage."""
    rid, cut = free_name(docs, "__rid"), free_name(docs, "__cut")
    found = repeats(docs, **options).where("size(dropped) > 0").select(F.col("rid").alias(rid), F.col("dropped").alias(cut))
    found = materialize(found, "repeats")
    keyed = docs.withColumn(rid, row_key("doc_id", "text"))
    n, width = found.agg(F.count("*"), F.coalesce(F.avg(F.size(cut)), F.lit(0.0))).first()
    rows = sized_join(keyed, found, rid, "left", n, int(24 * width) + 80).select(*[F.col(f"`{c}`") for c in docs.columns], cut)
    return rows.mapInArrow(_cut, StructType([StructField(f.name, StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields]))
