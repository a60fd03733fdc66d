"""Line dedup by content-defined chunks of lines.

Every line has a hash; a rolling hash over ``WINDOW`` line hashes closes a chunk where it
is 0 modulo ``MEAN``, so chunk borders depend on the lines nearby only and a passage that
is moved or inserted is cut as before. Of two borders in a row the second is dropped (a
chunk has two lines at least, but for a text's first and last), and a chunk of more than
``MOST`` lines, as of one line over and over, is cut every ``MOST`` lines. Chunks of two
or more lines that aren't blank are counted over all documents by hash; those that repeat
are compared byte by byte with their first occurrence, and every equal one but the first
is removed.

Cost: (hash, row, index) is shuffled for each chunk, the bytes only of chunks whose hash
repeats; a hot chunk is combined before its shuffle. Texts are joined with what they lose
by broadcast when the counted removals are small, else by a shuffle.

Cases: null texts stay null, empty ones empty. Rows that repeat in id and text are one
occurrence: both keep and lose the same lines. The first occurrence is that of the least
doc_id, nulls last, then of the least row hash. Line ends are "\\n"; other bytes count as
they are. A text may lose all its lines and is then empty. Other columns stay; ``removed``
is renamed as ``removed_`` where a column has that name. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loomgrid.llm.common import free_name, materialize, row_key, sized_join, slices
from loomgrid.llm.textkernel import U, mix, span_hashes, text_bytes

WINDOW = 2
MEAN = 3
MOST = 32


@dataclass
class Chunks:
    buf: np.ndarray
    key: np.ndarray  #: hash of the bytes
    start: np.ndarray  #: byte range in ``buf``, without the last line end
    end: np.ndarray
    lines: np.ndarray
    solid: np.ndarray  #: lines that aren't blank
    doc: np.ndarray
    bounds: np.ndarray  #: chunk offsets of the documents


def line_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all lines and the line offsets of the documents."""
    end = np.flatnonzero(buf == 10)
    docs = len(off) - 1
    count = np.bincount(np.searchsorted(off, end, "right") - 1, minlength=docs) + 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    first, last = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
    first[bounds[:-1]], last[bounds[1:] - 1] = True, True
    starts[first], starts[~first] = off[:-1], end + 1
    ends[last], ends[~last] = off[1:], end
    return starts, ends, bounds


def chunk(texts: pa.Array) -> Chunks:
    """Cut the texts of a column into chunks of lines."""
    buf, off = text_bytes(texts)
    starts, ends, bounds = line_spans(buf, off)
    n = len(starts)
    h = span_hashes(buf, starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    at = np.arange(n) - bounds[doc]
    roll = mix(h, 3)
    for back in range(1, WINDOW):
        i = np.flatnonzero(at >= back)
        roll[i] = mix(roll[i] + h[i - back] * U(2 * back + 1))
    close = roll % U(MEAN) == 0
    # of borders in a row, every other one stays
    prev = np.zeros(n, bool)
    prev[1:] = close[:-1] & (at[1:] > 0)
    head = np.maximum.accumulate(np.where(close & ~prev, np.arange(n), -1)) if n else at
    close &= (np.arange(n) - head) % 2 == 0
    close[bounds[1:] - 1] = True
    first = np.concatenate([[0], np.flatnonzero(close)[:-1] + 1]) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    close |= (np.arange(n) - np.repeat(first, size)) % MOST == MOST - 1
    last = np.flatnonzero(close)
    first = np.concatenate([[0], last[:-1] + 1]) if n else first
    solid = np.concatenate([[0], np.cumsum(ends > starts)])
    s, e = starts[first], ends[last]
    return Chunks(buf, span_hashes(buf, s, e), s, e, last - first + 1, solid[last + 1] - solid[first], doc[first], np.searchsorted(doc[first], np.arange(len(off))))


def _list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        c = chunk(b.column("text"))
        i = np.flatnonzero(c.solid >= 2)
        d = pa.array(c.doc[i])
        yield pa.record_batch({"key": pa.array(c.key[i].view(np.int64)), "rid": b.column("rid").take(d), "doc_id": b.column("doc_id").take(d), "at": pa.array((i - c.bounds[c.doc[i]]).astype(np.int32))})


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        c = chunk(b.column("text"))
        wanted = b.column("at")
        d = np.repeat(np.arange(b.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
        at = wanted.flatten().to_numpy()
        i = c.bounds[d] + at
        body = pa.array([c.buf[s:e].tobytes() for s, e in zip(c.start[i].tolist(), c.end[i].tolist())], pa.binary())
        yield pa.record_batch({"key": pa.array(c.key[i].view(np.int64)), "rid": b.column("rid").take(pa.array(d)), "at": pa.array(at), "body": body})


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(rid, at) of the chunks to remove: equal, byte by byte, to an earlier one."""
    slim = docs.where("text is not null").select(row_key("doc_id", "text").alias("rid"), "doc_id", "text")
    found = materialize(slim.mapInArrow(_list_chunks, "key long, rid long, doc_id long, at int"), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "rid", "at")
    twice = found.groupBy("key").agg(F.min(place).alias("lead"), F.max(place).alias("last")).where("lead <> last")
    twice = materialize(twice.select("key", F.col("lead.rid").alias("lead_rid"), F.col("lead.at").alias("lead_at")), "twice")
    keys = twice.count()
    places = materialize(sized_join(found.select("key", "rid", "at"), twice.select("key"), "key", "left_semi", keys, 16).groupBy("rid").agg(F.collect_set("at").alias("at")), "places")
    n, width = places.agg(F.count("*"), F.coalesce(F.avg(F.size("at")), F.lit(0.0))).first()
    rows = sized_join(slim.select("rid", "text"), places, "rid", "inner", n, int(8 * width) + 80)
    bodies = materialize(rows.mapInArrow(_read_chunks, "key long, rid long, at int, body binary"), "bodies").distinct()
    leads = twice.withColumnsRenamed({"lead_rid": "rid", "lead_at": "at"})
    leads = sized_join(bodies, leads, ["key", "rid", "at"], "left_semi", keys, 32).select("key", F.col("body").alias("lead_body"), F.col("rid").alias("lead_rid"), F.col("at").alias("lead_at"))
    leads = materialize(leads, "leads")
    n, width = leads.agg(F.count("*"), F.coalesce(F.avg(F.length("lead_body")), F.lit(0.0))).first()
    both = sized_join(bodies, leads, "key", "inner", n, int(width) + 40)
    return both.where("body = lead_body and not (rid = lead_rid and at = lead_at)").select("rid", "at")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column is what a text loses; the lines lost take its place."""
    for b in slices(batches, "text"):
        names = b.schema.names
        t, g = names.index("text"), len(names) - 1
        gone = b.column(g)
        lost = np.zeros(b.num_rows, np.int64)
        rows = np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False))
        text = b.column(t)
        if len(rows):
            new = {}
            c = chunk(text.take(pa.array(rows)))
            for k, r in enumerate(rows.tolist()):
                out = set(gone[r].as_py())
                a, z = int(c.bounds[k]), int(c.bounds[k + 1])
                new[r] = b"\n".join(c.buf[c.start[i] : c.end[i]].tobytes() for i in range(a, z) if i - a not in out)
                lost[r] = sum(int(c.lines[a + i]) for i in out)
            values = pa.array([new[r] for r in rows.tolist()], pa.binary()).cast(pa.string())
            place = np.arange(b.num_rows)
            place[rows] = b.num_rows + np.arange(len(rows))
            text = pa.concat_arrays([text, values]).take(pa.array(place))
        cols = [text if i == t else b.column(i) for i in range(g)]
        yield pa.record_batch([*cols, pa.array(lost)], names=names)


def drop_repeated_chunks(docs: DataFrame) -> DataFrame:
    """All rows, their texts without repeated chunks, and ``removed``, the lines they lost."""
    rid, name = free_name(docs, "__rid"), free_name(docs, "removed")
    gone = materialize(repeated_chunks(docs).groupBy(F.col("rid").alias(rid)).agg(F.collect_set("at").alias(name)), "gone")
    keyed = docs.withColumn(rid, row_key("doc_id", "text"))
    n, width = gone.agg(F.count("*"), F.coalesce(F.avg(F.size(name)), F.lit(0.0))).first()
    rows = sized_join(keyed, gone, rid, "left", n, int(8 * width) + 80).select(*[F.col(f"`{c}`") for c in docs.columns], name)
    return rows.mapInArrow(_rewrite, StructType([*docs.schema.fields, StructField(name, LongType())]))
