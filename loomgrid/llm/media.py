"""Media columns: ISO base media containers (MP4, MOV, M4A, fragmented MP4).

A container is walked box by box, nested boxes included; the sample tables of each track
(time to sample, sizes, chunks, chunk offsets, sync samples) and the runs of movie
fragments are decoded to arrays. A track becomes a row with its codec, duration and the
byte ranges of its keyframes. Payloads are never decoded: sample bytes aren't even looked
at. ``mux`` writes such containers, as the queries' input and for round trips in tests.

One pass over the rows; containers are neither shuffled nor copied.

Cases: null content gives one row without track and with ``error`` "null", empty content
one with "empty"; content without a movie box "no moov". A box that is cut short or larger
than its parent ends the walk of that parent: what was read before is reported, with the
place in ``error``, as are tables with fewer rows than they say. Times are decoding times, in
the order of the samples; edit lists are not applied. Ids are of type long. Tables that contradict each other are read as far as they agree, and
``error`` says so. Repeated rows are reported each. The result has its own columns, so
others can't clash. Unknown boxes are skipped. An empty table gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KEYFRAME = "struct<sample:int,time_ms:long,offset:long,size:long>"
RESULT = f"id long, track_id int, handler string, codec string, timescale long, duration_ms long, n_samples int, n_bytes long, keyframes array<{KEYFRAME}>, error string"
_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"mvex", b"moof", b"traf", b"edts", b"dinf"}
_FRAME_TYPE = pa.list_(pa.struct([("sample", pa.int32()), ("time_ms", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())]))


@dataclass
class Track:
    track_id: int = 0
    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict[bytes, np.ndarray] = field(default_factory=dict)
    size: int = 0  #: of every sample, if they are equal
    defaults: tuple[int, int, int] = (0, 0, 0)  #: duration, size, flags of fragments
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  #: duration, offset, size, sync


@dataclass
class Movie:
    timescale: int = 0
    duration: int = 0
    tracks: list[Track] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    found: bool = False
    next_data: int = 0  #: end of the samples of the fragment's last traf


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """(type, start, start of the content, end) of the boxes in a range; ends at a bad box
    with a type of b"" there."""
    while at < end:
        if end - at < 8:
            yield b"", at, at, end
            return
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1:
            if end - at < 16:
                yield b"", at, at, end
                return
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            yield b"", at, at, end
            return
        yield kind, at, at + head, at + size
        at += size


#: a table of equal samples that claims more is cut, and reported
MOST_SAMPLES = 50_000_000


def _table(data: bytes, at: int, end: int, width: int, movie: Movie, kind: str = ">u4") -> np.ndarray:
    """Rows of a counted table; as many as there are, and an error, if the count says more."""
    said, there = struct.unpack_from(">I", data, at)[0], max(0, end - at - 4) // (width * np.dtype(kind).itemsize)
    n = min(said, there)
    if said > there:
        movie.errors.append(f"table at {at} has {there} of {said} rows")
    return np.frombuffer(data, kind, n * width, at + 4).astype(np.int64).reshape(n, width)


def _leaf(data: bytes, kind: bytes, at: int, end: int, movie: Movie, track: Track | None) -> None:
    if kind in (b"mvhd", b"mdhd"):
        scale, length = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        if length == (2**64 - 1 if data[at] else 2**32 - 1):
            length = 0  # unknown
        if kind == b"mvhd":
            movie.timescale, movie.duration = scale, length
        elif track:
            track.timescale, track.duration = scale, length
    elif kind == b"trex":
        ident, _, *rest = struct.unpack_from(">5I", data, at + 4)
        for t in movie.tracks:
            if t.track_id == ident:
                t.defaults = tuple(rest)
    elif track is None:
        return
    elif kind == b"tkhd":
        track.track_id = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
    elif kind == b"hdlr":
        track.handler = data[at + 8 : at + 12].decode("latin-1")
    elif kind == b"stsd":
        if struct.unpack_from(">I", data, at + 4)[0]:
            track.codec = data[at + 12 : at + 16].decode("latin-1")
    elif kind in (b"stts", b"stsc"):
        track.tables[kind] = _table(data, at + 4, end, 2 if kind == b"stts" else 3, movie)
    elif kind in (b"stss", b"stco"):
        track.tables[kind] = _table(data, at + 4, end, 1, movie)[:, 0]
    elif kind == b"co64":
        track.tables[b"stco"] = _table(data, at + 4, end, 1, movie, ">u8")[:, 0]
    elif kind == b"stsz":
        track.size, n = struct.unpack_from(">II", data, at + 4)
        if track.size and n > MOST_SAMPLES:
            movie.errors.append(f"table at {at} claims {n} samples")
        track.tables[b"stsz"] = np.full(min(n, MOST_SAMPLES), track.size, np.int64) if track.size else _table(data, at + 8, end, 1, movie)[:, 0]
    elif kind == b"stz2":
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        raw = np.frombuffer(data, np.uint8, end - at - 12, at + 12)
        if bits == 16:
            raw = raw[: len(raw) // 2 * 2].view(">u2")
        elif bits == 4:
            raw = np.stack([raw >> 4, raw & 15], 1).ravel()
        if len(raw) < n:
            movie.errors.append(f"table at {at} has {len(raw)} of {n} rows")
        track.tables[b"stsz"] = raw[:n].astype(np.int64)


def _fragment(data: bytes, moof: int, at: int, end: int, movie: Movie) -> None:
    """One traf box: its runs of samples go to their track. Without a base they follow the data
    of the traf before, or count from the moof box if they are the first or a flag says so."""
    track, defaults = None, (0, 0, 0)
    origin = offset = movie.next_data or moof
    for kind, _, a, b in boxes(data, at, end):
        if kind == b"tfhd":
            flags, ident = struct.unpack_from(">II", data, a)
            track = next((t for t in movie.tracks if t.track_id == ident), None)
            if track is None:
                movie.errors.append(f"fragment of unknown track {ident}")
                return
            defaults, p = list(track.defaults), a + 8
            if flags & 0x20000:
                origin = offset = moof
            if flags & 1:
                origin = offset = struct.unpack_from(">Q", data, p)[0]
                p += 8
            p += 4 * bool(flags & 2)
            for bit, k in ((8, 0), (16, 1), (32, 2)):
                if flags & bit:
                    defaults[k] = struct.unpack_from(">I", data, p)[0]
                    p += 4
        elif kind == b"trun" and track is not None:
            flags, n = struct.unpack_from(">II", data, a)
            flags, p, first = flags & 0xFFFFFF, a + 8, None
            if flags & 1:
                offset = origin + struct.unpack_from(">i", data, p)[0]
                p += 4
            if flags & 4:
                first = struct.unpack_from(">I", data, p)[0]
                p += 4
            have = [bool(flags & x) for x in (0x100, 0x200, 0x400, 0x800)]
            width = sum(have)
            most = max(0, b - p) // (4 * width) if width else MOST_SAMPLES
            if n > most:
                movie.errors.append(f"run at {a} has {most} of {n} samples")
                n = most
            cells = np.frombuffer(data, ">u4", n * width, p).astype(np.int64).reshape(n, width)
            col = iter(range(width))
            duration, size, flag = (cells[:, next(col)] if h else np.full(n, x, np.int64) for h, x in zip(have, defaults))
            if first is not None and n and not have[2]:
                flag = flag.copy()
                flag[0] = first
            ends = offset + np.cumsum(size)
            track.parts.append((duration, ends - size, size, (flag >> 16) & 1 == 0))
            offset = int(ends[-1]) if n else offset
            movie.next_data = offset


def _walk(data: bytes, at: int, end: int, movie: Movie, track: Track | None, moof: int = 0) -> None:
    for kind, start, a, b in boxes(data, at, end):
        try:
            if not kind:
                movie.errors.append(f"bad box at {start}")
            elif kind == b"trak":
                movie.tracks.append(Track())
                _walk(data, a, b, movie, movie.tracks[-1])
            elif kind == b"traf":
                _fragment(data, moof, a, b, movie)
            elif kind in _NESTED:
                movie.found |= kind == b"moov"
                if kind == b"moof":
                    movie.next_data = 0
                _walk(data, a, b, movie, track, start)
            else:
                _leaf(data, kind, a, b, movie, track)
        except (struct.error, IndexError, ValueError):
            movie.errors.append(f"short {kind.decode('latin-1')} at {start}")


def samples(track: Track, errors: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start time, offset, size and sync flag of all samples, from the tables and fragments."""
    none = np.zeros(0, np.int64)
    t = track.tables
    size, chunk = t.get(b"stsz", none), t.get(b"stco", none)
    n = len(size)
    stsc = t.get(b"stsc", none.reshape(0, 3))
    first = stsc[:, 0] - 1
    if len(stsc) and ((np.diff(first) <= 0).any() or first[0] < 0):
        errors.append(f"track {track.track_id}: chunk table out of order")
        stsc, first = stsc[:0], first[:0]
    per = np.zeros(len(chunk), np.int64)
    for lo, hi, k in zip(first, np.append(first[1:], len(chunk)) if len(first) else none, stsc[:, 1]):
        per[lo:hi] = min(int(k), n)  # no chunk holds more than all samples
    which = np.repeat(np.arange(len(chunk)), per)[:n] if per.sum() <= max(8 * n, 1 << 16) else none
    if len(which) < n:
        errors.append(f"track {track.track_id}: {n - len(which)} samples without a place")
        n, size = len(which), size[: len(which)]
    done = np.cumsum(size) - size
    head = np.searchsorted(which, np.arange(len(chunk)))
    offset = chunk[which] + done - done[np.minimum(head[which], max(n - 1, 0))] if n else none
    stts = t.get(b"stts", none.reshape(0, 2))
    counts = np.diff(np.minimum(np.cumsum(stts[:, 0]), n), prepend=0)
    step = np.repeat(stts[:, 1], counts)
    if len(step) < n:
        errors.append(f"track {track.track_id}: {n - len(step)} samples without a time")
        step = np.append(step, np.zeros(n - len(step), np.int64))
    sync = np.ones(n, bool)
    if b"stss" in t:
        sync[:] = False
        k = t[b"stss"] - 1
        sync[k[(k >= 0) & (k < n)]] = True
    for d, o, s, f in track.parts:
        step, offset, size, sync = np.append(step, d), np.append(offset, o), np.append(size, s), np.append(sync, f)
    return np.cumsum(step) - step, offset, size, sync


def probe(data: bytes | None) -> list[dict]:
    """Rows of RESULT, without the id, for one container."""
    blank = {"track_id": None, "handler": None, "codec": None, "timescale": None, "duration_ms": None, "n_samples": None, "n_bytes": None, "keyframes": None}
    if not data:
        return [blank | {"error": "null" if data is None else "empty"}]
    movie = Movie()
    _walk(data, 0, len(data), movie, None)
    if not movie.tracks:
        return [blank | {"error": "; ".join([*movie.errors, "no track" if movie.found else "no moov"])}]
    out = []
    for track in movie.tracks:
        errors = list(movie.errors)
        time, offset, size, sync = samples(track, errors)
        scale = track.timescale
        spent = int(time[-1]) + (int(track.parts[-1][0][-1]) if track.parts and len(track.parts[-1][0]) else 0) if len(time) else 0
        length = track.duration or spent
        k = np.flatnonzero(sync)
        if len(k) and int((offset[k] + size[k]).max()) > len(data):
            errors.append(f"track {track.track_id}: samples beyond the end")
        ms = time[k] * 1000 // max(scale, 1)
        out.append({
            "track_id": track.track_id, "handler": track.handler, "codec": track.codec, "timescale": scale,
            "duration_ms": length * 1000 // scale if scale else movie.duration * 1000 // movie.timescale if movie.timescale else None,
            "n_samples": len(size), "n_bytes": int(size.sum()),
            "keyframes": [{"sample": s + 1, "time_ms": m, "offset": o, "size": z} for s, m, o, z in zip(k.tolist(), ms.tolist(), offset[k].tolist(), size[k].tolist())],
            "error": "; ".join(errors) or None,
        })
    return out


_TYPES = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), _FRAME_TYPE, pa.string()]
_NAMES = ["track_id", "handler", "codec", "timescale", "duration_ms", "n_samples", "n_bytes", "keyframes", "error"]


def media_tracks(df: DataFrame, content: str = "content", ident: str = "id") -> DataFrame:
    """One row a track of each container of a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                at, rows = [], []
                for i, data in enumerate(b.column(1)):
                    found = probe(data.as_py())
                    rows += found
                    at += [i] * len(found)
                cols = [b.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in zip(_NAMES, _TYPES))]
                yield pa.record_batch(cols, names=["id", *_NAMES])

    return df.select(ident, content).mapInArrow(run, RESULT)


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *content)


def _u32(*x: int) -> bytes:
    return struct.pack(f">{len(x)}I", *x)


def mux(payload: bytes, sample_bytes: int = 1024, gop: int = 12, per_chunk: int = 5, timescale: int = 90_000, step: int = 3000) -> bytes:
    """A container whose one video track has the payload, cut, as its samples; every
    ``gop``-th is a keyframe. The movie box follows the data."""
    sizes = [len(payload[i : i + sample_bytes]) for i in range(0, len(payload), sample_bytes)]
    n = len(sizes)
    head = box(b"ftyp", b"isom", _u32(512), b"isomavc1")
    start = len(head) + 8
    chunks = [start + i * sample_bytes for i in range(0, n, per_chunk)]
    stbl = box(
        b"stbl",
        _full(b"stsd", _u32(1), box(b"avc1", bytes(78))),
        _full(b"stts", _u32(1, n, step) if n else _u32(0)),
        _full(b"stss", _u32(len(range(0, n, gop)), *range(1, n + 1, gop))),
        _full(b"stsc", _stsc(n, per_chunk)),
        _full(b"stsz", _u32(0, n, *sizes)),
        _full(b"stco", _u32(len(chunks), *chunks)),
    )
    minf = box(b"minf", _full(b"vmhd", bytes(8), flags=1), box(b"dinf", _full(b"dref", _u32(1), _full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", _full(b"mdhd", _u32(0, 0, timescale, n * step, 0)), _full(b"hdlr", _u32(0), b"vide", bytes(12), b"\0"), minf)
    trak = box(b"trak", _full(b"tkhd", _u32(0, 0, 1, 0, n * step), bytes(60), flags=7), mdia)
    moov = box(b"moov", _full(b"mvhd", _u32(0, 0, timescale, n * step), bytes(80)), trak)
    return head + box(b"mdat", payload) + moov


def _stsc(n: int, per_chunk: int) -> bytes:
    full, rest = divmod(n, per_chunk)
    rows = ([(1, per_chunk, 1)] if full else []) + ([(full + 1, rest, 1)] if rest else [])
    return _u32(len(rows), *(x for r in rows for x in r))


def containers(df: DataFrame, ident: str, payload: str) -> DataFrame:
    """(id, content): a container for each row, with the text as its samples; null for null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                made = [None if t is None else mux(t.encode()) for t in b.column(1).to_pylist()]
                yield pa.record_batch({"id": b.column(0), "content": pa.array(made, pa.binary())})

    return df.select(ident, payload).mapInArrow(run, "id long, content binary")
