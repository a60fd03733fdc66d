from __future__ import annotations

import random
import struct

from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm import media as M


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.integers(1, 900), st.integers(1, 9), st.integers(1, 7))
def test_round_trip(payload, size, gop, per_chunk):
    data = M.mux(payload, size, gop, per_chunk)
    (r,) = M.probe(data)
    n = -(-len(payload) // size)
    assert (r["n_samples"], r["n_bytes"], r["codec"], r["handler"], r["error"]) == (n, len(payload), "avc1", "vide", None)
    assert r["duration_ms"] == n * 3000 * 1000 // 90_000
    assert [k["sample"] for k in r["keyframes"]] == list(range(1, n + 1, gop))
    for k in r["keyframes"]:
        i = k["sample"] - 1
        assert data[k["offset"] : k["offset"] + k["size"]] == payload[i * size : (i + 1) * size] and k["time_ms"] == i * 3000 * 1000 // 90_000


def u32(*x):
    return struct.pack(f">{len(x)}I", *x)


def test_fragments():
    trak = M.box(b"trak", M.box(b"tkhd", u32(0, 0, 0, 5, 0)), M.box(b"mdia", M.box(b"mdhd", u32(0, 0, 0, 1000, 0))))
    moov = M.box(b"moov", trak, M.box(b"mvex", M.box(b"trex", u32(0, 5, 1, 40, 7, 0x10000))))
    run = M.box(b"trun", u32(0x000205, 3, 100, 0, 4, 5, 6))
    moof = M.box(b"moof", M.box(b"traf", M.box(b"tfhd", u32(0, 5)), run))
    (r,) = M.probe(moov + moof + bytes(300))
    assert (r["n_samples"], r["n_bytes"], r["duration_ms"]) == (3, 15, 120)
    assert r["keyframes"] == [{"sample": 1, "time_ms": 0, "offset": len(moov) + 100, "size": 4}]
    (r,) = M.probe(moov + M.box(b"moof", M.box(b"traf", M.box(b"tfhd", u32(0, 9)), run)))
    assert "unknown track 9" in r["error"]


def test_large_sizes_and_offsets():
    data = M.mux(b"abc" * 100, 50)
    i = data.index(b"stco") - 4
    n = struct.unpack_from(">I", data, i + 12)[0]
    offsets = struct.unpack_from(f">{n}I", data, i + 16)
    co64 = M.box(b"co64", u32(0, n), struct.pack(f">{n}Q", *offsets))
    stbl = data[: i] + co64 + data[i + 16 + 4 * n :]
    for kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
        j = stbl.index(kind) - 4
        size = struct.unpack_from(">I", stbl, j)[0]
        stbl = stbl[:j] + u32(size + 4 * n) + stbl[j + 4 :]
    assert M.probe(stbl) == M.probe(data)
    head = struct.pack(">I4sQ", 1, b"free", 20) + bytes(4)
    assert M.probe(head + data)[0]["codec"] == "avc1" and M.probe(data[: data.index(b"moov") - 4] + u32(0) + data[data.index(b"moov") :])[0]["n_samples"] == 6


def test_broken_containers_are_reported():
    data = M.mux(bytes(range(256)) * 41)
    assert M.probe(None)[0]["error"] == "null" and M.probe(b"")[0]["error"] == "empty"
    assert "no moov" in M.probe(b"no container at all")[0]["error"]
    assert "bad box" in M.probe(data[:-40])[0]["error"]
    rng = random.Random(5)
    for _ in range(400):
        x = bytearray(data)
        for _ in range(4):
            x[rng.randrange(10_500, len(x))] = rng.randrange(256)
        assert M.probe(bytes(x))


def test_table(spark):
    df = spark.createDataFrame([(1, "x" * 5000, "a"), (2, "", "b"), (3, None, "c"), (1, "x" * 5000, "a")], "id long, html string, codec string")
    got = sorted((r.id, r.n_samples or 0, r.error or "") for r in M.media_tracks(M.containers(df, "id", "html")).collect())
    assert got == [(1, 5, ""), (1, 5, ""), (2, 0, ""), (3, 0, "null")]
    assert M.media_tracks(M.containers(df.limit(0), "id", "html")).count() == 0


def test_short_tables_are_reported():
    data = M.mux(bytes(50_000), 1000)
    i = data.index(b"stsz")
    assert M.probe(data[: i + 12] + u32(60) + data[i + 16 :])[0]["error"] is not None
    even = data[: i + 8] + u32(1000, 1_000_000) + data[i + 16 :]
    (r,) = M.probe(even)
    assert r["error"] and "without a place" in r["error"]
    trak = M.box(b"trak", M.box(b"tkhd", u32(0, 0, 0, 5, 0)), M.box(b"mdia", M.box(b"mdhd", u32(0, 0, 0, 1000, 0))))
    moov = M.box(b"moov", trak, M.box(b"mvex", M.box(b"trex", u32(0, 5, 1, 40, 7, 0))))
    (r,) = M.probe(moov + M.box(b"moof", M.box(b"traf", M.box(b"tfhd", u32(0, 5)), M.box(b"trun", u32(0x200, 9, 4, 5)))))
    assert r["n_samples"] == 2 and "2 of 9" in r["error"]


def test_a_fragment_without_base_follows_the_one_before():
    trak = lambda i: M.box(b"trak", M.box(b"tkhd", u32(0, 0, 0, i, 0)), M.box(b"mdia", M.box(b"mdhd", u32(0, 0, 0, 1000, 0))))
    trex = lambda i: M.box(b"trex", u32(0, i, 1, 40, 7, 0))
    moov = M.box(b"moov", trak(1), trak(2), M.box(b"mvex", trex(1), trex(2)))
    traf = lambda i, flags=0: M.box(b"traf", M.box(b"tfhd", u32(flags, i)), M.box(b"trun", u32(0x200, 2, 10, 20)))
    a, b = M.probe(moov + M.box(b"moof", traf(1), traf(2)) + bytes(200))
    assert [k["offset"] - len(moov) for k in a["keyframes"] + b["keyframes"]] == [0, 10, 30, 40]
    a, b = M.probe(moov + M.box(b"moof", traf(1), traf(2, 0x20000)) + bytes(200))
    assert [k["offset"] - len(moov) for k in b["keyframes"]] == [0, 10]
