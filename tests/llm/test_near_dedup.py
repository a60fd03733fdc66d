from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from loomgrid.llm import near_dedup as N
from loomgrid.llm.common import connected_components, row_key
from loomgrid.llm.textkernel import hamming
from tests.llm.corpus import ODD, frame, prose, rows


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(9999)}" if rng.random() < share else w for w in text.split())


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randrange(60, 250), 5000)
        texts += [base, base, edited(rng, base, 0.02), edited(rng, base, 0.04)]
    texts += [prose(rng, 100, 5000) for _ in range(60)]
    crowd = prose(rng, 150, 5000)
    texts += [edited(rng, crowd, 0.01) for _ in range(80)]
    return rows(texts) + ODD


def brute(docs):
    """(distinct documents with words, root of each) by all pairs."""
    live = list(dict.fromkeys((d[0], d[1]) for d in docs if d[1]))
    fp, n = N.fingerprint_arrays(pa.array([d[1] for d in live]))
    live, fp = [d for d, k in zip(live, n) if k], fp[n > 0]
    root = list(range(len(live)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in np.argwhere(hamming(fp[:, None], fp[None]) <= N.RADIUS):
        root[find(int(i))] = find(int(j))
    return live, [find(i) for i in range(len(live))]


def test_groups_are_those_of_all_pairs(spark, docs):
    live, root = brute(docs)
    out = N.near_groups(frame(spark, docs).selectExpr("*", "1 as group_id", "2 as keep")).collect()
    want, got = {}, {}
    for d, r in zip(live, root):
        want.setdefault(r, set()).add(d[0])
    for r in out:
        got.setdefault(r.group_id, set()).add(r.doc_id)
    big = [s for s in want.values() if len(s) > 1]
    mine = list(got.values())
    assert sum(any(s <= m for m in mine) for s in big) >= 0.9 * len(big)
    assert all(any(m <= s for s in want.values()) for m in mine)
    assert all(min(m) == g for g, m in got.items()) and all(sum(r.keep for r in out if r.group_id == g) == 1 for g in got)
    assert {r.doc_id: r.copies for r in out}[903] == 2


def pairs_at(g, n, distance):
    a = g.integers(0, 2**64, (n, 2), dtype=np.uint64)
    b = a.copy()
    for i in range(n):
        for bit in g.choice(128, distance(), replace=False):
            b[i, bit // 64] ^= np.uint64(1 << int(bit % 64))
    return a, b


@pytest.mark.parametrize("points, first", [(300, 100), (3000, 3000), (40_000, 20_000), (40_000, 40_000)])
def test_every_pair_at_the_radius_is_found(points, first):
    g = np.random.default_rng(8)
    fp = g.integers(0, 2**64, (points, 2), dtype=np.uint64)
    n = min(first, points - first, 1500) or points // 4
    fp[:n], fp[points - n :] = pairs_at(g, n, lambda: N.RADIUS)
    assert (N.blocks_for(min(first, points - first or points), 13) != []) == (points == 40_000)
    a, b = N.task_edges(fp, first, N.RADIUS)
    assert {*zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())} == {(i, points - n + i) for i in range(n)}


@pytest.mark.parametrize("radius", [0, 1, 6, 27, 40, 63])
def test_blocks_leave_no_pair_out(radius):
    """Of each pair some block, and its word, differ by no more than they may."""
    g = np.random.default_rng(radius)
    a, b = pairs_at(g, 2000, lambda: radius)
    for points in (1 << 14, 1 << 15, 1 << 18, 1 << 21):
        met = np.zeros(len(a), bool)
        for word, most in enumerate(N.share_out(radius, 2)):
            x = a[:, word] ^ b[:, word]
            blocks = N.blocks_for(points, most)
            assert most < 0 or blocks
            for shift, width, bits in blocks:
                met |= (np.bitwise_count((x >> np.uint64(shift)) & np.uint64((1 << width) - 1)) <= bits) & (np.bitwise_count(x) <= most)
        assert met.all()


def planted(spark, monkeypatch, points, pairs):
    """Documents whose fingerprints are random but for pairs of ids (i, points + i) at the radius."""
    g = np.random.default_rng(14)
    fp = g.integers(0, 2**64, (points + pairs, 2), dtype=np.uint64)
    fp[:pairs], fp[points:] = pairs_at(g, pairs, lambda: N.RADIUS)
    given = spark.createDataFrame([(i, *x) for i, x in enumerate(fp.view(np.int64).tolist())], "doc_id long, hi long, lo long")
    names = spark.createDataFrame([(i, x) for i, x in enumerate(N.names_of(fp).tolist())], "doc_id long, p long")
    monkeypatch.setattr(N, "fingerprints", lambda docs: docs.select(row_key("doc_id", "text").alias("rid"), "doc_id").join(given, "doc_id").join(names, "doc_id").select("rid", "doc_id", "p", "hi", "lo"))
    return frame(spark, rows([f"text {i}" for i in range(points + pairs)]))


@pytest.mark.parametrize("cell", [N.CELL, 700])
def test_all_links_of_a_table_are_found(spark, monkeypatch, cell):
    docs = planted(spark, monkeypatch, 4000, 500)
    out = N.near_groups(docs, cell=cell).collect()
    assert {(r.doc_id, r.group_id, r.copies, r.keep) for r in out} == {x for i in range(500) for x in ((i, i, 2, True), (4000 + i, i, 2, False))}


def test_chunks_are_spread_and_searched_alike(spark, docs):
    """Many chunks find what one finds, which is what all pairs give."""
    rng = random.Random(12)
    data = [*docs, *((5000 + i, *x) for i, *x in rows([prose(rng, 60, 5000) for _ in range(3000)]))]
    one = {tuple(r) for r in N.near_groups(frame(spark, data)).collect()}
    many = {tuple(r) for r in N.near_groups(frame(spark, data), cell=400).collect()}
    assert N.chunks_for(3200) == 1 and N.chunks_for(3200, cell=400) == 8 and N.chunks_for(250_000) == 8 and N.chunks_for(15_000_000) == 58
    live, root = brute(data)
    want = {}
    for d, r in zip(live, root):
        want.setdefault(r, []).append(d[0])
    rows_of = {}
    for _, doc, group, *_ in one:
        rows_of.setdefault(group, []).append(doc)
    assert one == many and sorted(map(sorted, rows_of.values())) == sorted(sorted(w) for w in want.values() if len(w) > 1 or w == [903])


def test_recall_against_exact_similarity_of_texts(spark):
    rng = random.Random(21)
    triples = lambda t: set(zip(t.split(), t.split()[1:], t.split()[2:]))
    texts, alike = [], []
    while len(alike) < 200:
        base = prose(rng, rng.randrange(40, 120), 50_000)
        other = edited(rng, base, rng.choice([0.06, 0.1, 0.14]))
        a, b = triples(base), triples(other)
        if 0.6 <= len(a & b) / len(a | b) < 0.8:
            alike.append((len(texts), len(texts) + 1))
            texts += [base, other]
    group = {r.doc_id: r.group_id for r in N.near_groups(frame(spark, rows(texts))).collect()}
    assert sum(i in group and group[i] == group.get(j) for i, j in alike) >= 0.95 * len(alike)


def test_one_of_each_group_stays(spark, docs):
    df = frame(spark, docs)
    kept = N.drop_near_copies(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    gone = {r.doc_id for r in N.near_groups(df).collect() if not r.keep}
    assert sorted(str(i) for i in ids) == sorted(str(d[0]) for d in docs if d[0] not in gone and d[0] != 903) + ["903"] or ids.count(903) == 1
    assert not gone & set(ids) and {None, 900, 901, 902, 905} <= set(ids)


def test_pivots_never_discard_a_near_pair_and_discard_the_far():
    g = np.random.default_rng(3)
    a, b = pairs_at(g, 500, lambda: g.integers(0, 30))
    forest = N.Forest(np.concatenate([a, b]), N.RADIUS)
    i = np.arange(500)
    assert (N.differ(forest.pivots, i, i + 500) <= hamming(a, b)).all()
    assert (forest.near(i, i + 500) == (hamming(a, b) <= N.RADIUS)).all()
    far = N.pivot_rows(g.integers(0, 2**64, (4000, 2), dtype=np.uint64))
    at = np.arange(2000)
    assert (N.differ(far, at, at + 2000) > N.RADIUS).mean() > 0.9


def test_differences_are_those_over_all_references():
    """The sum over blocks is the greatest difference of distances to references that differ by blocks."""
    g = np.random.default_rng(4)
    fp = g.integers(0, 2**64, (2, 2), dtype=np.uint64)
    rows = N.pivot_rows(fp).astype(int)
    best = 0
    for _ in range(4000):
        flip = g.integers(0, 2, N.BLOCKS).astype(bool)
        d = np.where(flip, 4 - rows, rows).sum(1)
        best = max(best, abs(d[0] - d[1]))
    flip = rows[0] < rows[1]
    d = np.where(flip, 4 - rows, rows).sum(1)
    assert best <= abs(d[0] - d[1]) == N.differ(rows.astype(np.int8), np.array([0]), np.array([1]))[0]


@pytest.mark.parametrize("points", [90, 40_000])
def test_crowds_connect_what_pairs_connect(points):
    """Six crowds, of which some points lie beyond the radius of others, give a tree each."""
    g = np.random.default_rng(5)
    fp = g.integers(0, 2**64, (6, 2), dtype=np.uint64)[g.integers(0, 6, points)]
    for _ in range(8):
        bit = g.integers(0, 128, points)
        fp[np.arange(points), bit // 64] ^= np.uint64(1) << (bit % 64).astype(np.uint64)
    join = lambda pairs: {frozenset(c) for c in comps(points, pairs)}
    for first in (points, points // 3):
        a, b = N.task_edges(fp, first, N.RADIUS)
        got = join(zip(a.tolist(), b.tolist()))
        assert len(a) == points - len(got) and (hamming(fp[a], fp[b]) <= N.RADIUS).all()
        if points == 90:
            meet = lambda i, j: first == points or (i < first) != (j < first)
            assert got == join([(i, j) for i, j in np.argwhere(hamming(fp[:, None], fp[None]) <= N.RADIUS) if meet(i, j)])
        else:
            assert len(got) == 6


def test_a_long_text_gives_its_features_in_parts(monkeypatch):
    rng = random.Random(2)
    texts = pa.array([prose(rng, 3000, 200), "", prose(rng, 5, 9), None, prose(rng, 700, 300)])
    want = N.fingerprint_arrays(texts)
    monkeypatch.setattr(N, "FEATURES", 100)
    got = N.fingerprint_arrays(texts)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def comps(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[find(int(a))] = find(int(b))
    out = {}
    for i in range(n):
        out.setdefault(find(i), set()).add(i)
    return out.values()


def test_components(spark):
    rng = random.Random(6)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(30)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {i: min(c) for c in comps(260, pairs) for i in c if len(c) > 1}
    assert got == want


def test_empty_table(spark):
    assert N.near_groups(frame(spark, [])).count() == 0 and N.drop_near_copies(frame(spark, [])).count() == 0
