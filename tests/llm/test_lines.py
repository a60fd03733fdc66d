from __future__ import annotations

import random

import pyarrow as pa

from loomgrid.llm import line_dedup as L
from tests.llm.corpus import ODD, frame, prose, rows


def lines(rng, n):
    return [prose(rng, rng.randrange(2, 9)) for _ in range(n)]


def brute(docs):
    """Texts without the chunks that an earlier document, or place, has byte by byte."""
    order = sorted({(d[0] is None, d[0] or 0, L_rid(d), d[1]) for d in docs if d[1] is not None})
    cut = {}
    for _, _, rid, text in order:
        c = L.chunk(pa.array([text]))
        cut[rid, text] = [(c.buf[s:e].tobytes(), int(k) >= 2) for s, e, k in zip(c.start, c.end, c.solid)]
    seen, out = set(), {}
    for _, _, rid, text in order:
        keep = []
        for body, many in cut[rid, text]:
            if many and body in seen:
                continue
            if many:
                seen.add(body)
            keep.append(body)
        out[text] = b"\n".join(keep).decode()
    return out


def L_rid(d):
    return str(d[0])


def make():
    rng = random.Random(3)
    shared = lines(rng, 14)
    texts = ["\n".join(lines(rng, rng.randrange(1, 30))) for _ in range(15)]
    texts += ["\n".join([*lines(rng, k), *shared, *lines(rng, 5)]) for k in range(6)]
    texts += ["\n".join(["same line"] * 100), "\n".join(["same line"] * 70), "one\n\n\ntwo", "\n".join(shared) + "\n"]
    return rows(texts) + [d for d in ODD if d[0] is not None]


def test_same_as_brute_force(spark):
    docs = make()
    want = brute(docs)
    out = L.drop_repeated_chunks(frame(spark, docs).selectExpr("*", "1 as removed", "2 as __rid")).collect()
    assert len(out) == len(docs)
    by_id = {d[0]: d[1] for d in docs}
    for r in out:
        assert r.text == (None if by_id[r.doc_id] is None else want[by_id[r.doc_id]])
        assert r.removed == 1 and (r.removed_ > 0) == (r.text != by_id[r.doc_id])
    assert sum(r.removed_ for r in out) > 40


def test_passages_are_cut_alike_wherever_they_are():
    rng = random.Random(4)
    shared = lines(rng, 60)
    sets = []
    for k in range(4):
        c = L.chunk(pa.array(["\n".join([*lines(rng, k), *shared, *lines(rng, 3)])]))
        sets.append({c.buf[s:e].tobytes() for s, e in zip(c.start, c.end)})
    body = [x for x in sets[0] & sets[1] & sets[2] & sets[3]]
    assert sum(x.count(b"\n") + 1 for x in body) > 45


def test_chunks_cover_the_text():
    texts = ["", "a", "a\n", "\n", "a\nb\n\nc", "x\n" * 100]
    c = L.chunk(pa.array(texts))
    for i, t in enumerate(texts):
        mine = range(int(c.bounds[i]), int(c.bounds[i + 1]))
        assert b"\n".join(c.buf[c.start[k] : c.end[k]].tobytes() for k in mine).decode() == t
        assert all(c.lines[k] <= L.MOST for k in mine) and sum(c.lines[k] for k in mine) == t.count("\n") + 1


def test_empty_table(spark):
    assert L.drop_repeated_chunks(frame(spark, [])).count() == 0
