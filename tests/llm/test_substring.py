from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomgrid.llm import substring_dedup as S
from tests.llm.corpus import ODD, frame, prose, rows, tokens


def brute(docs, size=50):
    """Words in runs of ``size`` that occur at two places, by document."""
    at = defaultdict(set)
    distinct = {(d[0], d[1]) for d in docs if d[1]}
    for d, text in distinct:
        w = tokens(text)
        for i in range(len(w) - size + 1):
            at[tuple(w[i : i + size])].add((d, text, i))
    out = defaultdict(set)
    for places in at.values():
        if len(places) > 1:
            for d, _, i in places:
                out[d].update(range(i, i + size))
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    passage, other = prose(rng, 70), prose(rng, 55)
    texts = [prose(rng, rng.randrange(20, 300)) for _ in range(30)]
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 30)}" for _ in range(4)]
    texts += [f"{other} {prose(rng, 12)}", f"{prose(rng, 9)} {other.upper()}", f"{prose(rng, 9)} " + " ".join(prose(rng, 49).split())]
    short = prose(rng, 49)
    texts += [f"{prose(rng, 30)} {short} {prose(rng, 30)}", f"{prose(rng, 20)} {short} {prose(rng, 20)}"]
    whole = prose(rng, 120)
    texts += [whole, whole, "spam " * 130, "ham eggs " * 60, f"{passage} and {passage}", passage]
    return rows(texts) + ODD


def test_same_as_brute_force(spark, docs):
    want = brute(docs)
    got = defaultdict(set)
    for r in S.report_repeats(frame(spark, docs)).collect():
        for s in r.repeats:
            got[r.doc_id].update(range(s.start_word, s.start_word + s.n_words))
    assert set(got) == set(want)
    assert sum(len(got[d] - want[d]) for d in got) == 0
    assert sum(len(got[d] & want[d]) for d in want) >= 0.99 * sum(map(len, want.values()))


def test_one_copy_stays(spark, docs):
    df = frame(spark, docs).selectExpr("*", "'x' as __rid", "1 as __cut")
    out = S.drop_repeats(df)
    assert out.columns == df.columns and out.count() == len(docs)
    kept = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in out.collect()]
    assert not {d for d in brute(kept)} - {35}
    lost = {r.doc_id: r.text for r in out.collect()}
    assert sum(lost[d[0]] == d[1] for d in docs) > 30 and lost[900] is None and lost[901] == ""


def test_recompression_is_local():
    import numpy as np

    rng = np.random.default_rng(1)
    core = rng.integers(0, 2**63, 400, dtype=np.uint64)
    found = []
    for k in range(2):
        around = [rng.integers(0, 2**63, 50 + k, dtype=np.uint64) for _ in range(2)]
        sym, at, _, _ = S.recompress(np.concatenate([around[0], core, around[1]]), np.zeros(500 + 2 * k, int))
        found.append(set(sym.tolist()))
    assert len(found[0] & found[1]) > 400 / 7.5 * 0.7


def test_empty_table(spark):
    assert S.report_repeats(frame(spark, [])).count() == 0


def test_repeats_are_told_across_batches():
    """A hot key goes through many batches; what is given out doesn't depend on their size."""
    g = np.random.default_rng(2)
    n = 3000
    key, rid, value = np.where(g.random(n) < 0.5, 5, g.integers(0, 900, n)), g.integers(0, 40, n), g.integers(0, 9, n)
    parts = np.array_split(np.arange(n), 7)
    rows = pa.Table.from_batches([S._rows(key[p], np.zeros(len(p), np.int64), rid[p], value[p]) for p in parts]).sort_by([(c, "ascending") for c in ("to", "key", "check", "rid", "value")])
    want = {}
    for k, r, v in zip(key.tolist(), rid.tolist(), value.tolist()):
        want.setdefault(k, set()).add((r, v))
    want = {(r, v, (r, v) == min(x)) for x in want.values() if len(x) > 1 for r, v in x}
    for size in (1, 13, 100_000):
        out = pa.Table.from_batches(list(S._repeated(iter(rows.to_batches(size)))))
        got = list(zip(out["rid"].to_pylist(), out["value"].to_pylist(), out["first"].to_pylist()))
        assert {(r, v, bool(f)) for r, v, f in got} == want


def test_marks_of_very_long_runs():
    mark, which = S._marks(np.array([3, 10]), np.array([2 * S.MOST_MARK + 5, 7]))
    spans = [(int(m >> 24), int(m & S.MOST_MARK)) for m in mark]
    assert which.tolist() == [0, 0, 0, 1] and spans == [(3, S.MOST_MARK), (3 + S.MOST_MARK, S.MOST_MARK), (3 + 2 * S.MOST_MARK, 5), (10, 7)]
