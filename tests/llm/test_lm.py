from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgrid.llm import brown_lm as B
from loomgrid.llm.textkernel import words
from tests.llm.corpus import ODD, frame, prose, rows, tokens


def grammar(rng, n):
    """Nouns follow adjectives, verbs follow nouns."""
    return " ".join(f"{k}{rng.randrange(12)}" for _ in range(n) for k in ("adj", "noun", "verb"))


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(7)
    return rows([grammar(rng, rng.randrange(5, 40)) for _ in range(120)]) + ODD


@pytest.fixture(scope="module")
def model(spark, docs):
    return B.train(frame(spark, docs), classes=6, rounds=9)


def test_gains_are_exact():
    rng = np.random.default_rng(0)
    v, c = 12, 3
    big, g = rng.integers(0, 5, (v, v)), rng.integers(0, c, v)
    table = lambda g: np.array([[big[np.ix_(g == a, g == b)].sum() for b in range(c + 1)] for a in range(c + 1)])
    for w in range(v):
        o = np.arange(v) != w
        got = B.gains(table(g), g[w], np.bincount(g[o], big[w, o], c + 1), np.bincount(g[o], big[o, w], c + 1), big[w, w])[:c]
        want = [B.likelihood(table(np.where(o, g, k))) - B.likelihood(table(g)) for k in range(c)]
        assert np.allclose(got, want)


def test_counts_cover_the_corpus(model, docs):
    words = Counter(t for d in docs for t in tokens(d[1]))
    rest = model.rest.collect()
    assert model.count.sum() + sum(r.n for r in rest) == sum(words.values())
    assert model.distinct.sum() == sum(n < B.MIN_COUNT for n in words.values())
    assert len(model.key) + len(rest) == sum(n >= B.MIN_COUNT for n in words.values())
    full = [d for d in docs if tokens(d[1])]
    assert model.pairs.sum() == sum(words.values()) + len(full)


def grown(seed, n):
    """Adjectives, nouns and verbs, of which most are rare."""
    rng = random.Random(seed)
    return [" ".join(f"{k}{int(rng.paretovariate(0.4)) % 5000}" for _ in range(rng.randrange(5, 40)) for k in ("adj", "noun", "verb")) for _ in range(n)]


def test_types_grow_with_the_corpus_and_rare_ones_get_their_class(spark):
    """A small core; the other types are classed by what stands beside them."""
    sizes = []
    for n in (60, 400):
        texts = grown(3, n)
        count = Counter(t for x in texts for t in tokens(x))
        m = B.train(frame(spark, rows(texts)), classes=8, min_share=0.01, part_bytes=20_000)
        assert len(m.key) < 100
        sizes.append(m.rest.count())
        assert sizes[-1] + len(m.key) == sum(v >= B.MIN_COUNT for v in count.values())
        assert m.pairs.sum() == sum(count.values()) + n
    assert sizes[1] > 2 * sizes[0]
    from loomgrid.llm.textkernel import words

    got = {r.key: r["class"] for r in m.rest.collect()}
    kind = {}
    for t in count:
        key = int(B.keys_of(words(pa.array([t])))[0])
        if key in got:
            kind.setdefault(t.rstrip("0123456789"), Counter())[got[key]] += 1
    # the classes of one part of speech are not those of another
    assert all(sum(kind[a][c] for c in kind[b]) <= 0.1 * sum(kind[a].values()) for a in kind for b in kind if a != b)


def test_scores_are_those_of_a_loop_over_words(spark):
    texts = grown(5, 60)
    df = frame(spark, rows(texts) + ODD)
    m = B.train(df, classes=5, min_share=0.02, part_bytes=9_000)
    from loomgrid.llm.textkernel import words

    rest = {r.key: (r["class"], r.n) for r in m.rest.collect()}
    move, emit, total = m.moves(), m.emissions(), m.weights()
    other = grown(6, 20)
    for data, out in ((texts, B.train_and_score(df, classes=5, min_share=0.02, part_bytes=9_000)), (other, B.score(frame(spark, rows(other)), m, 4_000))):
        got = {r.doc_id: r for r in out.collect()}
        for i, t in enumerate(data):
            w = words(pa.array([t]))
            last, p = m.classes, 0.0
            for key, core in zip(B.keys_of(w).tolist(), m.types(w).tolist()):
                c, e = (rest[key][0], np.log((rest[key][1] + 0.5) / total[rest[key][0]])) if key in rest else (m.group[core], emit[core])
                p, last = p + move[last, c] + e, c
            assert got[i].log_prob == pytest.approx(p + move[last, m.classes])


def test_exchange_is_that_of_a_loop_over_types(spark):
    """Brute force: the same rounds over a table of all bigrams."""
    texts = grown(7, 40)
    m = B.train(frame(spark, rows(texts)), classes=4, rounds=5, min_share=0.005)
    start = B.train(frame(spark, rows(texts)), classes=4, rounds=0, min_share=0.005)
    from loomgrid.llm.textkernel import U, mix, words

    big = np.zeros((len(m.group), len(m.group)), np.int64)
    for t in texts:
        seq = [0, *m.types(words(pa.array([t]))).tolist(), 0]
        np.add.at(big, (seq[:-1], seq[1:]), 1)
    group = start.group.copy()
    table = lambda g: np.array([[big[np.ix_(g == a, g == b)].sum() for b in range(5)] for a in range(5)])
    for turn in range(5):
        moves = []
        for w in range(1, len(group)):
            if mix(np.array([w], np.uint64), 77)[0] % U(B.TURNS) != turn % B.TURNS:
                continue
            value = []
            for k in range(4):
                trial = group.copy()
                trial[w] = k
                value.append(B.likelihood(table(trial)))
            best = int(np.argmax(np.array(value) - value[group[w]]))
            if value[best] - value[group[w]] > 1e-6:
                moves.append((-(value[best] - value[group[w]]), w, best))
        moves.sort()
        while moves:
            trial = group.copy()
            for _, w, k in moves:
                trial[w] = k
            if B.likelihood(table(trial)) > B.likelihood(table(group)):
                group = trial
                break
            moves = moves[: len(moves) // 2]
    assert (m.group == group).all()


def test_exchange_finds_the_parts_of_speech(spark, model, docs):
    start = B.train(frame(spark, docs), classes=6, rounds=0)
    assert B.likelihood(model.pairs) > B.likelihood(start.pairs)
    from loomgrid.llm.textkernel import words

    kind = {k: set(model.group[model.types(words(pa.array([" ".join(f"{k}{i}" for i in range(12))])))].tolist()) for k in ("adj", "noun", "verb")}
    assert not kind["adj"] & kind["noun"] and not kind["noun"] & kind["verb"]


def test_exchange_ends_when_no_type_moves(spark, docs, model):
    best = B.train(frame(spark, docs), classes=6)
    assert B.likelihood(best.pairs) >= B.likelihood(model.pairs) - 1


def test_probabilities_sum_to_one(model):
    move, emit = model.moves(), model.emissions()
    assert np.allclose(np.exp(move).sum(1), 1)
    shares = np.exp(emit)
    shares[1 : B.FIRST] *= model.distinct + 1
    total = np.bincount(model.group, shares, model.classes + 1)
    for r in model.rest.collect():
        total[r["class"]] += (r.n + 0.5) / model.weights()[r["class"]]
    assert np.allclose(total[model.weights() > 0], 1)


def test_order_matters(spark, model, docs):
    out = B.score(frame(spark, docs), model).collect()
    assert len(out) == len(docs)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, r)
    for d in docs:
        r = by[d[0]]
        assert r.n_words == len(tokens(d[1])) and (r.perplexity is None) == (r.n_words == 0)
    rng = random.Random(99)
    held = [grammar(rng, 30) for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held]
    total = lambda texts: sum(r.log_prob for r in B.score(frame(spark, rows(texts)).selectExpr("*", "1 as part", "2 as classes"), model).collect())
    assert total(held) > total(mixed) + 100


def test_empty_table(spark):
    none = frame(spark, [])
    assert B.score(none, B.train(none)).count() == 0 and B.train_and_score(none).count() == 0


@pytest.mark.parametrize("at_once", [B.AT_ONCE, 300])
def test_counts_travel_in_packs(monkeypatch, at_once):
    """A row for each bucket, not for each word; the sums are those of all words."""
    monkeypatch.setattr(B, "AT_ONCE", at_once)
    monkeypatch.setattr(B, "slices", lambda batches, column: (b.slice(k, 1) for b in batches for k in range(b.num_rows)))
    rng = random.Random(31)
    texts = pa.array([prose(rng, 100, 400) for _ in range(20)] + [None, ""])
    out = list(B._counts(B.keys_of, 7)(iter([pa.record_batch({"text": texts})])))
    assert all(b.num_rows <= 7 for b in out) and len(out) == (1 if at_once > 300 else 7)
    key, n = B.sums(*B._unpacked(iter(out), key=np.int64, n=np.int64))
    want, times = np.unique(B.keys_of(words(texts)), return_counts=True)
    assert key.tolist() == want.tolist() and n.tolist() == times.tolist()
    where = [set(np.frombuffer(b.column("key")[k].as_buffer(), np.int64).tolist()) for b in out for k in range(b.num_rows)]
    bucket = [x for b in out for x in b.column("bucket").to_pylist()]
    assert all(i == j or not a & b for a, i in zip(where, bucket) for b, j in zip(where, bucket))


def test_types_are_found_where_prefixes_are_shared():
    w = words(pa.array([prose(random.Random(32), 3000, 900)]))
    found = np.unique(B.keys_of(w))
    near = (found[:1] & ~np.int64(2**40 - 1)) + np.arange(0, 160, 16)  # the same prefix ten times
    key = np.unique(np.concatenate([found[::2], near, [-(2**63), 2**63 - 1]]))
    ident = B.FIRST + np.random.default_rng(1).permutation(len(key))
    model = B.Model(key, ident, np.zeros(0), np.zeros(B.KINDS), np.zeros(0), np.zeros((1, 1)), 1)
    known = dict(zip(key.tolist(), ident.tolist()))
    assert model.types(w).tolist() == [known.get(k, 1 + (k & 15)) for k in B.keys_of(w).tolist()]


def test_gains_of_several_types_are_those_of_each():
    rng = np.random.default_rng(33)
    pairs, home = rng.integers(0, 4, (8, 8)) * rng.integers(1, 900, (8, 8)), rng.integers(0, 7, 20)
    right, left, own = rng.integers(0, 3, (20, 8)), rng.integers(0, 3, (20, 8)), rng.integers(0, 3, 20)
    for k, h in enumerate(home):  # the counts hold those of every type
        pairs[h] += right[k]
        pairs[:, h] += left[k]
        pairs[h, h] += own[k]
    want = [B.gains(pairs, home[k], right[k], left[k], own[k]) for k in range(20)]
    assert (B.gains(pairs, home, right, left, own) == want).all()


def packed_pairs(spark, big, rows):
    """Bigrams of a table in some packs."""
    a, b = np.nonzero(big)
    key, n = a << B._BITS | b, big[a, b]
    cut = [key[k::rows] for k in range(rows)], [n[k::rows] for k in range(rows)]
    return spark.createDataFrame([(bytearray(x.tobytes()), bytearray(y.tobytes())) for x, y in zip(*cut)], "key binary, n binary"), len(key)


def test_neighbours_travel_in_packs_and_changes_of_classes_read_those_that_move(spark, monkeypatch):
    """A row for each part and turn, with both sides of a type in it; the class bigrams after some
    moves are those of the whole table, however few rows are read."""
    monkeypatch.setattr(B, "NEAR", 400)
    rng = np.random.default_rng(34)
    v, c = 60, 4
    big = rng.integers(0, 5, (v, v)) * (rng.random((v, v)) < 0.5)
    pairs, size = packed_pairs(spark, big, 3)
    near = B.near_of(pairs, size)
    rows = near.collect()
    assert len(rows) <= B.TURNS * -(-size // 400)
    seen, of = np.zeros((2, v, v), int), []
    for r in rows:
        w, second, other = B._split(np.frombuffer(r.key, np.int64))
        assert (B.mix(w.astype(np.uint64), 77) % np.uint64(B.TURNS) == r.turn).all()
        n = np.frombuffer(r.n, np.int64)
        np.add.at(seen, (second.astype(int), np.where(second, other, w), np.where(second, w, other)), n)
        of.append(set(w.tolist()))
    assert (seen == big).all() and sum(map(len, of)) == len(set().union(*of)) == v
    group = np.append(c, rng.integers(0, c, v - 1))
    table = lambda g: np.array([[big[np.ix_(g == a, g == b)].sum() for b in range(c + 1)] for a in range(c + 1)])
    assert (B._class_pairs(near, group, c) == table(group)).all()
    for t in range(B.TURNS):
        trial = group.copy()
        mine = np.array([w for r, s in zip(rows, of) if r.turn == t for w in s if w != B.EDGE])
        trial[mine] = rng.integers(0, c, len(mine))
        assert (B._class_pairs(near, group, c) + B._class_pairs(near.where(f"turn = {t}"), trial, c, group) == table(trial)).all()


@pytest.mark.parametrize("near, types", [(50, 5), (1 << 19, 7)])
def test_classes_do_not_depend_on_the_parts(spark, docs, model, monkeypatch, near, types):
    monkeypatch.setattr(B, "NEAR", near)
    monkeypatch.setattr(B, "TYPES", types)
    other = B.train(frame(spark, docs), classes=6, rounds=9)
    assert (other.group == model.group).all() and (other.pairs == model.pairs).all()


def test_all_halves_of_a_round_take_one_pass(spark, monkeypatch):
    """The trials of a round are those of the whole table, each alone; a round in which all of them
    fail reads its neighbours twice, for the moves and for the trials."""
    rng = np.random.default_rng(35)
    v, c = 300, 4
    big = rng.integers(0, 5, (v, v)) * (rng.random((v, v)) < 0.2)
    near = B.near_of(*packed_pairs(spark, big, 3)).localCheckpoint()
    group = np.append(c, rng.integers(0, c, v - 1))
    table = lambda g: np.array([[big[np.ix_(g == a, g == b)].sum() for b in range(c + 1)] for a in range(c + 1)])
    mine = B.mix(np.arange(v).astype(np.uint64), 77) % np.uint64(B.TURNS) == 1
    level = np.where(mine & (np.arange(v) != B.EDGE), rng.integers(-1, 6, v), -1)
    trial = np.where(level >= 0, rng.integers(0, c, v), group)
    found = B._trials(near.where("turn = 1"), trial, group, level, c)
    assert len(found) == 6
    for k in range(6):
        assert (found[k] == table(np.where(level >= k, trial, group)) - table(group)).all()
    steps, step = [], type(near).mapInArrow
    monkeypatch.setattr(type(near), "mapInArrow", lambda df, f, *a, **k: steps.append(f.__qualname__.split(".")[0]) or step(df, f, *a, **k))
    monkeypatch.setattr(B, "likelihood", lambda pairs: 0.0)
    after, pairs = B.exchange(near, group, c, rounds=2)
    assert (after == group).all() and (pairs == table(group)).all()
    assert sum(x != "_added" for x in steps) == 5  # the class bigrams, and two for each round


def test_shapes_are_those_of_a_loop_and_keys_are_taken_once(monkeypatch):
    texts = [*(d[1] for d in ODD), "a1 abcde naïve ünïcödë9 123456789012345678 ٣٤ x " + "y" * 16 + " " + "z" * 17, "end7", prose(random.Random(36), 500, 90)]
    w = words(pa.array(texts, pa.string()))
    loop = []
    for a, b in zip(w.start.tolist(), w.end.tolist()):
        x = bytes(w.buf[a:b])
        loop.append((0 if any(48 <= c < 58 for c in x) else 2 if max(x) >= 128 else 1) * 4 + sum(len(x) > n for n in (4, 8, 16)))
    assert B.kinds(w).tolist() == loop and set(loop) >= {0, 3, 4, 7, 8, 9}
    key = np.unique(B.keys_of(w))[::2]
    ident = B.FIRST + np.arange(len(key))
    model = B.Model(key, ident, np.zeros(0), np.zeros(B.KINDS), np.zeros(B.FIRST + len(key), np.int64), np.zeros((2, 2)), 1)
    batch = pa.record_batch({"text": pa.array(texts, pa.string()), "part": pa.array([0] * len(texts))})
    taken, keys_of = [], B.keys_of
    monkeypatch.setattr(B, "keys_of", lambda w: taken.append(1) or keys_of(w))
    for run in (B._contexts(model, 3), B._unknown(model)):
        taken.clear()
        assert list(run(iter([batch]))) and len(taken) == 1
