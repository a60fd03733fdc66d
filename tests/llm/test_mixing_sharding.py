from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import mixing as M
from loomgrid.llm import shard as S
from tests.llm.corpus import ODD, frame, prose


def corpus(n=300):
    rng = random.Random(13)
    return [(i, prose(rng, rng.randrange(5, 60)), rng.choice(["en", "fr"]), rng.choice(["web", "web", "web", "book"]), 1) for i in range(n)]


def cost(capacity, flow):
    """Repetition cost of a flow, filling the cheapest use first; None if it can't be."""
    total = 0
    for p, n in flow.items():
        for e in range(M.EPOCHS):
            take = min(n, capacity[p])
            total, n = total + take * e * e, n - take
        if n:
            return None
    return total


def test_flow_against_all_flows():
    rng = random.Random(1)
    for _ in range(15):
        capacity = {("a",): rng.randrange(0, 4), ("a", "b"): rng.randrange(0, 4), ("b",): rng.randrange(0, 3)}
        quota = {"a": rng.randrange(0, 7), "b": rng.randrange(0, 7)}
        got = M.route(capacity, quota)
        sent = Counter()
        for p, to in got.items():
            for k, v in to.items():
                assert k in p
                sent[k] += v
        best = None
        for a1, a2, b2, b3 in itertools.product(range(13), repeat=4):
            if a1 + a2 > quota["a"] or b2 + b3 > quota["b"]:
                continue
            c = cost(capacity, {("a",): a1, ("a", "b"): a2 + b2, ("b",): b3})
            if c is not None:
                key = (-(a1 + a2 + b2 + b3), c)
                best = key if best is None or key < best else best
        mine = (-sum(sent.values()), cost(capacity, {p: sum(to.values()) for p, to in got.items()}))
        assert mine == best


def test_the_plan_is_sent_without_python_workers(spark):
    out = M.mix(frame(spark, corpus()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "LocalTableScan" in plan  # the scan of the test's own frame
    assert M.mix(frame(spark, []), {}).count() == 0


def test_weights_are_met(spark):
    data = corpus()
    weights = {"source:web": 1, "source:book": 2, "lang:fr": 1}
    out = M.mix(frame(spark, data), weights, 0.9).collect()
    got = Counter()
    for r in out:
        got[r.pool] += len(r.text.split())
        assert r.pool in (f"source:{r.source}", f"lang:{r.lang}")
    budget = 0.9 * sum(len(d[1].split()) for d in data)
    for k, w in weights.items():
        assert abs(got[k] - budget * w / 4) <= 130
    uses = Counter((r.doc_id, r.copy, r.pool) for r in out)
    assert max(uses.values()) == 1
    by_copy = Counter((r.doc_id, r.copy) for r in out)
    assert max(by_copy.values()) == 1  # one reading of a document goes to one pool


@pytest.mark.parametrize("top", [False, True])
def test_cuts_are_those_of_a_sort_of_each_pattern(spark, monkeypatch, top):
    if top:  # all documents in the last hash range, where a cut can lie behind all of them
        monkeypatch.setattr(M, "order_hash", lambda seed: F.lit(2**63 - 1) - F.col("doc_id"))
    rng = random.Random(29)
    df = frame(spark, [(i, prose(rng, rng.randrange(5, 60)), rng.choice(["en", "fr"]), f"s{rng.randrange(30)}", 1) for i in range(80 if top else 400)])
    by = {}
    for r in df.select("doc_id", "text", "lang", "source", M.order_hash(M.SEED).alias("h")).collect():
        by.setdefault((f"lang:{r.lang}", f"source:{r.source}"), []).append((r.h, r.doc_id, len(r.text.split())))
    capacity = {p: sum(n for _, _, n in rows) for p, rows in by.items()}
    flow = M.route(capacity, M.quotas({k: 1.0 for p in capacity for k in p}, int(0.8 * sum(capacity.values()))))
    want = []
    for x in M.pieces(flow, capacity):
        at = 0
        for _, doc, n in sorted(by[tuple(x.pattern.split("\x1f"))]):
            if x.low <= at < x.high:
                want.append((doc, x.pool, x.copy))
            at += n
    assert sorted((r.doc_id, r.pool, r.copy) for r in M.mix(df).collect()) == sorted(want)


def test_seed_and_partitions(spark):
    data = corpus()
    run = lambda parts, seed: sorted((r.doc_id, r.pool, r.copy) for r in M.mix(frame(spark, data, parts), seed=seed).collect())
    assert run(2, 5) == run(5, 5) != run(2, 6)


def test_mixing_cases(spark):
    df = frame(spark, corpus(60) + ODD).selectExpr("*", "'p' as pool", "1 as copy")
    out = M.mix(df)
    assert {"orig_pool", "orig_copy", "pool", "copy"} <= set(out.columns)
    assert None not in {r.doc_id for r in out.collect()} and M.n_tokens is not None
    assert M.mix(frame(spark, [])).count() == 0
    assert [r[0] for r in spark.createDataFrame([("a  b\nc",), ("",), (None,), (" ",)], "t string").select(M.n_tokens(F.col("t"))).collect()] == [3, 0, 0, 0]


def test_fisher_yates_is_a_uniform_permutation():
    assert sorted(S.fisher_yates(50, 3).tolist()) == list(range(50)) and S.fisher_yates(0, 1).tolist() == [] and S.fisher_yates(1, 1).tolist() == [0]
    seen = Counter(tuple(S.fisher_yates(3, k).tolist()) for k in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 800


def test_all_rows_once_whatever_the_partitions(spark):
    data = corpus() + ODD
    runs = []
    for parts in (1, 6):
        rows = S.shard(frame(spark, data, parts), buckets=7).collect()
        runs.append(sorted(((r.shard, r.position, r.doc_id, r.text) for r in rows), key=str))
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((d[0], d[1]) for d in data)
        for k in range(7):
            mine = sorted(r.position for r in rows if r.shard == k)
            assert mine == list(range(len(mine))) and 15 < len(mine) < 85
    assert runs[0] == runs[1]
    order = [r[2] for r in runs[0] if r[2] is not None and r[2] < 300]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.2


def test_shard_columns_and_empty_tables(spark):
    out = S.shard(frame(spark, corpus(5)).selectExpr("*", "1 as shard", "2 as orig_shard", "3 as Position", "4 as __key"))
    assert len(set(c.lower() for c in out.columns)) == len(out.columns) == 11 and {r.shard for r in out.collect()} == {0}
    assert S.shard(frame(spark, [])).count() == 0


@pytest.mark.parametrize("size", [4000, 10**9])
def test_buckets_follow_the_bytes(spark, size):
    n = S.buckets_for(frame(spark, corpus()), size)
    assert (n > 10) == (size == 4000)


def test_clashing_names_in_any_case(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 1, 2, 3)], "doc_id long, text string, lang string, source string, Pool int, orig_pool int, COPY int")
    out = M.mix(df, budget=1)
    assert len({c.lower() for c in out.columns}) == len(out.columns) == 9
    assert out.columns[4:] == ["orig_orig_Pool", "orig_pool", "orig_COPY", "pool", "copy"]


def brute_shard(rows, buckets, seed=S.SEED):
    """Buckets as lists of the (doc_id, text) rows, in their places, by another way."""
    by = {}
    for h, h2, row in rows:
        by.setdefault(h % buckets, []).append((h, h2, row))
    return {b: [sorted(x, key=lambda r: r[:2])[i][2] for i in S.fisher_yates(len(x), seed * 1_000_003 + b)] for b, x in by.items()}


@pytest.mark.parametrize("most_parts", [2, 100])
def test_same_as_a_loop_over_buckets(spark, monkeypatch, most_parts):
    """With a third of all rows equal, and with several buckets in a partition."""
    monkeypatch.setattr(S, "MOST_PARTS", most_parts)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(400)] + [(7, "hot row")] * 200, "doc_id long, text string").repartition(5)
    h = [F.xxhash64(F.lit(S.SEED + k), "doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull()) for k in (0, 1)]
    want = brute_shard([(r[0], r[1], (r[2], r[3])) for r in df.select(*h, "doc_id", "text").collect()], 7)
    got = {}
    for r in S.shard(df, buckets=7).collect():
        got.setdefault(r.shard, {})[r.position] = (r.doc_id, r.text)
    assert {b: [x[i] for i in range(len(x))] for b, x in got.items()} == want


def test_nested_columns(spark):
    df = spark.createDataFrame([(i, [1.0] * 64, {"a": i, "b": 2}, (i, "x")) for i in range(50)], "id int, vec array<double>, m map<string,int>, s struct<a:int,b:string>")
    assert S.buckets_for(df, 1000) >= 50 * 64 * 8 // 1000
    assert sorted(r.id for r in S.shard(df, buckets=4).collect()) == list(range(50))
