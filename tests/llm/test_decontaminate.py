from __future__ import annotations

import random

import pyarrow as pa
import pytest

from loomgrid.llm import decontaminate as D
from tests.llm.corpus import ODD, frame, prose, rows, tokens


def weighted(words):
    if len(words) < 3:
        return {tuple(words): 1}
    return {tuple(words[i : i + 3]): sum(len(w.encode()) for w in words[i : i + 3]) for i in range(len(words) - 2)}


def similarity(a, b):
    a, b = weighted(a), weighted(b)
    both = sum(a[k] for k in a.keys() & b.keys())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(21)
    return [(i, prose(rng, rng.randrange(12, 60), 4000)) for i in range(25)] + [(50, None), (51, ""), (52, "two words"), (None, "an item that has no number at all"), (3, prose(rng, 30)), (53, "北京是哪个国家的首都？"), (54, "问题"), (55, "తెలుగు భాష చాలా అందమైనది")] + [(7, "a repeated row of items"), (7, "a repeated row of items")]


@pytest.fixture(scope="module")
def docs(items):
    rng = random.Random(22)
    texts = [prose(rng, rng.randrange(5, 300), 4000) for _ in range(40)]
    for _, t in items[:25]:
        words = t.split()
        for share in (0, 0.05, 0.1):
            texts.append(f"{prose(rng, 60, 4000)} " + " ".join(f"q{rng.randrange(999)}" if rng.random() < share else w for w in words) + f"! {prose(rng, 40, 4000)}")
        texts.append(" ".join(words[: len(words) // 4]) + f" {prose(rng, 50, 4000)}")
    texts += ["so two words, then", "北京是哪个国家的首都？", "請問北京是哪个国家的首都", "テスト問題は難しい", "తెలుగు భాష చాలా అందమైనది కదా"]
    texts += ["An item that has NO number at all", "a repeated row of items", "of items"]
    return rows(texts) + ODD


def brute(docs, items):
    """Best similarity of each document and item over all windows of the item's size."""
    out = {}
    for d in {(d[0], d[1]) for d in docs if d[1]}:
        w = tokens(d[1])
        for i, text in items:
            n = len(tokens(text))
            if not n or not w or n < 3 and len(w) < n:
                continue
            best = max((similarity(w[k : k + n], tokens(text)) for k in range(max(1, len(w) - n + 1))), default=0)
            if best >= D.THRESHOLD:
                out[d[0], i] = max(best, out.get((d[0], i), 0))
    return out


def test_same_as_all_windows(spark, docs, items):
    got = {}
    for r in D.find_contamination(frame(spark, docs).withColumnRenamed("n_chars", "similarity"), spark.createDataFrame(items, "item_id long, text string")).collect():
        got[r.doc_id, r.item_id] = max(r.similarity, got.get((r.doc_id, r.item_id), 0))
    want = brute(docs, items)
    assert len(want) > 60 and set(got) <= set(want)
    assert len(got) >= 0.9 * len(want)
    assert sum(abs(got[k] - want[k]) < 1e-9 for k in got) >= 0.95 * len(got)
    sure = {k for k, v in want.items() if v >= 0.75}
    assert sure <= set(got)


def test_clean_documents_stay(spark, docs, items):
    df = frame(spark, docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = D.drop_contaminated(df, bench)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    bad = {r.doc_id for r in D.find_contamination(df, bench).collect()}
    assert ids == sorted(str(d[0]) for d in docs if d[0] not in bad) and kept.columns == df.columns
    assert {str(i) for i in range(40)} <= set(ids)


def test_slices_of_the_benchmark(spark, docs, items, monkeypatch):
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, D.find_contamination(frame(spark, docs), bench).collect()), key=str)
    monkeypatch.setattr(D, "ITEM_BYTES", 2000)
    assert len(D.indexes(bench)) > 2
    assert sorted(map(tuple, D.find_contamination(frame(spark, docs), bench).collect()), key=str) == whole


def test_one_very_long_text(items):
    """Some 5 MB, with the items in it."""
    rng = random.Random(23)
    filler = prose(rng, 400_000, 4000)
    text = filler + " " + " ".join(t for _, t in items if t) + " " + filler[:1_000_000]
    index = D.Index([i for i, t in items if t], [t for _, t in items if t], D.RADIUS)
    found = index.matches(pa.array([text, "two words"]), D.THRESHOLD)
    assert {i for i, s in zip(found["item"].tolist(), found["similarity"].tolist()) if s == 1} >= set(range(25))


def test_empty_tables(spark, docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(frame(spark, docs), none).count() == 0
    assert D.drop_contaminated(frame(spark, docs), none).count() == len(docs)
    assert D.find_contamination(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
