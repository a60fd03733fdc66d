from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import langid as L
from loomgrid.llm.textkernel import words
from tests.llm.corpus import ODD, frame

SYLLABLES = {"aa": ["ba", "ko", "ri", "tu", "me"], "bb": ["sch", "ung", "ein", "kei", "ter"], "cc": ["qué", "ción", "ñor", "aje", "lla"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(2, 5))) for _ in range(n))


def corpus(seed, n=40):
    rng = random.Random(seed)
    return [(i * 3 + k, text(rng, lang, rng.randrange(20, 80)), lang, "s", 1) for i in range(n) for k, lang in enumerate(SYLLABLES)]


@pytest.fixture(scope="module")
def model(spark):
    return L.train(frame(spark, corpus(1) + ODD))


def test_viterbi_is_the_best_path():
    g = np.random.default_rng(0)
    for n in ([5], [3, 0, 6, 1], [0, 0], [1, 1]):
        bounds = np.concatenate([[0], np.cumsum(n)])
        score = g.normal(size=(bounds[-1], 3)) * 4
        got = L.viterbi(score.astype(np.float32), bounds, 2.5)
        for a, b in zip(bounds[:-1], bounds[1:]):
            value = lambda p, a=a: sum(score[a + i, s] for i, s in enumerate(p)) - 2.5 * sum(x != y for x, y in zip(p, p[1:]))
            assert value(got[a:b]) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=int(b - a))), abs=1e-5)


def test_held_out_accuracy(spark, model):
    out = L.label_languages(frame(spark, corpus(2)), model).collect()
    want = {d[0]: d[2] for d in corpus(2)}
    assert sum(r.lang == want[r.doc_id] for r in out) >= 0.98 * len(want) and all(r.accepted for r in out)


def test_spans_of_mixed_text(model):
    rng = random.Random(3)
    r = L.spans_of(pa.array([f"{text(rng, 'aa', 20)} 77 {text(rng, 'bb', 15)} привет мой друг", None, "", "12 34"]), model)
    names = [model.states[s] for s in r["state"][: r["offsets"][1]]]
    assert names == ["aa", "bb", "ru"]
    assert abs(int(r["start"][1]) - 20) <= 1 and r["start"][2] == 36 and r["letters"].tolist()[1:] == [0, 0, 0]


def test_scripts_narrow_the_candidates(model):
    w = words(pa.array(["abc дом สวัสดี 漢字 12"]))
    names = L.script_table()[1]
    assert [names[s] for s in L.word_scripts(w)] == ["LATIN", "CYRILLIC", *["THAI"] * 4, "CJK", "CJK", ""]
    w = words(pa.array(["漢字 жук Привет", "漢字テスト"]))
    state, _ = model.label(w)
    assert [model.states[s] for s in state] == ["zh", "zh", "ru", "ru", *["ja"] * 5]


WORLD = {"te": "తెలుగు భాష చాలా అందమైనది", "gu": "ગુજરાતી ભાષા સુંદર છે", "pa": "ਪੰਜਾਬੀ ਭਾਸ਼ਾ ਸੋਹਣੀ ਹੈ", "kn": "ಕನ್ನಡ ಭಾಷೆ ಸುಂದರವಾಗಿದೆ", "ml": "മലയാളം ഭാഷ മനോഹരമാണ്", "si": "සිංහල භාෂාව ලස්සනයි", "km": "ភាសាខ្មែរស្អាតណាស់", "my": "မြန်မာဘာသာစကား", "lo": "ພາສາລາວງາມ", "bo": "བོད་ཀྱི་སྐད་ཡིག", "am": "አማርኛ ቋንቋ ቆንጆ ነው", "zh": "北京是中国的首都", "ja": "これは日本語の文章です", "ko": "한국어는 아름답습니다", "th": "ภาษาไทยสวยงาม", "el": "η γλώσσα είναι όμορφη"}


def test_every_letter_has_a_script(spark, model):
    import unicodedata

    table, _ = L.script_table()
    assert not [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L" and not table[c]]
    data = [(i, t, None, "s", 1) for i, t in enumerate(WORLD.values())]
    kept = {r.doc_id for r in L.keep_identified(frame(spark, data), model).collect()}
    assert kept == set(range(len(WORLD)))
    assert [r.lang for r in L.label_languages(frame(spark, data, 1), model).orderBy("doc_id").collect()] == list(WORLD)
    # labelled rows of such a script train, with null ids too
    own = L.train(frame(spark, [(None, f"{WORLD['te']} {i}", "xx", "s", 1) for i in range(50)]))
    assert [r.lang for r in L.label_languages(frame(spark, data[:1]), own).collect()] == ["xx"]


def test_the_sample_is_the_same_for_all_orders_and_has_every_label(spark):
    data = [(None if i % 3 else 7, f"text {i} of this", "big", "s", 1) for i in range(3000)] + [(i, f"rare {i}", "small", "s", 1) for i in range(5)]
    got = [sorted(map(tuple, L.training_rows(frame(spark, data, parts), rows=100).collect())) for parts in (1, 5)]
    assert got[0] == got[1] and sum(r[0] == "small" for r in got[0]) == 5 and sum(r[0] == "big" for r in got[0]) == 50


def test_long_texts_are_cut_into_pieces(model, monkeypatch):
    g = np.random.default_rng(1)
    monkeypatch.setattr(L, "PIECE", 7)
    monkeypatch.setattr(L, "PART_WORDS", 60)
    for _ in range(30):
        bounds = np.concatenate([[0], np.cumsum(g.integers(0, 60, 5))])
        score = g.normal(size=(bounds[-1], 4)) * 4
        assert (L.viterbi(score, bounds, 3.0) == L.viterbi_in_parts(lambda a, b, s=score: s[a:b], bounds, 3.0, 4)).all()
    monkeypatch.undo()
    rng = random.Random(5)
    long = f"{text(rng, 'aa', 3000)} {text(rng, 'bb', 3000)} {text(rng, 'aa', 3000)} " * 20
    r = L.spans_of(pa.array(["", long, text(rng, "bb", 30)]), model)
    sizes = r["size"][: r["offsets"][2]]
    assert len(sizes) == 41 and abs(sizes[1:-1] - np.resize([3000, 6000], 39)).max() < 10


def test_rows_that_have_no_language(spark, model):
    data = corpus(4, 3) + ODD
    df = frame(spark, data).withColumn("share", F.lit(1))
    out = L.label_languages(df, model).collect()
    assert len(out) == len(data)
    none = {r.doc_id for r in out if r.lang is None}
    assert none == {900, 901, 902, 905} and all(r.spans == [] for r in out if r.lang is None)
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and not none & {r.doc_id for r in kept.collect()}
    assert {d[0] for d in corpus(4, 3)} <= {r.doc_id for r in kept.collect()}


def test_empty_and_unlabelled_tables(spark):
    none = frame(spark, [])
    assert L.label_languages(none, L.train(none)).count() == 0
    plain = L.train(frame(spark, [(1, "some words", None, "s", 1)]))
    assert [r.lang for r in L.label_languages(frame(spark, [(1, "some words", None, "s", 1)]), plain).collect()] == ["und"]


def test_scoring_in_parts_changes_nothing(model):
    rng = random.Random(8)
    texts = pa.array([text(rng, "aa", 30_000), text(rng, "bb", 20_000)])
    scores = lambda w: model.scores(w, L.word_scripts(w))
    whole = scores(words(texts))
    alone = np.concatenate([scores(words(texts.slice(i, 1))) for i in range(2)])
    assert np.allclose(whole, alone)


def test_rows_are_kept_in_little_memory(model):
    import tracemalloc

    rng = random.Random(9)
    some = [text(rng, lang, 300) for lang in SYLLABLES for _ in range(20)]
    b = pa.record_batch({"doc_id": pa.array(range(3000)), "text": pa.array([some[i % 60] if i % 7 else "12 34" for i in range(3000)])})
    want = L._accepts(L.spans_of(b.column("text"), model), model, L.MIN_SHARE)
    keep = L._keeper(model, L.MIN_SHARE)
    list(keep(iter([b.slice(0, 10)])))  # fills the caches
    tracemalloc.start()
    kept = [i for part in keep(iter([b])) for i in part.column("doc_id").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert b.nbytes > 5e6 and peak < 40e6 and kept == np.flatnonzero(want).tolist() and 0 < len(kept) < 3000
