"""Language spans: script ranges narrow the candidates, Viterbi labels the words.

Each word's script follows from Unicode ranges and leaves the languages written in it.
Where several remain, letter-trigram models score the word; a Viterbi pass over the
words of a document, with a penalty for each switch, labels spans. All documents of a
batch advance through the pass together, as array operations; a long text is cut into
pieces that advance together and are chained, which gives the same path.

Models are trained on ``TRAIN_ROWS`` labelled documents at most, as many of each label, chosen
by a seeded hash of id and text; all else covers every document. Every letter of Unicode has
a script. A script that no trained language uses has the default language of ``DEFAULTS``,
else ``und``.

Cases: a null or empty text, or one without letters, has language null, no spans and is
rejected. Digits take the label of their neighbours. Of labels that tie, the first in
alphabetical order wins. Rows that repeat are labelled each, but train once. Rows whose label
is null do not train; with none at all, words of Latin script are ``und``. Null or equal ids
train as others do. Ids are of type long. Other columns are kept.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.common import slices
from loomgrid.llm.textkernel import Words, code_points, words

TRAIN_ROWS = 2000
#: the most frequent labels that are trained
MOST_LABELS = 200
SWITCH = 12.0
MIN_SHARE = 0.5
SPANS = "array<struct<lang:string,start_word:int,n_words:int>>"
RESULT = f"doc_id long, lang string, share double, n_words long, accepted boolean, spans {SPANS}"
_BUCKETS = 1 << 16
#: default languages of the scripts that no trained language uses; the first one of a script wins a tie
DEFAULTS = {
    "LATIN": ["und"], "GREEK": ["el"], "CYRILLIC": ["ru"], "ARMENIAN": ["hy"], "HEBREW": ["he"], "ARABIC": ["ar"], "SYRIAC": ["syr"], "THAANA": ["dv"], "NKO": ["nqo"],
    "DEVANAGARI": ["hi"], "BENGALI": ["bn"], "GURMUKHI": ["pa"], "GUJARATI": ["gu"], "ORIYA": ["or"], "TAMIL": ["ta"], "TELUGU": ["te"], "KANNADA": ["kn"], "MALAYALAM": ["ml"],
    "SINHALA": ["si"], "THAI": ["th"], "LAO": ["lo"], "TIBETAN": ["bo"], "MYANMAR": ["my"], "GEORGIAN": ["ka"], "HANGUL": ["ko"], "ETHIOPIC": ["am"], "CHEROKEE": ["chr"],
    "CANADIAN": ["iu"], "KHMER": ["km"], "MONGOLIAN": ["mn"], "TIFINAGH": ["zgh"], "YI": ["ii"], "BOPOMOFO": ["zh"], "JAVANESE": ["jv"], "BALINESE": ["ban"], "OL": ["sat"],
    "HIRAGANA": ["ja"], "KATAKANA": ["ja"], "CJK": ["zh", "ja"], "VAI": ["vai"], "ADLAM": ["ff"], "LISU": ["lis"],
}
#: what a language that isn't a script's first default loses a word of it
SECOND = 0.5
_NEVER = -60.0


@functools.cache
def script_table() -> tuple[np.ndarray, list[str]]:
    """Script of every code point (0: no letter), and the scripts' names; Latin is 1. The
    name of a letter says its script, so that every letter has one."""
    names, number = ["", "LATIN"], {"LATIN": 1}
    out = np.zeros(0x110000, np.uint8)
    for c in range(0xAA, 0x323B0):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            if 0x3400 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or c >= 0x20000:
                name = "HANGUL" if 0xAC00 <= c < 0xD7A4 else "CJK"
            else:
                parts = unicodedata.name(ch, "OTHER").replace("-", " ").split()
                name = next((x for x in parts if x in DEFAULTS), "LATIN" if parts[0] in _NO_SCRIPT else parts[0])
            out[c] = number.setdefault(name, min(len(names), 255))
            if out[c] == len(names):
                names.append(name)
    for lo, hi in ((0x41, 0x5B), (0x61, 0x7B)):
        out[lo:hi] = 1
    return out, names


#: first words of the names of letters that belong to no script
_NO_SCRIPT = {"MODIFIER", "MATHEMATICAL", "FEMININE", "MASCULINE", "SCRIPT", "BLACK", "DOUBLE", "ALEF", "BET", "GIMEL", "DALET", "INFORMATION", "TURNED", "ROTATED", "REVERSED", "LIGATURE", "MICRO", "CARON", "EULER", "PLANCK", "OHM", "KELVIN", "ANGSTROM", "VEDIC"}


def word_scripts(w: Words) -> np.ndarray:
    """Highest script number among the letters of each word; 0 without letters."""
    if not len(w.hash):
        return np.zeros(0, np.uint8)
    table, _ = script_table()
    s = np.append(table[:256][np.where(w.buf < 0x80, w.buf, 0)], np.uint8(0))
    at, cp = code_points(w.buf)
    s[at] = table[cp]
    return np.maximum.reduceat(s, np.stack([w.start, w.end], 1).ravel())[::2]


def trigrams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram at each byte of the words, and the first index of each word."""
    length = w.end - w.start
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(w.start - first, length)
    c = w.buf[at].astype(np.uint32)
    prev, nxt = np.empty_like(c), np.empty_like(c)
    if len(c):
        prev[1:], nxt[:-1] = c[:-1], c[1:]
        prev[first], nxt[first + length - 1] = 32, 32
    code = (prev << np.uint32(16)) | (c << np.uint32(8)) | nxt
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), first


@dataclass
class Model:
    states: list[str]
    scripts: np.ndarray  #: (scripts, states) whether a state can write the script
    table: np.ndarray  #: (buckets, states) log probabilities, 0 where untrained
    prior: np.ndarray  #: (scripts, states) added to a word of the script
    switch: float = SWITCH

    def scores(self, w: Words, script: np.ndarray) -> np.ndarray:
        """(words, states) log scores."""
        code, first = trigrams(w)
        s = np.zeros((len(first), len(self.states)), np.float32)
        known = np.flatnonzero(self.table.any(0))
        table = np.ascontiguousarray(self.table[:, known])
        for lo in range(0, len(first), 32_768):  # a trigram's row of scores is wide: few at a time
            a, hi = first[lo], min(lo + 32_768, len(first))
            b = first[hi] if hi < len(first) else len(code)
            part = s[lo:hi]
            part[:, known] = np.add.reduceat(table[code[a:b]], first[lo:hi] - a, axis=0)
            can = self.scripts[script[lo:hi]]
            part[can.sum(1) <= 1] = 0
            part += self.prior[script[lo:hi]]
            worst = np.where(can, part, np.inf).min(1, keepdims=True)
            np.copyto(part, np.where(np.isfinite(worst), worst, 0) + np.float32(_NEVER), where=~can)
            part[script[lo:hi] == 0] = 0
        return s

    def label(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """State of each word by Viterbi over each document, and the scripts."""
        script = word_scripts(w)
        # a state that can write none of the words is on no best path
        few = np.flatnonzero(self.scripts[np.flatnonzero(np.bincount(script, minlength=1))].any(0))
        few = few if len(few) else np.arange(min(1, len(self.states)))
        m = replace(self, states=[self.states[j] for j in few], scripts=self.scripts[:, few], table=self.table[:, few], prior=self.prior[:, few])
        if len(w.hash) <= PART_WORDS and np.diff(w.bounds).max(initial=0) <= 4 * PIECE:
            s = viterbi(m.scores(w, script), w.bounds, self.switch)
        else:
            s = viterbi_in_parts(lambda a, b: m.scores(_part(w, a, b), script[a:b]), w.bounds, self.switch, len(few))
        return few[s] if len(few) else s, script


def _part(w: Words, a: int, b: int) -> Words:
    """Some of the words, without their documents."""
    lo, hi = (int(w.start[a]), int(w.end[b - 1])) if b > a else (0, 0)
    return replace(w, hash=w.hash[a:b], start=w.start[a:b] - lo, end=w.end[a:b] - lo, buf=w.buf[lo:hi], doc=w.doc[a:b])


def viterbi(score: np.ndarray, bounds: np.ndarray, switch: float, entry: np.ndarray | None = None, final: np.ndarray | None = None) -> np.ndarray:
    """Best path of each document; the documents advance together, longest first. ``entry`` is
    the state before each document and ``final`` that of its last word; -1 leaves it free."""
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    head, size = bounds[:-1][order], n[order]
    steps = int(size[0]) if len(size) else 0
    out = np.zeros(len(score), np.int16)
    if not steps:
        return out
    alive = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    best_prev = np.zeros(len(score), np.int16)
    moved = np.zeros(score.shape, bool)
    v = score[head[: alive[0]]].astype(np.float64)
    if entry is not None:
        e = entry[order][: alive[0]]
        i = np.flatnonzero(e >= 0)
        v[i] -= switch
        v[i, e[i]] += switch
    last = np.zeros(len(head), np.int64)
    for t in range(1, steps + 1):
        m = int(alive[t]) if t < steps else 0
        if m < len(v):
            last[m : len(v)] = v[m:].argmax(1)
        if not m:
            break
        v = v[:m]
        b = v.argmax(1)
        jump = v[np.arange(m), b][:, None] - switch
        at = head[:m] + t
        turn = jump > v
        best_prev[at], moved[at] = b, turn
        v = np.where(turn, jump, v) + score[at]
    state = last if final is None else np.where(final[order] >= 0, final[order], last)
    for t in range(steps - 1, -1, -1):
        m = int(alive[t])
        at = head[:m] + t
        out[at] = state[:m]
        state[:m] = np.where(moved[at, state[:m]], best_prev[at], state[:m])
    return out


#: words that are scored at a time, and words of a piece of a text longer than that
PART_WORDS = 1 << 18
PIECE = 1 << 10


def viterbi_in_parts(score, bounds: np.ndarray, switch: float, states: int) -> np.ndarray:
    """As ``viterbi`` of ``score(first, end)``, which is asked for a bounded number of words. A
    document is cut into pieces. For each the best way from every state to every other is
    found, all pieces advancing together; these are chained through the document, and then
    each piece has its path between the states that the chain gives it."""
    docs = np.repeat(np.arange(len(bounds) - 1), -(-np.diff(bounds) // PIECE))
    first = np.searchsorted(docs, np.arange(len(bounds)))
    head = bounds[docs] + (np.arange(len(docs)) - first[docs]) * PIECE
    tail = np.minimum(head + PIECE, bounds[docs + 1])
    inner = np.flatnonzero((tail < bounds[docs + 1]) | (head > bounds[docs]))  # of documents of several pieces
    ways = np.zeros((len(docs), states, states))
    parts = max(1, PART_WORDS // PIECE)
    for lo in range(0, len(inner), parts):
        p = inner[lo : lo + parts]
        base, size = int(head[p[0]]), tail[p] - head[p]
        s = score(base, int(tail[p[-1]]))
        at = head[p] - base
        v = np.where(np.eye(states, dtype=bool), 0.0, -switch)[None] + s[at][:, None, :].astype(np.float64)
        for t in range(1, int(size.max())):
            on = np.flatnonzero(size > t)
            x = v[on]
            v[on] = np.maximum(x, x.max(2, keepdims=True) - switch) + s[at[on] + t][:, None, :]
        ways[p] = v
    entry, final = np.full(len(docs), -1), np.full(len(docs), -1)
    for d in np.unique(docs[inner]):
        a, b = int(first[d]), int(first[d + 1])
        # nothing comes before the first piece: the state before is whichever suits best
        value, back = ways[a].max(0), []
        for k in range(a + 1, b):
            total = value[:, None] + ways[k]
            back.append(total.argmax(0))
            value = total.max(0)
            value = value - value.max()
        state = int(value.argmax())
        for k in range(b - 1, a - 1, -1):
            final[k] = state
            if k > a:
                state = int(back[k - a - 1][state])
                entry[k] = state
    out = np.zeros(int(bounds[-1]), np.int16)
    lo = 0
    while lo < len(docs):
        hi = max(lo + 1, int(np.searchsorted(tail, head[lo] + PART_WORDS, "right")))
        base, end = int(head[lo]), int(tail[hi - 1])
        out[base:end] = viterbi(score(base, end), np.append(head[lo:hi], end) - base, switch, entry[lo:hi], final[lo:hi])
        lo = hi
    return out


def training_rows(docs: DataFrame, label: str = "lang", rows: int = TRAIN_ROWS, seed: int = 9) -> DataFrame:
    """(label, text) of the rows that train: of each label the ``rows`` / labels that a seeded
    hash of id and text puts first."""
    known = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull()).select(F.col(label).alias("label"), "doc_id", "text")
    sizes = known.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(MOST_LABELS).collect()
    if not sizes:
        return known.select("label", "text").limit(0)
    each = max(1, rows // len(sizes))
    h = F.xxhash64(F.lit(seed), "doc_id", F.col("doc_id").isNull(), "text")
    # a share of the hashes leaves few rows of a label for the ranks: six deviations above what is wanted
    share = {r.label: min(1.0, (each + 6 * each**0.5 + 36) / r.n) for r in sizes}
    bound = F.lit(None).cast("long")
    for name, x in share.items():
        bound = F.when(F.col("label") == F.lit(name), F.lit(min(int(x * 2.0**64) - 2**63, 2**63 - 1))).otherwise(bound)
    few = known.withColumn("h", h).where(F.col("h") <= bound).select("label", "text", "h").distinct()
    place = F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))
    return few.withColumn("place", place).where(F.col("place") <= each).select("label", "text")


def train(docs: DataFrame, label: str = "lang", rows: int = TRAIN_ROWS, seed: int = 9, switch: float = SWITCH) -> Model:
    """Trigram models of the labels, from ``training_rows``."""
    sample = training_rows(docs, label, rows, seed).toArrow()
    labels = np.array(sample.column("label").to_pylist(), object)
    names = sorted(set(labels))
    scripts = script_table()[1]
    count = np.zeros((_BUCKETS, len(names)))
    used = np.zeros((len(names), len(scripts)))
    for k, name in enumerate(names):
        texts = sample.filter(pa.array(labels == name)).column("text").combine_chunks()
        w = words(texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts)
        script = word_scripts(w)
        code, first = trigrams(w)
        count[:, k] = np.bincount(code[np.repeat(script > 0, w.end - w.start)], minlength=_BUCKETS)
        used[k] = np.bincount(script, w.end - w.start, len(scripts))
    used[:, 0] = 0
    trained = used > 0.05 * np.maximum(used.sum(1, keepdims=True), 1)
    trained[:, 0] = False
    free = {scripts.index(s): d for s, d in DEFAULTS.items() if s in scripts and not trained[:, scripts.index(s)].any()}
    free |= {s: ["und"] for s in range(1, len(scripts)) if s not in free and not trained[:, s].any()}
    states = sorted({*names, *(x for d in free.values() for x in d)})
    can = np.zeros((len(scripts), len(states)), bool)
    prior = np.zeros((len(scripts), len(states)), np.float32)
    table = np.zeros((_BUCKETS, len(states)), np.float32)
    for k, name in enumerate(names):
        j = states.index(name)
        can[trained[k], j] = True
        table[:, j] = np.log((count[:, k] + 0.1) / (count[:, k].sum() + 0.1 * _BUCKETS))
    for s, found in free.items():
        for x in found:
            can[s, states.index(x)] = True
            prior[s, states.index(x)] = 0 if x == found[0] else -SECOND
    for s in free:  # a default has no trigrams to compare
        can_many = np.flatnonzero(can[s])
        if len(can_many) > 1 and (table[:, can_many] != 0).any():
            can[s] = [x == free[s][0] for x in states]
    return Model(states, can, table, prior, switch)


def spans_of(texts: pa.Array, model: Model) -> dict:
    """Dominant language, its share of the letters, spans and word counts of each text."""
    w = words(texts)
    state, script = model.label(w)
    docs, width = len(texts), len(model.states)
    letters = np.where(script > 0, w.end - w.start, 0)
    by = np.bincount(w.doc * width + state, letters, docs * width).reshape(docs, width)
    total = by.sum(1)
    cut = np.ones(len(state), bool)
    if len(state):
        cut[1:] = (state[1:] != state[:-1]) | (w.doc[1:] != w.doc[:-1])
    head = np.flatnonzero(cut)
    return {
        "top": by.argmax(1) if width else np.zeros(docs, int), "share": by.max(1, initial=0) / np.maximum(total, 1), "letters": total,
        "n": np.diff(w.bounds), "state": state[head], "start": head - w.bounds[w.doc[head]],
        "size": np.diff(np.append(head, len(state))), "offsets": np.searchsorted(head, w.bounds),
    }


def _accepts(r: dict, model: Model, min_share: float) -> np.ndarray:
    und = np.array([s == "und" for s in model.states] or [True])
    return (r["letters"] > 0) & (r["share"] >= min_share) & ~und[np.minimum(r["top"], len(und) - 1)]


def _labeller(model: Model, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.states, pa.string())
        for b in slices(batches, "text", 2 << 20):
            r = spans_of(b.column("text"), model)
            none = r["letters"] == 0
            lang = names.take(pa.array(np.where(none, 0, r["top"]), mask=none))
            offsets = np.where(np.append(none, False), r["offsets"], r["offsets"])
            items = pa.StructArray.from_arrays([names.take(pa.array(r["state"])), pa.array(r["start"].astype(np.int32)), pa.array(r["size"].astype(np.int32))], ["lang", "start_word", "n_words"])
            spans = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items)
            spans = pa.ListArray.from_arrays(pa.array(np.zeros(2, np.int32)), items.slice(0, 0)).take(pa.array(np.zeros(b.num_rows, int))) if none.all() else spans
            if none.any() and not none.all():
                empty = pa.array([[]], spans.type)
                both = pa.concat_arrays([spans, empty])
                spans = both.take(pa.array(np.where(none, len(spans), np.arange(len(spans)))))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "lang": lang, "share": pa.array(np.where(none, 0.0, r["share"])), "n_words": pa.array(r["n"].astype(np.int64)), "accepted": pa.array(_accepts(r, model, min_share)), "spans": spans})

    return run


def label_languages(docs: DataFrame, model: Model, min_share: float = MIN_SHARE) -> DataFrame:
    """One row a document: dominant language, share of its letters, and labelled spans."""
    return docs.select("doc_id", "text").mapInArrow(_labeller(model, min_share), RESULT)


#: bytes of text that are labelled at a time where whole rows pass: the Arrow batch of all columns is held beside
KEEP_BYTES = 1 << 19


def _keeper(model: Model, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", KEEP_BYTES):
            yield b.filter(pa.array(_accepts(spans_of(b.column("text"), model), model, min_share)))

    return run


def keep_identified(docs: DataFrame, model: Model, min_share: float = MIN_SHARE) -> DataFrame:
    """The documents of one known dominant language, all columns kept, in one pass."""
    return docs.mapInArrow(_keeper(model, min_share), docs.schema)
