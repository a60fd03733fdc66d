"""Small corpora with the cases that every operator must bear."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HAN = "\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff"
WORD = re.compile(rf"[{HAN}]|(?:[^\W_{HAN}])+")


def tokens(text: str | None) -> list[str]:
    """Words of texts in which no marks occur."""
    return WORD.findall((text or "").lower())


def prose(rng: random.Random, n: int, vocab: int = 900) -> str:
    return " ".join(f"w{rng.randrange(vocab)}x" for _ in range(n))


def rows(texts, lang="en", source="s0"):
    return [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, data, parts=3):
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


#: null id, null and empty text, no words, a repeated row, a very long word and text
ODD = [(None, "text without an id", None, None, None), (900, None, None, "s1", None), (901, "", "", "", 0), (902, " \n\n ", "en", "s0", 4), (903, "same row here", "en", "s0", 13), (903, "same row here", "en", "s0", 13), (904, "z" * 50_000, "en", "s0", 50_000), (905, "... --- !!!", "en", "s0", 11)]
