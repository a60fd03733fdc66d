"""Secret scan with a recursive decoding worklist.

The text is the first layer. A layer is scanned for secrets, then for encoded parts: URL
escapes, Unicode escapes and character references, base64, and compressed bytes (gzip,
zlib, bzip2, xz, zstandard) found in base64. Base64 may span lines, which are read together
and one by one, and start at any of four characters, as letters before it look like it. What a part decodes to is a new layer, and
the worklist goes on until no layer gives a new one. A layer that was seen before (a cycle,
or a part that occurs twice at one place) isn't scanned again. Every layer keeps, for each
of its characters, the range of the first text that it came from, so a finding at any depth
has a span of the text: exact for URL and Unicode escapes, the four characters of a group
for base64, the whole part for compressed bytes.

One pass over the documents, nothing is shuffled. Documents that hold nothing which could
be a secret or an encoded part are passed over by a linear-time regular expression; whole
texts are scanned, without a bound on depth. Compressed parts are unpacked up to
``MOST_BYTES``; one that would be larger is reported as kind ``oversized_layer``.

Cases: null and empty texts have no findings. Rows that repeat are reported each. Escapes
of bytes that aren't UTF-8, and of control characters, stay as they are. Decoded base64 and
unpacked bytes are read in the longest pieces that are UTF-8 without control characters, from
``SHORTEST`` bytes. All members of compressed bytes are unpacked. A secret that two rules match is reported by the first rule. A clash of column names can't occur: the
result has its own columns. The secret itself is not in the result, only its digest.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from loomgrid.llm.common import slices

MOST_BYTES = 64 << 20
RESULT = "doc_id long, kind string, start_char long, end_char long, depth int, layers string, length int, sha256 string"
RULES = [
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]|\\n)+?-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("aws_access_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("github_fine_grained", r"\bgithub_pat_[A-Za-z0-9_]{22,}\b"),
    ("slack_token", r"\bxox[abeoprs]-[A-Za-z0-9-]{10,}"),
    ("google_api_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("stripe_key", r"\b[sr]k_(?:live|test)_[0-9a-zA-Z]{16,}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("url_password", r"(?<=://)[^\s/:@]+:[^\s/:@]{3,}(?=@)"),
    ("assignment", r"(?i)(?:api[_-]?key|secret|token|passw(?:or)?d|pwd|credential)s?[\"']?\s{0,4}(?:=>|[=:])\s{0,4}[\"']?(?=[^\s\"']*\d)([A-Za-z0-9+/_.~!@#$^&*-]{8,})"),
]
_RULES = [(k, re.compile(r, re.ASCII)) for k, r in RULES]
#: a text without a match holds neither a secret nor an encoded part
MAYBE = (
    r"(?:[A-Za-z0-9+/_-](?:[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*)?){12}|%[0-9A-Fa-f]{2}|\\[uUx][0-9A-Fa-f{]|&#[0-9xX]|-----BEGIN|://[^\s/:@]+:"
    r"|(?i:api[_-]?key|secret|token|passw|pwd|credential)s?[\"']?\s{0,4}(?:=>|[=:])"
)
_RUN = re.compile(r"[^\s\"'<>]+")
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#(\d{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
_WORD = re.compile(r"\S+")
#: bytes of the shortest secret, ://a:bcd@; base64 of it has twelve characters
SHORTEST = 9
_BREAK = re.compile(r"[ \t]*(?:\r?\n|\r|(?:\\r)?\\n)[ \t]*")
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]+(?:{_BREAK.pattern}[A-Za-z0-9+/_-]+)*={{0,2}}")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0e-\x1f\x7f]")
_MAGIC = [(b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\x00", "xz"), (b"\x28\xb5\x2f\xfd", "zstd"), (b"\x78\x01", "zlib"), (b"\x78\x5e", "zlib"), (b"\x78\x9c", "zlib"), (b"\x78\xda", "zlib")]
_MAGICS = re.compile(b"|".join(re.escape(m) for m, _ in _MAGIC))
#: UTF-8 without control characters
_PIECE = re.compile(
    rb"(?:[\t\n\x0c\r -~]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]"
    rb"|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+"
)


class Oversized(Exception):
    pass


@dataclass
class Layer:
    text: str
    start: np.ndarray | None  #: start in the first text of each character; None: the text itself
    end: np.ndarray | None
    path: tuple[str, ...]

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.start is None:
            return a, b
        return int(self.start[a:b].min()), int(self.end[a:b].max())


@dataclass
class Finding:
    kind: str
    start: int
    end: int
    path: tuple[str, ...]
    value: str


def unpack(data: bytes, at: int = 0, most: int = MOST_BYTES) -> tuple[str, bytes, int, bool] | None:
    """Name, content of all members, end, and whether that end is known, of the compressed bytes
    that start at ``at``; None if they are not. Oversized beyond ``most``."""
    magic, name = next(((m, n) for m, n in _MAGIC if data.startswith(m, at)), (b"", ""))
    if not name:
        return None
    make = {"bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor, "zstd": lambda: zstandard.ZstdDecompressor().decompressobj()}.get(name, lambda: zlib.decompressobj(47))
    view, out, end, whole = memoryview(data), bytearray(), None, False
    while True:
        d, had = make(), len(out)
        try:
            while at < len(data) and not d.eof:
                chunk = view[at : at + 1024]
                out += d.decompress(chunk) if name == "zstd" else d.decompress(chunk, most + 1 - len(out))
                at += len(chunk)
                if len(out) > most:
                    raise Oversized(name)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError, zstandard.ZstdError):
            del out[had:]
            break
        at -= len(d.unused_data)
        end, whole = at, d.eof
        while data.startswith(b"\0", at):
            at += 1
        if not whole or not data.startswith(magic, at):
            break
    return None if end is None else (name, bytes(out), end, whole)


def _url(layer: Layer) -> Iterator[tuple[str, str, list[int], list[int]]]:
    for m in _RUN.finditer(layer.text) if _PERCENT.search(layer.text) else ():
        part, base = m.group(), m.start()
        if not _PERCENT.search(part):
            continue
        # the place in the part that each decoded byte came from, then by character
        raw, at, size = bytearray(), [], []
        i = 0
        while i < len(part):
            if part[i] == "%" and _PERCENT.match(part, i):
                raw.append(int(part[i + 1 : i + 3], 16))
                at.append(i)
                size.append(3)
                i += 3
            else:
                b = part[i].encode()
                raw += b
                at += [i] * len(b)
                size += [1] * len(b)
                i += 1
        out: list[str] = []
        start: list[int] = []
        end: list[int] = []

        def keep(lo: int, hi: int) -> None:
            out.append(part[lo:hi])
            start.extend(range(lo, hi))
            end.extend(range(lo + 1, hi + 1))

        last, new = 0, False
        for piece in _PIECE.finditer(raw):
            a, b = piece.span()
            keep(last, at[a])
            out.append(piece.group().decode())
            heads = [k for k in range(a, b) if raw[k] & 0xC0 != 0x80]
            start += [at[k] for k in heads]
            end += [at[k - 1] + size[k - 1] for k in [*heads[1:], b]]
            last = end[-1]
            new = new or 3 in size[a:b]
        keep(last, len(part))
        if new:
            yield "url", "".join(out), [base + x for x in start], [base + x for x in end]


def _unicode(layer: Layer) -> Iterator[tuple[str, str, list[int], list[int]]]:
    for run in _WORD.finditer(layer.text) if _ESCAPE.search(layer.text) else ():
        if "\\" not in run.group() and "&#" not in run.group():
            continue
        out: list[str] = []
        at: list[int] = []
        end: list[int] = []
        last, part, base = 0, run.group(), run.start()
        codes = [(m.start(), m.end(), int(m.group(5)) if m.group(5) else int(next(g for g in m.groups() if g), 16)) for m in _ESCAPE.finditer(part)]
        for (a, b, code), (c, d, low) in zip(codes, [*codes[1:], (-1, -1, 0)]):
            if a < last:
                continue  # the second half of a pair
            if 0xD800 <= code < 0xDC00 and c == b and 0xDC00 <= low < 0xE000:
                code, b = 0x10000 + ((code - 0xD800) << 10) + low - 0xDC00, d
            if code > 0x10FFFF or 0xD800 <= code < 0xE000 or _CONTROL.match(chr(code)):
                continue
            for i in range(last, a):
                out.append(part[i])
                at.append(i)
                end.append(i + 1)
            out.append(chr(code))
            at.append(a)
            end.append(b)
            last = b
        if not last:
            continue
        for i in range(last, len(part)):
            out.append(part[i])
            at.append(i)
            end.append(i + 1)
        yield "unicode", "".join(out), [base + x for x in at], [base + x for x in end]


def _base64(layer: Layer, most: int) -> Iterator[tuple[str, str, list[int] | np.ndarray, list[int] | np.ndarray]]:
    for m in _BASE64.finditer(layer.text):
        if m.end() - m.start() < 12:
            continue
        lines, at = [], m.start()
        for x in _BREAK.finditer(layer.text, *m.span()):
            lines.append((at, x.start()))
            at = x.end()
        lines.append((at, m.end()))
        packed: list[tuple[int, int]] = []
        for part in [lines, *([x] for x in lines)] if len(lines) > 1 else [lines]:
            if sum(b - a for a, b in part) < 12 or any(a <= part[0][0] and part[-1][1] <= b for a, b in packed):
                continue
            body = "".join(layer.text[a:b] for a, b in part).rstrip("=").replace("-", "+").replace("_", "/")
            place = np.concatenate([np.arange(a, b) for a, b in part])[: len(body)]
            for first in range(4):
                packed += yield from _decoded(body, place, part[-1][1], first, most)


def _decoded(body: str, place: np.ndarray, last: int, first: int, most: int) -> Generator[tuple[str, str, np.ndarray, np.ndarray], None, list[tuple[int, int]]]:
    """Layers of base64 from its ``first`` character on; ``place`` has that of each character.
    Returns the spans of compressed parts."""
    text = body[first:]
    if len(text) % 4 == 1:
        text = text[:-1]
    data = base64.b64decode(text + "=" * (-len(text) % 4))

    def spans(head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the characters that hold the bytes from head to tail, the last one."""
        i = first + tail // 3 * 4 + 3
        return place[first + head // 3 * 4], np.where(i < len(place), place[np.minimum(i, len(place) - 1)] + 1, last)

    packed, free, at = [], [], 0
    while x := _MAGICS.search(data, at):
        a = x.start()
        at, inner, to, names = a + 1, data, len(data), ["base64"]
        while True:
            try:
                found = unpack(inner, a if inner is data else 0, most)
            except Oversized as e:
                span = spans(np.array([a]), np.array([to - 1]))
                yield ">".join([*names, str(e)]), "", *span
                if inner is data:
                    packed.append((a, to))
                    at = to
                break
            if found is None:
                break
            name, out, end, whole = found
            if inner is data:
                to = end
                if whole:
                    packed.append((a, to))
                    at = to
            names.append(name)
            span = spans(np.array([a]), np.array([to - 1]))
            for y in _PIECE.finditer(out):
                if y.end() - y.start() >= SHORTEST:
                    child = y.group().decode()
                    yield ">".join(names), child, np.repeat(span[0], len(child)), np.repeat(span[1], len(child))
            if out == inner or len(names) >= 1000:
                break
            inner = out
    at = 0
    for a, b in packed:
        free.append((at, a))
        at = b
    for a, b in [*free, (at, len(data))]:
        for x in _PIECE.finditer(data, a, b):
            if x.end() - x.start() >= SHORTEST:
                head = np.flatnonzero(np.frombuffer(x.group(), np.uint8) & 0xC0 != 0x80) + x.start()
                yield "base64", x.group().decode(), *spans(head, np.append(head[1:], x.end()) - 1)
    return [(int(s[0]), int(e[0])) for s, e in (spans(np.array([a]), np.array([b - 1])) for a, b in packed)]


def scan(text: str | None, most: int = MOST_BYTES) -> list[Finding]:
    """All secrets of a text and of the layers in it, in order of their place."""
    found: dict[tuple[str, int, int, str], Finding] = {}
    if not text:
        return []
    work = [Layer(text, None, None, ())]
    seen = {(text, 0, len(text))}
    while work:
        layer = work.pop()
        taken: list[tuple[int, int]] = []
        for kind, rule in _RULES:
            for m in rule.finditer(layer.text):
                a, b = m.span(rule.groups)
                if any(a < y and x < b for x, y in taken):
                    continue
                taken.append((a, b))
                s, e = layer.span(a, b)
                found.setdefault((kind, s, e, m.group(rule.groups)), Finding(kind, s, e, layer.path, m.group(rule.groups)))
        for source in (_url(layer), _unicode(layer), _base64(layer, most)):
            for name, child, at, end in source:
                if not child:
                    s, e = layer.span(at[0], end[0])
                    found.setdefault(("oversized_layer", s, e, name), Finding("oversized_layer", s, e, (*layer.path, *name.split(">")), layer.text[at[0] : end[0]]))
                    continue
                at, end = np.asarray(at), np.asarray(end)
                if layer.start is not None:
                    at, end = layer.start[at], layer.end[end - 1]
                key = (child, int(at.min()), int(end.max()))
                if key not in seen:
                    seen.add(key)
                    work.append(Layer(child, at, end, (*layer.path, *name.split(">"))))
    return _largest(sorted(found.values(), key=lambda f: (f.start, f.end, f.kind, len(f.path), f.value)))


def _largest(found: list[Finding]) -> list[Finding]:
    """Without findings that are a part of another: of a secret that crosses a line of base64,
    or of compressed bytes that start in others."""
    out: list[Finding] = []
    held: dict[tuple[str, tuple[str, ...]], Finding] = {}
    for f in sorted(found, key=lambda f: (f.start, -f.end, -len(f.value))):
        wide = held.get((f.kind, f.path))
        if f.path and wide and wide.end >= f.end and f.value in wide.value and (wide.start, wide.end) != (f.start, f.end):
            continue
        if not wide or f.end > wide.end:
            held[f.kind, f.path] = f
        out.append(f)
    return sorted(out, key=lambda f: (f.start, f.end, f.kind, len(f.path), f.value))


def _scanner(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = np.flatnonzero(pc.fill_null(pc.match_substring_regex(b.column("text"), MAYBE), False).to_numpy(zero_copy_only=False))
            texts = b.column("text").take(pa.array(rows)).to_pylist()
            at, out = [], []
            for r, text in zip(rows.tolist(), texts):
                for f in scan(text, most):
                    at.append(r)
                    out.append({"kind": f.kind, "start_char": f.start, "end_char": f.end, "depth": len(f.path), "layers": ">".join(f.path), "length": len(f.value), "sha256": hashlib.sha256(f.value.encode("utf-8", "surrogatepass")).hexdigest()})
            types = {"kind": pa.string(), "start_char": pa.int64(), "end_char": pa.int64(), "depth": pa.int32(), "layers": pa.string(), "length": pa.int32(), "sha256": pa.string()}
            yield pa.record_batch({"doc_id": b.column("doc_id").take(pa.array(at, pa.int64()))} | {k: pa.array([x[k] for x in out], t) for k, t in types.items()})

    return run


def find_secrets(docs: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row a finding: kind, span in characters of the text, the layers it lay under
    from the outside in, and length and digest of the secret."""
    return docs.select("doc_id", "text").mapInArrow(_scanner(most_bytes), RESULT)
