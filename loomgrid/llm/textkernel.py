"""Vectorised word splitting and hashing over the bytes of an Arrow text column.

A word is a longest run of letters and digits in the lower-cased text, with the marks
and joiners inside it. In the scripts that are written without spaces (``UNSPACED``) each
character is a word, with its marks. All else, ASCII or not, parts words. All words of a
batch are found and hashed with array operations over the raw bytes, in blocks of bounded
size; nothing loops over words.
"""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = np.random.Generator(np.random.PCG64(20240601)).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
#: code points of scripts without spaces between words: Thai, Lao, Tibetan, Burmese, Khmer, Tai,
#: kana, Bopomofo, Yi and Han
UNSPACED = [(0xE00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x1950, 0x19E0), (0x19E0, 0x1AB0), (0x2E80, 0x2FE0), (0x3005, 0x3008), (0x3021, 0x3030), (0x3041, 0x3130), (0x31A0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA4D0), (0xA9E0, 0xAA80), (0xAA80, 0xAAE0), (0xF900, 0xFB00), (0xFF66, 0xFFA0), (0x16FE0, 0x1B300), (0x20000, 0x32400)]
BREAK, LETTER, ALONE, MARK = 0, 1, 2, 3
#: bytes that are hashed at a time
_BLOCK = 1 << 20
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finaliser of splitmix64 over an array."""
    h = h + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_UP, _DOWN = pow(_BASE, _BLOCK, 2**64), pow(_BASE, -_BLOCK, 2**64)
_ASCII = np.zeros(256, bool)
for _r in ("09", "az", "AZ"):
    _ASCII[ord(_r[0]) : ord(_r[1]) + 1] = True


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a, dtype=np.uint64))
        _powers = (out[0], out[1])
    return _powers


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the row offsets into them; a null is an empty text."""
    if pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    off = np.frombuffer(arr.buffers()[1], np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges; equal bytes have equal hashes wherever they are. Starts,
    and ends, ascend."""
    n = len(buf)
    pw, inv = _pow(min(n, _BLOCK) + 1)
    out = np.zeros(len(start), np.uint64)
    carry, up, down = 0, 1, 1  # sum before the block, and powers of the base and its inverse there
    for lo in range(0, n + 1, _BLOCK):
        part = buf[lo : lo + _BLOCK]
        cum = np.empty(len(part) + 1, np.uint64)
        cum[0] = 0
        np.cumsum(_VALUES[part] * pw[: len(part)], out=cum[1:])
        cum = cum * U(up) + U(carry)
        # sums up to the ends go in, those up to the starts go out, and the power of the start too
        a, b = np.searchsorted(end, [lo, lo + _BLOCK])
        out[a:b] += cum[end[a:b] - lo]
        a, b = np.searchsorted(start, [lo, lo + _BLOCK])
        out[a:b] -= cum[start[a:b] - lo]
        if len(part) == _BLOCK:
            carry, up, down = int(cum[-1]), up * _UP % 2**64, down * _DOWN % 2**64
    for k in range(n // _BLOCK + 1):
        a, b = np.searchsorted(start, [k * _BLOCK, (k + 1) * _BLOCK])
        out[a:b] *= inv[start[a:b] - k * _BLOCK] * U(pow(_DOWN, k, 2**64))
    return mix(out + (end - start).astype(np.uint64))


@functools.cache
def char_classes() -> np.ndarray:
    """Class of every code point: break, letter, a word alone, or mark."""
    out = np.zeros(0x110000, np.uint8)
    for c in (*range(0x323B0), *range(0xE0100, 0xE01F0)):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] in "LN" else MARK if kind[0] == "M" or c in (0x200C, 0x200D) else BREAK
    for a, b in UNSPACED:
        out[a:b][out[a:b] == LETTER] = ALONE
    return out


def code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of all characters beyond ASCII, and their code points."""
    at = np.flatnonzero(buf >= 0xC0)
    b = buf[at].astype(np.int32)
    more = 1 + (b >= 0xE0) + (b >= 0xF0)
    cp = b & (0x3F >> more)
    for k in (1, 2, 3):
        i = np.flatnonzero(more >= k)
        cp[i] = (cp[i] << 6) | (buf[at[i] + k] & 0x3F)
    return at, cp


@dataclass
class Words:
    hash: np.ndarray  #: 64-bit hash of each word
    start: np.ndarray  #: byte offsets in ``buf``
    end: np.ndarray
    bounds: np.ndarray  #: word offsets of the documents, one more than documents
    doc: np.ndarray  #: document of each word
    buf: np.ndarray
    off: np.ndarray


def words(arr: pa.Array) -> Words:
    """Words of a text column, in order. Byte offsets are those of the lower-cased text."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    buf, off = text_bytes(pc.utf8_lower(arr))
    n = len(buf)
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    isw = _ASCII[buf]
    lone = None
    lead, cp = code_points(buf)
    if len(lead):
        kind = char_classes()[cp]
        base = isw.astype(np.uint8)
        base[lead] = kind
        # other bytes of a character, and marks, are of the class of what they follow
        follow = (buf & 0xC0) == 0x80
        follow[lead[kind == MARK]] = True
        heads = off[:-1][off[:-1] < n]
        base[heads[base[heads] == MARK]] = BREAK
        follow[heads] = False
        base = base[np.maximum.accumulate(np.where(follow, 0, np.arange(n, dtype=np.int32)))]
        isw = base > 0
        lone = base == ALONE
    start = isw.copy()
    if n:
        start[1:] &= ~isw[:-1]
        if lone is not None:
            start |= lone & ~follow
            start[1:] |= isw[1:] & lone[:-1] & ~lone[1:]
        start[cut] = isw[cut]
    end = isw.copy()
    if n:
        end[:-1] &= ~isw[1:] | start[1:]
        end[cut - 1] = isw[cut - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    h = span_hashes(buf, s, e)
    bounds = np.searchsorted(s, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(bounds))
    return Words(h, s, e, bounds, doc, buf, off)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the index of each one's first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w.hash[:n].copy()
    for j in range(1, k):
        h = mix(h) + w.hash[j : n + j]
    ok = w.doc[:n] == w.doc[k - 1 :]
    return mix(h[ok], 7), np.flatnonzero(ok)


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64) * 2 - 1


def simhash(feature: np.ndarray, owner: np.ndarray, owners: int, lanes: int = 2, weight: np.ndarray | None = None) -> np.ndarray:
    """Fingerprints of ``lanes`` x 64 bits: sign of the weighted sum of feature bits.

    For each byte of a feature's hash a histogram per owner is taken, so the cost is
    some counting per byte rather than a sum per bit. A zero sum gives a 0 bit.
    """
    out = np.zeros((owners, lanes), np.uint64)
    step = 4096
    order_ok = len(owner) == 0 or bool((owner[1:] >= owner[:-1]).all())
    if not order_ok:
        o = np.argsort(owner, kind="stable")
        feature, owner = feature[o], owner[o]
        weight = None if weight is None else weight[o]
    for lo in range(0, owners, step):
        hi = min(owners, lo + step)
        a, b = np.searchsorted(owner, [lo, hi])
        f, own = feature[a:b], (owner[a:b] - lo) * 256
        wt = None if weight is None else weight[a:b]
        for lane in range(lanes):
            h = mix(f, 101 + lane)
            for byte in range(8):
                v = ((h >> U(8 * byte)) & U(255)).astype(np.int64)
                hist = np.bincount(own + v, wt, (hi - lo) * 256).reshape(hi - lo, 256)
                bits = (hist @ _BITS > 1e-9).astype(np.uint64)
                out[lo:hi, lane] |= (bits << np.arange(8, dtype=np.uint64)).sum(1, dtype=np.uint64) << U(8 * byte)
    return out


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of fingerprints given as (..., lanes)."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)
