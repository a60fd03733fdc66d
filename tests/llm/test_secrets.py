from __future__ import annotations

import base64
import bz2
import gzip
import lzma
import urllib.parse
import zlib

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm import secret_scan as S
from tests.llm.corpus import ODD, frame, rows

KEY = "AKIA" + "ABCDEFGH12345678"


def b64(x):
    return base64.b64encode(x.encode() if isinstance(x, str) else x).decode()


WRAPS = {
    "url": lambda s: "".join(f"%{b:02X}" for b in s.encode()),
    "unicode": lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
    "base64": b64,
    "gzip": lambda s: b64(gzip.compress(s.encode())),
    "zlib": lambda s: b64(zlib.compress(s.encode())),
    "bzip2": lambda s: b64(bz2.compress(s.encode())),
    "xz": lambda s: b64(lzma.compress(s.encode())),
    "zstd": lambda s: b64(zstandard.compress(s.encode())),
}


@pytest.mark.parametrize("name", WRAPS)
def test_each_layer(name):
    part = WRAPS[name](f"my key {KEY} ends")
    text = f"é before {part} after"
    (f,) = S.scan(text)
    assert f.kind == "aws_access_key_id" and f.value == KEY and f.path[-1] == name
    assert text.index(part) <= f.start < f.end <= text.index(part) + len(part)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(sorted(WRAPS)), max_size=5))
def test_nested_layers(names):
    text = f"id {KEY} "
    for n in names:
        text = WRAPS[n](text)
    found = [f for f in S.scan(f"see {text} .") if f.value == KEY]
    assert len(found) == 1 and 4 <= found[0].start < found[0].end <= 4 + len(text)


def test_spans_are_exact_through_escapes():
    text = f"x {urllib.parse.quote('k=é' + KEY, safe='')} y"
    (f,) = S.scan(text)
    assert text[f.start : f.end] == KEY
    (f,) = S.scan("a \\u0041\\u004B" + KEY[2:] + " b")
    assert (f.start, f.end) == (2, 14 + 18)


@pytest.mark.parametrize("width", [8, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  ", "\\n"])
def test_base64_over_lines(width, end):
    wrap = lambda x: end.join(b64(x)[i : i + width] for i in range(0, len(b64(x)), width))
    for pad in range(0, 60, 7):
        noise = "".join(f"{i * 7919 % 1000:03d} " for i in range(pad))
        for part in (wrap(f"{noise}{KEY} ends here"), wrap(gzip.compress(f"{noise}{KEY} ends".encode())), wrap(lzma.compress(f"{noise}{KEY} ends".encode()))):
            found = [f for f in S.scan(f"-----BEGIN DATA-----\n{part}\n-----END DATA-----") if f.value == KEY]
            assert len(found) == 1 and 21 <= found[0].start < found[0].end <= 21 + len(part)


def test_an_invalid_escape_hides_no_other():
    hidden = WRAPS["url"](KEY)
    for bad in ("%E9", "%00", "%C3", "%FF%FE"):
        (f,) = S.scan(f"q=caf{bad}&k={hidden}&z={bad}")
        assert f.value == KEY and (f.start, f.end) == (5 + len(bad) + 3, 5 + len(bad) + 3 + len(hidden))
    for bad in ("\\u0000", "\\ud800", "&#1;"):
        text = '{"a":"' + bad + '","k":"' + WRAPS["unicode"](KEY) + '"}'
        (f,) = S.scan(text)
        assert f.value == KEY and text[f.start : f.end] == WRAPS["unicode"](KEY)
    assert [f.value for f in S.scan(b64(b"\xff\x00" + f"id {KEY} x".encode() + b"\x00"))] == [KEY]


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_all_members_are_unpacked(pack):
    found = S.scan("see " + b64(pack(b"first member ") + pack(f"id {KEY[:9]}".encode()) + pack(f"{KEY[9:]} x".encode())))
    assert [f.value for f in found] == [KEY]


@pytest.mark.parametrize("before", ["", "a", "ab", "abc"])
def test_base64_starts_at_any_character(before):
    assert [f.value for f in S.scan(f"{before}{b64('  id ' + KEY + ' x')}")] == [KEY]
    assert [f.value for f in S.scan(before + WRAPS["gzip"](f"id {KEY} x"))] == [KEY]


def test_prefilter_lets_short_secrets_pass(spark):
    texts = ["xoxb-abcdefghij", b64("://a:bcd@"), "\n".join(b64(KEY + " ")[i : i + 8] for i in range(0, 28, 8))]
    assert {r.doc_id for r in S.find_secrets(frame(spark, rows(texts))).collect()} == {0, 1, 2}


def test_rules_and_their_order():
    kinds = lambda t: [f.kind for f in S.scan(t)]
    assert kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') == ["assignment"]
    assert kinds(f"secret: {KEY}") == ["aws_access_key_id"]
    assert kinds("https://bob:hunter22@x.org/") == ["url_password"]
    assert kinds("-----BEGIN RSA PRIVATE KEY-----\nMIIabc\n-----END RSA PRIVATE KEY-----") == ["private_key"]
    assert kinds("ghp_" + "a1B2" * 9) == ["github_token"] and kinds("a plain sentence about a secret: nothing") == []


def test_cycles_and_bombs_end():
    same = "%2541" * 200
    assert S.scan(same) == []
    assert S.scan("A" * 200_000) == []
    bomb = b64(gzip.compress(b"0" * 2_000_000))
    (f,) = S.scan(f"x {bomb}", most=1_000_000)
    assert f.kind == "oversized_layer" and (f.start, f.end) == (2, 2 + len(bomb))


def test_table(spark):
    data = rows([f"a {KEY} b {KEY}", "nothing", WRAPS["gzip"](KEY + " x"), f"a {KEY} b {KEY}"]) + ODD
    got = sorted((r.doc_id, r.start_char, r.layers, r.length) for r in S.find_secrets(frame(spark, data).withColumnRenamed("lang", "kind")).collect())
    assert [g[:3] for g in got] == [(0, 2, ""), (0, 25, ""), (2, 0, "base64>gzip"), (3, 2, ""), (3, 25, "")] and {g[3] for g in got} == {20}
    assert S.find_secrets(frame(spark, [])).count() == 0


def test_prefilter_loses_nothing():
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = [w(f"id {KEY} ") for w in WRAPS.values()] + ['pwd="abc12345"', "https://a:b12@c.d", "&#65;&#x4b;", "ghp_" + "a" * 36]
    assert all(pc.match_substring_regex(pa.array(texts), S.MAYBE).to_pylist())
