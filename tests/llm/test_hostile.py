"""Texts and bytes made to be slow: time stays linear, and results are those of the plain rules."""

import base64
import random
import struct
import time

from docketry.llm import media, secret_scan

KEY = bytes.fromhex("302e020100300506032b657004220420") + bytes(range(32))


def riff_end(b, at, form):
    """A RIFF medium by walking its chunks."""
    if b[at + 8 : at + 12] != form or at + 12 > len(b):
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p = at + 12
    if end > len(b) or end < p:
        return None
    while p not in (end, end + 1):
        if p + 8 > end:
            return None
        n = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + n + (n & 1)
    return end


def test_riff_by_walking():
    r, hits = random.Random(7), 0
    for _ in range(3000):
        parts = []
        for _ in range(r.randrange(1, 12)):
            kind = r.randrange(4)
            n = r.choice([0, 1, 2, 3, 4, 8, 12, 20, 36])
            parts.append(b"RIFF" + struct.pack("<I", r.choice([n, n + 4, n + 12, 40])) + r.choice([b"WAVE", b"WEBP"]) if kind == 0 else b"data" + struct.pack("<I", n) + (b"\0" * (n + (n & r.randrange(2)))))
        b = b"".join(parts)
        v = media.Value(b)
        at = b.find(b"RIFF")
        while at >= 0:
            for form in (b"WAVE", b"WEBP"):
                want = riff_end(b, at, form)
                hits += want is not None
                assert media._riff(form)(v, at) == want
            at = b.find(b"RIFF", at + 1)
    assert hits > 500


def test_riff_headers_with_distinct_ends():
    n = 20_000_000 // 12
    began = time.time()
    b = b"".join(b"RIFF" + struct.pack("<I", 4 + 12 * i) + b"WAVE" for i in range(n))
    v, check = media.Value(b), media._riff(b"WAVE")
    assert sum(check(v, 12 * i) is not None for i in range(n)) <= n
    assert time.time() - began < 60
    text = ("RIFF" + "a\0\0\0WAVE" * 1 + "LIST\x08\0\0\0") * 50_000
    began = time.time()
    media.sniff(text.encode())
    assert time.time() - began < 20


def test_armour_and_blanks():
    """Blanks, line breaks (escaped too), headers and further armour after armour: 20 MB in seconds; keys behind them are found."""
    body = base64.b64encode(KEY).decode()
    whole = f"-----BEGIN PRIVATE KEY-----{{0}}{body}{{0}}-----END PRIVATE KEY-----"
    for gap in (" ", "\n", "\\n", "\t \r\n"):
        blanks = gap * (5_000_000 // len(gap))
        began = time.time()
        assert secret_scan.added_spans("-----BEGIN A-----" + blanks) == []
        assert [s[0] for s in secret_scan.added_spans(whole.format(blanks[:1_000_000]))] == ["pem"]
        assert time.time() - began < 20
    for part in ("-----BEGIN A-----\nX: -----BEGIN A-----\n", "-----BEGIN A-----\nX: y\n", "-----BEGIN A-----\nAAAA", "-----BEGIN A-----AAAA \n", "-----BEGIN AAAA", "-----BEGIN A-----\nX", "-----BEGIN A-----\nx: ----", "password = ", "eyJa.eyJ", "AAAA", "MIIE", "M\n", "30", "AKIA"):
        began = time.time()
        secret_scan.added_spans(part * (2_000_000 // len(part)))
        secret_scan.base_spans(part * (2_000_000 // len(part)))
        assert time.time() - began < 20, part


def test_armour_forms():
    """Headers, escaped breaks and no break at all, as before."""
    body = base64.b64encode(KEY).decode()
    for mid in ("\n", "\\n", "\r\n", "", "  \n\n", "\nComment: a-b --- c\n\n", "\\nProc-Type: x\\n\\n", "\nA: b\nC-D: e\n"):
        text = f"x -----BEGIN PRIVATE KEY-----{mid}{body[:20]}\n{body[20:]}\n-----END PRIVATE KEY----- y"
        assert secret_scan.added_spans(text) == [("pem", 2, len(text) - 2)], mid
    assert secret_scan.added_spans(f"-----BEGIN PRIVATE KEY-----\n{body}\n-----END PUBLIC KEY-----")[0][0] == "der"
