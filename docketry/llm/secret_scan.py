"""Secret scans (op 6): patterns find candidates, structure confirms them.

Base kinds are the three patterns below. The method adds kinds that are reported only when their structure holds:
jwt (three base64url parts, the first two JSON objects, the first naming an algorithm), pem (armour, with or without
headers, whose base64 decodes to a private key), der (bare base64 or hex that decodes to one) and sshkey (base64 of an
SSH wire key, whose length-prefixed fields fill it). A DER private key is one whose nested lengths all fit, in the octet
strings that hold a key too, and that is not a certificate, a request for one or a public key; an OpenSSH private key is
parsed field by field; armour under an encryption header holds whole cipher blocks.

Offsets are code points of the whole text, ends exclusive. Base spans are always kept; added ones follow them by start.
Cases: null or empty text has no spans; copies of a text have the same spans; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import small_batches

#: The base patterns. Letters of the first are in either case (ASCII only).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: A run of lower-case hex is matched whole, so runs that are too short can be passed over.
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "jwt", "pem", "der", "sshkey"]

_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Line breaks inside armour may be escaped, as in JSON. No part gives back what it took, each character can belong to one part
#: only, and neither headers nor the body run on over other armour, so time is linear in the text.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]++)-----((?:\s|\\[nr])*+(?:[A-Za-z][A-Za-z0-9-]*+: (?:[^\n\\-]|-(?!----))*+(?:\r?\n|(?:\\r)?\\n))*+)(?:\s|\\[nr])*+([A-Za-z0-9+/](?:[A-Za-z0-9+/=\s]|\\[nr])*+)-----END \1-----")
_ESCAPED = re.compile(r"\\[nr]")
_SSH = re.compile(r"(?<![A-Za-z0-9+/])AAAA[A-Za-z0-9+/]{20,}={0,2}")
#: 0x30 is "M" and one of A-P; how long the key is, its length bytes say. Lines may be broken and indented.
_B64 = re.compile(r"(?<![A-Za-z0-9+/])M[A-P][A-Za-z0-9+/]{2}")
_B64RUN = re.compile(r"[A-Za-z0-9+/]+(?:(?:[ \t]*\r?\n[ \t]*|(?:\\r)?\\n)[A-Za-z0-9+/]+)*={0,2}")
_LINE = re.compile(r"\\[nr]|\s+|[A-Za-z0-9+/]+")
#: Bytes of the shortest key that is reported.
_LEAST = 24
_HEXDER = re.compile(r"(?<![0-9A-Fa-f])30(?:8[1-3])?(?:[0-9A-Fa-f]{2}){16,}(?![0-9A-Fa-f])")
_OPENSSH = b"openssh-key-v1\0"


def der_fits(b: bytes, depth: int = 0) -> bool:
    """True if b is one DER sequence (tag 0x30) and all nested lengths fill their parents exactly."""
    if depth == 0 and (len(b) < 8 or b[0] != 0x30):
        return False
    at, n = 0, len(b)
    while at < n:
        if at + 2 > n:
            return False
        tag, size, at = b[at], b[at + 1], at + 2
        if size & 0x80:
            k = size & 0x7F
            if not 1 <= k <= 4 or at + k > n:
                return False
            size, at = int.from_bytes(b[at : at + k], "big"), at + k
        if at + size > n or (tag & 0x20 and depth < 12 and not der_fits(b[at : at + size], depth + 1)):
            return False
        at += size
        if depth == 0:
            return at == n
    return True


def _elements(b: bytes) -> list[tuple[int, bytes]]:
    """(tag, content) of the elements that fill b; b's lengths must fit."""
    out, at = [], 0
    while at + 2 <= len(b):
        tag, size, at = b[at], b[at + 1], at + 2
        if size & 0x80:
            k = size & 0x7F
            size, at = int.from_bytes(b[at : at + k], "big"), at + k
        out.append((tag, b[at : at + size]))
        at += size
    return out


#: Object identifiers of RSA and of keys on elliptic curves, whose octet string holds a DER key.
_NESTED = (bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201"))


def der_secret(b: bytes) -> bool:
    """True if b is a DER sequence that fits and is not a certificate, a request or a public key; a key held in an octet string must fit too."""
    if not der_fits(b):
        return False
    parts = _elements(_elements(b)[0][1])
    tags = [t for t, _ in parts]
    if tags == [0x30, 0x30, 0x03] or tags == [0x30, 0x03]:
        return False
    if tags[:2] == [0x02, 0x02] and len(tags) == 2:  # a bare RSA public key: modulus and exponent
        return False
    if tags[:3] == [0x02, 0x30, 0x04]:
        name = next((v for t, v in _elements(parts[1][1]) if t == 0x06), b"")
        return der_fits(parts[2][1]) if name in _NESTED else True
    return True


def _fields(b: bytes, at: int, n: int) -> int | None:
    """Where n length-prefixed fields end."""
    for _ in range(n):
        if at + 4 > len(b):
            return None
        at += 4 + int.from_bytes(b[at : at + 4], "big")
        if at > len(b):
            return None
    return at


def openssh_fits(b: bytes) -> bool:
    """True if b is an OpenSSH private key: cipher, derivation and its options, a number of public keys, the keys, the private part."""
    if not b.startswith(_OPENSSH) or (at := _fields(b, len(_OPENSSH), 3)) is None or at + 4 > len(b):
        return False
    n = int.from_bytes(b[at : at + 4], "big")
    return 1 <= n <= 64 and _fields(b, at + 4, n + 1) == len(b)


def pem_secret(label: str, headers: str, body: str) -> bool:
    b = _decoded(_ESCAPED.sub("", body))
    if not b or "CERTIFICATE" in label or "PUBLIC" in label:
        return False
    if "ENCRYPTED" in headers and "DEK-Info" in headers:
        return len(b) % 8 == 0
    return der_secret(b) or openssh_fits(b)


def _bare_der(text: str) -> Iterator[tuple[str, int, int]]:
    """Base64 runs that begin with a whole DER sequence and end with it, or go on in another line."""
    done, end = 0, -1
    for m in _B64.finditer(text):
        if m.start() < done:
            continue
        if m.start() >= end:  # a run that begins inside another one ends with it
            end = _B64RUN.match(text, m.start()).end()
        head = _decoded("".join(_ESCAPED.sub("", text[m.start() : min(end, m.start() + 64)]).split())[:16].rstrip("=")) or b""
        k = head[1] & 0x7F if len(head) > 1 and head[1] & 0x80 else 0
        # A key of 64 KB or more there is none; it begins with its version, or with the name of what it is encrypted by.
        if k > 2 or len(head) < 5 + k or not (head[2 + k : 4 + k] == b"\x02\x01" and head[4 + k] <= 3 or head[2 + k] == 0x30):
            continue
        size = 2 + k + (int.from_bytes(head[2 : 2 + k], "big") if k else head[1])
        if size < _LEAST or size > end - m.start():
            continue
        # The characters that hold `size` bytes, without line breaks.
        need, at = -(-size * 8 // 6), m.start()
        for part in _LINE.finditer(text, m.start(), end):
            if part[0][0] == "\\" or part[0].isspace():
                continue
            take = min(need, len(part[0]))
            need, at = need - take, part.start() + take
            if not need:
                break
        if need or (at < len(text) and re.match(r"[A-Za-z0-9+/]", text[at])):
            continue
        pad = re.compile("={0,2}").match(text, at).end()
        b = _decoded(_ESCAPED.sub("", text[m.start() : pad]))
        if b and der_secret(b):
            done = pad
            yield "der", m.start(), pad


def ssh_fits(b: bytes) -> bool:
    """True if b is an SSH wire key: length-prefixed fields that fill it, the first naming a key type."""
    at, first = 0, b""
    while at < len(b):
        if at + 4 > len(b):
            return False
        size = int.from_bytes(b[at : at + 4], "big")
        if at + 4 + size > len(b):
            return False
        first = first or b[at + 4 : at + 4 + size]
        at += 4 + size
    return bool(re.match(rb"(ssh|ecdsa|sk)-[\w@.-]+$", first))


def _decoded(text: str) -> bytes | None:
    raw = "".join(text.split()).replace("-", "+").replace("_", "/").rstrip("=")
    try:
        return base64.b64decode(raw + "=" * (-len(raw) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _json(part: str) -> dict | None:
    try:
        x = json.loads(_decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def added_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            head, claims, sign = m[0].split(".")
            h = _json(head)
            if h is not None and isinstance(h.get("alg"), str) and _json(claims) is not None and (h["alg"].lower() == "none" or _decoded(sign)):
                out.append(("jwt", *m.span()))
    if "-----BEGIN " in text:
        out += [("pem", *m.span()) for m in _PEM.finditer(text) if pem_secret(m[1], m[2], m[3])]
    if "AAAA" in text:
        out += [("sshkey", *m.span()) for m in _SSH.finditer(text) if (b := _decoded(m[0])) and ssh_fits(b)]
    if "M" in text:
        armour = [m.span() for m in _PEM.finditer(text)] if "-----BEGIN " in text else []
        out += [x for x in _bare_der(text) if not any(a <= x[1] and x[2] <= b for a, b in armour)]  # what armour holds is judged with it
    if "30" in text:
        out += [("der", *m.span()) for m in _HEXDER.finditer(text) if len(m[0]) % 2 == 0 and der_secret(bytes.fromhex(m[0]))]
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each text, in one pass without a shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base, added = base_spans(t or ""), added_spans(t or "")
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[c.split()[0] for c in SCANNED.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCANNED)
