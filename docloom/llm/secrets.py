"""Secret scan with structural confirmation.

Three plain patterns (assignments, access key ids, long hex runs) are reported as they are. Runs of base64 or
hex digits that may hold a key are decoded, and reported only if the bytes parse: DER key encodings, whose
nested lengths must fill the whole, key files with length-prefixed fields, and tokens of three parts whose header
names a signature algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import pieces, utf8

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "token", "der", "keyfile")
_TOKEN = re.compile(r"[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")
_BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}(?:\r?\n[A-Za-z0-9+/]+)*={0,2}|[A-Za-z0-9_-]{40,}={0,2}")
_HEX_KEY = re.compile(r"[0-9A-Fa-f]{60,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HEX_MAP = bytes(120 if chr(b) in "0123456789abcdefABCDEF" else 32 for b in range(256))
_B64_MAP = bytes(120 if chr(b).isalnum() and b < 128 or chr(b) in "+/_-." else 32 for b in range(256))
# object identifiers of key algorithms, as DER bodies
KEY_OIDS = {
    bytes.fromhex("2a864886f70d010101"): "rsa",
    bytes.fromhex("2a8648ce3d0201"): "ec",
    bytes.fromhex("2a8648ce380401"): "dsa",
    bytes.fromhex("2b6570"): "ed25519",
    bytes.fromhex("2b656e"): "x25519",
}


def der_nodes(data: bytes, depth: int = 0) -> list[tuple[int, bytes, list]] | None:
    """Nested (tag, body, children) if the lengths fill `data` exactly, else None."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size == 0x80:
            return None
        if size > 0x80:
            n = size & 0x7F
            if n > 4 or at + n > len(data) or data[at] == 0:
                return None
            size = int.from_bytes(data[at : at + n], "big")
            at += n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        body = data[at : at + size]
        at += size
        inner: list = []
        if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
            found = der_nodes(body, depth + 1) if depth < 16 else None
            if found is None:
                return None
            inner = found
        out.append((tag, body, inner))
    return out


def is_key(data: bytes) -> bool:
    """DER of a key: one sequence holding a key algorithm, a version with at least five integers, or an EC key."""
    top = der_nodes(data) if len(data) >= 24 and data[0] == 0x30 else None
    if not top or len(top) != 1 or not top[0][2]:
        return False
    inside = top[0][2]
    tags = [t for t, _, _ in inside]
    numbers = all(body and (len(body) == 1 or (body[0] != 0 or body[1] >= 0x80) and (body[0] != 0xFF or body[1] < 0x80)) for tag, body, _ in inside if tag == 2)
    if not numbers:
        return False
    if len(tags) >= 6 and set(tags) == {2}:
        return True
    if tags[:2] == [2, 4] and len(tags) >= 3 and inside[0][1] == b"\x01":
        return True
    return any(t == 6 and body in KEY_OIDS for tag, _, kids in inside if tag == 0x30 for t, body, _ in kids)


def is_keyfile(data: bytes) -> bool:
    """Length-prefixed fields that fill the whole, the first an algorithm name, or the header of a private key file."""
    if data.startswith(b"openssh-key-v1\0"):
        data = data[15:]
        return len(data) >= 12 and 0 < int.from_bytes(data[:4], "big") <= 32
    at, n = 0, 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data) or len(data) - at < 4:
            return False
        if n == 0 and not re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,60}", data[4 : 4 + size]):
            return False
        at += 4 + size
        n += 1
    return n >= 2


def unbase64(text: str) -> bytes | None:
    text = re.sub(r"\s", "", text).rstrip("=").translate({45: "+", 95: "/"})
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    head, body, _ = text.split(".")
    out = []
    for part in (head, body):
        data = unbase64(part)
        try:
            value = json.loads(data.decode()) if data else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict):
            return False
        out.append(value)
    return isinstance(out[0].get("alg"), str)


def _kind(data: bytes | None) -> str | None:
    if not data:
        return None
    return "der" if is_key(data) else "keyfile" if is_keyfile(data) else None


def _peek(chars: str, start: int, at: int, size: int) -> bytes:
    """`size` bytes at byte `at` of what is encoded from character `start`."""
    first = start + at // 3 * 4
    part = chars[first : first + (at % 3 + size + 2) // 3 * 4]
    return (unbase64(part[: len(part) - (len(part) % 4 == 1)]) or b"")[at % 3 : at % 3 + size]


def _fields(chars: str, start: int) -> Iterator[int]:
    """Ends, in bytes, behind which a key file that begins at a character may be whole."""

    def number(at: int) -> int | None:
        raw = _peek(chars, start, at, 4)
        return int.from_bytes(raw, "big") if len(raw) == 4 else None

    if _peek(chars, start, 0, 15) == b"openssh-key-v1\0":
        at = 15
        for _ in range(3):
            if (size := number(at)) is None:
                return
            at += 4 + size
        keys = number(at)
        at += 4
        for _ in range(0 if keys is None else keys + 1):
            if (size := number(at)) is None:
                return
            at += 4 + size
        if keys is not None:
            yield at
        return
    at, n = 0, 0
    while (size := number(at)) is not None:
        if size <= 67 and re.fullmatch(rb"(ssh|ecdsa|sk)-[a-z0-9@.-]{3,60}", _peek(chars, start, at + 4, size)):
            if n:
                return  # the next key begins
        elif not n:
            return
        at += 4 + size
        n += 1
        if n >= 2:
            yield at


def _keys(run: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the keys in a run of base64 lines.

    Every line may begin a key, and its own lengths say behind which line it ends. The search goes on behind a
    key, and with the next line where there was none.
    """
    lines = [(m.start(), m.end()) for m in re.finditer(r"[^\r\n]+", run)]
    sizes = [len(run[a:b].rstrip("=")) for a, b in lines]
    chars = "".join(run[a : a + n] for (a, _), n in zip(lines, sizes, strict=True))
    before = [0, *accumulate(sizes)]
    ends = {n: i for i, n in enumerate(before)}  # characters up to an end of line: the number of lines
    at = 0
    while at < len(lines):
        start = before[at]
        behind, kind = None, None
        if chars.startswith("M", start):  # a DER sequence
            head = _peek(chars, start, 0, 6)
            n = head[1] & 0x7F if len(head) > 1 and head[1] > 0x80 else 0
            total = 2 + n + (int.from_bytes(head[2 : 2 + n], "big") if n else head[1] if len(head) > 1 else 0)
            behind = ends.get(start - (-total * 4 // 3))
            kind = _kind(unbase64(chars[start : before[behind]])) if behind and n <= 4 else None
        elif chars.startswith(("AAAA", "b3BlbnNzaC1rZXktdjEA"), start):  # a key file
            for size in _fields(chars, start):
                behind = ends.get(start - (-size * 4 // 3), behind)
            if behind is None and not chars.startswith("AAAA", start):
                kind = _kind(unbase64(chars[start:]))  # its fields do not end in this run
                if kind:
                    yield lines[at][0], len(run), kind
                kind = None
            elif behind is not None:
                kind = _kind(unbase64(chars[start : before[behind]]))
        if kind:
            yield lines[at][0], lines[behind - 1][1], kind
        at = behind if kind else at + 1


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the three plain patterns."""
    out = []
    low = raw.translate(_LOWER)
    if any(w in low for w in _WORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in raw.translate(_HEX_MAP):
        out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str, raw: bytes) -> list[tuple[int, int, int]]:
    """Spans that only their structure makes a secret; a candidate is only looked for where a long enough run stands."""
    runs = raw.translate(_B64_MAP)
    if b"x" * 26 not in runs:
        return []
    out = []
    if b"." in raw:
        out += [(*m.span(), 3) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    if b"x" * 40 in runs:
        for m in _BASE64.finditer(text):
            out += [(m.start() + a, m.start() + b, KINDS.index(kind)) for a, b, kind in _keys(m[0])]
        for m in _HEX_KEY.finditer(text):
            odd = len(m[0]) % 2
            for a in range(odd + 1):  # a digit too many stands before or behind
                if kind := _kind(bytes.fromhex(m[0][a : len(m[0]) - odd + a])):
                    out.append((m.start() + a, m.end() - odd + a, KINDS.index(kind)))
    return sorted(set(out))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document; null texts are empty.

    Offsets are code points of the whole text. Rows without any secret have the digest of the empty string.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"

    def run(batches):
        for batch in pieces(batches):
            counts, hashes, spans = [], [], []
            for raw in utf8(batch, "text"):
                text = raw.decode(errors="replace")
                base = base_spans(text, raw)
                counts.append([sum(k == n for _, _, k in base) for n in range(3)])
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(base + confirmed_spans(text, raw)))
            numbers = [pa.array([c[n] for c in counts], pa.int64()) for n in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, pa.array(hashes), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", F.col("text")).mapInArrow(run, schema)
