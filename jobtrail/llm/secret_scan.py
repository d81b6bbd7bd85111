"""Secret scan: patterns, and candidates that are decoded and parsed before they count.

Base kinds are plain patterns. The confirmed kinds come from candidates that must hold together:

* ``jwt``: three dotted base64url parts whose header is a JSON object with an ``alg`` and whose
  payload is a JSON object; a signature unless ``alg`` is ``none``;
* ``pem``: a PRIVATE KEY block whose body decodes to a key structure (or is marked encrypted);
* ``key``: a bare base64 or hex run that decodes to a key structure.

A key structure is a DER sequence whose nested lengths fill it exactly and whose fields are those
of PKCS#1, PKCS#8 (also encrypted) or SEC1, or an OpenSSH key whose length-prefixed fields fit.

Defined cases: NULL text is empty and has no span; repeated rows are scanned each; an empty table
gives an empty result; texts of any length are scanned whole. Offsets are code points. Further
columns of the input are not touched and may have any name.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from jobtrail.llm.texts import columns, map_arrow, pieces

KINDS = ("assign", "access", "hex", "jwt", "pem", "key")
MASK = "[SECRET]"

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
#: Runs are maximal, so asking for the length in the pattern drops the same matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: A block ends before the next one begins, so that openings without an end cost no more than the text between them.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:(?!-----BEGIN ).)*?)-----END \1-----", re.S)
RUN = re.compile(r"[A-Za-z0-9+/]{64,}={0,2}")
#: What a text must contain for a kind to be looked for at all.
HINTS = {
    "assign": "(?i)(password|passwd|secret|token|api_?key)", "access": "AKIA", "hex": "[0-9a-f]{24}",
    "jwt": "eyJ", "pem": "-----BEGIN ", "key": "[A-Za-z0-9+/]{64}",
}
_OPENSSH = b"openssh-key-v1\0"


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER values that fill ``data`` exactly; None if lengths do not fit."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size > 127:
            width = size - 128
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            size, at = int.from_bytes(data[at:at + width], "big"), at + width
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    outer = der_items(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    fields = der_items(outer[0][1])
    if not fields:
        return False
    tags = [t for t, _ in fields]
    if tags[:2] == [0x30, 0x04] and len(tags) == 2:  # PKCS#8, encrypted
        scheme = der_items(fields[0][1])
        return bool(scheme) and scheme[0][0] == 0x06
    if tags[0] != 0x02 or len(tags) < 2:
        return False
    version = fields[0][1]
    if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:  # PKCS#8
        scheme = der_items(fields[1][1])
        return version in (b"\0", b"\1") and bool(scheme) and scheme[0][0] == 0x06
    if tags[1] == 0x04:  # SEC1
        return version == b"\1" and len(fields[1][1]) >= 16
    return version in (b"\0", b"\1") and len(tags) in (6, 9, 10) and set(tags[:6]) == {0x02}  # PKCS#1, DSA


def is_openssh_key(data: bytes) -> bool:
    if not data.startswith(_OPENSSH):
        return False
    at, parts = len(_OPENSSH), []
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        size = int.from_bytes(data[at:at + 4], "big")
        parts.append(data[at + 4:at + 4 + size])
        at += 4 + size
    if at + 4 > len(data) or not parts[0].isascii():
        return False
    keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    for _ in range(min(keys, 64) + 1):  # public keys, then the private block
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at:at + 4], "big")
    return keys >= 1 and at == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def _base64(text: str, url: bool = False) -> bytes | None:
    text = text.rstrip("=")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    try:
        value = json.loads(_base64(part, url=True) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def is_signed_token(text: str) -> bool:
    header, payload, signature = text.split(".")
    head = _object(header)
    if head is None or not isinstance(head.get("alg"), str) or _object(payload) is None:
        return False
    return head["alg"].lower() == "none" or bool(signature and _base64(signature, url=True))


def is_pem_key(body: str) -> bool:
    body = body.replace("\\r", "").replace("\\n", "\n")
    if "ENCRYPTED" in body and "DEK-Info" in body:
        return True
    return is_key(_base64("".join(body.split())))


def is_bare_key(run: str) -> bool:
    if len(run) % 2 == 0 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", run) and is_key(bytes.fromhex(run)):
        return True
    return is_key(_base64(run))


def find_spans(text: str, kinds: tuple[str, ...] = KINDS) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then by kind as listed."""
    found: list[tuple[int, int, str]] = []
    if "assign" in kinds:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        if kind in kinds:
            found += [(*m.span(), kind) for m in pattern.finditer(text)]
    if "jwt" in kinds:
        found += [(*m.span(), "jwt") for m in JWT.finditer(text) if is_signed_token(m[0])]
    blocks = [m.span() for m in PEM.finditer(text) if is_pem_key(m[2])] if "pem" in kinds else []
    found += [(*span, "pem") for span in blocks]
    if "key" in kinds:
        for m in RUN.finditer(text):
            if not any(a <= m.start() < b for a, b in blocks) and is_bare_key(m[0]):
                found.append((*m.span(), "key"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _hinted(texts: pa.Array) -> list[tuple[str, ...]]:
    """Per text the kinds whose hints it contains, from fast scans without Python."""
    masks = {k: pc.fill_null(pc.match_substring_regex(texts, p), False).to_pylist() for k, p in HINTS.items()}
    return [tuple(k for k, m in zip(masks, row) if m) for row in zip(*masks.values())]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts and digest of the base kinds, and all spans."""
    rows = columns(docs, id=doc_id, text=text)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in pieces(batches, "text"):
            texts = batch.column("text")
            hints = _hinted(texts)
            spans = [find_spans(texts[i].as_py(), h) if h else [] for i, h in enumerate(hints)]
            counts = {f"n_{k}": [sum(s[2] == k for s in row) for row in spans] for k in KINDS[:3]}
            base = [joined([s for s in row if s[2] in KINDS[:3]]) for row in spans]
            yield {
                doc_id: batch.column("id"), **{k: pa.array(v, pa.int64()) for k, v in counts.items()},
                "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                "spans": pa.array([joined(row) for row in spans], pa.string()),
            }

    return map_arrow(rows, run, f"{doc_id} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, str]], mask: str = MASK) -> str:
    """The text with every span, overlapping ones together, replaced."""
    out, at, end = [], 0, -1
    for start, stop, _ in spans:
        if start >= end:
            out += [text[at:start], mask]
        end = at = max(end, stop)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", mask: str = MASK) -> DataFrame:
    """All documents in their columns, secrets masked; NULL texts stay NULL."""
    names = docs.columns
    at, size = names.index(text), names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            found = {i: s for i, h in enumerate(_hinted(texts)) if h and (s := find_spans(texts[i].as_py(), h))}
            if found:
                parts = list(batch.columns)
                body = texts.to_pylist()
                long = parts[size].to_pylist() if size is not None else []
                for i, spans in found.items():
                    body[i] = masked(body[i], spans, mask)
                    if size is not None:
                        long[i] = len(body[i])
                parts[at] = pa.array(body, texts.type)
                if size is not None:
                    parts[size] = pa.array(long, parts[size].type)
                batch = pa.RecordBatch.from_arrays(parts, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)
