"""Secret scans: pattern spans, and spans whose decoded structure proves a key or a signed token.

Base kinds are patterns alone: ``assign``, ``access`` and ``hex``. The structural kinds are reported only where
decoding confirms them:

* ``token``: three base64url parts, the first two JSON objects, the first naming an ``alg``;
* ``key``: base64 or hex that decodes to DER whose nested lengths fill it exactly and which has the fields of a
  PKCS#1, PKCS#8 or SEC 1 private key, or to an OpenSSH private key container with sound lengths;
* ``pem``: a PEM block of a private key whose body decodes to such an encoding or to an encrypted PKCS#8 one; one with a
  cipher named in its headers, an initial vector of that cipher's length and a body of whole cipher blocks; or an
  OpenPGP block whose packets fill it exactly, begin with a secret key, and agree with its checksum where it has one.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "token", "key", "pem")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{43,}={0,2}")
HEX_PAIRS = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
HEADER = re.compile(r"([A-Za-z][A-Za-z-]*): *(.*)")
CIPHER = re.compile(r"(AES-(?:128|192|256)-CBC|DES-EDE3-CBC|DES-CBC),([0-9A-Fa-f]+)")
OPENSSH = b"openssh-key-v1\0"
# Fixed values of OpenPGP: the secret-key packet's tag, key versions, public-key algorithms, the checksum's start and polynomial.
SECRET_KEY, VERSIONS, ALGORITHMS = 5, {3, 4, 5, 6}, {1, 2, 3, 16, 17, 18, 19, 22, 25, 26, 27, 28}
CRC_START, CRC_POLYNOMIAL = 0xB704CE, 0x1864CFB
SEQUENCE, INTEGER, OCTETS, OBJECT_ID = 0x30, 0x02, 0x04, 0x06


def der_items(data: bytes, at: int, stop: int) -> list[tuple[int, int, int]] | None:
    """Tags and content bounds of the DER items that fill data[at:stop] exactly; None if their lengths don't."""
    out = []
    while at < stop:
        if at + 2 > stop:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > stop:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > stop:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def is_private_der(data: bytes) -> bool:
    """PKCS#1 (version and eight integers), PKCS#8 (version, algorithm, octets) or SEC 1 (version 1, octets)."""
    top = der_items(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    fields = der_items(data, *top[0][1:])
    if not fields or fields[0][0] != INTEGER or fields[0][2] - fields[0][1] != 1:
        return False
    tags = [t for t, _, _ in fields]
    if len(tags) >= 9 and tags[:9] == [INTEGER] * 9:
        return all(b > a for _, a, b in fields)
    if len(tags) >= 3 and tags[1] == SEQUENCE and tags[2] == OCTETS:
        algorithm = der_items(data, *fields[1][1:])
        return bool(algorithm) and algorithm[0][0] == OBJECT_ID
    return len(tags) >= 2 and data[fields[0][1]] == 1 and tags[1] == OCTETS and fields[1][2] - fields[1][1] >= 16


def is_encrypted_der(data: bytes) -> bool:
    """PKCS#8 with encryption: an algorithm, named by an object id, and octets."""
    top = der_items(data, 0, len(data)) if data[:1] == b"\x30" else None
    fields = der_items(data, *top[0][1:]) if top and len(top) == 1 else None
    if not fields or [t for t, _, _ in fields] != [SEQUENCE, OCTETS] or fields[1][1] == fields[1][2]:
        return False
    algorithm = der_items(data, *fields[0][1:])
    return bool(algorithm) and algorithm[0][0] == OBJECT_ID


def pgp_packets(data: bytes) -> list[tuple[int, int, int]] | None:
    """Tags and body bounds of the OpenPGP packets that fill the bytes exactly; None if their lengths don't."""
    out, at = [], 0
    while at < len(data):
        head, at = data[at], at + 1
        if not head & 0x80 or at >= len(data):
            return None
        if head & 0x40:
            tag, first, at = head & 0x3F, data[at], at + 1
            if first < 192:
                size, more = first, 0
            elif first < 224:
                size, more = (first - 192 << 8) + 192, 1
            elif first == 255:
                size, more = 0, 4
            else:
                return None  # keys have no partial lengths
        else:
            tag, size, more = head >> 2 & 15, 0, (1, 2, 4, 0)[head & 3]
            if not more:
                return None
        if at + more > len(data):
            return None
        size, at = size + int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > len(data):
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def crc24(data: bytes) -> int:
    crc = CRC_START
    for x in data:
        crc ^= x << 16
        for _ in range(8):
            crc = crc << 1 ^ (CRC_POLYNOMIAL if crc & 0x800000 else 0)
    return crc & 0xFFFFFF


def is_pgp_secret(data: bytes, checksum: bytes | None) -> bool:
    packets = pgp_packets(data)
    if not packets or packets[0][0] != SECRET_KEY:
        return False
    _, a, b = packets[0]
    # Version, time of creation (and days of validity in version 3), algorithm, then the key's numbers.
    if b - a < 16 or data[a] not in VERSIONS or data[a + (7 if data[a] == 3 else 5)] not in ALGORITHMS:
        return False
    return checksum is None or crc24(data).to_bytes(3, "big") == checksum


def is_sealed(headers: dict[str, str], data: bytes) -> bool:
    """Whether an encrypted block's headers name a cipher with a whole initial vector and the body is whole blocks."""
    cipher = CIPHER.fullmatch(headers.get("dek-info", "").strip())
    if headers.get("proc-type", "").replace(" ", "") != "4,ENCRYPTED" or not cipher:
        return False
    block = 16 if cipher[1].startswith("AES") else 8
    return len(cipher[2]) == 2 * block and len(data) >= 64 and len(data) % block == 0


def is_private_block(label: str, body: str) -> bool:
    """Whether what stands between a block's marks is a private key."""
    headers, lines, checksum = {}, [], None
    for line in filter(None, map(str.strip, body.splitlines())):
        if not lines and (m := HEADER.fullmatch(line)):
            headers[m[1].lower()] = m[2]
        elif line.startswith("=") and len(line) == 5:
            checksum = from_base64(line[1:])
        else:
            lines.append(line)
    data = from_base64("".join("".join(lines).split()))
    if not data:
        return False
    if label.endswith("BLOCK"):
        return is_pgp_secret(data, checksum)
    return is_sealed(headers, data) if "proc-type" in headers else is_key(data) or is_encrypted_der(data)


def is_openssh_private(data: bytes) -> bool:
    """The container's magic, three strings, a key count, and that many public keys and one private blob."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def blob() -> bool:
        nonlocal at
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at <= len(data)

    if not (blob() and blob() and blob()) or at + 4 > len(data):
        return False
    count, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    return 1 <= count <= 16 and all(blob() for _ in range(count + 1))


def from_base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_private_der(data) or is_openssh_private(data))


def is_signed_token(text: str) -> bool:
    parts = []
    for part in text.split(".")[:2]:
        data = from_base64(part)
        try:
            parts.append(json.loads(data) if data else None)
        except (ValueError, RecursionError):
            return False
    return len(parts) == 2 and all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, index of kind and end of the pattern kinds; matches of a kind don't overlap, the leftmost wins."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def structural_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m.group())]
    keys = {m.span() for m in BASE64.finditer(text) if is_key(from_base64(m.group()))}
    keys |= {m.span() for m in HEX_PAIRS.finditer(text) if is_key(bytes.fromhex(m.group()))}
    out += [(a, 4, b) for a, b in keys]
    if "-----BEGIN " in text:
        for m in PEM_BEGIN.finditer(text):
            mark = f"-----END {m.group(1)}-----"
            stop = text.find("-----", m.end())
            if stop < 0 or not text.startswith(mark, stop):
                continue
            if is_private_block(m.group(1), text[m.end() : stop]):
                out.append((m.start(), 5, stop + len(mark)))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, or run of spans that overlap, replaced by its first kind in angle brackets."""
    out, at, open_at = [], 0, -1
    for a, k, b in sorted(spans):
        if a < at and open_at >= 0:
            at = max(at, b)
            continue
        out += [text[at:a], f"<{KINDS[k]}>"]
        at, open_at = b, a
    return "".join([*out, text[at:]])


def scan_documents(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Find secrets in every whole text; one row per input row.

    Columns: doc_id, n_assign, n_access, n_hex, base_sha256 (of the pattern spans as listed), spans (all spans as
    ``kind:start:end`` by start, then kind; code points, end exclusive), and with ``keep_text`` the redacted text.
    A null text counts as empty (no spans, the hash of nothing); a null doc_id stays null; repeated rows give
    repeated rows; an empty table gives none; other columns are not looked at.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", text string" * keep_text

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["text"]:
                t = t or ""
                base = base_spans(t)
                every = sorted(base + structural_spans(t))
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((*n, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), *([redacted(t, every)] * keep_text)))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")][1:])
            out.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(scan, schema)


def redact_documents(docs: DataFrame) -> DataFrame:
    """All columns of the documents; every secret in ``text`` gives way to its kind, and ``n_chars``, where there is one, follows.

    Null texts stay null.
    """
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [t if t is None else redacted(t, base_spans(t) + structural_spans(t)) for t in b["text"]]
            changed = {"text": text}
            if counted:
                changed["n_chars"] = [n if a is None or a == t else len(t) for n, a, t in zip(b["n_chars"], b["text"], text, strict=True)]
            yield b.assign(**changed)

    return docs.mapInPandas(run, docs.schema)
