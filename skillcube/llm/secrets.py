"""Secret scans with structural confirmation.

Base spans are plain patterns. Further candidates (signed tokens, PEM blocks, PuTTY files, base64 and hex runs) are reported only if
they decode and what they decode to has the structure of a secret: a token header with an algorithm and a JSON payload, or
a private key whose nested lengths add up exactly to the decoded bytes. A base64 run may go over several lines, and a key may start inside it: the
length in its first bytes says where it ends. Decoded bytes that are text are looked at again (DEPTH times), so a PEM file or a token that was encoded
once more is found. A run inside a block that is reported is not reported again. All patterns start at the edge of a run and do not go back into it; a key inside a
run is decoded only as far as its lengths say (KEY_BYTES at most where a sequence's tag is all that shows it, any length for an OpenSSH key, which names itself);
a line of a PuTTY file is walked once. So the work is linear in the text.

Null texts are empty. Spans count code points, end exclusive. Texts without a span give zero counts, the digest of the empty
string and an empty span list. Rows with equal doc_id stay separate; extra columns are ignored (scan) or kept (redact).
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skillcube.llm.common import read_table, slices, worker_state

STEP_BYTES = 1 << 21
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("jwt", "pem", "key64", "keyhex", "putty")
DEPTH = 2
#: Bytes that a key has at most where it starts inside a run with a sequence's tag; the largest RSA keys in use (16,384 bits) have 9,300.
KEY_BYTES = 1 << 14
_ORDER = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{12,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+(?:\.[A-Za-z0-9_-]*+\.[A-Za-z0-9_-]++)?+")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s:,.]|-(?!----))*+)-----END \1-----")
_B64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]{16,}+)*+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++(?=\s|=|\Z))?+={0,2}+")
#: Characters of the shortest key in base64, and in hex.
_LEAST64, _LEAST_HEX = 52, 78
_ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{78,}+")
#: Where a key can start in base64: a sequence's tag and a length, or the words of an OpenSSH key.
_KEY_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjEA")
_PUTTY_HEAD = "PuTTY-User-Key-File-"
_PUTTY = re.compile(_PUTTY_HEAD + r"[0-9]: [^\r\n]*\r?\n")
_LINE64 = re.compile(r"[A-Za-z0-9+/]*={0,2}")


def decode64(s: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padding optional; None if it is not base64."""
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: Fixed value: the object identifier 1.2.840.113549.1.7.1.
_PKCS7_DATA = bytes.fromhex("2a864886f70d010701")


def der(data: bytes) -> list[tuple[int, bytes]] | None:
    """Elements (tag, content) of DER data, None unless their lengths add up exactly."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > len(data) or not data[at]:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def private_key(data: bytes) -> str | None:
    """The encoding of a private key (rsa, dsa, ec, pkcs8, encrypted, pkcs12, openssh), None if the bytes are none."""
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, key derivation, its options
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
        for _ in range(keys + 1 if keys <= 16 else 99):  # public keys, private section
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return "openssh" if keys and at == len(data) else None
    top = der(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    parts = der(top[0][1])
    if not parts:
        return None
    tags = [t for t, _ in parts]
    if tags[:9] == [2] * 9 and len(parts[1][1]) >= 32:
        return "rsa"
    if tags == [2] * 6 and len(parts[1][1]) >= 32:
        return "dsa"
    if tags[:2] == [2, 4] and parts[0][1] == b"\1" and 16 <= len(parts[1][1]) <= 72 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "ec"
    if tags[:2] == [2, 0x30] and parts[0][1] == b"\3" and set(tags[2:]) <= {0x30} and (info := der(parts[1][1])) and info[0] == (6, _PKCS7_DATA):
        return "pkcs12"
    if tags[:3] == [2, 0x30, 4] and parts[0][1] in (b"\0", b"\1") and (alg := der(parts[1][1])) and alg[0][0] == 6 and der(parts[2][1]):
        return "pkcs8"
    if tags == [0x30, 4] and (alg := der(parts[0][1])) and alg[0][0] == 6 and len(parts[1][1]) % 8 == 0:
        return "encrypted"
    return None


def signed_token(s: str) -> bool:
    """Whether header.payload.signature decode to a header that names an algorithm and a JSON object."""
    head, body = s.split(".")[:2]
    try:
        first = json.loads(decode64(head) or b"")
        if not isinstance(first, dict) or not isinstance(first.get("alg"), str):
            return False
        return "enc" in first or isinstance(json.loads(decode64(body) or b""), dict)
    except (ValueError, RecursionError):
        return False


def _der_size(head: bytes) -> int:
    """Bytes of the sequence that starts here and can be a key by its first elements, 0 if it cannot."""
    if len(head) < 12 or head[0] != 0x30:
        return 0
    n, at = head[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 3:
            return 0
        n, at = int.from_bytes(head[2 : 2 + k], "big"), 2 + k
    if at + n > KEY_BYTES or at + n < 39:
        return 0
    version = head[at] == 2 and head[at + 1] == 1 and head[at + 2] <= 3
    wrapped = head[at] == 0x30 and 6 in head[at + 2 : at + 5]
    return at + n if version or wrapped else 0


def _openssh_size(run: str, start: int) -> int:
    """Bytes of the OpenSSH key that starts here, by its nested lengths; 0 if they lead out of the run."""
    whole = 3 * (len(run) - start) // 4

    def number(at: int) -> int:
        group = at // 3
        six = decode64(run[start + 4 * group : start + 4 * group + 8]) or b""
        return int.from_bytes(six[at - 3 * group : at - 3 * group + 4], "big")

    at, keys = 15, 0
    for part in range(3 + 17):  # cipher, key derivation, its options; public keys, private section
        if part == 3:
            if at + 4 > whole or not 1 <= (keys := number(at)) <= 16:
                return 0
            at += 4
        if at + 4 > whole:
            return 0
        at += 4 + number(at)
        if part >= 3 and part - 3 == keys:
            break
    return at if at <= whole else 0


def _keys_inside(run: str) -> Iterator[tuple[int, int]]:
    """(start, end) of private keys in a run of standard base64 without padding."""
    at = 0
    while m := _KEY_START.search(run, at):
        i = at = m.start()
        at += 1
        size = _openssh_size(run, i) if m[0][0] == "b" else _der_size(decode64(run[i : i + 24]) or b"")
        end = i + -(-4 * size // 3)
        data = decode64(run[i:end]) if size and end <= len(run) else None
        if data and private_key(data):
            yield i, end
            at = end


def _is_text(data: bytes) -> bool:
    return len(data) >= 40 and all(32 <= c < 127 or c in b"\t\r\n" for c in data[:40])


def _key64(m: re.Match, depth: int) -> list[tuple[int, int]]:
    """Spans of what a base64 run holds."""
    shown = m[0].rstrip("=")
    run = "".join(shown.split()) if not shown.isascii() or "\n" in shown else shown
    if len(run) < _LEAST64:
        return []
    run = run.replace("-", "+").replace("_", "/")
    places = [i for i, c in enumerate(shown) if not c.isspace()] if len(run) < len(shown) else range(len(run))
    found = list(_keys_inside(run))
    if not found and depth > 1:
        for i in {0, max(0, run.find("LS0tLS1CRUdJTi"))}:  # text from the start, or a PEM block that follows something
            data = decode64(run[i : i + 4 * ((len(run) - i) // 4)]) or b""
            if _is_text(data) and confirmed(data.decode("latin-1"), depth - 1):
                found.append((i, len(run)))
                break
    pad = len(m[0]) - len(shown)
    return [(m.start() + places[a], m.start() + places[z - 1] + 1 + (pad if z == len(run) else 0)) for a, z in found]


def _putty(text: str) -> Iterator[tuple[int, int]]:
    """Spans of PuTTY key files: as many base64 lines as each count says, and a code of hex digits. No file goes on over a line that starts another one."""
    for m in _PUTTY.finditer(text):
        at, ok, parts = m.end(), True, 0
        while ok and at < len(text):
            line, end, at = _line(text, at)
            name, _, value = line.strip().partition(": ")
            if _PUTTY_HEAD in line:
                break
            if name in ("Public-Lines", "Private-Lines") and value.isdecimal() and len(value) < 5:
                body: list[str] = []
                while len(body) < int(value) and at < len(text):
                    line, _, after = _line(text, at)
                    if not _LINE64.fullmatch(line.strip()):
                        break
                    body.append(line.strip())
                    at = after
                ok = len(body) == int(value) and decode64("".join(body)) is not None
                parts += 1
            elif name in ("Private-MAC", "Private-Hash"):
                if parts == 2 and re.fullmatch("[0-9a-f]{40,64}", value):
                    yield m.start(), end
                break
            elif name not in ("Encryption", "Comment", "Key-Derivation", "Argon2-Memory", "Argon2-Passes", "Argon2-Parallelism", "Argon2-Salt"):
                break


def _line(text: str, at: int) -> tuple[str, int, int]:
    """The line that starts here, its end and where the next one starts."""
    end = text.find("\n", at)
    end = len(text) if end < 0 else end
    return text[at:end], end, end + 1


def confirmed(text: str, depth: int = DEPTH) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the candidates that decode to a secret."""
    more = []
    if "." in text:
        more += [(*m.span(), "jwt") for m in _JWT.finditer(text) if signed_token(m[0])]
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"^[A-Za-z-]+:.*$", "", m[2], flags=re.M)
            data = decode64("".join(body.split()))
            if data and (private_key(data) or "Proc-Type" in m[2] and len(data) % 8 == 0):
                more.append((*m.span(), "pem"))
    if _PUTTY_HEAD in text:
        more += [(a, b, "putty") for a, b in _putty(text)]
    for m in _B64.finditer(text):
        if m.end() - m.start() >= _LEAST64:
            more += [(a, b, "key64") for a, b in _key64(m, depth)]
    for m in _ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0:
            data = bytes.fromhex(m[0])
            if private_key(data) or depth > 1 and _is_text(data) and confirmed(data.decode("latin-1"), depth - 1):
                more.append((*m.span(), "keyhex"))
    more.sort()
    out, until = [], 0
    for a, b, kind in more:  # what lies in a block that is reported is not reported again
        if b > until or kind not in ("key64", "keyhex"):
            out.append((a, b, kind))
            until = max(until, b)
    return out


def scan(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, added spans) of one text as (start, end, kind)."""
    base = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        base += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    more = confirmed(text)
    key = lambda x: (x[0], _ORDER[x[2]])
    return sorted(base, key=key), sorted(more, key=key)


def shown(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span replaced by a mark; overlapping spans become one."""
    base, more = scan(text)
    out, at = [], 0
    for a, b, _ in sorted(base + more):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("secrets")
    for whole in batches:
        for b in slices(whole, "text", STEP_BYTES):
            rows = [scan(t) for t in b.column("text").to_pylist()]
            counts = [pa.array([sum(k == x[2] for x in base) for base, _ in rows], pa.int64()) for k in BASE_KINDS]
            digest = pa.array([hashlib.sha256(shown(base).encode()).hexdigest() for base, _ in rows])
            spans = pa.array([shown(sorted(base + more, key=lambda x: (x[0], _ORDER[x[2]]))) for base, more in rows], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, digest, spans], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state("secrets")
    for whole in batches:
        if whole.num_rows == 0:
            continue
        at = whole.schema.get_field_index("text")
        for b in slices(whole, "text", STEP_BYTES):
            texts = [t if t is None else redact(t) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the secrets of text replaced; every row and every other column stays."""
    return docs.mapInArrow(_redacted, docs.schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(read_table(spark, sf_dir, "documents"))
