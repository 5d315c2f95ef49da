"""Secrets in documents: three plain patterns, and keys and signed tokens that are confirmed by their structure.

Patterns (kinds assign, access, hex) are reported as they match. Besides, runs of base64 or hex digits, armoured blocks
and dotted tokens are candidates only: they are decoded and reported if what comes out is built like a secret:

* key: a private key. DER whose lengths nest and fill their parents exactly, of the shape of PKCS#8, an encrypted
  PKCS#8, an RSA, DSA or EC key; or the OpenSSH form, whose counted strings fill the block exactly. The candidate is a
  run of base64 (either alphabet) or hex digits, or the lines between BEGIN and END marks, which then belong to the span.
* jwt: a token of three parts whose header is a JSON object that names alg, and whose payload is one too, with a
  signature unless alg is none; or of five parts whose header names alg and enc.

Each document is worked on by itself, without a shuffle; Arrow batches are bounded in bytes. Defined cases: null and empty
texts have no secret; repeated rows and null ids give rows like any other; places are counted in code points over the
whole text, of any length; of candidates of one kind that overlap the one that begins first is reported, and the longer
at one place; spans of different kinds may overlap; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "key", "jwt")
BASE = KINDS[:3]
#: Least lengths: of an assigned value, an access key, a run of hex digits, and of base64 or hex digits that may be a key.
ASSIGN, ACCESS, HEX, KEY = 12, 18, 16, 40

_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile("AKIA[A-Z0-9]{%d,}" % (ACCESS - 4))
_HEX = re.compile("[0-9a-f]{%d,}" % HEX)
_ARMOUR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[A-Za-z0-9+/=,:\x20\x09-]|\r|\n|\\r|\\n)*?)-----END \1-----")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % KEY)
_DIGITS = re.compile("[0-9A-Fa-f]{%d,}" % (2 * KEY))
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*){2,4}(?![A-Za-z0-9_.-])")
#: Object identifiers of password-based encryption begin like this: PKCS#5 and PKCS#12.
_ENCRYPTED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c"))
_OPENSSH = b"openssh-key-v1\0"
_INT, _BITS, _OCTETS, _OID, _SEQ = 0x02, 0x03, 0x04, 0x06, 0x30


def unbase64(digits: str) -> bytes | None:
    """The bytes of base64 digits of either alphabet, with or without padding; None if they are none."""
    body = digits.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[at:end] exactly; None if they don't."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80 or (n > 1 and size < 1 << (8 * (n - 1))):
                return None  # not the shortest form
        if at + size > end:
            return None
        out.append((tag, at, at + size))
        at += size
    return out


def well_nested(data: bytes, at: int, end: int, depth: int = 0) -> bool:
    """Whether all lengths inside hold, to the innermost constructed element."""
    found = elements(data, at, end)
    return found is not None and depth < 32 and all(well_nested(data, a, b, depth + 1) for tag, a, b in found if tag & 0x20)


def der_key(data: bytes) -> str | None:
    """The kind of the private key that data is in DER, None if it is none."""
    if len(data) < 16 or data[0] != _SEQ or not well_nested(data, 0, len(data)):
        return None
    top = elements(data, 0, len(data)) or []
    if len(top) != 1:
        return None
    inner = elements(data, *top[0][1:]) or []
    tags = [t for t, _, _ in inner]
    value = lambda k: data[inner[k][1] : inner[k][2]]
    number = lambda k: int.from_bytes(value(k), "big")
    if tags[:2] == [_SEQ, _OCTETS] and len(tags) == 2:
        oid = elements(data, *inner[0][1:]) or []
        if oid and oid[0][0] == _OID and data[oid[0][1] : oid[0][2]].startswith(_ENCRYPTED):
            return "pkcs8-encrypted"
    if tags[:3] == [_INT, _SEQ, _OCTETS] and number(0) in (0, 1):
        oid = elements(data, *inner[1][1:]) or []
        return "pkcs8" if oid and oid[0][0] == _OID and inner[2][1] < inner[2][2] else None
    if len(tags) >= 9 and set(tags[:9]) == {_INT} and number(0) in (0, 1) and number(2) > 2 and number(4) * number(5) == number(1):
        return "rsa"
    if tags == [_INT] * 6 and number(0) == 0 and number(2) > 1 and (number(1) - 1) % number(2) == 0:
        return "dsa"
    if tags[:2] == [_INT, _OCTETS] and number(0) == 1 and 16 <= len(value(1)) <= 80 and set(tags[2:]) <= {0xA0, 0xA1} and len(tags) > 2:
        return "ec"
    return None


def openssh_key(data: bytes) -> bool:
    """Whether data is an OpenSSH private key: counted strings one after another that fill it exactly."""
    if not data.startswith(_OPENSSH):
        return False
    at, strings = len(_OPENSSH), 3
    while strings:
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        strings -= 1
    if at + 4 > len(data):
        return False
    strings, at = int.from_bytes(data[at : at + 4], "big") + 1, at + 4
    if strings > len(data):
        return False
    for _ in range(strings):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at == len(data)


def key_form(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "openssh" if openssh_key(data) else der_key(data)


def json_object(part: str) -> dict | None:
    raw = unbase64(part) if part else None
    try:
        found = json.loads(raw) if raw is not None and raw[:1] in b"{ \t\r\n" else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def signed_token(token: str) -> str | None:
    """The algorithm that the token's header names, None if it is no token."""
    parts = token.split(".")
    if len(parts) not in (3, 5):
        return None
    header = json_object(parts[0])
    alg = header.get("alg") if header else None
    if not isinstance(alg, str) or not alg:
        return None
    if len(parts) == 5:
        return alg if isinstance(header.get("enc"), str) and parts[3] and parts[4] and all(not p or unbase64(p) is not None for p in parts) else None
    if json_object(parts[1]) is None or (parts[2] and unbase64(parts[2]) is None):
        return None
    return alg if bool(parts[2]) != (alg.lower() == "none") else None


def _keys(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ARMOUR.finditer(text):
        lines = [x for x in re.split(r"[\r\n]+|\\r|\\n", m[2]) if ":" not in x]  # header lines of older forms aside
        body = re.sub(r"[\x20\t]", "", "".join(lines))
        data = unbase64(body)
        # an older encrypted body is cipher text: its two header lines are its structure
        form = key_form(data) or ("armoured-encrypted" if data and "DEK-Info:" in m[2] and len(data) % 8 == 0 else None)
        if form:
            yield m.start(), m.end(), form
    for m in _RUN.finditer(text):
        digits = m[0]
        if digits[0] == "M" or digits.startswith("b3BlbnNzaC"):  # DER sequences and OpenSSH blocks begin so
            if form := key_form(unbase64(digits)):
                yield m.start(), m.end(), form
    for m in _DIGITS.finditer(text):
        digits = m[0]
        if len(digits) % 2 == 0 and digits[:2] in ("30", "6f", "6F") and (form := key_form(bytes.fromhex(digits))):
            yield m.start(), m.end(), form


def _apart(found: Iterator[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Of overlapping candidates the first, the longer at one place."""
    upto = 0
    for start, end, detail in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= upto:
            yield start, end, detail
            upto = end


def spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, detail) of a text's secrets by start, then kind: places in code points, end exclusive."""
    out = [("assign", *m.span(), m[1].lower()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span(), "access key id") for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span(), "digits") for m in _HEX.finditer(text)]
    out += [("key", *x) for x in _apart(_keys(text))]
    out += [("jwt", *m.span(), alg) for m in _TOKEN.finditer(text) if (alg := signed_token(m[0]))]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:int,end:int,detail:string>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, secrets): per document its spans, an empty list where there is none."""
    kind = dict(docs.dtypes)[id_col]
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("detail", pa.string())]))
    names = [f.name for f in struct.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(names, x, strict=True)) for x in spans(text.as_py() or "")] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], ["id", "secrets"])

    found = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, secrets {SPANS}")
    return found.withColumnRenamed("id", id_col)


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The documents that have secrets, with each replaced; spans that overlap are replaced as one. found: find_secrets."""
    own = found.where(F.size("secrets") > 0).groupBy(id_col).agg(F.first("secrets").alias("secrets"))
    # text before a span that begins behind all spans before it, and where the last of them ends
    step = lambda acc, s: F.struct(F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
    walked = F.aggregate("secrets", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col))))
    return docs.select(id_col, text_col).join(own, id_col).select(id_col, walked.alias(text_col))


def listed(secrets: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    chosen = F.filter(secrets, lambda s: s["kind"].isin(*kinds)) if kinds != KINDS else secrets
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the plain patterns' spans, and all spans as text."""
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[count(k) for k in KINDS], F.sha2(listed(F.col("secrets"), BASE), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
