"""Secret scans (operator 7): pattern spans, and spans confirmed by decoding their structure.

Base kinds (assign, access, hex) are what the patterns match. The method adds candidates that are reported only
if they decode: ``jwt`` (a signed token whose header is a JSON object with an algorithm), ``pem`` (an armoured
block whose body is a key encoding), ``der`` (bare base64 or hex that is a sequence with exact nested lengths)
and ``sshkey`` (length-prefixed key blobs). Spans count code points, ends are exclusive. Null texts are empty.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: In the order in which spans at one place are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "sshkey")
SPANS = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # runs are maximal: the same as matching any run and dropping short ones
_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----([A-Za-z0-9+/=\s]*)-----END \1-----")
_BARE = re.compile(r"(?<![A-Za-z0-9+/_-])(?:M[A-Za-z0-9+/_-]{31,}|30[0-9a-f]{30,}|30[0-9A-F]{30,}|AAAA[A-Za-z0-9+/]{28,}|b3BlbnNzaC1rZXk[A-Za-z0-9+/]{20,})={0,2}")


def _from_base64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_elements(data: bytes, depth: int = 0) -> list | None:
    """Tag and content of each element if ``data`` is a run of elements with exact lengths, nested ones too."""
    out, i = [], 0
    while i < len(data):
        if i + 2 > len(data) or depth > 12:
            return None
        tag, length = data[i], data[i + 1]
        i += 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or i + width > len(data):
                return None
            length = int.from_bytes(data[i : i + width], "big")
            if length < 0x80 or width > 1 and length < 1 << 8 * (width - 1):
                return None  # not the shortest form
            i += width
        if i + length > len(data):
            return None
        content = data[i : i + length]
        if tag & 0x20:
            inner = der_elements(content, depth + 1)
            if inner is None:
                return None
            content = inner
        out.append((tag, content))
        i += length
    return out


def is_der_key(data: bytes | None) -> bool:
    """One sequence that holds at least two elements, an integer, bit or octet string among them."""
    if not data or data[0] != 0x30:
        return False
    found = der_elements(data)
    if not found or len(found) != 1 or len(found[0][1]) < 2:
        return False
    return any(tag in (0x02, 0x03, 0x04) for tag, _ in found[0][1])


def is_ssh_blob(data: bytes | None) -> bool:
    """A private key container, or length-prefixed fields that begin with a key type and end with the data."""
    if not data:
        return False
    if data.startswith(b"openssh-key-v1\0"):
        return True
    fields, i = [], 0
    while i < len(data):
        length = int.from_bytes(data[i : i + 4], "big")
        if i + 4 > len(data) or i + 4 + length > len(data):
            return False
        fields.append(data[i + 4 : i + 4 + length])
        i += 4 + length
    return len(fields) >= 2 and re.match(rb"(ssh-|ecdsa-sha2-|sk-)[\w@.-]+$", fields[0]) is not None


def is_token_header(part: str) -> bool:
    """A base64url JSON object that names an algorithm."""
    try:
        header = json.loads(_from_base64(part) or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str)


def confirm_bare(text: str) -> str | None:
    """The kind of a bare base64 or hex candidate, None if its structure does not hold."""
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) and len(text) % 2 == 0 and is_der_key(bytes.fromhex(text)):
        return "der"
    data = _from_base64(text)
    if is_der_key(data):
        return "der"
    return "sshkey" if is_ssh_blob(data) else None


def scan(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text by start, then kind."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text) if is_token_header(m[1])]
    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            data = _from_base64(re.sub(r"\s", "", m[2]))
            if is_der_key(data) or is_ssh_blob(data):
                out.append(("pem", *m.span()))
    out += [(kind, *m.span()) for m in _BARE.finditer(text) if (kind := confirm_bare(m[0]))]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return out


def secret_spans(text: Column) -> Column:
    """All spans of a text (array of kind, start, end); none for null."""

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t)] for t in texts], dtype=object)

    return spans(F.coalesce(text.cast("string"), F.lit("")))


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id and secrets (array of spans) for every row, repeated rows and null ids included."""
    return documents.select("doc_id", secret_spans(F.col("text")).alias("secrets"))


def redacted(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones merged, replaced by ``mark``."""
    out, done = [], 0
    for _, a, b in scan(text):
        if a >= done:
            out.append(text[done:a] + mark)
        done = max(done, b)
    return "".join(out) + text[done:]


def redact_secrets(documents: DataFrame) -> DataFrame:
    """The same rows and columns with secrets replaced in text; null texts stay null, other columns as they are."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t) for t in texts], dtype=object)

    return documents.withColumn("text", clean(F.col("text")))
