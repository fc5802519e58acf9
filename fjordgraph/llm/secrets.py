"""Secret scans that look into what they find.

Patterns find assignments of passwords and tokens, access key ids and long runs of hex
digits. Beside them every run of base64 or hex digits is decoded where the start of a
key encoding stands, and reported if it parses as one: DER structures of private keys
(PKCS#1, PKCS#8, encrypted PKCS#8, SEC 1) whose nested lengths add up, OpenSSH private
keys whose length-prefixed fields do, and signed tokens whose header names an
algorithm, whose payload is an object and whose signature has that algorithm's length.
A run that looks random but has no such structure is not reported, nor is a public key.

A structure ends where its own length says, so neighbours of a key in a text are not
taken for it. Base64 may be broken into lines, as in PEM files, indented ones too.

Spans are code points, ends exclusive. Null texts count as empty and have no spans;
those are found in whole texts, however long. Repeated rows and null ids are rows like
others, and an empty table gives an empty result. Columns other than the id and the
text are not used and may have any names.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "dsa", "pkcs1", "pkcs8", "pkcs8_encrypted", "sec1", "openssh", "signed_token")
#: Least lengths: of an assigned value, an access key id, a run of hex digits.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16

# fixed values: the patterns that the base kinds are defined by
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

# fixed values: lengths in bytes of the signatures of signed tokens
SIGNATURES = {"HS256": {32}, "HS384": {48}, "HS512": {64}, "ES256": {64}, "ES256K": {64}, "ES384": {96}, "ES512": {132}, "EdDSA": {64, 114}}
#: RSA signatures are as long as the modulus.
RSA = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}

# a signed token starts with the base64 of `{"`, or of `{` and white space
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[wy][A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
# base64 digits, also over lines, whose breaks may be escaped as in JSON
RUN64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?:(?:(?:\\r)?\\n|[ \t]*\r?\n[ \t]*)[A-Za-z0-9+/_-]+)*")
RUN16 = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{32,}")
_BREAK = re.compile(r"\\r|\\n|[ \t\r\n]+")
# how a SEQUENCE's tag and length, or the OpenSSH magic, begin in either notation
START64 = re.compile(r"M[A-I]|b3BlbnNzaC1rZXktdjEA")
START16 = re.compile(r"30(?=[0-8])|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100")
_URL_SAFE = str.maketrans("-_", "+/")
MAGIC = b"openssh-key-v1\0"

INTEGER, OCTETS, OID, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at ``at`` if its length is well formed and
    it ends within ``end``."""
    if end - at < 2:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or end - at < n or not data[at] or (n == 1 and data[at] < 0x80):
            return None
        size, at = int.from_bytes(data[at : at + n]), at + n
    return (tag, at, at + size) if at + size <= end else None


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill this range to its last byte, else None."""
    found = []
    while at < end:
        e = element(data, at, end)
        if e is None:
            return None
        found.append(e)
        at = e[2]
    return found


def _inner(data: bytes, e: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    return elements(data, e[1], e[2]) or []


def key_kind(data: bytes) -> str | None:
    """Which private key the DER structure ``data`` is."""
    top = element(data, 0, len(data))
    if top is None or top[0] != SEQUENCE or top[2] != len(data):
        return None
    parts = _inner(data, top)
    tags = [t for t, _, _ in parts]
    if len(tags) < 2:
        return None
    value = int.from_bytes(data[parts[0][1] : parts[0][2]]) if tags[0] == INTEGER else None
    if value == 0 and tags == [INTEGER] * 6:
        return "dsa"
    if value in (0, 1) and tags[:9] == [INTEGER] * 9 and tags[9:] in ([], [SEQUENCE]) and len(tags) - 9 == value:
        return "pkcs1"
    if value in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS] and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        names, key = _inner(data, parts[1]), _inner(data, parts[2])
        return "pkcs8" if names and names[0][0] == OID and len(key) == 1 else None
    if value == 1 and tags[1] == OCTETS and set(tags[2:]) <= {0xA0, 0xA1} and parts[1][1] < parts[1][2]:
        return "sec1" if all(_inner(data, p) for p in parts[2:]) else None
    if tags == [SEQUENCE, OCTETS] and parts[1][1] < parts[1][2]:
        names = [t for t, _, _ in _inner(data, parts[0])]
        return "pkcs8_encrypted" if names == [OID, SEQUENCE] else None
    return None


def openssh_end(data: bytes) -> int | None:
    """Where the OpenSSH private key at the start of ``data`` ends, if its fields fit."""
    at = len(MAGIC)
    names = []

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4])
        if at + 4 + size > len(data):
            return None
        out, at = data[at + 4 : at + 4 + size], at + 4 + size
        return out

    for _ in range(3):
        names.append(field())
    keys = int.from_bytes(data[at : at + 4])
    at += 4
    if None in names or not re.fullmatch(rb"[\x21-\x7e]+", names[0]) or not re.fullmatch(rb"[\x21-\x7e]+", names[1]) or not 1 <= keys <= len(data):
        return None
    for _ in range(keys):
        public = field()
        if public is None or not 0 < int.from_bytes(public[:4]) <= len(public) - 4:
            return None
    secret = field()
    if not secret or (names[0] == b"none" and secret[:4] != secret[4:8]):
        return None
    return at


def _plausible(head: bytes) -> int | None:
    """Bytes of the SEQUENCE that ``head`` begins, if a private key may begin so."""
    if len(head) < 8 or head[0] != SEQUENCE:
        return None
    n = head[1] & 0x7F if head[1] >= 0x80 else 0
    if n > 4 or head[2 + n] not in (INTEGER, SEQUENCE) or (head[2 + n] == INTEGER and (head[3 + n] != 1 or head[4 + n] > 1)):
        return None
    return 2 + n + (int.from_bytes(head[2 : 2 + n]) if n else head[1])


def _keys(digits: str, starts: re.Pattern, per: tuple[int, int], decode) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the keys in a run of digits, ``per[0]`` of which make
    ``per[1]`` bytes. A key found is not searched again."""
    at = 0
    many = lambda n: -(-n * per[0] // per[1])
    while (m := starts.search(digits, at)) is not None:
        at = m.start()
        size = kind = None
        if m.end() - at > 2:
            data = decode(digits[at:])
            if data.startswith(MAGIC) and (size := openssh_end(data)) is not None:
                kind = "openssh"
        elif (size := _plausible(decode(digits[at : at + many(9)]))) is not None and at + many(size) <= len(digits):
            kind = key_kind(decode(digits[at : at + many(size)])[:size])
        if kind:
            yield at, at + many(size), kind
            at += many(size)
        else:
            at += 1


def _decode64(digits: str) -> bytes:
    # a last digit alone holds no byte
    whole = digits[: len(digits) - (len(digits) % 4 == 1)]
    return base64.b64decode(whole + "=" * (-len(whole) % 4))


def _decode16(digits: str) -> bytes:
    return bytes.fromhex(digits[: len(digits) // 2 * 2])


def _json(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None


def signed_token(head: str, body: str, signature: str) -> str | None:
    """The algorithm of a signed token, if all three parts are what it says."""
    header = _json(head)
    alg = header.get("alg") if isinstance(header, dict) else None
    if not isinstance(alg, str) or len(signature) % 4 == 1 or not isinstance(_json(body), dict):
        return None
    size = len(signature) * 3 // 4
    return alg if size in SIGNATURES.get(alg, ()) or (alg in RSA and size >= 128) else None


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, detail) of the patterns' matches."""
    found = [(m.start(), m.end(), "assign", m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", "") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    return found + [(m.start(), m.end(), "hex", "") for m in HEX.finditer(text)]


def structures(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, detail) of the keys and tokens that decode and parse."""
    found = []
    for m in RUN64.finditer(text):
        run = m[0]
        if START64.search(run) is None:
            continue
        breaks = [(b.start(), b.end()) for b in _BREAK.finditer(run)]
        digits = _BREAK.sub("", run).translate(_URL_SAFE)
        # where each line starts in the digits, and how far the breaks before it shift it
        lines, shift = [(0, 0)], 0
        for a, b in breaks:
            lines.append((a - shift, shift + b - a))
            shift += b - a
        back = lambda i, lines=lines: i + lines[bisect.bisect_right(lines, (i, len(text))) - 1][1]
        for a, b, kind in _keys(digits, START64, (4, 3), _decode64):
            found.append((m.start() + back(a), m.start() + back(b - 1) + 1, kind, "base64"))
    for m in RUN16.finditer(text):
        found += [(m.start() + a, m.start() + b, kind, "hex") for a, b, kind in _keys(m[0], START16, (2, 1), _decode16)]
    for m in TOKEN.finditer(text):
        alg = signed_token(*m.groups())
        if alg:
            found.append((m.start(), m.end(), "signed_token", alg))
    return found


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """All spans, by start, then by kind as listed."""
    text = text or ""
    return sorted(base_spans(text) + structures(text), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


SPANS = "array<struct<start:long,end:long,kind:string,detail:string>>"


def spans(text: Column) -> Column:
    """The spans of a text, as :func:`find` has them."""
    names = ("start", "end", "kind", "detail")

    @F.pandas_udf(SPANS)
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in find(t)] for t in texts], dtype=object)

    return scanned(text)


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_structures, base_sha256, spans`` of every
    document; ``spans`` lists ``kind:start:end``."""
    told = docs.select("doc_id", spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    more = F.size(F.filter("found", lambda x: ~x["kind"].isin(*BASE))).cast("long").alias("n_structures")
    return told.select("doc_id", *[count(k) for k in BASE], more, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"))


def findings(docs: DataFrame) -> DataFrame:
    """A row ``doc_id, start, end, kind, detail, secret, confirmed`` for each span, with
    its text; ``confirmed`` tells of spans that are, or lie over, a parsed structure."""
    told = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), spans(F.col("text")).alias("found"))
    parsed = F.filter("found", lambda x: ~x["kind"].isin(*BASE))
    each = told.select("doc_id", "text", parsed.alias("parsed"), F.explode("found").alias("x"))
    over = F.exists("parsed", lambda p: (p["start"] < F.col("x.end")) & (p["end"] > F.col("x.start")))
    secret = F.substr("text", (F.col("x.start") + 1).cast("int"), (F.col("x.end") - F.col("x.start")).cast("int"))
    return each.select("doc_id", "x.start", "x.end", "x.kind", "x.detail", secret.alias("secret"), over.alias("confirmed"))
