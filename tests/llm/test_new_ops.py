"""Resampling, secret scans and the filter audit against brute force."""

import base64
import hashlib
import itertools
import json
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from fjordgraph.llm import audit, resampling, secrets, sql


def table(spark, rows, ddl="doc_id long, text string"):
    """With columns whose names the operators use themselves."""
    names = {c.split()[0] for c in ddl.split(", ")}
    extra = {c: F.lit("x") for c in ("n", "w", "part", "digest", "rank", "score", "found", "good", "fails_A", "bucket", "kind") if c not in names}
    return spark.createDataFrame(rows, ddl).withColumns(extra)


# resampling


def plain_resample(rows, target, percent, least, longest, buckets, seed):
    def features(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(bucket, features(x)[1]))
    for x in target:
        t.update(map(bucket, features(x)[1]))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for d, x in rows:
        w, f = features(x)
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f)
        out.append((d, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0] is not None, r[0] or 0) for r in out if r[1] >= least)
    return out, able[: percent * len(able) // 100]


@pytest.mark.parametrize("longest,nodes", [(1, 250_000), (3, 40)])
def test_resampling_equals_brute_force(spark, monkeypatch, longest, nodes):
    monkeypatch.setattr(resampling, "NODES", nodes)
    monkeypatch.setattr(resampling, "SLICE", 7)
    rng = random.Random(4)
    lex = "The cat École ÀÉ x1 42 naïve THE dog's a-b 日本 ſtop K".split(" ")
    rows = [(i, " \n".join(rng.choice(lex) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    rows += [(None, None), (None, "the " * 30), (500, ""), (501, "... !!"), (502, "cat " * 5000), (3, rows[3][1]), (3, rows[3][1])]
    target = [(i, "cat the cat École " * i) for i in range(5)] + [(9, None)]
    got = resampling.resample(table(spark, rows).repartition(5), table(spark, target), 25, 20, longest, 97, 7).collect()
    want, drawn = plain_resample(rows, [x for _, x in target], 25, 20, longest, 97, 7)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, r.doc_id is not None, r.doc_id or 0) for r in ranked] == drawn


def test_resampling_of_nothing(spark):
    none, some = table(spark, []), table(spark, [(1, "a b c")])
    assert resampling.resample(none, some).collect() == []
    assert resampling.resample(some, none).count() == 1
    gains = resampling.bucket_gains(resampling.bucket_totals(none, buckets=5), resampling.bucket_totals(none, buckets=5), 5)
    assert gains == [0] * 5


def test_trie_continues_crc_states():
    trie = resampling.Trie(3)
    text = resampling.words(b"One two three two THREE")
    for node in trie.paths(text, 0, 99):
        node.count += 1
    node = trie.root[b"two"][b"three"]
    assert node.crc == zlib.crc32(b"two three") and node.count == 1 + 1
    assert trie.root[b"one"][b"two"][b"three"].crc == zlib.crc32(b"one two three")


# secrets


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else (n := (len(body).bit_length() + 7) // 8, bytes([0x80 | n]) + len(body).to_bytes(n))[1]
    return bytes([tag]) + size + body


def whole(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1))


RNG = random.Random(5)
NUMBERS = [RNG.getrandbits(b) | 1 << b - 1 for b in (512, 17, 512, 256, 256, 256, 256, 256)]
RSA_OID, EC_OID = der(6, bytes.fromhex("2a864886f70d010101")), der(6, bytes.fromhex("2a8648ce3d0301"))
PKCS1 = der(0x30, whole(0), *map(whole, NUMBERS))
SEC1 = der(0x30, whole(1), der(4, RNG.randbytes(32)), der(0xA0, EC_OID), der(0xA1, der(3, b"\0" + RNG.randbytes(65))))
field = lambda x: struct.pack(">I", len(x)) + x
OPENSSH = secrets.MAGIC + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(field(b"ssh-ed25519") + field(RNG.randbytes(32))) + field(b"\1\2\3\4" * 2 + RNG.randbytes(120))
KEYS = {
    "pkcs1": PKCS1,
    "pkcs8": der(0x30, whole(0), der(0x30, RSA_OID, der(5)), der(4, PKCS1)),
    "pkcs8_encrypted": der(0x30, der(0x30, RSA_OID, der(0x30, der(4, b"salt"))), der(4, RNG.randbytes(200))),
    "sec1": SEC1,
    "dsa": der(0x30, whole(0), *map(whole, NUMBERS[:5])),
    "openssh": OPENSSH,
}
PUBLIC = der(0x30, der(0x30, RSA_OID, der(5)), der(3, b"\0" + der(0x30, whole(NUMBERS[0]), whole(65537))))
b64 = lambda x: base64.b64encode(x).decode()
url = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
lines = lambda x, end: end.join(x[i : i + 64] for i in range(0, len(x), 64))


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("form", ["plain", "lines", "escaped", "indented", "glued", "url", "hex", "HEX"])
def test_keys_are_found_where_they_are(kind, form):
    key = KEYS[kind]
    digits = {"url": url(key), "hex": key.hex(), "HEX": key.hex().upper()}.get(form, b64(key).rstrip("="))
    shown = {"lines": lines(digits, "\n"), "escaped": lines(digits, "\\n"), "indented": lines(digits, "\r\n    ")}.get(form, digits)
    ahead = "élan -----BEGIN X-----" + ("\\n" if form == "escaped" else "qq" if form == "glued" else "\n")
    text = ahead + shown + ("== the rest" if form == "glued" else "\n-----END X-----")
    found = [x[:3] for x in secrets.structures(text)]
    assert (len(ahead), len(ahead) + len(shown), kind) in found and len(found) == 1


def test_no_structure_no_report():
    spoilt = bytearray(PKCS1)
    spoilt[6] ^= 0x55  # the length of a nested number
    for data in (PUBLIC, bytes(spoilt), PKCS1[:-1], PKCS1 + b"", RNG.randbytes(300), OPENSSH[:-9], der(0x30, PUBLIC, PUBLIC)):
        if data != PKCS1:
            assert secrets.structures(f"x {b64(data)} y {data.hex()} z") == []
    rng = random.Random(2)
    noise = " ".join("".join(rng.choice("MIEABCabc0123+/") for _ in range(rng.randrange(300))) for _ in range(300))
    assert secrets.structures(noise) == []


def test_der_lengths_are_strict():
    assert secrets.element(b"\x30\x81\x05hello", 0, 8) is None and secrets.element(b"\x30\x80hello", 0, 7) is None
    assert secrets.element(b"\x30\x05hello", 0, 7) == (0x30, 2, 7) and secrets.element(b"\x30\x06hello", 0, 7) is None
    assert secrets.elements(b"\x02\x01\x01\x02", 0, 4) is None and secrets.elements(b"", 0, 0) == []


def test_signed_tokens():
    def token(head, body=b'{"sub":1}', size=32):
        return f"{url(head if isinstance(head, bytes) else json.dumps(head).encode())}.{url(body)}.{url(RNG.randbytes(size))}"

    good = [token({"alg": "HS256"}), token({"typ": "JWT", "alg": "RS256"}, size=256), token(b'{ "alg":"ES512" }', size=132), token({"alg": "EdDSA"}, size=64)]
    bad = [token({"alg": "none"}), token({"alg": "HS256"}, size=31), token({"alg": "RS256"}, size=64), token({"typ": "JWT"}), token({"alg": 5}), token({"alg": "HS256"}, b"[1]"), token(b'{"alg":"HS256"'), token(b"[" * 5000), "eyJhbGciOi.x.y"]
    assert [secrets.signed_token(*x.split(".")) for x in good] == ["HS256", "RS256", "ES512", "EdDSA"]
    assert not any(secrets.structures(f"a {x} b") for x in bad)
    text = f"Authorization: Bearer {good[0]}, token={good[1]}"
    at = text.index(good[1])
    assert [x[:3] for x in secrets.find(text)] == [(22, 22 + len(good[0]), "signed_token"), (at - 6, len(text), "assign"), (at, len(text), "signed_token")]


def plain_base(text):
    """Matches tried at every place, letter by letter."""
    out, at = [], 0
    run = lambda i, ok: next((j for j in range(i, len(text)) if text[j] not in ok), len(text))
    digits, upper, lower = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    while at < len(text):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            part = text[at : at + len(word)]
            if part.isascii() and part.lower() == word:
                i = at + len(word)
                i += text[i : i + 1] in ("'", '"') and len(text) > i
                i = run(i, " ")
                if text[i : i + 1] in (":", "=") and i < len(text):
                    i = run(i + 1, " ")
                    i += text[i : i + 1] in ("'", '"') and len(text) > i
                    j = run(i, digits + upper + lower + "+/_.=-")
                    if j > i:
                        if j - i >= 12:
                            out.append((at, j, "assign"))
                        at = j - 1
                        break
        at += 1
    for kind, head, ok, least in (("access", "AKIA", upper + digits, 18), ("hex", "", digits + "abcdef", 16)):
        at = 0
        while at < len(text):
            i = at + len(head)
            j = run(i, ok) if text.startswith(head, at) else i
            if j > i and text.startswith(head, at):
                if j - at >= least:
                    out.append((at, j, kind))
                at = j
            else:
                at += 1
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_base_spans_equal_plain_search():
    rng = random.Random(3)
    bits = ["password", "PassWd", "secret", "toKen", "ſecret", "toKen", "api_key", "APIkey", "=", ":", " ", "  ", '"', "'", "é", "\n", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "ABCDEF0123456789", "x.y-z_=/+", "ZZTOP", "12345", "f"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14)))
        assert [x[:3] for x in sorted(secrets.base_spans(text), key=lambda x: (x[0], secrets.KINDS.index(x[2])))] == plain_base(text), text


def test_secret_scan_of_a_table(spark, tmp_path):
    key = lines(b64(KEYS["pkcs8"]).rstrip("="), "\n")
    rows = [(1, "token = 'abcdefghijkl'"), (1, "token = 'abcdefghijkl'"), (2, None), (3, ""), (None, "AKIA" + "Z" * 14), (4, "é" * 70_000 + " passwd:" + "a" * 40), (5, f"secret: {key}\n.")]
    df = table(spark, rows)
    got = {(r.doc_id, r.spans): r for r in secrets.scan(df).collect()}
    assert len(got) == 6 and (2, "") in got and (None, "access:0:18") in got and (4, "assign:70001:70048,hex:70008:70048") in got
    assert got[2, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    five = next(r for r in got.values() if r.doc_id == 5)
    assert five.n_structures == 1 and five.spans == f"assign:0:72,pkcs8:8:{8 + len(key)}" and five.base_sha256 == hashlib.sha256(b"assign:0:72").hexdigest()
    found = {(r.doc_id, r.kind): r for r in secrets.findings(df).collect()}
    assert found[5, "pkcs8"].secret == key and found[5, "assign"].confirmed and not found[4, "assign"].confirmed
    assert secrets.scan(df.where("false")).collect() == []
    docs = spark.createDataFrame(rows[2:], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = {r[:4] + (r[4],) for r in con.sql(sql.SECRETS_BASE).fetchall() if r[0] is not None}
    assert want == {(r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan(docs.where("doc_id is not null")).collect()}


# filter audit


def plain_audit(rows, said):
    out, parts = [], {lang or "" for _, _, lang in rows}
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))

    def fails(d, t):
        t = t or ""
        w = [x for x in re.split("[ \t-\r]+", t) if x]
        flags = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t]}
        return {k for k, v in flags.items() if v}

    for part in parts:
        docs = [(fails(d, t), *said.get(d, (False, False))) for d, t, lang in rows if (lang or "") == part]
        steps, total = [], Counter()
        for order in itertools.permutations("ABCDE"):
            for i, k in enumerate(order):
                left = [x for x in docs if not x[0] & set(order[:i])]
                gone = [x for x in left if k in x[0]]
                total[k] += len(gone)
                steps.append((part, "".join(order), i + 1, len(left) - len(gone), len(gone), sum(k in x[0] for x in docs) - len(gone), sum(x[0] == {k} for x in docs), sum(x[1] for x in gone), sum(x[2] for x in gone), k))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return out


def test_audit_equals_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["aa", "Bb", "c#", "d", "é%"][: rng.randrange(1, 6)]) + str(rng.randrange(k)) for _ in range(rng.randrange(0, 400))) for k in (1, 50, 1000) for _ in range(8)] + ["\x0b".join(map(str, range(250))), None, "", "|"]
    rows = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(150)] + [(77, texts[0], "de")] * 3 + [(78, texts[0], "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 70, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    said = {}
    for d, q, t in labels:
        if d is not None:
            g = said.get(d, (False, False))
            said[d] = (g[0] or q == 1, g[1] or t == 1)
    df = table(spark, rows, "doc_id long, text string, lang string").drop("part")
    found = audit.audit(df, table(spark, labels, "doc_id long, quality int, toxic int").drop("good")).drop("filter")
    assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.collect())) == sorted(plain_audit(rows, said))
    assert audit.audit(df.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_audit_of_all_parts_and_other_filters(spark):
    rows = [(1, "a x", "p"), (2, "b", "q"), (3, "a b", "q"), (4, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts = audit.flag_counts(df, none, {"X": F.col("text").contains("a"), "Y": F.col("text").contains("b")})
    got = {(r.filter_order, r.step): r for r in audit.interactions(counts, "XY", whole=True).collect()}
    assert (got["XY", 1].removed, got["XY", 2].removed, got["YX", 1].removed, got["XY", 2].redundant, got["YX", 2].kept) == (2, 1, 2, 1, 1)
    assert got["XY", 1].shapley == 2 + 1 and {r.part for r in got.values()} == {"*"}
    assert len(audit.steps("ABCDE")) == 600 and sum(x[3] for x in audit.pairs("ABCDE") if x[0] == "C") == 120
