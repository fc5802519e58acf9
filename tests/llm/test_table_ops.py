"""Fingerprints, embeddings, near-duplicates, URLs, chat, sharding."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fjordgraph.llm import chat, embeddings, merkle, minhash, sharding, urls

from .. import plain

def doc_table(spark, rows):
    clashing = {"key": F.lit("x"), "bucket": F.lit(1), "component": F.lit(None).cast("string"), "th": F.lit("y")}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(clashing)


# fingerprints


def test_merkle_neighbours_and_edits(spark):
    rng = random.Random(1)
    rows = [(i * 37 if i % 3 else i * 1000, "\n".join("é" * rng.randrange(0, 9) + f" {k} {i}." for k in range(rng.randrange(0, 12)))) for i in range(1, 150)]
    rows += [(7, None), (-5, ""), (70_000_000_000, "long " * 40_000)]
    rows = list({d: (d, t) for d, t in rows}.values())
    got = {r.doc_id: r for r in merkle.compare_with_edits(doc_table(spark, rows)).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        e = t[: len(t) - k] + nxt[:k]
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (t == e)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.first_section is None) == (t == e)
    assert merkle.compare_with_edits(doc_table(spark, [])).collect() == []
    one = merkle.compare_with_edits(doc_table(spark, [(1, "abc")])).first()
    assert one.near_next == 1.0
    twice = merkle.compare_with_edits(doc_table(spark, [(1, "abc"), (1, "abc"), (None, "x"), (None, None)])).collect()
    assert len(twice) == 4 and len({r.fingerprint for r in twice if r.doc_id == 1}) == 1


def plain_tree(text):
    """Fingerprint and multiset of nodes, piece by piece with hashlib."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def pieces(x, ends):
        out, at = [], 0
        for i in range(1, len(x) + 1):
            if ends(x, i):
                out.append(x[at:i])
                at = i
        return [*out, x[at:]]

    def no_blanks(c):
        script = "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u3000" <= c <= "\u9fff"
        return script and ord(c) % 64 < 8

    found = Counter()

    def node(level, children):
        h = sha("/".join(children))
        found[level, h] += 1
        return h

    sections = []
    for s in pieces(text, lambda x, i: x[i - 2 : i] == "\n\n" and i > 1 and x[i : i + 1] != "\n"):
        paragraphs = []
        for p in pieces(s, lambda x, i: x[i - 1] == "\n"):
            leaves = [sha(q) for q in pieces(p, lambda x, i: i > 1 and x[i - 1] == " " and x[i - 2] in ".!?,;:|ea" or no_blanks(x[i - 1]))]
            found.update(("leaf", h) for h in leaves)
            paragraphs.append(node("paragraph", leaves))
        sections.append(node("section", paragraphs))
    return node("root", sections), found


def test_merkle_equals_plain_tree(spark):
    rng = random.Random(9)
    texts = ["", "a\n\nb", "a\n \nb", "a\n\n\nb", "\n\na\n", "a. b", "a.b", "a.  b", "one. two. three.", "three. one. one. two.", "no marks in this", "\u0001e \u0001\n", "é𝄞e ß", "a\r\n\r\nb", "x" * 300_000 + " e " * 2000]
    texts += ["".join(chr(rng.choice([rng.randrange(0x3000, 0xA100), rng.randrange(0xDC0, 0x1120), rng.randrange(0x1770, 0x1810), 10, 32])) for _ in range(80)) for _ in range(40)]
    texts += ["".join(rng.choice([" ", "\n", "\n\n", "a", "b. ", "é", "e ", "\t", "? "]) for _ in range(rng.randrange(40))) for _ in range(250)]
    data = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in merkle.compare_with_edits(doc_table(spark, data)).collect()}
    dice = lambda a, b: 2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))
    for i, t in data:
        nxt = texts[i - 1]
        k = len(t) // 3
        mine, edit, other = map(plain_tree, (t, t[: len(t) - k] + nxt[:k], nxt))
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (mine[0], edit[0])
        assert abs(r.near_edited - dice(mine[1], edit[1])) < 1e-12 and abs(r.near_next - dice(mine[1], other[1])) < 1e-12
        assert (r.near_next == 1) == (t == nxt)
    assert len({r.fingerprint for r in got.values()}) == len(set(texts))


def test_merkle_likeness_without_blanks(spark):
    """One character more, or a third of the text, changes the leaves about it only."""
    rng = random.Random(5)
    kana = [chr(c) for c in (*range(0x3041, 0x3094), *range(0x30A1, 0x30F7))] + [chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(300)] + ["、", "。"]
    for letters in (kana, [chr(c) for c in range(0x0E01, 0x0E2F)], [chr(c) for c in range(0x1000, 0x1022)]):
        text = "".join(rng.choice(letters) for _ in range(900))
        rows = [(2, text[:300] + letters[5] + text[300:]), (1, text)]
        near = {r.doc_id: r for r in merkle.compare_with_edits(doc_table(spark, rows)).collect()}
        assert near[2].near_next > 0.9 and 0.5 < near[1].near_edited < 1


def test_merkle_locates_edits(spark):
    a = [(1, "a\nb\n\nc\nd"), (2, "same"), (3, "x\n\ny\n\nz"), (4, "p\n\nq\n\nr"), (5, None)]
    b = [(1, "a\nb\n\nc\nD"), (2, "same"), (3, "new\n\nx\n\ny\n\nz"), (4, "q\n\np\n\nr"), (5, "")]
    rows = merkle.locate_edits(*(merkle.fingerprints(doc_table(spark, x)) for x in (a, b))).collect()
    got = sorted((r.doc_id, r.change, r.side, r.section, -1 if r.paragraph is None else r.paragraph) for r in rows)
    # an inserted section leaves those after it alone
    want = [(1, "gone", "a", 1, 1), (1, "new", "b", 1, 1), (3, "new", "b", 0, 0), (3, "new", "b", 0, 1), (3, "new", "b", 0, 2)]
    assert got == want + [(4, "moved", s, k, -1) for s in "ab" for k in (0, 1)]


# embeddings


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base, hub = rng.standard_normal((300, 16)), rng.standard_normal(16)
    rows = [(b, int(k % 3)) for k, b in enumerate(base)]
    rows += [(hub + 0.12 * rng.standard_normal(16) * (k % 7) / 6, 1) for k in range(700)] + [(hub.copy(), 1)] * 300
    rows += [(base[k] + 0.1 * rng.standard_normal(16), int(k % 3)) for k in range(100)] + [(base[5] * k, 2) for k in range(1, 9)]
    ids = rng.permutation(len(rows)).tolist()
    data = [(i, [float(np.float32(v)) for v in x], y) for i, (x, y) in zip(ids, rows, strict=True)]
    odd = [(5000, None, 1), (5001, [0.0] * 16, 1), (5002, [float("nan")] * 16, 1), (5003, [None] * 16, 1), (5004, data[0][1], None), (5005, [1.0, 2.0], 1), (5006, [1.0, 2.0], 1), (5007, [], 1), (5008, [float("inf")] + [0.0] * 15, 1)]
    df = spark.createDataFrame([(*r, "x") for r in data + odd], "vec_id long, embedding array<float>, label int, rep string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    x = np.array([r[1] for r in data])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([r[2] for r in data])
    near = (u @ u.T >= 0.98) & (y[:, None] == y[None, :])
    np.fill_diagonal(near, False)
    i = np.array([r[0] for r in data])
    comp = plain.components([(int(i[a]), int(i[b])) for a, b in zip(*np.nonzero(near), strict=True)], i.tolist())
    assert near.sum() > 100_000 and len(got) == len(data) + len(odd)
    for k, v in enumerate(i.tolist()):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (near[k].sum(), comp[v], comp[v] == v)
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (5000, 5001, 5002, 5003, 5004, 5007, 5008))
    assert (got[5005].n_links, got[5006].component_id) == (1, 5005)
    assert embeddings.near_duplicates(df.where("false")).collect() == []


def test_embedding_plan_keeps_recall():
    for typical in (1, 1000, 1e6, 1e9):
        bits, tables = embeddings.plan_tables(typical)
        p = (1 - np.arccos(0.98) / np.pi) ** bits
        assert (1 - p) ** tables <= 1e-5 * 1.01 and bits <= 24


# near-duplicates


def runs(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(rows):
    c = {i: runs(t) for i, t in rows}
    inv = defaultdict(list)
    for i, k in c.items():
        for g in k:
            inv[g].append(i)
    pairs = {(a, b) for v in inv.values() for a in v for b in v if a < b}
    ok = [(a, b) for a, b in pairs if sum((c[a] & c[b]).values()) >= 0.8 * sum((c[a] | c[b]).values())]
    return plain.components(ok, c)


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(2)
    off = []
    with np.errstate(over="ignore"):
        for k in range(120):
            a = rng.integers(0, 50, 150)
            b = np.concatenate([a[:110], rng.integers(0, 50, 40)])
            ca, cb = Counter(a.tolist()), Counter(b.tolist())
            sig = [minhash.bag_minhash(minhash._mix(np.array(sorted(c), np.uint64) + np.uint64(k << 20)), np.array([c[x] for x in sorted(c)])) for c in (ca, cb)]
            off.append((sig[0] == sig[1]).mean() - sum((ca & cb).values()) / sum((ca | cb).values()))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.05


@pytest.mark.parametrize("block", [256, 8])
def test_minhash_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    base = text(120)
    rows = [" ".join(text(rng.randrange(1, 60))) for _ in range(80)]
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append(" ".join(w))
    chain = text(100)
    for k in range(12):  # neighbours are near, the ends are not
        rows.append(" ".join(chain[k * 2 : k * 2 + 60]))
    rows += [rows[0], rows[0].upper() + "\n", "a b", "a  B", "one", "", None, None, "  \n", "z " * 9000, "z " * 9500, "passage " * 60 + " ".join(text(200))]
    data = list(enumerate(rows))
    random.Random(1).shuffle(data)
    df = doc_table(spark, data).repartition(5)
    got = {r.doc_id: r for r in minhash.near_duplicates(df).collect()}
    want = brute_classes(data)
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.class_id == i) for i, r in got.items())
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[want[i]] for i, r in got.items())
    left = minhash.drop_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))


def test_minhash_odd_ids(spark):
    """A class keeps one row, whatever its rows' ids repeat; texts without words all stay."""
    t = "one two three four five six"
    rows = [(None, t), (5, t), (5, t), (5, t + " "), (9, t), (None, None), (None, None), (3, " "), (2, "other words here and there now"), (None, "lone"), (None, "lone")]
    df = doc_table(spark, rows)
    got = [(str(r.doc_id), str(r.class_id), r.class_size) for r in minhash.near_duplicates(df).collect() if r.kept]
    assert sorted(got) == [("2", "2", 1), ("3", "3", 1), ("5", "5", 5), ("None", "None", 1), ("None", "None", 1), ("None", "None", 2)]
    left = [(r.doc_id, r.text) for r in minhash.drop_duplicates(df).collect()]
    want = [(2, rows[8][1]), (3, " "), (None, "lone"), (None, None), (None, None)]
    assert sorted(map(str, left)) in (sorted(map(str, [*want, (5, t)])), sorted(map(str, [*want, (5, t + " ")])))
    assert minhash.near_duplicates(doc_table(spark, [])).collect() == []
    assert minhash.drop_duplicates(doc_table(spark, [])).collect() == []


def test_long_texts_hash_in_pieces(monkeypatch):
    words = [f"w{i % 700}é" for i in range(5000)]
    whole = minhash.word_hashes(" ".join(words))
    monkeypatch.setattr(minhash, "PIECE", 64)
    assert (minhash.word_hashes(" ".join(words)) == whole).all() and len(whole) == 5000
    assert (minhash.word_hashes("x" * 1000 + "\n" + "y") == np.concatenate([minhash.word_hashes("x" * 1000), minhash.word_hashes("Y")])).all()


# urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "a.com", ""), ("allow", "x.a.com", "/ok")]


@pytest.mark.parametrize("inline", [64, 0])
def test_urls(spark, monkeypatch, inline):
    monkeypatch.setattr(urls, "INLINE_RULES", inline)
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://A.com/p", ""), (2, "https://b.net/q?utm_source=1#t", link("http://a.com/p")), (3, "http://c.net/", '<meta http-equiv="refresh" content="0; url=https://b.net/q">'),
        (4, "http://www.Example.org/es/1", None), (5, "http://u.example.org/en", None), (6, None, None), (7, "no scheme", None), (8, "http://x.a.com/ok/1", link("http://c.net")),
        (9, "http://d.net/z", link("http://e.net/z")), (10, "http://nota.com/", ""), (1, "http://A.com/p", ""), (11, "http://org", ""), (12, "http://c.net?x=1", ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")
    rows_out = urls.judge_pages(df, RULES).collect()
    got = {r.page_id: r for r in rows_out}
    assert len(rows_out) == len(rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.com", "/p", "a.com", "block")
    # 8 is explicitly allowed, and its component with it; 1 has its own rule
    assert got[2].verdict == got[3].verdict == "allow" and got[2].decided_by == "alias" and got[8].rule == "x.a.com/ok"
    assert (got[4].rule, got[4].verdict) == ("example.org/es/", "block") and (got[5].rule, got[5].verdict) == ("org/", "allow")
    assert all((got[k].host, got[k].path, got[k].rule, got[k].verdict) == ("", "", None, "allow") for k in (6, 7))
    assert got[10].rule is None and got[11].rule is None and got[12].host == "c.net" and got[12].path == ""
    without = {r.page_id: r.verdict for r in urls.judge_pages(df.where("page_id <> 8"), RULES).collect()}
    assert without[2] == without[3] == "block" and without[9] == "allow"
    assert urls.judge_pages(df.where("false"), RULES).collect() == []


def test_urls_relative_links(spark):
    at = "https://www.a.com/x/y.html?k=1"
    want = {
        "/en/2": "https://www.a.com/en/2", "//b.org/p": "https://b.org/p", "z.html#t": "https://www.a.com/x/z.html#t", "../q/./r": "https://www.a.com/q/r", "../../..": "https://www.a.com/",
        "?k=2": "https://www.a.com/x/y.html?k=2", "#top": at, "go?u=http://c.de/": "https://www.a.com/x/go?u=http://c.de/", "HTTP://d.fr/a/../b": "HTTP://d.fr/a/../b", "mailto:me@a.com": None, "": None,
    }
    df = spark.createDataFrame([(at, k) for k in want], "url string, target string")
    assert {r.target: r.to for r in df.withColumn("to", urls.resolve(F.col("url"), F.col("target"))).collect()} == want
    bare = spark.createDataFrame([("http://a.com", "p")], "url string, target string")
    assert bare.select(urls.resolve(F.col("url"), F.col("target"))).first()[0] == "http://a.com/p"
    pages = [
        (1, at, '<link rel=canonical href="/en/2">'), (2, "http://e.net/a/b", '<meta content="0;url=../c" http-equiv=refresh>'), (3, "http://f.net/", '<META HTTP-EQUIV="Refresh" content="1; URL=//g.net/h">'),
        (4, "http://h.net/i", '<base href="/deep/"><link href="j" rel="canonical">'), (5, "http://k.net/", '<meta name="url" content="url=/no"><link rel="canonical" href="javascript:void(0)">'), (6, None, '<link rel="canonical" href="/x">'),
    ]
    edges = {tuple(r) for r in urls.link_edges(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert edges == {("//a.com/x/y?k=1", "//a.com/en/2"), ("//e.net/a/b", "//e.net/c"), ("//f.net", "//g.net/h"), ("//h.net/i", "//h.net/deep/j")}


def test_urls_read_attributes_as_browsers_do(spark):
    at, to = "http://a.net/", "//b.net/p"
    link = {
        '<link data-href="http://no.net/" href="http://b.net/p" rel="canonical">': True,
        '<link rel="shortlink canonical" href="http://b.net/p">': True,
        "<LINK\n  HREF = 'http://b.net/p'\n  REL = CANONICAL />": True,
        '<link title="a > b" rel="canonical" href=" http://b.net/p ">': True,
        '<link rel="canonical" href="http://b.net/p" href="http://no.net/">': True,
        '<meta content="0; URL = \'http://b.net/p\'" http-equiv="Refresh">': True,
        '<meta http-equiv="refresh" content="5,http://b.net/p">': True,
        '<meta http-equiv=refresh content="0;url=http://b.net/p">': True,
        '<!-- <link rel="canonical" href="http://b.net/p"> -->': False,
        '<!-- open <link rel="canonical" href="http://b.net/p">': False,
        '<link title="rel=canonical" href="http://b.net/p">': False,
        '<link data-rel="canonical" href="http://b.net/p">': False,
        '<link rel="canonicals" href="http://b.net/p">': False,
        '<meta http-equiv="refresh" content="30">': False,
        '<meta http-equiv="refreshed" content="0;url=http://b.net/p">': False,
        '<linked rel="canonical" href="http://b.net/p">': False,
        '<link rel="canonical">': False,
        "<link " + "a='>' " * 3000 + 'rel="canonical" href="http://b.net/p">': True,
    }
    for html, tied in link.items():
        edges = [tuple(r) for r in urls.link_edges(spark.createDataFrame([(1, at, "<p>x</p>" + html + "<b>")], "page_id long, url string, html string")).collect()]
        assert edges == ([("//a.net", to)] if tied else []), html[:90]
    blank = spark.createDataFrame([(1, at, '<base href="/d/"><base href="/e/"><link rel="canonical" href="x y&amp;z">')], "page_id long, url string, html string")
    assert urls.link_edges(blank).collect() == [("//a.net", "//a.net/d/x y&z")]


# chat


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\s<\\|", "<", "|im_end|>\n", "", None, "é🙂\n\n", "\\r<|", "x" * 200_000]
    rng = random.Random(2)
    rows = [(c, k, rng.choice(["user", "assistant", "system", None, "we\nird<|"]), rng.choice(nasty)) for c in range(40) for k in range(rng.randrange(1, 7))]
    rows += [(50, None, "user", "a"), (50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (None, 0, "user", "x"), (None, 0, "assistant", "y"), (60, 0, "user", "only")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, target int")
    ex = chat.expand(df)
    got = [r for r in chat.read_back(ex).collect() if r.conv_id is not None]
    groups = defaultdict(list)
    for c, k, role, t in rows:
        if c is not None:
            groups[c].append((-1 if k is None else k, role or "", t or ""))
    assert len(got) == len(groups)
    for r in got:
        turns = sorted(groups[r.conv_id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(ex).where("conv_id is null").count() == 2
    for e in ex.where("target >= 0").collect():
        assert e.formatted.endswith(chat.END) and len(e.formatted) == e.loss_start + e.loss_length + len(chat.END)
    assert chat.expand(df.where("false")).collect() == []


# sharding


def test_all_links_of_a_page_count(spark):
    rows = [
        (1, "http://a.net/x", '<link rel=canonical href="http://b.net/1"><LINK REL="canonical" HREF="http://c.net/2?a=1&amp;b=2"><meta content="3; URL=//d.net/w&#38;z" http-equiv=refresh>'),
        (2, "http://c.net/2?b=2&a=1", None), (3, "http://d.net/w&z", ""), (4, "http://b.net/1", ""), (5, "http://c.net/2?a=1&amp;b=2", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge_pages(df, [("block", "b.net", "/")]).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
    assert urls.judge_pages(df.where("false"), RULES).collect() == []


def test_sharding(spark):
    rng = random.Random(6)
    rows = [(i, "é" * rng.randrange(0, 400)) for i in range(3000)] + [(None, None), (None, "a"), (7, "twice"), (7, "twice"), (9001, "x" * 60_000)]
    got = sharding.shard_documents(doc_table(spark, rows), 16).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert set(by) == set(range(16)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    loads = [sum(r.size for r in v) for v in by.values()]
    mean = sum(loads) / 16
    assert max(loads) <= max(1.02 * mean, 60_001 + mean * 0.02)
    moved = [r for r in got if r.next_shard != r.shard]
    assert moved and all(r.next_shard == 16 for r in moved)
    assert abs(sum(r.size for r in moved) / sum(loads) - 1 / 17) < 0.01
    assert sharding.shard_documents(doc_table(spark, []), 16).collect() == []


def plain_map(loads, n_shards, n_slots):
    """Heaviest slot first, each to the shard that is lightest so far."""
    owner, total = {}, [0] * n_shards
    for slot in sorted(range(n_slots), key=lambda k: -loads[k]):  # stable: by number among equals
        owner[slot] = total.index(min(total))
        total[owner[slot]] += loads[slot]
    return owner


def test_sharding_equals_brute_force(spark):
    import struct

    import xxhash

    rng = random.Random(8)
    rows = [(rng.randrange(1 << 40), "x" * int(rng.expovariate(0.01))) for _ in range(2500)]
    rows = list(dict(rows).items())
    got = {r.doc_id: r for r in sharding.shard_documents(doc_table(spark, rows), 5, 64).collect()}
    slot = {d: xxhash.xxh64(struct.pack("<q", d), seed=42).intdigest() % 64 for d, _ in rows}
    loads = Counter()
    for d, t in rows:
        loads[slot[d]] += len(t) + 1
    owner = plain_map(loads, 5, 64)
    places = defaultdict(list)
    for d, _ in sorted(rows, key=lambda r: (slot[r[0]], r[0])):
        places[owner[slot[d]]].append(d)
    assert all(got[d].virtual_slot == slot[d] and got[d].shard == owner[slot[d]] and places[owner[slot[d]]][got[d].slot] == d for d, _ in rows)


def test_hot_slots_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_ROWS", 50)
    rows = [(None, "same")] * 900 + [(4, "twice")] * 500 + [(i, "t" * (i % 30)) for i in range(1000)]
    df = doc_table(spark, rows).repartition(6)
    got = sharding.shard_documents(df, 4, 32).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in by.values())
    slotted = sharding.assign_slots(df, "doc_id", F.lit(1), 32).withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    assert max(r.rows for r in sharding._parts(sharding.cut(slotted, "t")).collect()) < 900


def test_shard_maps_are_kept(spark, tmp_path):
    """A stored map is used again, grows, shrinks and evens out; versions stay."""
    folder = str(tmp_path / "maps")
    rng = random.Random(2)
    rows = [(i, "y" * rng.randrange(300)) for i in range(2000)]
    df = doc_table(spark, rows)
    slotted = sharding.assign_slots(df, "doc_id", F.octet_length("text") + 1, 256)
    totals = sharding.slot_totals(slotted)
    assert sharding.save_map(sharding.build_map(spark, totals, 4, 256), folder) == 1
    first = {r.virtual_slot: r.shard for r in sharding.load_map(spark, folder).collect()}
    got = sharding.shard_documents(df.where("doc_id % 2 = 0"), 4, 256, folder).collect()
    assert all(r.shard == first[r.virtual_slot] and r.map_version == 1 for r in got)  # other rows, same map
    assert {r.next_shard for r in got if r.next_shard != r.shard} == {4} and sharding.versions(spark, folder) == {1: 4}
    expected = {r.virtual_slot: r.next_shard for r in sharding.shard_documents(df, 4, 256, folder).collect()}
    bigger = sharding.shard_documents(df, 5, 256, folder).collect()
    assert all(r.shard == expected[r.virtual_slot] and r.shard in (4, first[r.virtual_slot]) for r in bigger) and {r.shard for r in bigger} == set(range(5))
    grown = sharding.load_map(spark, folder)
    assert grown.first().version == 2 and grown.agg(F.max("shard")).first()[0] == 4 and sharding.versions(spark, folder) == {1: 4, 2: 5}
    # the newest of four shards still holds, whatever was written after it
    assert all(r.shard == first[r.virtual_slot] and r.map_version == 1 for r in sharding.shard_documents(df, 4, 256, folder).collect())
    shrunk = sharding.rebalance_map(spark, grown, 4, totals)
    assert sharding.save_map(shrunk, folder) == 3
    moved = sharding.compare_maps(grown, sharding.load_map(spark, folder, 3)).collect()
    assert moved and all(r.shard_to < 4 for r in moved) and {r.virtual_slot: r.shard for r in sharding.load_map(spark, folder, 1).collect()} == first
    # shard 0 swells: slots leave it, and none moves between the others without need
    heavy = totals.join(spark.createDataFrame(list(first.items()), "virtual_slot int, shard int"), "virtual_slot").withColumn("slot_bytes", F.when(F.col("shard") == 0, F.col("slot_bytes") * 3).otherwise(F.col("slot_bytes"))).drop("shard")
    even = sharding.rebalance_map(spark, sharding.load_map(spark, folder, 1), 4, heavy).collect()
    loads = Counter()
    for r in even:
        loads[r.shard] += r.slot_bytes
    assert max(loads.values()) < 1.05 * sum(loads.values()) / 4 and all(first[r.virtual_slot] == 0 for r in even if r.shard != first[r.virtual_slot])
    with pytest.raises(Exception, match="exists"):
        sharding.save_map(sharding.load_map(spark, folder, 1), folder)


def test_equal_runs_place_alike(spark, tmp_path):
    """An empty folder gets a first map; the second run moves nothing and writes nothing."""
    folder = str(tmp_path / "none" / "maps")
    rng = random.Random(4)
    df = doc_table(spark, [(i, "z" * rng.randrange(500)) for i in range(3000)] + [(None, None)] * 5)
    one = sharding.shard_documents(df, 16, 512, folder).collect()
    two = sharding.shard_documents(df, 16, folder=folder).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id, r.shard, r.slot)
    assert sorted(one, key=key) == sorted(two, key=key) and sharding.versions(spark, folder) == {1: 16}
    assert sharding.versions(spark, str(tmp_path / "nothing")) == {}


def test_shard_map_shrinks(spark):
    totals = spark.createDataFrame([(i, 100 + i, 1) for i in range(64)], "virtual_slot int, slot_bytes long, slot_rows long")
    one = sharding.build_map(spark, totals, 4, 64)
    two = sharding.rebalance_map(spark, one, 3)
    a, b = ({r.virtual_slot: r.shard for r in m.collect()} for m in (one, two))
    assert all(b[s] == a[s] for s in a if a[s] < 3) and set(b.values()) == {0, 1, 2} and two.first().version == 2
