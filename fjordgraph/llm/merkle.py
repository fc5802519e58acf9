r"""Document fingerprints: a Merkle tree over sections, paragraphs and phrases.

A text splits into sections after blank lines, a section into paragraphs after
line ends, a paragraph into phrases after a blank that follows one of ``MARKS``
(sentence marks, and two letters so that text without marks has phrases too). In scripts
that put no blanks between words a phrase ends after one of an eighth of their
characters, which a rule over code points picks, so it is the content that decides and
an edit moves no end but its own. Separators
stay with what they end: the phrases, one after another, are the text. Leaves
hash phrases, every other node hashes the hashes of its children in order, and
the root is the fingerprint, so two texts have equal roots exactly if they are
equal. Where roots differ, the branches that only one tree has locate the edit.
The likeness of two trees is the share of nodes that they have in common,
counted as often as they occur (Dice), from the leaves to the root; it is 1 for
equal texts only. Only built-in functions are used.

A null text counts as empty; an empty text has one empty phrase, so its root is
a constant. Texts of any length are hashed whole. Repeated rows each get a row,
an empty table gives an empty result; columns with the names of added ones are
replaced by :func:`fingerprints` and not used elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, drop

#: Ids that share a bucket when neighbours in doc_id order are sought.
BUCKET = 64
MARKS = ".!?,;:|ea"
#: Scripts without blanks (Thai and Lao, Burmese, Khmer, Chinese and Japanese) as ranges of
#: code points, and those of them that end a phrase: eight of every 64.
SCRIPTS = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0x9FFF))
ENDS = [(c, c + 7) for low, high in SCRIPTS for c in range(-(-low // 64) * 64, high, 64)]
_SECTION, _PARAGRAPH = r"(?<=\n\n)(?!\n)", r"(?<=\n)"


def _class(ranges: Iterable[tuple[int, int]]) -> str:
    return "[" + "".join(rf"\u{a:04X}-\u{b:04X}" for a, b in ranges) + "]"


_PHRASE = rf"(?<=[{MARKS}] )"
_SCRIPT, _EITHER = _class(SCRIPTS), rf"{_PHRASE}|(?<={_class(ENDS)})"


def _digest(children: Column) -> Column:
    return F.sha2(F.array_join(children, "/"), 256)


def tree(text: Column) -> Column:
    """Hashes of the phrases, by section and paragraph: three arrays deep."""
    # most paragraphs have none of the scripts, and the short pattern says the same there
    pieces = lambda p: F.when(p.rlike(_SCRIPT), F.split(p, _EITHER)).otherwise(F.split(p, _PHRASE))
    phrases = lambda p: F.transform(pieces(p), lambda x: F.sha2(x, 256))
    return F.transform(F.split(text, _SECTION), lambda s: F.transform(F.split(s, _PARAGRAPH), phrases))


def paragraph_hashes(t: Column) -> Column:
    """Of :func:`tree`, by section."""
    return F.transform(t, lambda s: F.transform(s, _digest))


def section_hashes(paragraphs: Column) -> Column:
    return F.transform(paragraphs, _digest)


def root(sections: Column) -> Column:
    return _digest(sections)


def nodes(t: Column, paragraphs: Column, sections: Column) -> Column:
    """64-bit names of all nodes of a tree, with repeats."""
    name = lambda level: lambda h: F.xxhash64(h, F.lit(level))
    levels = F.flatten(F.flatten(t)), F.flatten(paragraphs), sections, F.array(root(sections))
    return F.concat(*[F.transform(h, name(k)) for k, h in enumerate(levels)])


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two multisets of nodes, 0 to 1.

    Both are sorted into one array, their lowest bits telling them apart, and
    the differences in number of equal nodes add up in one pass.
    """
    both = F.sort_array(F.concat(F.transform(a, lambda x: x.bitwiseAND(F.lit(-2))), F.transform(b, lambda x: x.bitwiseOR(F.lit(1)))))

    def add(acc: Column, x: Column) -> Column:
        node, side = x.bitwiseAND(F.lit(-2)), x.bitwiseAND(F.lit(1)) * 2 - 1
        same = acc["node"] == node
        return F.struct(node.alias("node"), F.when(same, acc["more"] + side).otherwise(side).alias("more"), F.when(same, acc["off"]).otherwise(acc["off"] + F.abs(acc["more"])).alias("off"))

    zero = F.lit(0).cast("long")
    off = F.aggregate(both, F.struct(zero.alias("node"), zero.alias("more"), zero.alias("off")), add, lambda acc: acc["off"] + F.abs(acc["more"]))
    n = F.size(a) + F.size(b)
    return (n - off).cast("double") / n


def first_difference(a: Column, b: Column) -> Column:
    """Index of the first differing child, or null where the arrays agree."""
    both = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    at = F.array_position(both, F.lit(False))
    return F.when(at > 0, at - 1)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``merkle_tree`` (paragraph hashes by section), ``merkle_sections``
    and ``fingerprint``."""
    out = docs.withColumn("merkle_tree", paragraph_hashes(tree(F.coalesce(F.col(text), F.lit("")))))
    out = out.withColumn("merkle_sections", section_hashes(F.col("merkle_tree")))
    return out.withColumn("fingerprint", root(F.col("merkle_sections")))


def _unmatched(rows: DataFrame, key: str, at: list[str]) -> DataFrame:
    """Of ``key, side, hash`` and places, the rows that stand apart.

    The k-th branch with a hash on one side matches the k-th with it on the
    other; a match whose place among all matches differs has moved.
    """
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(key, "side", "hash").orderBy(*at)))
    paired = F.count(F.lit(1)).over(Window.partitionBy(key, "hash", "k")) == 2
    rows = rows.withColumn("paired", paired)
    rows = rows.withColumn("place", F.when(F.col("paired"), F.row_number().over(Window.partitionBy(key, "side", "paired").orderBy(*at))))
    same = Window.partitionBy(key, "hash", "k")
    moved = F.min("place").over(same) != F.max("place").over(same)
    rows = rows.withColumn("change", F.when(~F.col("paired"), F.when(F.col("side") == "a", "gone").otherwise("new")).when(moved, "moved"))
    return rows.where("change is not null").drop("k", "paired", "place")


def locate_edits(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """The branches in which documents with the same key differ.

    ``a`` and ``b`` come from :func:`fingerprints`, with unique keys. Branches
    are aligned by their hashes, so what stands after an insertion still
    matches. Returns key, ``change`` (``gone`` from a, ``new`` in b, ``moved``),
    ``side``, section, paragraph and hash. Documents with equal roots are dropped
    before anything is unfolded, and sections that match before their paragraphs
    are; a section that moved whole has a null paragraph.
    """
    cols = lambda d, s: d.select(key, *[F.col(c).alias(f"{s}_{c}") for c in ("merkle_tree", "merkle_sections", "fingerprint")])
    both = cols(a, "a").join(cols(b, "b"), key).where("a_fingerprint <> b_fingerprint")
    side = lambda s: both.select(key, F.lit(s).alias("side"), F.posexplode(F.arrays_zip(F.col(f"{s}_merkle_sections").alias("hash"), F.col(f"{s}_merkle_tree").alias("tree"))).alias("section", "x")).select(key, "side", "section", "x.hash", "x.tree")
    apart = _unmatched(side("a").unionByName(side("b")), key, ["section"])
    whole = apart.where("change = 'moved'").select(key, "change", "side", "section", F.lit(None).cast("int").alias("paragraph"), "hash")
    inner = apart.where("change <> 'moved'").select(key, "side", "section", F.posexplode("tree").alias("paragraph", "hash"))
    return _unmatched(inner, key, ["section", "paragraph"]).select(*whole.columns).unionByName(whole)


def _floor_div(x: Column, width: int) -> Column:
    """Exact for all 64-bit integers, unlike a division of doubles."""
    w = F.lit(width).cast("long")
    return F.call_function("div", x - F.pmod(x, w), w)


def next_bucket(ids: DataFrame, width: int = BUCKET) -> DataFrame:
    """(bucket) -> (bucket, below): the next lower bucket that has rows.

    Buckets are themselves bucketed, level by level, so that no task sees more
    than ``width`` of them; the last of a level asks the level above.
    """
    span = ids.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).first()
    least = span.lo or 0
    level = ids.select((F.col("bucket") - least).alias("bucket"))
    levels = []
    size = 1
    while True:
        w = Window.partitionBy("up").orderBy(F.col("bucket").desc())
        level = cut(level.withColumn("up", _floor_div(F.col("bucket"), width)).withColumn("below", F.lead("bucket").over(w)), "merkle-level")
        levels.append(level)
        size *= width
        if span.lo is None or (span.hi - least) // size == 0:
            break
        level = level.groupBy("up").agg(F.max("bucket").alias("top")).select(F.col("up").alias("bucket"), "top")
    found = None
    for lv in reversed(levels):
        if found is None:
            found = lv
            continue
        # of the group above: the highest bucket in the next lower group
        tops = lv.groupBy("up").agg(F.max("bucket").alias("next_top")).withColumnRenamed("up", "g")
        hop = found.select(F.col("bucket").alias("up"), F.col("below").alias("g")).join(tops, "g").select("up", "next_top")
        found = lv.join(hop, "up", "left").withColumn("below", F.coalesce("below", "next_top")).drop("next_top")
    out = cut(found.select((F.col("bucket") + least).alias("bucket"), (F.col("below") + least).alias("below")), "merkle-below")
    drop(*levels)
    return out


def with_next(docs: DataFrame, text: str = "text", width: int = BUCKET) -> DataFrame:
    """``doc_id, text, next_text``: the following document by descending doc_id.

    After the last comes the first; a lone document follows itself. Rows with a
    null id come last, in the order of a hash of their text; ties go by text.
    Texts cross the network once: within a bucket of ids a window finds the
    neighbour, and only the last row of each bucket, one in ``width``, is joined
    to the first row of the bucket below (both read from the same exchange).
    """
    slim = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    lo = docs.agg(F.min("doc_id").alias("lo")).first().lo
    base = (lo // width if lo is not None else 0) - 1
    # never null, so that no branch below filters its own copy of the exchange
    spread = F.lit(base) - F.xxhash64("text").bitwiseAND(F.lit((1 << 20) - 1))
    slim = slim.withColumn("bucket", F.coalesce(_floor_div(F.col("doc_id"), width), spread))
    below = next_bucket(slim.select("bucket").distinct(), width)
    top = below.agg(F.max("bucket").alias("hi")).first().hi
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = slim.withColumns({"next_text": F.lead("text").over(order), "place": F.row_number().over(order)})
    inner = rows.where("next_text is not null").select("doc_id", "text", "next_text")
    last = rows.where("next_text is null").select("doc_id", "text", "bucket")
    first = rows.where("place = 1").select(F.col("bucket").alias("below"), F.col("text").alias("next_text"))
    asks = last.join(below.select("bucket", F.coalesce("below", F.lit(top)).alias("below")), "bucket")
    return inner.unionByName(asks.join(first, "below").select("doc_id", "text", "next_text"))


def edited_text(text: Column, other: Column) -> Column:
    """``text`` with its last third replaced by the beginning of ``other``."""
    k = F.floor(F.char_length(text) / F.lit(3)).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - k), F.substring(other, F.lit(1), k))


def compare_with_edits(docs: DataFrame, width: int = BUCKET) -> DataFrame:
    """Fingerprints of each text, its edited form and its neighbour, compared.

    ``first_section, first_paragraph`` is the first differing branch of the two
    trees (null where the roots agree).
    """
    rows = with_next(docs, width=width).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    for n, c in (("a", "text"), ("b", "edited"), ("n", "next_text")):
        rows = rows.withColumn(f"t_{n}", tree(F.col(c)))
        rows = rows.withColumn(f"p_{n}", paragraph_hashes(F.col(f"t_{n}")))
        rows = rows.withColumn(f"s_{n}", section_hashes(F.col(f"p_{n}")))
        rows = rows.withColumn(f"n_{n}", nodes(*[F.col(f"{x}_{n}") for x in "tps"]))
    rows = rows.withColumn("first_section", first_difference(F.col("s_a"), F.col("s_b")))
    part = lambda p: F.coalesce(F.get(F.col(p), F.col("first_section").cast("int")), F.array().cast("array<string>"))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        root(F.col("s_a")).alias("fingerprint"),
        root(F.col("s_b")).alias("edited_fingerprint"),
        likeness(F.col("n_a"), F.col("n_b")).alias("near_edited"),
        likeness(F.col("n_a"), F.col("n_n")).alias("near_next"),
        "first_section",
        F.when(F.col("first_section").isNotNull(), first_difference(part("p_a"), part("p_b"))).alias("first_paragraph"),
    )
