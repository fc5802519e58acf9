"""How the filters of a corpus interact, in every order they could be applied.

Every document gets one failure flag per filter. A SQL ``CUBE`` over the flags and
the part then counts, for each subset of filters, the documents that none of the
subset fails: the grouping-set rows whose selected flags are all false. What a
filter removes at a step of an order is the difference between two such subsets,
those before and after the step, so all orders are joins of pairs of subsets, and
the documents are read once however many orders there are.

The cube runs over rows that are summed up per combination of flags and part
beforehand; it is as large as the number of parts times ``3 ** filters``, whatever
the number of documents. Copies of a text, hot ones too, are counted per text
before they meet, and rows of a hot id are summed up before they meet its label.

Null texts count as empty, null parts as the empty string. A document without an id
has no smaller id and no label. Rows that repeat an id are documents each; a copy of
a text is one that a smaller id has, so rows that share the text's least id are none
of them copies. Ids with several labels are good, or toxic, if one label says so. An
empty table gives no rows. Columns other than the id, the text and the part are not
used and may have any names.
"""

from __future__ import annotations

from itertools import combinations, permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows without an id are dealt over so many keys.
SPREAD = 1024
MEASURES = ("n", "good", "toxic")


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that see one text only: few words, words
    that repeat, many capitals, and signs of markup."""
    words = word_list(text)
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 3 * F.char_length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flag_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None = None, part: str = "lang", text: str = "text") -> DataFrame:
    """``part, <flags>, n, good, toxic``: documents per combination of flags.

    ``filters`` are failure conditions over the text; ``copies`` names one more flag,
    of texts that a smaller ``doc_id`` has.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    flags = {f"fails_{k}": F.coalesce(c, F.lit(False)) for k, c in filters.items()}
    digest = F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest")
    # rows without an id match no label; their second key keeps them apart
    alone = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64(digest), F.lit(SPREAD))).otherwise(0).cast("int").alias("alone")
    keys = ["doc_id", "alone", "digest", "part", *flags]
    rows = docs.select("doc_id", alone, digest, F.coalesce(F.col(part), F.lit("")).alias("part"), *[c.alias(k) for k, c in flags.items()])
    rows = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    told = rows.join(said.withColumn("alone", F.lit(0)), ["doc_id", "alone"], "left").fillna(False, ["good", "toxic"])
    if copies is not None:
        told = _copies(told, copies, [*flags])
        flags[f"fails_{copies}"] = F.lit(None)
    sums = [F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")]
    return told.groupBy("part", *flags).agg(*sums)


def _copies(told: DataFrame, name: str, flags: list[str]) -> DataFrame:
    """Splits rows ``doc_id, digest, part, flags, good, toxic, n`` into originals and
    copies; ids are gone afterwards.

    Flags follow from the text, so a text has few combinations, and each keeps its
    least id with that id's count. Only these meet at the text.
    """
    same = ["digest", "part", *flags, "good", "toxic"]
    known = F.col("doc_id").isNotNull()
    # an id may stand in the rows of several parts, but once in each of them
    least = F.min(F.when(known, F.struct("doc_id", "n"))).alias("least")
    each = told.groupBy(*same).agg(F.sum("n").alias("all"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("nameless"), least)
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    kept = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    flag = lambda x, n: F.struct(F.lit(x).alias(f"fails_{name}"), n.alias("n"))
    split = each.withColumn("first", first).withColumn("kept", kept).select(*same[1:], F.inline(F.array(flag(False, F.col("kept")), flag(True, F.col("all") - F.col("kept")))))
    return split.where("n > 0")


def survivors(counts: DataFrame, names: str) -> DataFrame:
    """``part, whole, subset, n, good, toxic``: documents that no filter of the subset
    fails, by a cube over the flags and the part.

    ``subset`` has a bit for each filter, the first of ``names`` being the lowest.
    ``whole`` marks the rows of all parts together. Subsets without survivors have no
    row.
    """
    flags = [f"fails_{k}" for k in names]
    cube = counts.cube(*flags, "part").agg(*[F.sum(m).alias(m) for m in MEASURES], *[F.grouping(f).alias(f"rolled_{f}") for f in [*flags, "part"]])
    clean, subset = F.lit(True), F.lit(0)
    for i, f in enumerate(flags):
        clean = clean & ((F.col(f"rolled_{f}") == 1) | ~F.col(f))
        subset = subset + F.when(F.col(f"rolled_{f}") == 0, 1 << i).otherwise(0)
    return cube.where(clean).select("part", (F.col("rolled_part") == 1).alias("whole"), subset.alias("subset"), *MEASURES)


def steps(names: str) -> list[tuple[str, int, str, int]]:
    """``filter_order, step, filter, before`` of all orders; ``before`` is the subset of
    the filters ahead."""
    bit = {k: 1 << i for i, k in enumerate(names)}
    return [("".join(o), i + 1, k, sum(bit[x] for x in o[:i])) for o in permutations(names) for i, k in enumerate(o)]


def pairs(names: str) -> list[tuple[str, int, int, int, bool, bool]]:
    """``filter, before, after, orders, alone, last``: all subsets without and with a
    filter, the number of orders in which exactly ``before`` stands ahead of it, and
    whether that is none of the others, or all."""
    out = []
    for i, k in enumerate(names):
        rest = [1 << j for j in range(len(names)) if j != i]
        for size in range(len(rest) + 1):
            orders = factorial(size) * factorial(len(rest) - size)
            out += [(k, sum(x), sum(x) | 1 << i, orders, not size, size == len(rest)) for x in combinations(rest, size)]
    return out


def interactions(counts: DataFrame, names: str, whole: bool = False) -> DataFrame:
    """``part, filter_order, step, filter, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley`` for every part and step of every order.

    ``counts`` is as :func:`flag_counts` has it, ``names`` has a letter for each
    filter. ``shapley`` is what a filter removes summed over all orders, so over
    filters it adds up to the number of orders times the documents removed in all.
    With ``whole`` the rows are those of all parts together, under the part ``*``.
    """
    spark = counts.sparkSession
    found = survivors(counts, names).where(F.col("whole") == F.lit(whole)).withColumn("part", F.coalesce("part", F.lit("*"))).drop("whole")
    # subsets without survivors are counted too: as none
    none = found.where("subset = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1))).alias("subset"), *[F.lit(0).cast("long").alias(m) for m in MEASURES])
    found = cut(found.unionByName(none).groupBy("part", "subset").agg(*[F.sum(m).alias(m) for m in MEASURES]), "audit")
    two = spark.createDataFrame(pairs(names), "filter string, before int, after int, orders long, alone boolean, last boolean")
    ahead = found.select("part", F.col("subset").alias("before"), *[F.col(m).alias(f"{m}_before") for m in MEASURES])
    behind = found.withColumnRenamed("subset", "after")
    lost = [(F.col(f"{m}_before") - F.col(m)).alias(to) for m, to in zip(MEASURES, ("removed", "good_lost", "toxic_lost"), strict=True)]
    step = ahead.join(F.broadcast(two), "before").join(behind, ["part", "after"])
    step = step.select("part", "filter", "before", "orders", "alone", "last", F.col("n").alias("kept"), *lost)
    fails, unique = F.sum(F.when(F.col("alone"), F.col("removed"))), F.sum(F.when(F.col("last"), F.col("removed")))
    facts = step.groupBy("part", "filter").agg(fails.alias("fails"), unique.alias("unique_fails"), F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    order = spark.createDataFrame(steps(names), "filter_order string, step int, filter string, before int")
    out = step.join(F.broadcast(order), ["filter", "before"]).join(facts, ["part", "filter"])
    return out.select("part", "filter_order", "step", "filter", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`interactions` of the filters of :func:`text_filters` and E, copies of a
    text with a smaller ``doc_id``, per language."""
    counts = flag_counts(docs, labels, text_filters(F.coalesce(F.col("text"), F.lit(""))), copies="E")
    return interactions(cut(counts, "audit-flags"), "ABCDE")
