"""MinHash near-duplicates by BagMinHash, banding and exact multiset overlap.

A document is the multiset of its runs of five words (lower case, split at ASCII
white space; texts of one to four words have one run of them all). BagMinHash
draws, for each distinct run, a Poisson process over its discretised weight: the
weight axis is cut into the blocks [0,1), [1,2), [2,4), [4,8), ..., each with a
process of its own whose rate is its length, and a run of weight w takes part
with the points that lie below w. Points fall on random components; each
component keeps its earliest point, and drawing stops where no component can
change. Two components agree with the probability of the weighted Jaccard
similarity. Signatures are banded, and colliding documents are verified exactly.

Texts of equal words are one class from the start. Collisions tie each class to
the least of its bucket only; the connected components of these ties are the
groups that need checking. A group is cut into blocks of bounded size and runs,
and every class is compared to the group's most central one, which is sent to
each block, and to those of its own block as far as they are not connected yet.
What is then still apart from the centre, in a group of several blocks, meets
the members of its buckets that are not connected to it, again in blocks: a pair
that shares no bucket is no candidate. So every candidate pair is connected or
verified, and no task holds more than a block and a chunk of rows.

Null, empty and blank texts have no runs, link with nothing and are all kept.
Rows that repeat an id and its text are copies like any others, so one row of a
class is kept: the least by id (null ids last), then by a hash of the text, then
by a number given to the row. An empty table gives an empty result. Texts are
read whole, a piece at a time. Columns other than the id and the text are not
used, and may have any names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import cut, drop

WORDS, THRESHOLD = 5, 0.8
#: Components, and rows of a band: a pair at 0.8 collides with p > 0.9997.
COMPONENTS, ROWS = 256, 7
BANDS = COMPONENTS // ROWS
#: Rows of a block, and runs of words, beyond which a group is split.
BLOCK, BLOCK_RUNS = 256, 1_000_000
#: Characters of a text that are hashed at a time.
PIECE = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_C = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F], _U)
_GOLD = _U(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []
_BLANK = re.compile(r"[ \t\n\v\f\r]")


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> _U(30))) * _C[0]
    x = (x ^ (x >> _U(27))) * _C[1]
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.full(size, _U(x), _U)) for x in (_P, _INV)]
    return _POWERS[0], _POWERS[1]


def _words_of(raw: np.ndarray) -> np.ndarray:
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([1], blank.view(np.int8), [1]))))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, _U)
    up, down = _powers(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)])))
    return _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words: polynomials over their bytes, by prefix sums.

    Long texts are hashed in pieces that end at a blank, so the sums take memory
    for a piece (or a longer single word) only.
    """
    low = text.lower()
    out, at = [], 0
    while at < len(low):
        stop = _BLANK.search(low, at + PIECE)
        end = stop.end() if stop else len(low)
        out.append(_words_of(np.frombuffer(low[at:end].encode("utf-8", "surrogatepass"), np.uint8)))
        at = end
    return np.concatenate(out) if len(out) > 1 else out[0] if out else np.empty(0, _U)


def runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the runs of five words, and their counts."""
    n = len(words)
    if not n:
        return np.empty(0, _U), np.empty(0, np.int64)
    if n < WORDS:
        return _mix((words * _C[:n]).sum(keepdims=True) + _U(n)), np.ones(1, np.int64)
    m = n - WORDS + 1
    h = words[:m] * _C[0]
    for k in range(1, WORDS):
        h = h + words[k : k + m] * _C[k]
    return np.unique(_mix(h), return_counts=True)


def bag_minhash(items: np.ndarray, counts: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """Earliest point of each component: a weighted-Jaccard signature."""
    sig = np.full(m, np.inf)
    if not len(items):
        return sig
    keys, rate, low, top = [items], [np.ones(len(items))], [np.zeros(len(items))], [counts.astype(float)]
    level, length = 1, 1
    while (more := counts > length).any():
        keys.append(items[more])
        rate.append(np.full(more.sum(), float(length)))
        low.append(np.full(more.sum(), float(length)))
        top.append(counts[more].astype(float))
        items, counts = items[more], counts[more]
        level, length = level + 1, length * 2
    levels = np.repeat(np.arange(len(keys), dtype=_U), [len(k) for k in keys])
    key = _mix(np.concatenate(keys) + _GOLD * (levels + _U(1)))
    rate, low, top = np.concatenate(rate), np.concatenate(low), np.concatenate(top)
    at = np.zeros(len(key))
    drawn, missing = 0, m
    while len(key):
        most = sig.max()
        if most == np.inf:  # as many points as should leave no component empty
            draws = max(1, math.ceil(m * (math.log(max(missing, 1)) + 2.0) / rate.sum()))
        else:  # as many as should take every process past the last component
            need = float(((most - at) * rate).max())
            draws = math.ceil(need + 2 * math.sqrt(need) + 1)
        j = np.arange(drawn + 1, drawn + draws + 1, dtype=_U)
        u = _mix(key[:, None] + j[None, :] * _GOLD)
        gap = -np.log(((u >> _U(11)).astype(float) + 0.5) * 2.0**-53) / rate[:, None]
        gap[:, 0] += at
        x = np.cumsum(gap, axis=1)
        v = _mix(u ^ _C[2])
        part = (v & _U(m - 1)).astype(np.int64)
        place = low[:, None] + rate[:, None] * ((v >> _U(11)).astype(float) * 2.0**-53)
        use = place < top[:, None]
        np.minimum.at(sig, part[use], x[use])
        most = sig.max()
        missing = int(np.isinf(sig).sum()) if most == np.inf else 0
        live = x[:, -1] <= most
        key, rate, low, top, at = key[live], rate[live], low[live], top[live], x[live, -1]
        drawn += draws
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """One 64-bit hash per band, with the band's number in it."""
    bits = sig[: BANDS * ROWS].view(_U).reshape(BANDS, ROWS)
    h = np.arange(1, BANDS + 1, dtype=_U) * _GOLD
    for k in range(ROWS):
        h = _mix(h ^ bits[:, k]) + _C[k % 5]
    return h.view(np.int64)


def signed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, th, key, total, bands``; key is null where there are no words.

    ``key`` is a digest of the words, ``th`` a hash of the text as it is.
    """
    names, types = ["doc_id", "th", "key", "total", "bands"], [None, pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, np.ndarray] = {}
        with np.errstate(over="ignore"):
            for batch in batches:
                keys, totals, sigs = [], [], []
                for x in batch.column(2).to_pylist():
                    words = word_hashes(x) if x else ()
                    if not len(words):
                        keys.append(None), totals.append(0), sigs.append(None)
                        continue
                    key = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
                    if key not in seen:
                        if len(seen) > 2000:
                            seen.clear()
                        seen[key] = bands(bag_minhash(*runs(words)))
                    keys.append(key), totals.append(max(1, len(words) - WORDS + 1)), sigs.append(seen[key])
                arrays = [batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip((keys, totals, sigs), types[2:], strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    thin = docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    return thin.mapInArrow(run, f"doc_id {kind}, th long, key binary, total long, bands array<long>")


class Overlaps:
    """Runs of a task's texts, for one-against-all weighted Jaccard."""

    def __init__(self, texts: list[str]):
        with np.errstate(over="ignore"):
            each = [runs(word_hashes(t)) for t in texts]
        items, self.code = np.unique(np.concatenate([h for h, _ in each]), return_inverse=True)
        self.count = np.concatenate([c for _, c in each])
        self.start = np.concatenate(([0], np.cumsum([len(h) for h, _ in each])))
        self.total = np.add.reduceat(self.count, self.start[:-1])
        self.weight = np.zeros(len(items), np.int64)

    def against(self, k: int) -> np.ndarray:
        """Similarity of text ``k`` to every text."""
        own = slice(self.start[k], self.start[k + 1])
        self.weight[self.code[own]] = self.count[own]
        both = np.add.reduceat(np.minimum(self.weight[self.code], self.count), self.start[:-1])
        self.weight[self.code[own]] = 0
        return both / (self.total + self.total[k] - both)


def _find(root: list[int], k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


_INNER = "key binary, cls binary, asks boolean"
_OUTER = "a binary, b binary"


def _table(rows: list[tuple], **types: pa.DataType) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ((),) * len(types)
    return pa.table({n: pa.array(c, t) for (n, t), c in zip(types.items(), columns, strict=True)})


def _within(threshold: float):
    """One block of a group and the group's centre: the members' classes so far,
    and whether they must ask further. The centre itself, in every block, is in
    no row."""

    def run(group: pa.Table) -> pa.Table:
        rows = {}
        for key, text, centre, blocks in zip(*(group.column(c).to_pylist() for c in ("key", "text", "is_centre", "blocks")), strict=True):
            rows[key] = (centre, text, blocks)
        # the centre first, then by key, so that a rerun gives the same
        keys = sorted(rows, key=lambda k: (not rows[k][0], k))
        over = Overlaps([rows[k][1] for k in keys])
        root = list(range(len(keys)))
        first = True
        for k in range(len(keys)):
            if not first and _find(root, k) == _find(root, 0):
                continue
            for other in np.flatnonzero(over.against(k) >= threshold):
                a, b = _find(root, k), _find(root, int(other))
                root[max(a, b)] = min(a, b)
            first = False
        out = [(key, keys[_find(root, k)], _find(root, k) != _find(root, 0) and rows[key][2] > 1) for k, key in enumerate(keys) if k]
        return _table(out, key=pa.binary(), cls=pa.binary(), asks=pa.bool_())

    return run


def _across(threshold: float):
    """A chunk of asking rows against a block of their bucket: links of classes."""

    def run(group: pa.Table) -> pa.Table:
        asks, others = {}, {}
        for key, text, side, cls in zip(*(group.column(c).to_pylist() for c in ("key", "text", "asks", "cls")), strict=True):
            (asks if side else others)[key] = (text, cls)
        found = set()
        if asks and others:
            keys = sorted(asks), sorted(others)
            over = Overlaps([asks[k][0] for k in keys[0]] + [others[k][0] for k in keys[1]])
            cls = [others[k][1] for k in keys[1]]
            for k, key in enumerate(keys[0]):
                own = asks[key][1]
                if any(c != own and (own, c) not in found for c in cls):
                    found |= {(own, cls[j]) for j in np.flatnonzero(over.against(k)[len(asks) :] >= threshold) if cls[j] != own}
        return _table(sorted(found), a=pa.binary(), b=pa.binary())

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without the rows whose key is that of the row before."""
    last = None
    for batch in batches:
        keys = batch.column(0).to_pylist()
        keep = [k != before for k, before in zip(keys, [last, *keys], strict=False)]
        last = keys[-1] if keys else last
        yield batch.filter(pa.array(keep))


def _groups(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of the groups tied by buckets (``key, first, copies, total,
    component, ties``), and the buckets that tie them (``bucket, n, low``)."""
    seats = classes.select("key", F.explode("bands").alias("bucket"))
    crowds = cut(seats.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low")).where("n > 1"), "mh-crowds")
    ties = cut(seats.join(crowds, "bucket").groupBy("key", "low").agg(F.sum("n").alias("n")), "mh-ties")
    groups = connected_components(ties.where("key <> low"), "key", "low")
    central = ties.groupBy("key").agg(F.sum("n").alias("ties"))
    members = classes.select("key", "first", "copies", "total").join(groups.withColumnRenamed("id", "key"), "key").join(central, "key")
    members = cut(members, "mh-members")
    drop(ties, groups)
    return members, crowds


def _texts(members: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``key, component, blocks, block, is_centre, text`` of all members."""
    stats = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("runs"), F.max(F.struct("ties", "key")).alias("c"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("runs") / BLOCK_RUNS)).cast("int")
    stats = cut(stats.select("component", blocks.alias("blocks"), F.col("c.key").alias("centre")), "mh-groups")
    seated = members.select("key", "first", "component").join(stats, "component").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    seated = seated.select("key", "component", "blocks", "block", (F.col("key") == F.col("centre")).alias("is_centre"), F.col("first.doc_id").alias("m_id"), F.col("first.th").alias("m_th"))
    bodies = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64(text).alias("d_th"), F.col(text).alias("text"))
    found = seated.join(bodies, (F.col("m_th") == F.col("d_th")) & F.col("m_id").eqNullSafe(F.col("d_id"))).drop("m_id", "m_th", "d_id", "d_th")
    out = cut(found.mapInArrow(_once, found.schema), "mh-texts")
    drop(stats)
    return out


def _ask(classes: DataFrame, texts: DataFrame, inner: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b`` of classes, found between asking rows and their buckets."""
    wide = texts.where("blocks > 1").select("key", "text").join(inner, "key", "left")
    wide = cut(wide.select("key", "text", F.coalesce("cls", "key").alias("cls"), F.coalesce("asks", F.lit(False)).alias("asks")), "mh-wide")
    seats = wide.select("key", "cls", "asks").join(classes.select("key", "total", "bands"), "key")
    seats = cut(seats.select("key", "cls", "asks", "total", F.explode("bands").alias("bucket")), "mh-seats")
    parts = lambda n, runs: F.greatest(F.ceil(n / BLOCK), F.ceil(runs / BLOCK_RUNS)).cast("int")
    asking = F.when(F.col("asks"), F.col("total"))
    mixed = seats.groupBy("bucket").agg(parts(F.count(F.lit(1)), F.sum("total")).alias("blocks"), parts(F.count(asking), F.sum(asking)).alias("chunks"), F.min("cls").alias("lo"), F.max("cls").alias("hi"))
    mixed = cut(mixed.where("chunks > 0 and lo <> hi").select("bucket", "blocks", "chunks"), "mh-mixed")
    met = seats.join(mixed, "bucket").withColumns({"block": F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), "chunk": F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")).cast("int")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    targets = met.select("bucket", "key", "cls", F.lit(False).alias("asks"), "block", every("chunks").alias("chunk"))
    askers = met.where("asks").select("bucket", "key", "cls", F.lit(True).alias("asks"), every("blocks").alias("block"), "chunk")
    both = cut(targets.unionByName(askers), "mh-meet")
    out = cut(both.join(wide.select("key", "text"), "key").groupBy("bucket", "block", "chunk").applyInArrow(_across(threshold), _OUTER).distinct(), "mh-links")
    drop(wide, seats, mixed, both)
    return out


def _told(docs: DataFrame, threshold: float, text: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and of each distinct wording its class's first row and size."""
    rows = cut(signed(docs, text).withColumn("row", F.monotonically_increasing_id()), "mh-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "row")).alias("first")
    classes = cut(rows.where("key is not null").groupBy("key").agg(first, F.count(F.lit(1)).alias("copies"), F.first("total").alias("total"), F.first("bands").alias("bands")), "mh-classes")
    members, crowds = _groups(classes)
    texts = _texts(members, docs, text)
    # the centre goes to every block of its group
    to = F.explode(F.when(F.col("is_centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
    sent = texts.select("key", "component", "blocks", "is_centre", "text", to.alias("to"))
    inner, seen = cut(sent.groupBy("component", "to").applyInArrow(_within(threshold), _INNER), "mh-inner", asks=F.count_if("asks"))
    owned = members.select("key", "first", "copies").join(inner.select("key", "cls"), "key", "left").withColumn("cls", F.coalesce("cls", "key"))
    links = merged = None
    if seen["asks"]:
        links = _ask(classes, texts, inner, threshold)
        merged = connected_components(links, "a", "b")
        owned = owned.join(merged.select(F.col("id").alias("cls"), "component"), "cls", "left").withColumn("cls", F.coalesce("component", "cls")).drop("component")
    owned = cut(owned, "mh-owned")
    drop(texts, members, crowds, inner, links, merged)
    sizes = cut(owned.groupBy("cls").agg(F.min("first").alias("c_first"), F.sum("copies").alias("c_size")), "mh-sizes")
    told = owned.join(sizes, "cls").select("key", "c_first", "c_size")
    named = classes.select("key", "first", "copies").join(told, "key", "left")
    named = cut(named.select("key", F.coalesce("c_first", "first").alias("first"), F.coalesce("c_size", "copies").alias("class_size")), "mh-named")
    drop(classes, owned, sizes)
    return rows, named


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``doc_id, th, row, class_id, class_size, kept`` per row.

    ``class_id`` is the least doc_id of the class, ``kept`` marks the one row of
    it that stays, ``th`` is a hash of the text and ``row`` numbers the rows.
    """
    rows, named = _told(docs, threshold, text)
    whole = rows.where("key is not null").join(named, "key")
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "row")
    with_words = whole.select("doc_id", "th", "row", F.col("first.doc_id").alias("class_id"), "class_size", (own == F.col("first")).alias("kept"))
    alone = rows.where("key is null").select("doc_id", "th", "row", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return with_words.unionByName(alone)


def drop_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that stay: one of each class, and all without words.

    A kept id and text that several rows have is reduced to one of them; only
    such rows are grouped, by partial results.
    """
    rows, named = _told(docs, threshold, text)
    first = named.select(F.col("first.doc_id").alias("__mh_id"), F.col("first.th").alias("__mh_th")).withColumn("__mh_words", F.lit(True))
    again = rows.where("key is not null").groupBy(F.col("doc_id").alias("__mh_id"), F.col("th").alias("__mh_th")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select(F.col("__mh_id").alias("r_id"), F.col("__mh_th").alias("r_th"), F.lit(True).alias("__mh_again"))
    blank = rows.where("key is null").select(F.col("doc_id").alias("__mh_id"), F.col("th").alias("__mh_th"), F.lit(False).alias("__mh_words")).distinct()
    kept = first.unionByName(blank).distinct().join(again, (F.col("__mh_th") == F.col("r_th")) & F.col("__mh_id").eqNullSafe(F.col("r_id")), "left")
    kept = cut(kept.select("__mh_id", "__mh_th", (F.col("__mh_words") & F.coalesce("__mh_again", F.lit(False))).alias("__mh_again")), "mh-kept")
    same = F.col("doc_id").eqNullSafe(F.col("__mh_id")) & (F.xxhash64(text) == F.col("__mh_th"))
    found = docs.join(kept, same)
    one = found.where("__mh_again").dropDuplicates(["__mh_id", "__mh_th"])
    return found.where("not __mh_again").unionByName(one).select(*docs.columns)
