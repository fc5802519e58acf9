"""Importance resampling towards a target distribution of hashed word n-grams.

Every task keeps tries of words: a node stands for a run of words and holds how often
it came up and the state of the CRC of its text, from which the state of a longer run
continues. Tasks turn their tries into totals per bucket, which Spark adds up; so
much is small, as buckets are given in number. The gain of a bucket follows from the
totals of the corpus and of the target. A second pass walks tries whose nodes have the
gains of their buckets attached, and a document's weight is the sum along its paths.
Scores add noise that follows from the id, so the highest ones are a sample without
replacement, drawn in proportion to the weights.

A trie is emptied into its totals when it holds ``NODES`` nodes, so a task's memory
is bounded whatever its words; nothing is lost by that. Documents are ranked over
sampled ranges of all scores.

Words are letters a to z (A to Z count as such), digits and everything beyond ASCII;
null texts and texts without a word have no features and weight 0. A null id is the
empty string to the noise, and comes first among equal scores. Repeated rows are
documents like others. An empty table gives an empty result; an empty target is one
without features. Columns other than the id and the text are not used and may have
any names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import running_total
from ..storage import cut

#: Nodes that a task's trie may have.
NODES = 250_000
#: Words of a text that are followed between two looks at the number of nodes.
SLICE = 50_000
BUCKETS = 10_000
#: Bytes of words: lower-cased a to z, digits, beyond ASCII; all else ends a word.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class Node(dict):
    """A run of words; the longer ones that start with it are its items.

    ``crc`` is the CRC state of its words joined by spaces, ``count`` how often it
    came up, ``gain`` that of its bucket.
    """

    __slots__ = ("count", "crc", "gain", "trie")

    def __init__(self, trie: Trie, crc: int):
        self.trie, self.crc, self.count = trie, crc, 0
        self.gain = trie.gains[crc % len(trie.gains)] if trie.gains is not None else 0

    def __missing__(self, word: bytes) -> Node:
        trie = self.trie
        trie.size += 1
        child = self[word] = Node(trie, zlib.crc32(word) if self is trie.root else zlib.crc32(word, zlib.crc32(b" ", self.crc)))
        return child


class Trie:
    """The runs of up to ``longest`` words that a task has seen.

    Nodes have gains attached if ``gains`` has one for each bucket.
    """

    def __init__(self, longest: int, gains: list[int] | None = None):
        self.longest, self.gains = longest, gains
        self.clear()

    def clear(self) -> None:
        self.size = 0
        self.root = Node(self, 0)

    def paths(self, text: list[bytes], start: int, stop: int) -> Iterator[Node]:
        """The nodes of all runs that start within this range of words."""
        if self.longest == 1:
            yield from map(self.root.__getitem__, text[start:stop])
            return
        for i in range(start, min(stop, len(text))):
            node = self.root
            for word in text[i : i + self.longest]:
                node = node[word]
                yield node

    def totals(self, into: np.ndarray) -> None:
        """Adds the counts of all nodes to their buckets."""
        left = [self.root]
        while left:
            for child in left.pop().values():
                into[child.crc % len(into)] += child.count
                if child:
                    left.append(child)


def n_features(n_words: int, longest: int) -> int:
    return sum(max(0, n_words - k) for k in range(longest))


def bucket_totals(docs: DataFrame, longest: int = 1, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """``bucket, n``: features of the whole texts per bucket, without empty ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, sums = Trie(longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for x in batch.column(0):
                found = words(x.as_py())
                for at in range(0, len(found), SLICE):
                    for node in trie.paths(found, at, at + SLICE):
                        node.count += 1
                    if trie.size > NODES:
                        trie.totals(sums)
                        trie.clear()
        trie.totals(sums)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    parts = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """1000 times the log of how much likelier each bucket is in the target, rounded
    down; every bucket counts one more feature than it has. Both tables have at most
    ``buckets`` rows."""
    s, t = ({r.bucket: r.n for r in x.collect()} for x in (corpus, target))
    all_s, all_t = (float(sum(x.values()) + buckets) for x in (s, t))
    return [math.floor(1000 * math.log((t.get(b, 0) + 1.0) * all_s / ((s.get(b, 0) + 1.0) * all_t))) for b in range(buckets)]


def weights(text: Column, gains: list[int], longest: int = 1) -> Column:
    """``struct<n_words, n_features, weight>`` of whole texts."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def walk(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = Trie(longest, gains)
        for texts in batches:
            rows = []
            for x in texts:
                found, total = words(x), 0
                for at in range(0, len(found), SLICE):
                    total += sum([node.gain for node in trie.paths(found, at, at + SLICE)])
                    if trie.size > NODES:
                        trie.clear()
                rows.append((len(found), n_features(len(found), longest), total))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"], dtype="int64")

    return walk(text.cast("binary"))


def noise(doc_id: Column, seed: int) -> Column:
    """-1000 times the log of an exponential variate that follows from the id, rounded
    down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds ``rank`` to ``doc_id, n_words, score, ...``: 1, 2, 3 ... for the highest
    scores among documents of ``least_words`` and more, that share of them, smaller ids
    first among equal scores; null for the others."""
    ranked = scored.withColumns({"__out": F.col("n_words") < least_words, "__low": -F.col("score"), "__tie": F.monotonically_increasing_id(), "__one": F.lit(1).cast("long")})
    ranked, seen = cut(ranked, "scored", n=F.count_if(~F.col("__out")))
    full = running_total(ranked, ["__out", "__low", "doc_id", "__tie"], "__one", "rank")
    drawn = ~F.col("__out") & (F.col("rank") <= F.lit(seen["n"] * percent // 100))
    return full.withColumn("rank", F.when(drawn, F.col("rank"))).drop("__out", "__low", "__tie", "__one")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; those
    with a rank are the sample."""
    docs = docs.select("doc_id", "text")
    gains = bucket_gains(bucket_totals(docs, longest, buckets), bucket_totals(target, longest, buckets), buckets)
    scored = docs.select("doc_id", weights(F.col("text"), gains, longest).alias("w")).select("doc_id", "w.*")
    return draw(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), percent, least_words)
