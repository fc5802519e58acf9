"""Language identification by words first, character n-grams otherwise.

A known word counts with its log frequency in each language. A word that the
training sample did not have backs off to its longest known character n-grams:
those of five characters, or if none is known of four, and so on down to one.
The language with the highest mean wins.

Frequencies are interpolated with those of all languages together, after Witten and
Bell: a language that has seen T different keys in N gives the share T / (N + T) to
the common frequencies. A language with little data so says about what all of them
say, and a key that it has not seen is no evidence for it. What is kept is the log of
the frequency over the common one, which is the same for all keys that a language has
not seen; so only the pairs of a key and a language that occur take up space.

The model is fitted on a sample of the labelled documents, the one thing that is
bounded: by ``MAX_TRAIN_DOCS`` documents and ``MAX_TRAIN_BYTES`` bytes in all, shared
equally by the languages, and at least one document of each language. Documents of
more than ``LONGEST`` bytes are drawn only if nothing else is in their language, and
rows with the same id and text count once in the sample. A language without a word in
the sample is not in the model.

Null texts and texts without a letter are ``und`` with score 0; nothing else is.
Empty training data makes every text ``und``. Texts are scored whole. Documents
with a null id are learned from and held out from nothing; repeated rows are told
alike. Columns other than the id, the text and the language are not used, and those
that are not replaced by :func:`identify` stay.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..storage import cut, drop

#: About how many documents, and bytes of them, the model is fitted on.
MAX_TRAIN_DOCS, MAX_TRAIN_BYTES = 3_000, 16 << 20
#: Longer documents are not drawn where there are others.
LONGEST = 1 << 20
MAX_N = 5
#: Scored tokens that a worker remembers, and the bytes of their scores.
CACHE, CACHE_BYTES = 300_000, 64 << 20
#: A table of up to so many bytes is spread out to a row of all languages per key.
FULL_BYTES = 32 << 20
UNDETERMINED = "und"
DRAWS = 1 << 40
RESULT = "lang_pred string, score double"

_WORD = re.compile(r"[^\W\d_]+")


def equal_bound(sizes: Iterable[int], total: int) -> int:
    """Greatest equal bound, 1 at least, that cuts ``sizes`` to ``total`` in all;
    what small ones leave of their share goes to the others."""
    left, rest = total, sorted(sizes)
    for i, n in enumerate(rest):
        if n * (len(rest) - i) > left:
            return max(1, left // (len(rest) - i))
        left -= n
    return max(1, rest[-1] if rest else 1)


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())


def language_sizes(docs: DataFrame, id_col: str = "doc_id") -> dict[str, Row]:
    """``n, bytes, least`` of each language, over all its labelled rows: their number,
    the bytes of those that may be drawn, and the least draw among those."""
    drawn = F.struct((F.octet_length("text") > LONGEST).alias("long"), _draw(id_col).alias("draw"))
    size = F.when(F.octet_length("text") <= LONGEST, F.octet_length("text")).otherwise(0)
    rows = _labelled(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("bytes"), F.min(drawn).alias("least"))
    return {r.lang: r for r in rows.collect()}


def _draw(id_col: str) -> Column:
    """A number below ``DRAWS`` that follows from a row's id and text."""
    return F.pmod(F.xxhash64(id_col, "text"), F.lit(DRAWS))


def training_sample(docs: DataFrame, id_col: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS, max_bytes: int = MAX_TRAIN_BYTES, sizes: dict[str, Row] | None = None) -> DataFrame:
    """Labelled rows ``lang, text``, thinned by a hash of id and text to about
    ``max_docs`` and ``max_bytes``. The bounds are the same for each language, so small
    languages stay whole, and each keeps its least draw at least."""
    sizes = language_sizes(docs, id_col) if sizes is None else sizes
    most = equal_bound((r.n for r in sizes.values()), max_docs), equal_bound((r.bytes for r in sizes.values()), max_bytes)
    share = lambda r: min(1.0, most[0] / r.n, most[1] / max(r.bytes, 1))
    rows = [(x, r.least.long, r.least.draw, int(DRAWS * share(r))) for x, r in sizes.items()]
    limits = docs.sparkSession.createDataFrame(rows, "lang string, __long boolean, __least long, __limit long")
    drawn = _labelled(docs).select("lang", "text", (F.octet_length("text") > LONGEST).alias("__of"), _draw(id_col).alias("__draw")).join(F.broadcast(limits), "lang")
    # where all documents of a language are long, only the one of the least draw is taken
    taken = (F.col("__of") == F.col("__long")) & ((F.col("__draw") == F.col("__least")) | (~F.col("__long") & (F.col("__draw") < F.col("__limit"))))
    return drawn.where(taken).groupBy("lang", "__draw").agg(F.any_value("text").alias("text")).select("lang", "text")


def ngrams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Table:
    """Keys with the logs of their frequencies over the common ones, by language.

    ``unseen`` holds what a language says of a key that it has not seen; ``more`` what
    those that have seen it say beyond that, at ``langs``, from ``starts[row]`` on. A
    small table has ``full``, all of this in a row per key, instead.
    """

    def __init__(self, counts: Iterable[tuple[str, int, int]], k: int):
        self.rows: dict[str, int] = {}
        rows, langs, times = [], [], []
        for key, lang, n in counts:
            rows.append(self.rows.setdefault(key, len(self.rows)))
            langs.append(lang)
            times.append(n)
        pairs, at = np.unique(np.array(rows, np.int64) * k + np.array(langs, np.int64), return_inverse=True)
        n = np.bincount(at, np.array(times, float), len(pairs))
        row, self.langs = pairs // k, (pairs % k).astype(np.int32)
        total, kinds = np.bincount(self.langs, n, k), np.bincount(self.langs, minlength=k)
        common = np.bincount(row, n, len(self.rows)) / max(n.sum(), 1)
        # a language without any key says what all say
        self.unseen = np.log(np.where(kinds > 0, kinds / np.maximum(total + kinds, 1), 1.0))
        seen = (n + kinds[self.langs] * common[row]) / (total + kinds)[self.langs] / common[row]
        self.more = np.log(seen) - self.unseen[self.langs]
        self.starts = np.searchsorted(row, np.arange(len(self.rows) + 1))
        self.full: np.ndarray | None = None
        if len(self.rows) * k * 8 <= FULL_BYTES:
            self.full = np.tile(self.unseen, (len(self.rows), 1))
            self.full[row, self.langs] += self.more
            self.langs = self.more = self.starts = None

    def mean(self, rows: list[int]) -> np.ndarray:
        """What each language says of these keys, on average."""
        if self.full is not None:
            return self.full[rows[0]] if len(rows) == 1 else np.add.reduce(self.full.take(rows, 0), 0) / len(rows)
        out = np.zeros(len(self.unseen))
        for r in rows:
            a, b = self.starts[r], self.starts[r + 1]
            out[self.langs[a:b]] += self.more[a:b]
        return out / len(rows) + self.unseen


class Model:
    """A table of words and one of n-grams of each length, and the languages' shares."""

    def __init__(self, counts: list[tuple[str, str, int]], sizes: dict[str, int]):
        self.langs = sorted({x for _, x, _ in counts})
        k, col = len(self.langs), {x: i for i, x in enumerate(self.langs)}
        total = sum(sizes[x] for x in self.langs)
        self.prior = np.array([math.log(sizes[x] / total) for x in self.langs])
        self.words = Table(((w, col[x], n) for w, x, n in counts), k)
        self.grams = [Table(((g, col[x], n) for w, x, n in counts for g in ngrams(w, size)), k) for size in range(1, MAX_N + 1)]

    def word(self, word: str) -> np.ndarray:
        """What each language says of a word: logs of frequencies over common ones."""
        row = self.words.rows.get(word)
        if row is not None:
            return self.words.mean([row])
        for size in range(MAX_N, 0, -1):
            table = self.grams[size - 1]
            known = [r for g in ngrams(word, size) if (r := table.rows.get(g)) is not None]
            if known:
                return table.mean(known)
        return np.zeros(len(self.langs))


class Scorer(dict):
    """Token -> row of ``table``: summed vectors of its words, and their number."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.k = model, len(model.langs)
        self.most = min(CACHE, max(4, CACHE_BYTES // (8 * (self.k + 1))))
        self.table = np.zeros((self.most + 1, self.k + 1))

    def __missing__(self, token: str) -> int:
        words = [w for w in _WORD.findall(token.lower()) if any(map(str.isalpha, w))]
        at = len(self)
        row = self.table[at]
        row[:] = 0
        for w in words:
            row[: self.k] += self.model.word(w)
        row[self.k] = len(words)
        self[token] = at
        return at

    def score(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.k:
            return UNDETERMINED, 0.0
        tokens = text.split()
        total = np.zeros(self.k + 1)
        step = self.most // 4
        for i in range(0, len(tokens), step):
            part = tokens[i : i + step]
            if len(self) + len(part) > self.most:
                self.clear()
            total += self.table[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0)
        n = total[self.k]
        if not n:
            return UNDETERMINED, 0.0
        # the mean over words, weighed as at most ten of them: long texts stay comparable
        z = total[: self.k] / n * min(n, 10) + self.model.prior
        p = np.exp(z - z.max())
        best = int(p.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def fit(train: DataFrame, id_col: str = "doc_id", max_docs: int = MAX_TRAIN_DOCS, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """Fit on ``text, lang``: words are counted by Spark, in the bounded sample."""
    sizes = language_sizes(train, id_col)
    rows = training_sample(train, id_col, max_docs, max_bytes, sizes).select(F.lower("text").alias("text"), "lang")
    words = rows.select("lang", F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).where("word <> ''")
    counts = cut(words.groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n")), "langid-words")
    kept = [(r.word, r.lang, r.n) for r in counts.toLocalIterator()]
    drop(counts)
    return Model(sorted(kept), {x: r.n for x, r in sizes.items()})


_SCORERS: dict[int, Scorer] = {}


def predictor(spark, model: Model):
    """Column function text -> ``struct<lang_pred, score>``."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        if id(m) not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[id(m)] = Scorer(m)
        scorer = _SCORERS[id(m)]
        for texts in batches:
            yield pd.DataFrame([scorer.score(x) for x in texts], columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score``; the other columns stay as they are."""
    found = predictor(docs.sparkSession, model)(F.col(text))
    return docs.withColumn("__lid", found).withColumns({"lang_pred": F.col("__lid.lang_pred"), "score": F.col("__lid.score")}).drop("__lid")


def held_out(doc_id: Column) -> Column:
    """One document in five, by the CRC of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
