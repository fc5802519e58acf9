"""Hierarchical multi-length packing.

Context sizes are tiers of powers of two. A document's full windows of the longest
tier go out as they are; its rest is routed to the shortest tier that holds it.
Tiers are packed from long to short: each sequence starts with a document of its
tier, its gap is filled with the largest fitting documents of shorter tiers, and
the last bit of it with the head of a document cut to measure. So sequences are
exactly as long as their tier and need no padding. Sequences of one tier are then
dealt, costliest first and back and forth, into step groups of equal token counts
and about equal attention cost.

Packing runs task by task over the input's own partitions, without a shuffle, on
a bounded number of tokens at a time. What a task has left at its end, less than
the longest tier, is handed on: the leftovers of many tasks are packed by fewer,
until one task has the last ones, and only what that one has left, for the whole
table, is cut into shorter powers of two. A partition's rows must come in the
same order when a lost task is run again, as those of a table do; write a
shuffled input first. Null texts are empty; every document has at least its end
token. Ids may be of any type; null and repeated ids are kept as they are. An
empty table gives no pieces. Columns other than the id and the text are not used.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

TIERS = (512, 1024, 2048, 4096)
#: Tokens that a task packs at a time, and tokens of a training step.
BUFFER_TOKENS, STEP_TOKENS = 2_000_000, 262_144
#: Chunks of text, in each of two generations, that a worker remembers.
CACHE = 500_000
#: Tokens of leftovers that a task takes over.
HANDED = 2_000_000
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class WordTokenizer:
    """Ids of a word-end BPE tokenizer, remembered by white-space chunk.

    Texts in common Latin characters split at white space before they are
    normalised, as the tokenizer drops white space and never joins over it; each
    new word goes through the tokenizer's own model. All other texts go through
    the whole tokenizer.
    """

    #: Characters that normalisation leaves alone but for their case.
    _OTHER = re.compile(r"[^\t\n\r -~ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿŒœ¡¿«»‘’“”…–—€]")
    #: The tokenizer's own splitting pattern, in terms of those characters.
    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        as_char = {b: ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(b))[0][0] for b in range(1, 128)}
        for b in range(128, 256):  # a two-byte character shows its second byte; a three-byte one its first
            lead = b < 192
            text = bytes([195, b]).decode() if lead else self._with_byte(b)
            if text:
                shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0]
                as_char[b] = shown[1 if lead else 0]
        self.as_char = as_char
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _with_byte(b: int) -> str:
        for tail in (b"\x80", b"\x80\x80", b"\xa0\x80", b"\x80\x80\x80", b"\x90\x80\x80"):
            try:
                return (bytes([b]) + tail).decode()
            except UnicodeDecodeError:
                continue
        return ""

    def _chunk(self, chunk: str) -> bytes:
        packed = self.old.get(chunk)
        if packed is None:
            packed = b"".join([self.words.get(w) or self._word(w) for w in self._PARTS.findall(chunk.lower())])
        if len(chunk) <= 64:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[chunk] = packed
        return packed

    def _word(self, word: str) -> bytes:
        table = self.as_char
        ids = [t.id for t in self.whole.model.tokenize("".join([table[b] for b in word.encode()]))]
        packed = np.array(ids, "<u4").tobytes()
        if len(word) <= 64:
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "<|" in text or self._OTHER.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, chunks = [], text.split()
        for i in range(0, len(chunks), 10_000):
            get, chunk = self.new.get, self._chunk
            out += [get(c) or chunk(c) for c in chunks[i : i + 10_000]]
        return b"".join(out)


class Packer:
    """Packs pieces ``(n, doc_id, start, ids, doc_tokens)`` of one task.

    Sequences are pairs of a tier and pieces; tier 0 has pieces to be handed on. Pieces
    wait in a queue for each length; a bit for each length tells which have any, so the
    next fitting one is found in the same time however many wait.
    """

    def __init__(self, tiers: tuple[int, ...], first_id: int, step_tokens: int):
        self.tiers, self.next_id, self.next_group, self.step = tiers, first_id, first_id, step_tokens
        self.waiting: dict[int, deque[tuple]] = {}
        self.lengths = self.held = 0

    def rest(self) -> list[tuple[int, list[tuple]]]:
        """What is left, as pieces to be handed on."""
        return [(0, [piece]) for n in sorted(self.waiting) for piece in self.waiting[n]]

    def add(self, doc_id, ids: np.ndarray) -> list[list[tuple]]:
        """Take a document; its full windows come back as sequences."""
        top, n, full = self.tiers[-1], len(ids), []
        at = 0
        while n - at >= top:
            full.append([(top, doc_id, at, ids[at : at + top], n)])
            at += top
        if at < n:
            self._put((n - at, doc_id, at, ids[at:], n))
        return full

    def put(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        """Take a piece that another task had left."""
        self._put((len(ids), doc_id, start, ids, total))

    def _put(self, piece: tuple) -> None:
        n = piece[0]
        self.waiting.setdefault(n, deque()).append(piece)
        self.lengths |= 1 << n
        self.held += n

    def _out(self, n: int, oldest: bool) -> tuple:
        queue = self.waiting[n]
        piece = queue.popleft() if oldest else queue.pop()
        if not queue:
            self.lengths ^= 1 << n
        self.held -= n
        return piece

    def _take(self, most: int) -> tuple | None:
        """Largest piece of at most ``most`` tokens."""
        fits = self.lengths & (2 << most) - 1
        return self._out(fits.bit_length() - 1, False) if fits else None

    def _cut(self, size: int) -> tuple | None:
        """The head of the shortest piece, ``size`` tokens of it."""
        if not self.lengths:
            return None
        n, doc_id, start, ids, total = self._out((self.lengths & -self.lengths).bit_length() - 1, True)
        self._put((n - size, doc_id, start + size, ids[size:], total))
        return (size, doc_id, start, ids[:size], total)

    def pack(self) -> list[tuple[int, list[tuple]]]:
        """Sequences ``(tier, pieces)`` from the pool, until it runs out."""
        out = []
        while self.lengths:
            longest = self.lengths.bit_length() - 1
            tier = next(t for t in self.tiers if t >= longest)
            if self.held < tier:
                break
            pieces, gap = [self._take(longest)], tier - longest
            while gap:
                piece = self._take(gap) or self._cut(gap)
                pieces.append(piece)
                gap -= piece[0]
            out.append((tier, pieces))
        return out

    def finish(self) -> list[tuple[int, list[tuple]]]:
        """What is left, as sequences of falling powers of two."""
        out = []
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            pieces, gap = [], size
            while gap:
                piece = self._take(gap) or self._cut(gap)
                pieces.append(piece)
                gap -= piece[0]
            out.append((size, pieces))
        return out

    def rows(self, sequences: list[tuple[int, list[tuple]]]) -> Iterator[tuple]:
        """Number the sequences and balance them over step groups."""
        by_tier: dict[int, list] = {}
        for tier, pieces in sequences:
            by_tier.setdefault(tier, []).append(pieces)
        for tier, many in sorted(by_tier.items()):
            if not tier:
                yield from ((doc_id, start, n, ids.tobytes(), total, -1, 0, 0, -1) for [(n, doc_id, start, ids, total)] in many)
                continue
            many.sort(key=lambda ps: -sum(p[0] * p[0] for p in ps))
            groups = -(-len(many) * tier // self.step)
            for k, pieces in enumerate(many):
                lap, place = divmod(k, groups)
                group = self.next_group + (place if lap % 2 == 0 else groups - 1 - place)
                offset = 0
                for n, doc_id, start, ids, total in pieces:
                    yield doc_id, start, n, ids.tobytes(), total, self.next_id, offset, tier, group
                    offset += n
                self.next_id += 1
            self.next_group += groups


_LOADED: dict[str, WordTokenizer] = {}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, text: str = "text") -> DataFrame:
    """Documents -> ``doc_id`` and the columns of ``SCHEMA``: pieces of sequences.

    ``tokenizer`` is a path that every executor has; ``tiers`` rising powers of
    two. Ids of sequences and step groups are unique over the whole table.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, {SCHEMA}"
    names = ["doc_id", *[x.split()[0] for x in SCHEMA.split(", ")]]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    end = np.array([end_id], "<u4").tobytes()

    def packed(level: int, last: bool, pieces: Callable) -> Callable:
        """A task's work: ``pieces`` feeds the packer and returns full windows."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a place for each level, task and sequence of the task
            packer = Packer(tiers, level << 58 | TaskContext.get().partitionId() << 34, step_tokens)
            full: list = []
            size, id_type = 0, None

            def table(sequences) -> Iterator[pa.RecordBatch]:
                rows = list(packer.rows(sequences))
                for i in range(0, len(rows), 4000):
                    columns = zip(*rows[i : i + 4000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [id_type, *types], strict=True)], names=names)

            for batch in batches:
                id_type = batch.column(0).type
                for window in pieces(packer, batch):
                    full.append((tiers[-1], window))
                    size += tiers[-1]
                    if size + packer.held >= BUFFER_TOKENS:
                        yield from table(full + packer.pack())
                        full, size = [], 0
                if size + packer.held >= BUFFER_TOKENS:
                    yield from table(full + packer.pack())
                    full, size = [], 0
            yield from table(full + packer.pack() + (packer.finish() if last else packer.rest()))

        return run

    def from_texts(packer: Packer, batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = WordTokenizer(tokenizer)
        t = _LOADED[tokenizer]
        for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield from packer.add(doc_id, np.frombuffer((t.encode(x) if x else b"") + end, "<u4"))

    def from_pieces(packer: Packer, batch: pa.RecordBatch) -> Iterator[list[tuple]]:
        for doc_id, start, ids, total in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.put(doc_id, start, np.frombuffer(ids, "<u4"), total)
        return iter(())

    left = {"tokens": F.sum(F.when(F.col("tier") == 0, F.col("length")))}
    mark = F.col("tier") == 0
    out, seen = cut(docs.select("doc_id", text).mapInArrow(packed(0, False, from_texts), schema).withColumn("__left", mark), "packed", by="__left", **left)
    done, level = out.where("not __left"), 0
    while seen["tokens"]:
        level += 1
        tasks = -(-seen["tokens"] // HANDED)
        given = out.where("__left").select(names).coalesce(tasks)
        if tasks == 1:
            done = done.drop("__left").unionByName(given.mapInArrow(packed(level, True, from_pieces), schema))
            return done.select(names)
        out, seen = cut(given.mapInArrow(packed(level, False, from_pieces), schema).withColumn("__left", mark), "packed", by="__left", **left)
        done = done.unionByName(out.where("not __left"))
    return done.select(names)
