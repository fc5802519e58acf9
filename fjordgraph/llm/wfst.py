"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled from a ``.model`` file: the normaliser (a transducer
over the input's characters that takes the longest rule or copies a character),
the pieces (a trie whose accepting arcs emit a piece) and byte fallback (an arc
over any character that no piece has, emitting its UTF-8 bytes). They are
composed with each input: the normaliser with the text, its output, read by the
other two as it comes, to a lattice. The lattice's shortest path in the tropical
semiring (weights add along a path, the least wins) is the encoding; it is found
by relaxing the arcs of each position in turn.

In a unigram model an arc weighs the piece's negated log probability. In a BPE
model the weights sit on pairs of neighbouring arcs: 0 where the two pieces stay
apart when their concatenation is merged in order of rank, infinity where some
merge would cross between them. A sequence is what merging gives for a whole text
exactly if all its neighbouring pairs are of weight 0, so one path is finite and
it is the model's own encoding. So is every beginning of it: a position has one
live arc that reaches it.

A user-defined piece is an arc that no other crosses: the normaliser copies it,
and the lattice is cut around it. An unused piece has no arc of its own in a
unigram model; in a BPE model it is merged, and emits what it was merged from.

A lattice falls apart wherever no piece holds the two characters around a
position, so words are composed once and remembered (a bounded number of them).

Null texts encode to null, empty ones to no ids. Texts are encoded whole, and
repeated rows alike; an empty table stays empty. Both operators are columns, so
a table's other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import re
import string
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
INF = float("inf")
#: Words, in each of two generations, and pairs of pieces that a worker remembers.
CACHE, PAIRS = 200_000, 300_000
#: Fixed in the format: how far below the least score an unknown character lies.
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one protocol-buffer message."""
    i, n = 0, len(data)

    def varint() -> int:
        nonlocal i
        x = shift = 0
        while True:
            b = data[i]
            i += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + size]
            i += size


def _char_map(blob: bytes) -> dict[bytes, bytes]:
    """Rewriting rules of a precompiled map: a double-array trie and its targets."""
    size = struct.unpack_from("<I", blob)[0]
    units = struct.unpack_from(f"<{size // 4}I", blob, 4)
    texts = blob[4 + size :]
    rules = {}
    todo = [(0, b"")]
    while todo:
        node, key = todo.pop()
        unit = units[node]
        base = node ^ ((unit >> 10) << ((unit & 512) >> 6))
        if key and unit >> 8 & 1:
            at = units[base] & 0x7FFFFFFF
            rules[key] = texts[at : texts.index(b"\0", at)]
        for c in range(1, 256):
            child = base ^ c
            if child < len(units) and units[child] & 0x800000FF == c:
                todo.append((child, key + bytes([c])))
    return rules


class Transducer:
    def __init__(self, path: str, machines: bool = True):
        data = open(path, "rb").read()
        self.pieces: list[tuple[str, float, int]] = []
        self.bpe = self.byte_fallback = False
        self.rules: dict[str, str] = {}
        self.dummy_prefix = self.trim = True
        for field, value in _fields(data):
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif field == 2:
                spec = dict(_fields(value))
                self.bpe, self.byte_fallback = spec.get(3, 1) == 2, bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_fields(value))
                self.dummy_prefix, self.trim = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if spec.get(2):
                    self.rules = {k.decode(): v.decode() for k, v in _char_map(spec[2]).items()}
        if machines:  # decoding needs the pieces only
            self._compile()

    def _compile(self) -> None:
        self.score: dict[str, float] = {}
        self.byte_id = {}
        self.unk = 0
        self.trie: dict = {}
        self.users: dict[str, int] = {}
        self.unused: set[str] = set()
        alphabet, after = set(), set()
        for i, (p, score, kind) in enumerate(self.pieces):
            if kind == BYTE:
                self.byte_id[int(p[1:-1], 16)] = i
            elif kind == UNKNOWN:
                self.unk = i
            elif kind == USER:
                self.users[p] = i
            elif kind != CONTROL and p and (self.bpe or kind != UNUSED):
                self.score[p] = score
                if kind == UNUSED:
                    self.unused.add(p)
                node = self.trie
                for c in p:
                    node = node.setdefault(c, {})
                node[""] = (p, [i])
                alphabet.update(p)
                after.update((a, b) for a, b in zip(p, p[1:], strict=False))
        # the longest user-defined piece at a place
        self.user = re.compile("|".join(map(re.escape, sorted(self.users, key=lambda p: (-len(p), p))))) if self.users else None
        self.low = min(self.score.values(), default=0.0) - UNKNOWN_PENALTY
        self.rule_trie: dict = {}
        for k, v in self.rules.items():
            node = self.rule_trie
            for c in k:
                node = node.setdefault(c, {})
            node[""] = v
        self.rules_at = re.compile("[" + re.escape("".join(sorted(self.rule_trie))) + "]") if self.rules else None
        self.words = self._cuts(alphabet, after)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], float] = {}
        self.story: dict[str, tuple | None] = {}
        for p in sorted(self.unused, key=lambda p: (len(p), p)):
            self._resegment(p)

    @staticmethod
    def _cuts(alphabet: set[str], after: set[tuple[str, str]]) -> re.Pattern:
        """Where a lattice falls apart, as a pattern of its parts.

        Before a space that no piece has after another character, around line
        ends that no piece has, and between letters and marks that no piece has
        side by side. Without the first, the text is one part.
        """
        if not all(a == SPACE for a, b in after if b == SPACE):
            return re.compile(r"(?s).+")
        line = "" if "\n" in alphabet else "\n"
        plain = set(string.ascii_letters + string.digits)
        mixed = {c for a, b in after for c, d in ((a, b), (b, a)) if d in plain}
        marks = {c for c in alphabet & set(string.punctuation) if c not in mixed}
        letters = {c for c in alphabet if c.isalnum()}
        letters -= {c for a, b in after for c, d in ((a, b), (b, a)) if d in marks}
        rest = f" *[^ {line}]+| +" + (f"|{line}+" if line else "")
        if not marks or not letters:
            return re.compile(rest)
        x, y = (f"[{re.escape(''.join(sorted(s)))}]" for s in (letters, marks))
        stop = lambda s: f"(?=[ {line}]|{s}|$)"
        return re.compile(f" *{x}+{stop(y)}| *{y}+{stop(x)}|{rest}")

    def _node(self, piece: str) -> dict:
        node = self.trie
        for c in piece:
            node = node[c]
        return node

    def _resegment(self, piece: str) -> None:
        """Let an unused piece's arc emit the two pieces of its last merge, these
        in turn if they are unused, and so on down."""
        out: list[int] = []
        todo = [piece]
        while todo:
            p = todo.pop()
            if p in self.unused and self._story(p):
                syms = list(p)
                while len(syms) > 2:
                    at = self._merge(syms)[1]
                    syms[at : at + 2] = [syms[at] + syms[at + 1]]
                todo += reversed(syms)
            else:
                out += self._node(p)[""][1] if p in self.score else self.fallback(p)
        self._node(piece)[""] = (piece, out)

    def _merge(self, syms: list[str]) -> tuple[float, int]:
        """Score and place of the best merge on offer, the leftmost of equals."""
        best, at = -INF, -1
        for k in range(len(syms) - 1):
            s = self.score.get(syms[k] + syms[k + 1], -INF)
            if s > best:
                best, at = s, k
        return best, at

    # normaliser

    def rewritten(self, text: str) -> Iterator[tuple[int, str]]:
        """The normaliser composed with a text: ``(end in the text, output)`` of
        its arcs along the text, the longest rule at each place, or a copy."""
        i, n = 0, len(text)
        while i < n:
            if self.user and (m := self.user.match(text, i)):
                i, out = m.end(), m[0]
            else:
                node, j, hit = self.rule_trie, i, None
                while j < n and (node := node.get(text[j])) is not None:
                    j += 1
                    if "" in node:
                        hit = (j, node[""])
                i, out = hit or (i + 1, text[i])
            yield i, out

    def normalise(self, text: str) -> str:
        """The normaliser's output for a text, spaces as spaces; the dummy prefix
        included. Without rules that could match it copies the text."""
        if self.rules_at and self.rules_at.search(text):
            text = "".join([out for _, out in self.rewritten(text)])
        text = text.replace(SPACE, " ")
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        return " " + text if text and self.dummy_prefix else text

    # weights on pairs of pieces

    def _story(self, piece: str) -> tuple | None:
        """How merging builds a piece: (score, first symbol, last symbol) by step.

        None if merging the piece's characters ends with anything else.
        """
        if piece in self.story:
            return self.story[piece]
        syms, steps = list(piece), []
        while len(syms) > 1:
            best, at = self._merge(syms)
            if at < 0:
                break
            syms[at : at + 2] = [syms[at] + syms[at + 1]]
            steps.append((best, syms[0], syms[-1]))
        self.story[piece] = out = tuple(steps) if len(syms) == 1 else None
        return out

    def stands(self, piece: str) -> bool:
        return self._story(piece) is not None

    def pair_weight(self, left: str, right: str) -> float:
        """0 if no merge crosses between the two pieces, else infinity.

        An empty ``left`` is the start of the text.

        Both build up side by side, always by the best merge on offer (of equal
        ones the leftmost); the pair fails if that is one across the border.
        """
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self._story(left) if left else (), self._story(right)
        w = INF
        if a is not None and b is not None:
            i = j = 0
            last, first = left[-1:] or "\0\0", right[0]
            score = self.score
            while True:
                x = a[i][0] if i < len(a) else -INF
                y = b[j][0] if j < len(b) else -INF
                z = score.get(last + first, -INF)
                if z > x and z >= y and z > -INF:
                    break
                if x == y == -INF:
                    w = 0.0
                    break
                if x >= y:
                    last = a[i][2]
                    i += 1
                else:
                    first = b[j][1]
                    j += 1
        self.pairs[(left, right)] = w
        return w

    # composition and shortest path

    def fallback(self, char: str) -> list[int]:
        if self.byte_fallback:
            return [self.byte_id[b] for b in char.encode()]
        return [self.unk]

    def arcs(self, word: str, i: int) -> list[tuple[str, list[int]]]:
        """Arcs of the lattice that leave position ``i``, by rising length."""
        out = [] if word[i] in self.score else [(word[i], self.fallback(word[i]))]
        node = self.trie
        for j in range(i, len(word)):
            node = node.get(word[j])
            if node is None:
                break
            if "" in node:
                out.append(node[""])
        return out

    def shortest_path(self, word: str) -> list[int]:
        """Ids of the least path through the lattice of ``word`` (spaces as U+2581).

        The arcs of each position that has been reached are relaxed in turn. The
        last piece on the way to a position is part of its state, as weights may
        sit on pairs.
        """
        n, bpe, pairs, score, low = len(word), self.bpe, self.pairs, self.score, self.low
        cost, last = [INF] * (n + 1), [""] * (n + 1)
        back: list = [None] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            so_far, left = cost[i], last[i]
            if so_far == INF:
                continue
            for piece, ids in self.arcs(word, i):
                j = i + len(piece)
                if bpe:
                    if cost[j] <= so_far:
                        continue
                    w = pairs.get((left, piece))
                    if w is None:
                        w = self.pair_weight(left, piece)
                else:
                    w = -score.get(piece, low)
                if so_far + w < cost[j]:
                    cost[j], last[j], back[j] = so_far + w, piece, (i, ids)
        out, at = [], n
        while at:
            at, ids = back[at]
            out.append(ids)
        return [x for ids in reversed(out) for x in ids]

    def _word(self, word: str) -> bytes:
        packed = self.old.get(word)
        if packed is None:
            ids = self.shortest_path(word.replace(" ", SPACE))
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        whole = self.normalise(text)
        if not self.user:
            return self._part(whole)
        out, at = [], 0
        for m in self.user.finditer(whole.replace(" ", SPACE)):
            out += [self._part(whole[at : m.start()]), struct.pack("<I", self.users[m[0]])]
            at = m.end()
        return b"".join([*out, self._part(whole[at:])])

    def _part(self, text: str) -> bytes:
        out, words = [], self.words.findall(text)
        for i in range(0, len(words), 10_000):
            get, word = self.new.get, self._word
            out += [get(w) or word(w) for w in words[i : i + 10_000]]
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        if not hasattr(self, "bytes_of"):
            self.bytes_of = []
            for p, _, kind in self.pieces:
                out = {CONTROL: b"", UNKNOWN: " ⁇ ".encode()}.get(kind)
                self.bytes_of.append(bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() if out is None else out)
        text = b"".join(map(self.bytes_of.__getitem__, memoryview(packed).cast("I"))).decode(errors="replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_LOADED: dict[tuple[str, bool], Transducer] = {}
#: Texts that become Python strings at a time.
SLICE = 200


def load(path: str, machines: bool = True) -> Transducer:
    if (path, machines) not in _LOADED:
        _LOADED[path, machines] = Transducer(path, machines)
    return _LOADED[path, machines]


def _each(values: pa.Array, f: Callable, kind: pa.DataType) -> pa.Array:
    """``f`` of all values but nulls, a slice at a time."""
    parts = [pa.array([None if x is None else f(x) for x in values.slice(i, SLICE).to_pylist()], kind) for i in range(0, len(values), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def encode(spark: SparkSession, text: Column, model: str) -> Column:
    """Text -> ids, packed as little-endian unsigned 32-bit integers.

    ``model`` is a path that every executor has.
    """

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = load(model)
        for texts in batches:
            yield _each(texts, t.encode, pa.binary())

    return run(text)


def decode(spark: SparkSession, ids: Column, model: str) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = load(model, False)
        for packed in batches:
            yield _each(packed, t.decode, pa.string())

    return run(ids)
