"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into transducers:

* the normaliser, whose states are the start of a text, inside it, and behind spaces that are to be
  joined; it writes spaces as the visible space and one in front;
* the lexicon, a tree whose arcs read characters and whose leaves write a piece and lead back to its root;
* byte fallback, which reads a character that is no piece and writes its bytes, or the unknown piece;
* the junction, an acceptor of pieces whose states are the pieces read last.

An input is composed with them, one after the other and only as far as it leads, and the path of least weight
in the tropical semiring is its encoding. Arc weights say what kind of model it is. In a unigram model a
lexicon's leaf weighs minus its piece's score, and the junction has one state. In a BPE model a path is the
result of the merges if and only if each two neighbouring pieces are what merging their joint text gives, so
the junction's arc from one piece to the next weighs 0 if that holds and infinity otherwise, and exactly one
path is finite. Whether it holds is found once for a pair of pieces, by its merges.

Where no piece holds two neighbouring kinds of characters, which compiling checks, shortest paths never
cross such a place, so inputs are cut there and the paths of their parts are remembered.

Decoding is the way back: pieces and bytes to text, visible spaces to spaces.

Texts are encoded whole. A null text gives null ids and null text. An empty text has no ids. Repeated
rows give equal results; an empty table gives an empty one; columns beside id and text are ignored.
Models with user-defined or unused pieces, character maps other than the identity, or spaces kept at
the end of words are refused.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public model lies; a parameter of every function that needs it.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
# Fixed values of the file format: kinds of pieces and of models.
NORMAL, UNK, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
# Ways to cut a text, finest first: letters, digits and others apart with the spaces before them; words; not at all.
PARTS = (
    rf"[ {SPACE}]*[^\W\d_²³¹¼½¾]+|[ {SPACE}]*\d|[ {SPACE}]*(?:[^ {SPACE}\w]|[_²³¹¼½¾])+|[ {SPACE}]+",
    rf"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+",
    r"(?s).+",
)
#: States of the normaliser, and the junction's state before the first piece.
BEGIN, INSIDE, GAP, NOTHING = 0, 1, 2, -1
#: Entries that a cache of words or pairs may hold before it is emptied; numbers of unknown characters stay below Unicode's size.
WORDS_KEPT, PAIRS_KEPT = 500_000, 600_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Cache(dict):
    """Results of a function, remembered up to a limit."""

    def __init__(self, function, limit: int):
        super().__init__()
        self.function, self.limit = function, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = value = self.function(key)
        return value


class Normaliser:
    """A transducer from characters to characters: for each state, what it writes for a space or before another character, and the next states."""

    def __init__(self, prefix: bool, joined: bool):
        front = SPACE if prefix else ""
        if joined:  # spaces write nothing until something follows, at the start and at the end nothing at all
            self.space = {BEGIN: ("", BEGIN), INSIDE: ("", GAP), GAP: ("", GAP)}
            self.other = {BEGIN: front, INSIDE: "", GAP: SPACE}
        else:
            self.space = {BEGIN: (front + SPACE, INSIDE), INSIDE: (SPACE, INSIDE)}
            self.other = {BEGIN: front, INSIDE: ""}

    def compose(self, text: str, state: int = INSIDE) -> str:
        """What it writes for a text: the composition of a text with it is a chain again."""
        if " " not in text:
            return self.other[state] + text if text else ""
        if state == INSIDE == self.space[state][1] and not self.other[state]:  # from here on, every character is written by itself
            return text.replace(" ", self.space[state][0])
        out = []
        for c in text:
            if c == " ":
                written, state = self.space[state]
                out.append(written)
            else:
                out.append(self.other[state] + c)
                state = INSIDE
        return "".join(out)


class Lexicon:
    """The tree of pieces: a state is its arcs, by character the next state and the piece that is written there, -1 for none."""

    def __init__(self, pieces: dict[str, int]):
        self.root: dict[str, tuple[dict, int]] = {}
        for text, number in sorted(pieces.items()):  # beginnings come before what goes on from them
            state = self.root
            for c in text[:-1]:
                state = state.setdefault(c, ({}, -1))[0]
            state[text[-1]] = ({}, number)


class Transducer:
    """A compiled model."""

    def __init__(self, proto: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.kind, fallback, prefix, joined, escaped, charsmap, suffix, unk_text = UNIGRAM, 0, 1, 1, 1, b"", 0, " ⁇ "
        for number, value in _fields(proto):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind, fallback, suffix = trainer.get(3, UNIGRAM), trainer.get(35, 0), trainer.get(24, 0)
                unk_text = trainer.get(44, unk_text.encode()).decode()
            elif number == 3:
                norm = dict(_fields(value))
                charsmap, prefix, joined, escaped = norm.get(2, b""), norm.get(3, 1), norm.get(4, 1), norm.get(5, 1)
        if self.kind not in (UNIGRAM, BPE) or charsmap or suffix or not escaped or {USER, UNUSED} & set(self.kinds):
            raise ValueError("a model of this kind isn't supported")
        self.prefix = bool(prefix)
        self.unk = self.kinds.index(UNK)
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.weights = {p: -scores[i] for p, i in self.ids.items()}
        lowest = min((scores[i] for i in self.ids.values()), default=0.0)
        self.unk_weight = -(lowest - 10.0)
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE} if fallback else {}
        self.normaliser, self.lexicon = Normaliser(self.prefix, bool(joined)), Lexicon(self.ids)
        # what arcs of the lexicon weigh: in a BPE model the junction alone weighs
        self.arc_weights = [0.0] * len(self.pieces) if self.kind == BPE else [-x for x in scores]
        self.written = [(i,) for i in range(len(self.pieces))]  # ids that a symbol writes: pieces, then characters of the fallback
        self.symbols = list(self.pieces)
        self.numbers = Cache(self._fallback, 1 << 31)
        # places where inputs are cut: the finest pattern by which every piece stays whole
        self.parts = next(x for x in map(re.compile, PARTS) if all(x.findall(p) == [p] for p in self.ids))
        self.stable = Cache(self._stable, PAIRS_KEPT)
        self.edges = Cache(self._edges, PAIRS_KEPT)
        self.encoded = Cache(lambda part: self._encoded(part, INSIDE), WORDS_KEPT)
        self.encoded_first = Cache(lambda part: self._encoded(part, BEGIN), WORDS_KEPT)
        self.text = [self._text(i, unk_text) for i in range(len(self.pieces))]

    def normalise(self, text: str) -> str:
        return self.normaliser.compose(text, BEGIN)

    def _fallback(self, character: str) -> int:
        """The symbol of a character that is no piece; it writes bytes, or the unknown piece."""
        self.symbols.append(character)
        self.written.append(tuple(self.bytes[b] for b in character.encode()) if self.bytes else (self.unk,))
        self.arc_weights.append(0.0 if self.kind == BPE else self.unk_weight)
        return len(self.symbols) - 1

    def arcs(self, text: str, at: int) -> list[tuple[int, int]]:
        """(end, symbol) of the arcs that lexicon and fallback have from a position of a chain."""
        state, out = self.lexicon.root, []
        for end in range(at, len(text)):
            step = state.get(text[end])
            if step is None:
                break
            state, symbol = step
            if symbol >= 0:
                out.append((end + 1, symbol))
        if not out or out[0][0] != at + 1:
            out.append((at + 1, self.numbers[text[at]]))
        return out

    def shortest_path(self, text: str) -> list[int]:
        """The symbols on the path of least weight through a normalised text's composition with lexicon, fallback and junction.

        A state of the composition is a position and a state of the junction; positions are in topological order.
        A junction of one state leaves one state a position, kept as (weight, symbol read last, state before).
        """
        if self.kind == BPE:
            return self._finite_path(text)
        reached: list[list] = [[(0.0, NOTHING, None)], *([] for _ in text)]
        for at in range(len(text)):
            state = min(reached[at], key=lambda s: s[0])
            for end, symbol in self.arcs(text, at):
                reached[end].append((state[0] + self.arc_weights[symbol], symbol, state))
        out, state = [], min(reached[-1], key=lambda s: s[0])
        while state[2] is not None:
            out.append(state[1])
            state = state[2]
        return out[::-1]

    def _finite_path(self, text: str) -> list[int]:
        """shortest_path() where steps weigh 0 or infinity: every state that is reached has weight 0, and is kept as (symbol read last, state before)."""
        n, stable, root = len(text), self.stable, self.lexicon.root
        reached: list[list | None] = [None] * (n + 1)
        reached[0] = [(NOTHING, None)]
        for at in range(n):
            here = reached[at]
            if here is None:
                continue
            arcs, end, alone = root, at, True
            while end < n and (step := arcs.get(text[end])):
                arcs, symbol = step
                end += 1
                if symbol >= 0:
                    alone &= end > at + 1
                    for state in here:
                        if state[0] < 0 or stable[state[0] << 32 | symbol]:
                            if (there := reached[end]) is None:
                                reached[end] = [(symbol, state)]
                            else:
                                there.append((symbol, state))
            if alone:
                symbol = self.numbers[text[at]]
                for state in here:
                    if state[0] < 0 or stable[state[0] << 32 | symbol]:
                        reached[at + 1] = [*(reached[at + 1] or ()), (symbol, state)]
        out, state = [], reached[n][0]
        while state[1] is not None:
            out.append(state[0])
            state = state[1]
        return out[::-1]

    def merged(self, text: str) -> Iterator[list[str]]:
        """The states of merging a text: of all neighbours that form a piece, the best scored, leftmost first."""
        parts = list(text)
        yield parts
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                weight = self.weights.get(parts[i] + parts[i + 1])
                if weight is not None and (best is None or weight < best):
                    best, where = weight, i
            if where < 0:
                return
            parts = [*parts[:where], parts[where] + parts[where + 1], *parts[where + 2 :]]
            yield parts

    def _edges(self, piece: str) -> tuple[list[str], list[str]]:
        """What stands first and last in a piece while it is merged, each in the order in which it comes about."""
        first: list[str] = []
        last: list[str] = []
        for parts in self.merged(piece):
            first += [parts[0]] * (first[-1:] != parts[:1])
            last += [parts[-1]] * (last[-1:] != parts[-1:])
        return first, last

    def _stable(self, pair: int) -> bool:
        """Whether two pieces, given as one number, can be neighbours: the weight of the step is 0, else infinite.

        They can't if, at some point of merging both, what stands on either side of their border forms a
        piece that comes before the next merge of either; of equal ones, the left one comes first.
        """
        one, two = self.symbols[pair >> 32], self.symbols[pair & 0xFFFFFFFF]
        if one.strip(SPACE) == two.strip(SPACE) == "":  # pieces of spaces alone have equal scores
            *_, end = self.merged(one + two)
            return end == [one, two]
        left, right = self.edges[one][1], self.edges[two][0]
        weights, never = self.weights, float("inf")
        i = j = 0
        while True:
            across = weights.get(left[i] + right[j], never)
            next_left = weights[left[i + 1]] if i + 1 < len(left) else never
            next_right = weights[right[j + 1]] if j + 1 < len(right) else never
            if across < next_left and across <= next_right and across < never:
                return False
            if next_left == next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1

    def _encoded(self, part: str, state: int) -> bytes:
        """The ids of a part of a text, from the normaliser's state before it."""
        path = self.shortest_path(self.normaliser.compose(part, state))
        if path and max(path) >= len(self.pieces):
            path = [i for symbol in path for i in self.written[symbol]]
        return array("i", path).tobytes()

    def encode(self, text: str) -> np.ndarray:
        first, *rest = self.parts.findall(text) or [""]
        ids = np.frombuffer(b"".join([self.encoded_first[first], *map(self.encoded.__getitem__, rest)]), np.int32)
        if not self.bytes and len(ids):  # neighbouring unknowns are one
            unknown = ids == self.unk
            ids = ids[~(unknown & np.concatenate(([False], unknown[:-1])))]
        return ids

    def _text(self, i: int, unknown: str) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return {UNK: unknown.encode(), CONTROL: b""}.get(kind, piece.replace(SPACE, " ").encode())

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the way back through lexicon, byte fallback and normaliser; broken bytes become U+FFFD."""
        data = b"".join(map(self.text.__getitem__, ids.tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@functools.lru_cache(2)
def _compiled(digest: str, proto: bytes) -> Transducer:
    return Transducer(proto)


def load(path: str = MODEL) -> bytes:
    """The bytes of a model file, for its digest and for workers; they stay under a megabyte or so."""
    with open(os.path.realpath(path), "rb") as f:
        return f.read()


def tokenized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per row of df: id, n_tokens, ids array<int>, decoded string (the ids decoded again), exact (whether that is the text).

    The file is read once by the driver; its bytes, whose size the vocabulary bounds, go to the workers, which
    compile them.
    """
    proto = df.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = proto.value
        fst = _compiled(hashlib.sha256(data).hexdigest(), data)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                given = part.column(1).to_pylist()
                ids = [None if t is None else fst.encode(t) for t in given]
                offsets = np.concatenate([[0], np.cumsum([0 if x is None else len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate([np.empty(0, np.int32), *(x for x in ids if x is not None)])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in ids]))
                counts = pa.array([0 if x is None else len(x) for x in ids], pa.int64())
                texts = [None if x is None else fst.decode(x) for x in ids]
                exact = pa.array([None if t is None else t == u for t, u in zip(given, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, lists, pa.array(texts, pa.string()), exact], names=["id", "n_tokens", "ids", "decoded", "exact"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n_tokens bigint, ids array<int>, decoded string, exact boolean").withColumnRenamed("id", id_col)
