"""Cuts of a text at which public tokenizers never join what stands on both sides, and encoders over such parts.

A byte-level BPE file cuts a text into pre-tokens by a fixed pattern and merges within them alone, so the ids of a text
are those of its pre-tokens in turn. A piece model whose pieces have spaces at their front alone never joins a space to
what stands before it, so its ids are those of the parts that begin at spaces. Both hold for any text; what is known of
a part can then be kept, whatever text it comes from.

Patterns need to know which characters are letters, numbers and white space. The libraries at hand carry other
versions of these tables than `regex`; they differ in characters that were unassigned when the older one was made. A
text with a character that may differ is cut by the tokenizer library itself.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import regex

#: The pattern that cuts pre-tokens of the byte-level files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a text that are cut at a time: lists of parts stay small however long a text is.
SLICE = 1 << 18
#: Characters of the longest part that is kept, and bytes that a worker's kept parts may take, keys and values.
PART_LONGEST, KEPT_BYTES = 64, 48 << 20
#: Bytes that an entry takes beside its key's and value's own characters.
ENTRY = 160

_PARTS = regex.compile(PATTERN)
_UNITS = regex.compile(" *[^ ]+| +")
_CLASSES = [(k, regex.compile(p)) for k, p in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s"))]
_BREAK = regex.compile(r"(?<=\S) ")


class Kept(dict):
    """What a function gives for parts of texts; emptied when it would take more than KEPT_BYTES."""

    def __init__(self, function, limit: int = KEPT_BYTES):
        super().__init__()
        self.function, self.limit, self.size = function, limit, 0

    def __missing__(self, part: str):
        value = self.function(part)
        if len(part) <= PART_LONGEST:
            self.size += ENTRY + 4 * len(part) + (len(value) if isinstance(value, bytes) else 0)
            if self.size > self.limit:
                self.clear()
                self.size = ENTRY
            self[part] = value
        return value


#: Characters that texts have had and whose class is settled.
_SETTLED: set[str] = set(map(chr, range(128)))


def settled(text: str) -> bool:
    """Whether tables of all versions class the characters of a text alike: assigned ones that `regex` and Python agree on."""
    if text.isascii():
        return True
    new = set(text) - _SETTLED
    for c in new:
        kind = unicodedata.category(c)
        own = kind[0] if kind[0] in "LN" else "S" if kind[0] == "Z" or c == "\x85" else ""
        here = next((k for k, m in _CLASSES if m.match(c)), "")
        if kind == "Cn" or own != here:
            return False
    _SETTLED.update(new)
    return True


def slices(text: str) -> Iterator[str]:
    """A text in turn, cut before spaces that follow something else than white space; no part crosses such a cut."""
    at = 0
    while len(text) - at > SLICE and (cut := _BREAK.search(text, at + SLICE)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def unicode_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level BPE file of the `tokenizers` library; special: whether its special strings in a text are its special tokens."""

    def __init__(self, data: bytes, special: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = not special
        spec = json.loads(data)
        front = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or front.get("type") != "ByteLevel" or front.get("add_prefix_space") or not front.get("use_regex", True):
            raise ValueError("only byte-level files without a normaliser or a prefixed space are cut into pre-tokens here")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added) or any(not t["special"] for t in added):
            raise ValueError("only plain special tokens are known here")
        self.special = {t["content"]: t["id"] for t in added} if special else {}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        self._at = unicode_bytes()
        self._shown = {b: c for c, b in self._at.items()}
        self._merge = self.library.model.tokenize
        self.size = self.library.get_vocab_size()

    def parts(self, text: str) -> Iterator[list[str]]:
        """Lists of pre-tokens, and of special strings where those count, in turn."""
        for stretch in self._cut.split(text) if self._cut else (text,):
            if stretch in self.special:
                yield [stretch]
            elif settled(stretch):
                for part in slices(stretch):
                    yield _PARTS.findall(part)
            elif stretch:
                yield [stretch[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(stretch)]

    def encode(self, part: str) -> list[int]:
        """The ids of a pre-token or of a special string."""
        if part in self.special:
            return [self.special[part]]
        return [t.id for t in self._merge(part.encode().decode("latin-1").translate(self._shown))]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id."""
        return [bytes(map(self._at.__getitem__, t)) if (t := self.library.id_to_token(i)) not in self.special else t.encode() for i in range(self.size)]


class Pieces:
    """A model of the `sentencepiece` library that puts a space before a text and has no piece with a space behind another character."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.size = self.library.get_piece_size()
        self.pieces = [self.library.id_to_piece(i) for i in range(self.size)]
        if any("▁" in p.lstrip("▁") for p in self.pieces) or self.library.encode("x ", out_type=str)[-1:] != ["▁"] or self.library.encode("x", out_type=str)[0][:1] != "▁":
            raise ValueError("only models that keep spaces, put one before a text and have none inside pieces are cut at spaces here")
        self._x = len(self.library.encode("x"))

    def parts(self, text: str) -> Iterator[list[str]]:
        """Lists of parts of space+text, each with its spaces in front; nothing of an empty text. A visible space is a space to the library."""
        if text:
            for part in slices(" " + text.replace("▁", " ")):
                yield _UNITS.findall(part)

    def encode(self, part: str) -> list[int]:
        """The ids of a part behind something else, as which a letter stands."""
        return self.library.encode("x" + part)[self._x :]

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id: visible spaces are spaces, byte pieces are bytes."""
        byte = self.library.is_byte
        return [bytes([int(p[3:5], 16)]) if byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]


def load(path: str) -> bytes:
    """The bytes of a vocabulary file, which the driver reads and workers get; they stay under some megabytes."""
    with open(os.path.realpath(path), "rb") as f:
        return f.read()


@functools.lru_cache(4)
def _made(digest: str, kind: str, special: bool, data: bytes) -> ByteLevel | Pieces:
    return Pieces(data) if kind == "model" else ByteLevel(data, special)


def encoder(path: str, data: bytes, special: bool = True) -> ByteLevel | Pieces:
    """The encoder of a file's bytes, made once per process; its name tells the library: .json or .model."""
    kind = path.rpartition(".")[2]
    if kind not in ("json", "model"):
        raise ValueError(f"{path} is neither a .json nor a .model file")
    return _made(hashlib.sha256(data).hexdigest(), kind, special, data)
