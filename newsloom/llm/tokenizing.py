"""Quick ways into a BPE tokenizer of the tokenizers library, each exact: what they can't take goes to the library whole."""

from __future__ import annotations

import os
import re

import numpy as np
import public_tokenizers
import regex

#: Memory a cache of words and one of pre-tokens may take, and what an entry takes besides its bytes.
WORD_BYTES, PIECE_BYTES, ENTRY_BYTES = 96 << 20, 64 << 20, 150

# Pre-tokens of the tokenizer that drops white space.
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SPACED_PATTERN = regex.compile(public_tokenizers.PATTERN)
#: Characters that normalisation leaves alone but for their case.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _byte_characters() -> list[str]:
    """A visible character for each byte: its own where it has one, else those from 256 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


_BYTES = _byte_characters()


def visible(piece: str) -> str:
    """A pre-token as the byte-level model reads it."""
    if piece.isascii() and piece.isprintable() and " " not in piece:
        return piece
    return "".join([_BYTES[b] for b in piece.encode()])


class Cache(dict):
    """A dictionary that makes what it lacks; `trim` empties it when it has outgrown its bound."""

    def __init__(self, make, bound: int):
        super().__init__()
        self.make, self.bound, self.taken = make, bound, 0

    def __missing__(self, key):
        value = self[key] = self.make(key)
        self.taken += len(key) + ENTRY_BYTES
        return value

    def trim(self) -> None:
        if self.taken > self.bound:
            self.clear()
            self.taken = 0


class Library:
    """A tokenizer file, with its special strings."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = tuple(token.content for token in self.tokenizer.get_added_tokens_decoder().values())

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class WordEncoder(Library):
    """Ids of texts as bytes of little-endian unsigned 32-bit numbers, for any tokenizer.

    With `by_word`, for the lower-casing tokenizer that drops white space, texts are split at ASCII white space, and
    each word's and each pre-token's ids are remembered.
    """

    def __init__(self, path: str, by_word: bool = True):
        super().__init__(path)
        self.by_word = by_word
        self.words, self.pieces = Cache(self._word, WORD_BYTES), Cache(self._piece, PIECE_BYTES)
        self.id_bytes = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.ids(text), "<u4").tobytes()
        self.words.trim()
        self.pieces.trim()
        return b"".join(map(self.words.__getitem__, text.encode().split()))

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self.pieces[word.lower().decode()]
        bare = word[:-1]
        if bare.isalpha() and word[-1:] in (b".", b","):
            return self.pieces[bare.lower().decode()] + self.pieces[word[-1:].decode()]
        text = word.decode()
        if not _PLAIN.fullmatch(text) or any(token in text for token in self.special):
            return np.array(self.ids(text), "<u4").tobytes()
        return b"".join([self.pieces[piece] for piece in WORD_PATTERN.findall(text.lower())])

    def _piece(self, piece: str) -> bytes:
        named = self.id_bytes
        return b"".join([named[token.id] for token in self.model.tokenize(visible(piece))])


class LengthCounter(Library):
    """Token counts for the byte-level tokenizer that keeps white space.

    A unit is what single spaces cut from a text: its pre-tokens, read with the space before it; at the start of a line
    the line break takes the space's place. So each unit is a whole number of pre-tokens. Texts with any other white
    space are cut into pre-tokens instead, texts with special strings are the library's matter.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.units, self.pieces = Cache(self.unit_length, WORD_BYTES), Cache(self._piece, PIECE_BYTES)

    def unit_length(self, unit: str) -> int:
        if unit[:1] == "\n":
            return sum([self.pieces[piece] for piece in ["\n", *SPACED_PATTERN.findall(unit[1:])]])
        return sum([self.pieces[piece] for piece in SPACED_PATTERN.findall(f" {unit}")])

    def _piece(self, piece: str) -> int:
        return len(self.model.tokenize(visible(piece)))

    def count(self, text: str, frequent: dict[str, int]) -> int:
        if not text:
            return 0
        if any(token in text for token in self.special):
            return len(self.ids(text))
        self.units.trim()
        self.pieces.trim()
        units = units_of(text)
        if "" in units or "\n" in units or len(units) != len(text.split()):
            return sum([self.pieces[piece] for piece in SPACED_PATTERN.findall(text)])
        found = list(map(frequent.get, units))
        missed = [unit for unit, length in zip(units, found) if length is None]
        return sum(filter(None, found)) + sum(map(self.units.__getitem__, missed)) - self.pieces["\n"]


def units_of(text: str) -> list[str]:
    """The units of a text without loose white space; the first is read as if a line break stood before it."""
    return f"\n{text}".replace("\n", " \n").split(" ")[1:]


_WORKERS: dict[tuple, Library] = {}


def worker(kind: type, path: str, *options) -> Library:
    """The Python worker's own tokenizer for a file; it and its caches outlive the task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (kind.__name__, path, *options)
    if key not in _WORKERS:
        _WORKERS[key] = kind(path, *options)
    return _WORKERS[key]
