"""Token ids of the public tokenizers, with a cache of the ids of each pre-token.

Both vocabularies are byte-pair encoders that merge within one pre-token only, so a text's ids are
those of its pre-tokens put together. Pre-tokens are cut by the vocabulary's own pattern; the
tokenizers library's model merges each new one once, and the cache serves the rest. Texts
with characters outside the plain range below, or with a special token's string, go to the library
whole, so every id is one that the library gave.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Latin letters whose case and composition are simple; the plain range is ASCII without odd controls, and these.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
PLAIN = re.compile("[\\t\\n\\r -~À-ÖØ-öø-įı-ňŊ-ž]*")
#: Pre-token patterns of the two vocabularies, written for the plain range, letters first: no other branch starts with one.
BYTE_LEVEL = re.compile(rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
WORD_LEVEL = re.compile(rf"[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s{LETTERS}0-9]+")
#: Pre-tokens of one generation of the cache. When it is full it becomes the old one, of which only what
#: occurs again is carried over, so memory is bounded and frequent words stay.
CACHE = 150_000


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pretokens(dict):
    """The ids of each pre-token, as bytes; the library's model merges those that are new."""

    def __init__(self, model):
        self.model, self.letters, self.old = model, byte_alphabet(), {}

    def turn(self) -> None:
        """Makes this generation the old one."""
        self.old = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.pop(word, None)) is not None:
            self[word] = ids
            return ids
        written = word.encode().decode("latin-1").translate(self.letters)
        found = self.model.tokenize(written)
        ids = struct.pack(f"<{len(found)}H", *(t.id for t in found))
        self[word] = ids
        return ids


class Encoder:
    """encode(texts) gives each text's ids as little-endian bytes of two (all ids are below 65,536)."""

    def __init__(self, path: str, most: int = CACHE):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if max(self.library.get_vocab(with_added_tokens=True).values()) >= 1 << 16:
            raise ValueError("token ids beyond two bytes")
        self.word_level = self.library.model.end_of_word_suffix == "</w>"
        self.pattern = WORD_LEVEL if self.word_level else BYTE_LEVEL
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache, self.most = Pretokens(self.library.model), most

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        if len(self.cache) > self.most:
            self.cache.turn()
        words = self.pattern.findall(text.lower() if self.word_level else text)
        return b"".join(map(self.cache.__getitem__, words))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most: int = CACHE) -> Encoder:
    """One a Python worker for each vocabulary and size of cache."""
    if (path, most) not in _encoders:
        _encoders[path, most] = Encoder(path, most)
    return _encoders[path, most]
