"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words seen before.

The tokenizer drops white space and never joins across it, so a text's ids are
those of its words one after another.  A worker keeps the ids of words and of
the parts they consist of; only parts not seen yet go through the merges.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import regex

MOST_WORDS = 1_000_000  # remembered by a worker; beyond that it starts over
SIZE_BITS = 24  # of a word's number of ids, beside the place where they begin

# How the tokenizer splits a normalised word into parts.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Letters for which lower-casing is all that normalising does, and signs beside them.
PLAIN = regex.compile(r"[!-~¡-ɏ]+")
# Signs of ASCII, which are a part of their own behind letters.
SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum())


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: itself if it prints, else the next free one from 256."""
    prints = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()
LETTER_OF = [chr(BYTE_LETTERS[b]) for b in range(256)]


def _plain_letters(word: bytes) -> bool:
    if word.isascii():
        return word.isalpha()
    text = word.decode("utf-8", "replace")
    return text.lower().isalpha() and PLAIN.fullmatch(text) is not None


class Words(dict):
    """Words by place; a word that is asked for the first time is learned."""

    def __init__(self, learn):
        self.learn = learn

    def __missing__(self, word: bytes) -> int:
        place = self[word] = self.learn(word)
        return place


class WordTokenizer:
    """Ids by a tokenizer file; equal to encoding the text at once without special tokens added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.words = Words(self._learn)
        self.parts: dict[str, list[int]] = {}
        self.pool = array("I")

    def _letters(self, part: str) -> list[int]:
        """Ids of a part in lower case."""
        if not part.isascii():
            part = "".join([LETTER_OF[b] for b in part.encode()])
        return [t.id for t in self.model.tokenize(part)]

    def _part(self, part: str) -> list[int]:
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = self._letters(part)
        return ids

    def _ids(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and "<|" not in text:
            low = text.lower()
            if low.isalpha():
                return self._letters(low)
            if low[:-1].isalpha():
                return self._part(low[:-1]) + self._part(low[-1])
            return [i for part in PARTS.findall(low) for i in self._part(part)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, word: bytes) -> int:
        stem = word.rstrip(SIGNS)
        if len(stem) < len(word) and b"<|" not in word and _plain_letters(stem):  # the stem's ids, as learned, and those of the signs
            at = self.words[stem]
            first = at >> SIZE_BITS
            ids = [*self.pool[first:first + (at & ((1 << SIZE_BITS) - 1))], *self._part(word[len(stem):].decode())]
        elif word.isalpha() and word.islower():  # letters of ASCII
            ids = [t.id for t in self.model.tokenize(word.decode())]
        else:
            ids = self._ids(word)
        place = len(self.pool) << SIZE_BITS | len(ids)
        self.pool.extend(ids)
        return place

    def encode(self, text: str | bytes | None) -> np.ndarray:
        """Ids of one whole text, a string or its UTF-8 bytes, as unsigned 32-bit integers; a null text has none."""
        raw = text.encode() if isinstance(text, str) else text or b""
        # Special tokens are told by their letters as they are.
        words = (raw if b"<|" in raw else raw.lower()).split()
        if not words:
            return np.zeros(0, np.uint32)
        if len(self.words) > MOST_WORDS:
            self.forget()
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        sizes = at & ((1 << SIZE_BITS) - 1)
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat((at >> SIZE_BITS) - (ends - sizes), sizes)
        return np.frombuffer(self.pool, np.uint32)[places]


_held: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for each worker process and file."""
    if path not in _held:
        _held[path] = WordTokenizer(path)
    return _held[path]
