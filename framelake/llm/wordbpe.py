"""Exact token counts and ids of a lower-casing word BPE vocabulary, one white-space word at a time.

The vocabulary's own rules (normalise, lower-case, split, merge) never look across white space, so the
tokens of a text are those of its words in turn, and a word's tokens can be kept. Texts with characters
outside a checked range, or with one of the vocabulary's special strings, go whole to the library.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata

import numpy as np
import xxhash
from tokenizers import Tokenizer

#: Tasks are the parallelism: the library's own threads would only contend with them.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Up to here, each character's class and lower case agree between Python and the library (see the tests).
LAST_SIMPLE = 0x17F
_CHARS = [chr(c) for c in range(LAST_SIMPLE + 1)]
_LETTERS = re.escape("".join(c for c in _CHARS if unicodedata.category(c)[0] == "L"))
_NUMBERS = re.escape("".join(c for c in _CHARS if unicodedata.category(c)[0] == "N"))
#: Control characters that only Python takes for white space are not simple either.
NOT_SIMPLE = re.compile("[^\x00-\x1b\x20-ſ‐-‧€]")
#: The split rule of the vocabulary file (fixed value), for simple lower-case words.
PRE_TOKEN = re.compile(f"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")


class WordBpe:
    """Words to tokens through the library, with the simple texts told apart."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def simple(self, text: str) -> bool:
        return (text.isascii() and not re.search("[\x1c-\x1f]", text) or not NOT_SIMPLE.search(text)) and not any(s in text for s in self.special)

    @staticmethod
    def words(text: str) -> list[str]:
        """Lower-case words of a simple text."""
        return text.lower().split()

    def ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids  # no offsets are worked out


@functools.lru_cache(2)
def loaded(path: str) -> WordBpe:
    """One tokenizer for all tasks that a worker runs."""
    return WordBpe(path)


class WordCache(dict):
    """key -> value, filled by a function on a miss; of two generations, so that frequent keys outlive a full one."""

    def __init__(self, fill, limit: int):
        super().__init__()
        self.fill, self.limit, self.older = fill, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.fill(key)
        self[key] = value
        return value


class CompactTable:
    """Open-addressed table from the 64-bit hash of a string to a small number, held in two NumPy arrays.

    9 to 20 bytes an entry whatever the strings' lengths; built once, broadcast, and read in workers.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    @staticmethod
    def key(piece: str) -> int:
        return xxhash.xxh64_intdigest(piece.encode()) | 1  # zero marks a free slot

    @classmethod
    def build(cls, entries: list[tuple[int, int]]) -> CompactTable:
        size = 1 << max(4, (2 * len(entries)).bit_length())
        keys, values = np.zeros(size, np.uint64), np.zeros(size, np.uint16)
        for key, value in entries:
            at = key & (size - 1)
            while keys[at] and int(keys[at]) != key:
                at = (at + 1) & (size - 1)
            keys[at], values[at] = key, value
        return cls(keys, values)

    def get(self, key: int) -> int | None:
        mask = len(self.keys) - 1
        at = key & mask
        while found := int(self.keys[at]):
            if found == key:
                return int(self.values[at])
            at = (at + 1) & mask
        return None


class IdCache:
    """word or pre-token -> the bytes of its ids. What a batch brings anew is encoded in one call, as one text.

    A pre-token by itself is a word of one pre-token, so one table serves both; a word of letters only is
    never split. Of two generations, so that frequent words outlive a full table. Only the last token of a
    pre-token carries the vocabulary's end-of-word mark, which tells them apart.
    """

    def __init__(self, bpe: WordBpe, wide: str, limit: int):
        self.bpe, self.wide, self.limit = bpe, wide, limit
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocab = bpe.library.get_vocab()
        mark = bpe.library.model.end_of_word_suffix
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if mark and t.endswith(mark)]] = True

    def _missing(self, words: set[str]) -> set[str]:
        """Those words that neither generation has; what the older one has is taken over."""
        new = words.difference(self.known)
        if self.older:
            self.known.update((w, self.older[w]) for w in new if w in self.older)
            new = new.difference(self.known)
        return new

    def learn(self, words: set[str]) -> None:
        """Make all these words known."""
        if len(self.known) > self.limit:
            self.known, self.older = {}, self.known
        new = self._missing(words)
        split = {w: PRE_TOKEN.findall(w) for w in new if not w.isalpha()}
        ask = list(self._missing(new.difference(split).union(*split.values())))
        ids = np.array(self.bpe.ids(" ".join(ask)), self.wide)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) == len(ask):
            data, size, start = ids.tobytes(), ids.itemsize, 0
            for p, end in zip(ask, (ends * size).tolist(), strict=True):
                self.known[p], start = data[start:end], end
        else:  # a vocabulary without the mark
            self.known.update((p, np.array(self.bpe.ids(p), self.wide).tobytes()) for p in ask)
        get = self.known.__getitem__
        self.known.update((w, b"".join(map(get, parts))) for w, parts in split.items() if len(parts) > 1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        split = [self.bpe.words(t) if self.bpe.simple(t) else None for t in texts]
        self.learn(set().union(*[s for s in split if s]))
        get = self.known.__getitem__
        return [b"".join(map(get, s)) if s is not None else np.array(self.bpe.ids(t), self.wide).tobytes() for s, t in zip(split, texts, strict=True)]


@functools.lru_cache(2)
def id_cache(path: str, wide: str, limit: int) -> IdCache:
    """One cache for all tasks that a worker runs: what a vocabulary makes of a word never changes."""
    return IdCache(loaded(path), wide, limit)


@functools.lru_cache(2)
def length_caches(path: str, limit: int) -> tuple[WordCache, WordCache]:
    """Caches of word and pre-token lengths for all tasks that a worker runs; the caller sets how they are filled."""
    return WordCache(None, limit), WordCache(None, limit)
