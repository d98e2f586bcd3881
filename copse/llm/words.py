"""Ids of whole texts through a table of words.

The texts of a batch lie one after the other in Arrow's own buffer. They are cut
into words there, every byte in one word, at places where the tokenizer cuts too.
Arrow numbers the distinct words of a window, so that Python looks up each of them
once a window, and takes the ids of all words by their numbers. What words are,
and how new ones are encoded, is told by the tokenizer's own subclass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Marks that end a word of letters, where the tokenizer cuts before them.
MARKS = ".,;:!?"


def flags(chars) -> np.ndarray:
    """By byte, whether it is one of these."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


def letter_before(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the byte before each place ends a letter of ASCII or Latin-1; others are not told."""
    one, two = raw[np.maximum(at - 1, 0)], raw[np.maximum(at - 2, 0)]
    return (at > 0) & (ASCII_LETTER[one] | (one >= 0x80) & (two == 0xC3) & (one != 0x97) & (one != 0xB7))


ASCII_LETTER = flags((*range(65, 91), *range(97, 123)))


class WordTable:
    """Words and their ids as little-endian bytes, in two generations of half the bound each.

    Words that are met stay in or move to the younger; when that is full the older one goes.
    """

    def __init__(self, dtype, entry_bytes: int):
        self.dtype, self.entry_bytes = np.dtype(dtype), entry_bytes
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.size = 0  # bytes in the younger generation
        self.fold: np.ndarray | None = None  # by byte, what a word has in its place

    def cuts(self, raw: np.ndarray, bounds: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Where words of raw[lo:hi] begin, ascending: lo, where texts that aren't empty begin (bounds), and others."""
        raise NotImplementedError

    def learn(self, fresh: list[bytes]) -> None:
        """Keeps the ids of these words, which neither generation has."""
        raise NotImplementedError

    def keep(self, words: list[bytes], ids: list[bytes]) -> None:
        self.known.update(zip(words, ids, strict=True))
        self.size += sum(map(len, words)) + sum(map(len, ids)) + self.entry_bytes * len(words)

    def moved(self, words: list[bytes]) -> list[bytes]:
        """Those of the words that neither generation has; the older's move to the younger."""
        words = [w for w in words if w not in self.known]
        if self.older:
            old = list(filter(self.older.__contains__, words))
            self.keep(old, [self.older[w] for w in old])
            words = [w for w in words if w not in self.older]
        return words

    def _window(self, raw: np.ndarray, cuts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words that begin at the cuts, and how many are before each word and at the end."""
        edges = np.append(cuts, len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        own = words.dictionary.to_pylist()
        found = list(map(self.known.get, own))
        gaps = [i for i, x in enumerate(found) if x is None]
        self.learn(self.moved([own[i] for i in gaps]))
        for i in gaps:
            found[i] = self.known[own[i]]
        ids = pa.array(found, pa.binary()).take(words.indices)
        before = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1) // self.dtype.itemsize
        if self.size > most // 2:
            self.known, self.older, self.size = {}, self.known, 0
        return np.frombuffer(ids.buffers()[2] or b"", self.dtype, before[-1]), before

    def ids_of(self, text: pa.Array, window: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (and the last's end); null is empty. About window bytes are worked on at a time."""
        text = text.cast(pa.large_string())
        text = text.fill_null("") if text.null_count else text
        bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset) if len(text) else np.zeros(1, np.int64)
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        out, starts, lo, total = [], np.zeros(len(bounds), np.int64), 0, 0
        while lo < len(raw):
            hi = min(lo + window, len(raw))
            while len(cuts := self.cuts(raw, bounds, lo, hi)) < 2 and hi < len(raw):  # a word of over a window
                hi = min(2 * hi - lo, len(raw))
            if hi < len(raw):
                cuts, hi = cuts[:-1], int(cuts[-1])
            own = raw[lo:hi] if self.fold is None else self.fold[raw[lo:hi]]
            ids, before = self._window(own, cuts - lo, most)
            a, b = np.searchsorted(bounds, (lo, hi))
            starts[a:b] = total + before[np.searchsorted(cuts, bounds[a:b])]
            out.append(ids)
            lo, total = hi, total + len(ids)
        starts[np.searchsorted(bounds, lo) :] = total
        return (np.concatenate(out) if len(out) != 1 else out[0]) if out else np.empty(0, self.dtype), starts
