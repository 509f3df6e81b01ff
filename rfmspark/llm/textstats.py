"""Vectorised text statistics that the quality operators (6 and 10) share: one kernel call per slice of texts."""

from __future__ import annotations

import numpy as np

from rfmspark.llm.common import U64, mix, prefix_hash, rolling, span_hash, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_DOC = U64(0x632BE59BD9B4E019)


def per_text(mask_cumsum: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return mask_cumsum[offs[1:]] - mask_cumsum[offs[:-1]]


def count_in(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return per_text(c, offs)


def first_of(keys: np.ndarray) -> np.ndarray:
    """For each key the place where it stands first."""
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    first = np.empty(len(keys), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
    return first


class Texts:
    """Words, their hashes and the window statistics of a slice of texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1
        self.start, self.end, self.at = words(buf, offs)
        self.n_words = np.diff(self.at)
        self.doc = np.repeat(np.arange(self.n), self.n_words)
        self.prefix = prefix_hash(buf)
        self.hash = span_hash(self.prefix, self.start, self.end)
        self.points = (buf & 0xC0) != 0x80  # bytes that begin a code point

    def by_doc(self, values: np.ndarray, doc: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc if doc is None else doc, weights=values, minlength=self.n)

    def word_chars(self) -> np.ndarray:
        c = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(self.points, out=c[1:])
        return self.by_doc(c[self.end] - c[self.start]).astype(np.int64)

    def n_symbols(self) -> np.ndarray:
        return count_in(SYMBOLS[self.buf], self.offs)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of the \\n-split lines that hold a word."""
        nl = np.flatnonzero(self.buf == 10)
        s, e = np.sort(np.concatenate([self.offs[:-1], nl + 1])), np.sort(np.concatenate([nl, self.offs[1:]]))
        held = np.searchsorted(self.start, e) > np.searchsorted(self.start, s)
        s, e = s[held], e[held]
        return s, e, np.searchsorted(self.offs, s, side="right") - 1

    def n_dup_lines(self) -> np.ndarray:
        s, e, doc = self.lines()
        key = mix(span_hash(self.prefix, s, e) + doc.astype(U64) * _DOC)
        return self.by_doc(first_of(key) != np.arange(len(key)), doc).astype(np.int64)

    def repeat_words(self, width: int = 3) -> np.ndarray:
        """Per text: words that lie in a window of ``width`` words found twice or more in the text."""
        h = rolling(self.hash, width)
        n = len(h)
        if not n:
            return np.zeros(self.n, np.int64)
        inside = self.doc[:n] == self.doc[width - 1:]
        place = np.flatnonzero(inside)
        key = mix(h[place] + self.doc[place].astype(U64) * _DOC)
        first = first_of(key)
        again = first != np.arange(len(key))
        rep = again.copy()
        rep[first[again]] = True
        mark = np.zeros(len(self.hash) + 1, np.int64)
        np.add.at(mark, place[rep], 1)
        np.add.at(mark, place[rep] + width, -1)
        return self.by_doc(np.cumsum(mark[:-1]) > 0).astype(np.int64)

    def n_distinct(self) -> np.ndarray:
        key = mix(self.hash + self.doc.astype(U64) * _DOC)
        return self.by_doc(first_of(key) == np.arange(len(key))).astype(np.int64)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of single words and word pairs, with their text numbers."""
        two = rolling(self.hash, 2)
        inside = self.doc[:len(two)] == self.doc[1:] if len(two) else np.zeros(0, bool)
        return np.concatenate([self.hash, two[inside]]), np.concatenate([self.doc, self.doc[:-1][inside] if len(two) else self.doc[:0]])
