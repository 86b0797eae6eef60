"""Letter n-grams of words, counted in hashed tables of a fixed size.

Counting and scoring see a word as its letters with ``order - 1`` marks in front and one behind. An n-gram is known by
its hash in a table of ``2 ** bits`` places; so the size of a model is bounded by its parameters, whatever the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np

LETTERS = re.compile(r"[^\W\d_]+")
ASCII_LETTERS = re.compile(r"[a-z]+")  # the same in lower-case ASCII, in about half the time
PIECE = 1 << 20  # characters of a text taken at a time
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> Iterator[list[str]]:
    """Lower-case letter runs of the whole text; long texts are read in pieces cut where a word cannot be."""
    start = 0
    while text and start < len(text):
        end = start + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        piece = text[start:end].lower()
        yield (ASCII_LETTERS if piece.isascii() else LETTERS).findall(piece)
        start = end


def word_counts(text: str | None) -> Counter:
    counts: Counter = Counter()
    for words in words_of(text):
        counts.update(words)
    return counts


class Grams:
    """All n-grams of a list of words: ``places(n)`` gives the table place of the n-gram that ends at each letter."""

    def __init__(self, words: list[str], order: int, bits: int):
        self.order, self.bits = order, bits
        lengths = np.fromiter((len(w) for w in words), np.int64, len(words)) + order
        flat = "".join("\x02" * (order - 1) + w + "\x03" for w in words)
        self.codes = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        at = np.arange(len(self.codes)) - np.repeat(self.starts, lengths)
        self.ends = np.flatnonzero(at >= order - 1)
        sizes = lengths - (order - 1)
        self.words = np.repeat(np.arange(len(words)), sizes)
        self.first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(words) else np.zeros(0, np.int64)
        self.letters = [self.codes[self.ends - k] for k in range(order)]  # those 0, 1, ... letters before each end

    def places(self, n: int, back: int = 0) -> np.ndarray:
        """Place of the n-gram that ends ``back`` letters before each end; 0-grams all have place 0."""
        value = np.full(len(self.ends), n, np.uint64)
        for k in range(n):
            value += self.letters[back + k]
            value *= _PRIME
            value ^= value >> np.uint64(29)
        return ((value * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64) if n else np.zeros(len(self.ends), np.int64)


def total(places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places and the sum of their weights, which are above zero."""
    sums = np.bincount(places, weights=weights)
    keys = np.flatnonzero(sums)
    return keys, sums[keys]


class WordScores:
    """Scores of words, computed for many new words at once and remembered up to ``limit`` words."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], limit: int = 200_000):
        self.compute, self.limit = compute, limit
        self.known: dict[str, int] = {}
        self.scores: np.ndarray | None = None

    def rows(self, counts: list[Counter]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For a few documents: score of each distinct word, its count, the first row of each document, words per document."""
        if len(self.known) > self.limit:
            self.known, self.scores = {}, None
        known = self.known
        new = [w for w in set().union(*counts) if w not in known]
        if new:
            scored = self.compute(new)
            self.scores = scored if self.scores is None else np.concatenate((self.scores, scored))
            known.update(zip(new, range(len(known), len(known) + len(new))))
        sizes = np.fromiter((len(c) for c in counts), np.int64, len(counts))
        ids = np.fromiter((known[w] for c in counts for w in c), np.int64, int(sizes.sum()))
        n = np.fromiter((v for c in counts for v in c.values()), np.float64, int(sizes.sum()))
        return self.scores[ids], n, np.cumsum(sizes) - sizes, sizes


def groups(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, list[Counter]]]:
    """Word counts of consecutive texts, about ``most`` characters at a time."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(word_counts(text))
        size += len(text or "")
        if size >= most:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held
