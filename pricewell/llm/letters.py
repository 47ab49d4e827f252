"""Letter words of whole texts as 64-bit hashes, made a piece of bounded size at a time.

A word is a run of letters of the lower-cased text. Pieces are cut where no letter stands, so that no word is cut, however
long a text is; nothing is kept between pieces, so a Python worker's memory doesn't grow with the words it has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from pricewell.llm.shingles import U, mix, powers

#: Characters per piece, about.
PIECE = 1 << 18
#: Where a text may be cut: none of these is a letter.
CUT = re.compile(r"[\W\d_]")
#: Odd multipliers for the characters of an n-gram.
PLACES = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)]


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.uint8).view(bool)


@dataclass
class Words:
    """The words of some texts: `doc` (index of its text), `first` and `last` place in `codes`."""

    codes: np.ndarray
    sums: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def hashes(self) -> np.ndarray:
        return self._hash(self.first, self.last, U(0))

    def starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the first k letters, index of the word) of the words longer than k."""
        at = np.flatnonzero(self.last - self.first > k)
        first = self.first[at]
        return self._hash(first, first + k, U(k << 40)), at

    def _hash(self, first: np.ndarray, last: np.ndarray, tag: np.uint64) -> np.ndarray:
        _, down = powers(len(self.codes) + 1)
        return mix((self.sums[last] - self.sums[first]) * down[first] + (last - first).astype(U) + tag)

    def padded(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of "^word$" one after another, length of each) of the words `at`."""
        n = self.last[at] - self.first[at]
        size = n + 2
        begin = np.cumsum(size) - size
        out = np.full(int(size.sum()), ord("^"), np.uint32)
        place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(begin + 1, n) + place] = self.codes[np.repeat(self.first[at], n) + place]
        out[begin + size - 1] = ord("$")
        return out, size


def gram_hash(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k characters from each place on."""
    h = np.full(len(at), U(k))
    for j in range(k):
        h += mix(codes[at + j].astype(U) + U(1)) * PLACES[j]
    return mix(h)


def words_of(texts: Iterable[str | None]) -> Iterator[Words]:
    """The words of the texts, in order, a piece at a time; null counts as empty."""
    parts: list[str] = []
    docs: list[int] = []
    n = 0
    for d, whole in enumerate(texts):
        text, at = (whole or "").lower(), 0
        while at < len(text):
            end = at + PIECE
            if end < len(text):
                found = CUT.search(text, end)
                end = found.start() if found else len(text)
            parts.append(text[at:end])
            docs.append(d)
            n, at = n + min(end, len(text)) - at, end
            if n >= PIECE:
                yield _words(parts, docs)
                parts, docs, n = [], [], 0
    if parts:
        yield _words(parts, docs)


def _words(parts: list[str], docs: list[int]) -> Words:
    codes = np.frombuffer("\n".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(codes) + 2, bool)
    letter[1:-1] = letter_table()[codes]
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    first, last = edge[::2], edge[1::2]
    up, _ = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U)
    np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)], out=sums[1:])
    begin = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    return Words(codes, sums, np.array(docs)[np.searchsorted(begin, first, "right") - 1], first, last)


def find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each asked number in the rising keys, -1 if it isn't there."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)
