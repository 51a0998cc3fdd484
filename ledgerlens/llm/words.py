"""Words of whole texts as numpy arrays: positions, hashes, windows.

A batch of UTF-8 texts is one byte array; words are runs of bytes that are
no separators.  Every step works on the whole array, never word by word,
so a batch costs a few passes over its bytes whatever the word count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import GOLDEN64, IS_SPACE, mix64, random64

_PLACES = 64                                     # places of a word with a row of their own
_PLACE_CODES = random64(256 * _PLACES, 11)       # place * 256 + byte -> code
_STEP = np.uint64(int(random64(1, 13)[0]) | 1)


@dataclass
class Words:
    data: np.ndarray      # bytes of all texts
    offsets: np.ndarray   # text i is data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray    # first byte of each word
    ends: np.ndarray      # one past its last byte
    first: np.ndarray     # text i has words first[i]:first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text index of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def find_words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> Words:
    solid = ~separator[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def byte_sums(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Prefix sums of the codes of all bytes; a code depends on the byte and on its
    distance from the last of ``starts``.

    One such array serves all words of a batch and all their beginnings.  Codes are
    pseudo-random per (place, byte), so no two different strings collide for a reason
    of arithmetic, as they do in a polynomial modulo 2^64."""
    n = len(data)
    place = np.zeros(n, dtype=np.int64)
    place[starts] = starts
    place = np.arange(n) - np.maximum.accumulate(place)
    code = _PLACE_CODES[(place & (_PLACES - 1)) << 8 | data]
    far = np.flatnonzero(place >= _PLACES)
    with np.errstate(over="ignore"):
        if len(far):
            code[far] = mix64(code[far] + (place[far] // _PLACES).astype(np.uint64) * GOLDEN64)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(code, out=sums[1:])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range, which begins at one of the ``starts``
    of ``byte_sums`` and does not reach the next."""
    with np.errstate(over="ignore"):
        return mix64(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64) * _STEP)


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash per word."""
    return range_hashes(byte_sums(words.data, words.starts), words.starts, words.ends)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out) if n else out


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the word
    index each begins at (texts with fewer words have none)."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        steps = _powers(_STEP, size)
        value = np.zeros(n - size + 1, dtype=np.uint64)
        for k in range(size):
            value += hashes[k: n - size + 1 + k] * steps[k]
        value = mix64(value)
    inside = np.zeros(n + 1, dtype=bool)
    for k in range(1, size):          # a window may not begin in the last size-1 words of a text
        at = first[1:] - k
        inside[at[at >= first[:-1]]] = True
    begin = np.flatnonzero(~inside[: n - size + 1])
    return value[begin], begin
