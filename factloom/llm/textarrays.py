"""Texts of a batch as flat arrays of code points and word hashes.

A batch of texts becomes one array of code points with offsets; words, their
hashes and shingles come from a fixed number of array passes over it, so no
Python code runs per word. All functions take whole texts; a null text counts
as an empty one.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np

_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts, and the n+1 offsets at which each text begins."""
    texts = [t or "" for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


@functools.cache
def word_table(marks: bool = False) -> np.ndarray:
    """For each code point, whether it is a letter or digit (or a combining mark)."""
    flags = np.zeros(sys.maxunicode + 1, bool)
    flags[[i for i in range(sys.maxunicode + 1) if chr(i).isalnum() or marks and unicodedata.combining(chr(i))]] = True
    return flags


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads nearby values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return (h ^ (h >> np.uint64(27))) * _MULT


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    out = np.full(n, _MULT, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_spans(cp: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of letters and digits, and the n+1 word offsets of the texts."""
    flags = word_table(marks)[cp]
    begins = flags.copy()
    begins[1:] &= ~flags[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(cp)]
    begins[inner] = flags[inner]
    start = np.flatnonzero(begins)
    ends = flags.copy()
    if len(ends):
        ends[:-1] &= ~flags[1:]
        last = inner[inner > 0] - 1
        ends[last] = flags[last]
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(cp: np.ndarray, offsets: np.ndarray, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the n+1 word offsets of the texts."""
    start, end, per_text = word_spans(cp, offsets, marks)
    if not len(start):
        return np.zeros(0, np.uint64), per_text
    length = end - start
    first = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=first[1:])
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    letters = cp[within + np.repeat(start, length)].astype(np.uint64)
    size = 1 << max(6, int(length.max()).bit_length())
    return mix(np.add.reduceat(mix(letters + np.uint64(1)) * _powers(size)[within], first)), per_text


def shingles(words: np.ndarray, per_text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``size`` consecutive words of each text, ascending, and their n+1 offsets."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(per_text), np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = mix(h + words[i : i + n])
    text = np.repeat(np.arange(len(per_text) - 1), np.diff(per_text))
    keep = text[:n] == text[size - 1 :]
    h, text = h[keep], text[:n][keep]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(per_text)))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


def slices(texts: list[str | None], most: int = 1 << 20):
    """Ranges (lo, hi) of the texts of about ``most`` characters together, so that work arrays stay small."""
    lo = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)
