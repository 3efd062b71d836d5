"""Hashes of five-word shingles, computed on whole arrays of bytes."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])

WORDS = 5
SLICE_CHARACTERS = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: every input bit reaches every output bit."""
    z = np.array(x, "uint64")
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.where(_SPACE, np.uint64(0), mixed(np.arange(1, 257, dtype="uint64") * BASE))
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_STEPS = mixed(np.arange(101, 101 + 16, dtype="uint64")) | np.uint64(1)
_powers = {BASE: np.ones(1, "uint64"), INVERSE: np.ones(1, "uint64")}


def power(base: np.uint64, count: int) -> np.ndarray:
    """The first ``count`` powers of ``base``, kept for the next text."""
    if _powers[base].size < count:
        steps = np.full(max(count, 1 << 16), base, "uint64")
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:count]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, a run of UTF-8 bytes without space, tab or line break characters.

    A word's hash is a polynomial in the hashes of its bytes, summed for all words at once: bytes count by their place in
    the text, and the sum is divided by the power at the word's start. White space counts 0.
    """
    raw = np.frombuffer(text.encode(), "uint8")
    inside = np.zeros(raw.size + 1, bool)
    np.logical_not(_SPACE[raw], out=inside[1:])
    starts = np.flatnonzero(inside[1:] > inside[:-1])
    if not starts.size:
        return np.zeros(0, "uint64")
    terms = _BYTE[raw]
    terms *= power(BASE, raw.size)
    return mixed(np.add.reduceat(terms, starts) * power(INVERSE, raw.size)[starts])


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """A hash for each run of ``words`` words in order; one for all words of a shorter text, none without words."""
    h = word_hashes(text)
    if h.size == 0:
        return h
    runs = h.size - words + 1
    if runs < 1:
        words, runs = h.size, 1
    out = np.full(runs, words, "uint64")
    for i in range(words):
        out += h[i:i + runs] * _STEPS[i]
    return mixed(out)


def slices(rows: Sequence[tuple], characters: int = SLICE_CHARACTERS) -> Iterator[list[tuple]]:
    """``rows`` of texts in runs of about so many characters, at least one row each."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += sum(len(t) for t in row if t)
        if size >= characters:
            yield some
            some, size = [], 0
    if some:
        yield some
