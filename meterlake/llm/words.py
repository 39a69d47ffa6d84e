"""Words of whole texts as 64-bit hashes, in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash

#: Odd constants of 64-bit mixing.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
CACHE_WORDS = 200_000


class Hashes(dict):
    """xxh64 of a word, remembered; emptied when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(31))) * MIX_B
    return (x ^ (x >> np.uint64(29))) * MIX_A


def word_hashes(text: str | None, cache: Hashes, lower: bool = True) -> np.ndarray:
    """Hashes of the words of a text (null: none), parted by ASCII white space, A-Z lower-cased."""
    if not isinstance(text, str):
        return np.empty(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass")
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for every run of n words in turn; with fewer words, one for the whole sequence; without words, none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) + words[k : len(words) - n + 1 + k]
    return mix(out)


def whole_numbers(values) -> pd.array:
    """Integers, null or not, from a column that came as strings: pandas would make floats of integers with nulls."""
    return pd.array([None if x is None else int(x) for x in values], "Int64")
