"""Word shingles of texts and their hashes: A-Z in lower case, words cut at ASCII white space, XXH64 with seed 42."""

from __future__ import annotations

from itertools import accumulate

import numpy as np

SEED = 42


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def hashes(found: list[bytes], words: int) -> np.ndarray:
    """One hash for each run of ``words`` words, repeats included; of fewer words, that of the whole sequence."""
    from xxhash import xxh64_intdigest

    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends[:-words]]
    return np.fromiter((xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[words - 1 :])), np.uint64, len(starts))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    return hashes(words_of(text), words)


def mixed(values: np.ndarray, t: int) -> np.ndarray:
    """Independent values for table ``t``; those of table 0 are the given ones."""
    if not t:
        return values
    z = values + np.uint64(0x9E3779B97F4A7C15 * t % (1 << 64))
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)
