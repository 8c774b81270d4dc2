"""Hashed words and n-grams of texts in numpy, for work inside tasks."""

from __future__ import annotations

import re
import sys
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

WORD = re.compile(r"[^\W_]+")
# Odd multipliers of splitmix64
STEP, FIRST, SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * FIRST
    x = (x ^ (x >> np.uint64(27))) * SECOND
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words; at most ``keep`` are remembered."""

    def __init__(self, keep: int = 400_000):
        super().__init__()
        self.keep = keep

    def __missing__(self, word: str) -> int:
        if len(self) >= self.keep:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the runs of letters and digits in lower case, in order."""
        found = WORD.findall((text or "").lower())
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))

    def of_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``of`` for many texts: the hashes of all of them in order, and of each hash the place of its text."""
        spaced = pc.utf8_trim(pc.replace_substring_regex(pa.array([(x or "").lower() for x in texts], pa.string()), between(), " "), " ")
        found = pc.split_pattern(pc.if_else(pc.equal(spaced, ""), None, spaced), " ")
        # each distinct word is looked up once
        words = found.flatten().dictionary_encode()
        hashes = np.fromiter(map(self.__getitem__, words.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(words.dictionary))
        counts = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False)
        return hashes[words.indices.to_numpy()], np.repeat(np.arange(len(texts)), counts)


@lru_cache(maxsize=1)
def between() -> str:
    """What lies between two words as a pattern of Arrow's, its letters and digits those of ``WORD``."""
    runs = [[c for _, c in run] for held, run in groupby(((WORD.match(chr(c)) is not None, c) for c in range(sys.maxunicode + 1)), lambda x: x[0]) if held]
    return "[^" + "".join(rf"\x{{{run[0]:x}}}-\x{{{run[-1]:x}}}" for run in runs) + "]+"


def joined(*parts: np.ndarray) -> np.ndarray:
    """One hash of several aligned arrays of hashes; their order counts."""
    out = mix(parts[0] + STEP)
    for p in parts[1:]:
        out = mix(out * STEP + p)
    return out


@lru_cache(maxsize=1)
def worker_words() -> Words:
    """The word hashes of this Python worker, kept from task to task."""
    return Words()
