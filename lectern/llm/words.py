"""Words of texts as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import xxhash

# Words hashed together, so that array calls are few.
GROUP_WORDS = 150_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHasher:
    """XXH64 of words; on real vocabularies hashing a word again is cheaper than looking it up."""

    def __init__(self, seed: int = 0):
        self.seed = seed

    def hashes(self, words: list[bytes]) -> np.ndarray:
        digests = b"".join(map(xxhash.xxh64_digest, words, repeat(self.seed)))
        return np.frombuffer(digests, ">u8").astype(np.uint64)


class Group:
    """Documents whose words lie one after another in ``words`` and ``hashes``."""

    def __init__(self, rows: list[int], words: list[bytes], lengths: list[int], hasher: WordHasher):
        self.rows = rows
        self.words = words
        self.bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int64)
        self.lengths = np.array(lengths, np.int64)
        self.hashes = hasher.hashes(words)
        self.doc_of = np.repeat(np.arange(len(rows)), self.lengths)

    def inside(self, n: int) -> np.ndarray:
        """For each word: does a run of n words from here stay in its document?"""
        return np.arange(len(self.words)) + n <= self.bounds[1:][self.doc_of]


def groups(texts: Iterable[bytes | None], hasher: WordHasher) -> Iterator[Group]:
    """Split texts at ASCII white space, in groups of some hundred thousand words.

    A null text has no words. Every text is in exactly one group, however long it is.
    """
    rows: list[int] = []
    words: list[bytes] = []
    lengths: list[int] = []
    for row, text in enumerate(texts):
        own = text.split() if text else []
        rows.append(row)
        lengths.append(len(own))
        words += own
        if len(words) >= GROUP_WORDS:
            yield Group(rows, words, lengths, hasher)
            rows, words, lengths = [], [], []
    if rows:
        yield Group(rows, words, lengths, hasher)


def runs(hashes: np.ndarray, n: int, step: np.uint64 = _STEP) -> np.ndarray:
    """A hash of every run of n words, for each run's first word."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= step
        out += hashes[i : i + size]
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole number."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))
