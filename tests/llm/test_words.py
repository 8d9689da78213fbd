"""Hashes of words and look-ups in lists of hashes, as the repeated-passage stage uses them."""

import numpy as np
import pyarrow as pa
import xxhash

from lectern.llm import substrings
from lectern.llm.words import WordHasher


def test_words_are_hashed_without_a_growing_cache():
    words = [b"w%d" % (i % 7_000) for i in range(20_000)] + [b"", "ü".encode(), b"x" * 5_000]
    for seed in (0, 1):
        hasher = WordHasher(seed=seed)
        before = len(vars(hasher))
        assert hasher.hashes(words).tolist() == [xxhash.xxh64_intdigest(w, seed) for w in words]
        assert hasher.hashes([]).dtype == np.uint64 and not len(hasher.hashes([]))
        # A cache was slower than hashing where vocabularies are large.
        assert len(vars(hasher)) == before and not any(isinstance(v, dict) for v in vars(hasher).values())


def test_listed_hashes_are_found():
    rng = np.random.default_rng(3)
    rows = [None, [], [5], *(rng.integers(-50, 50, n).tolist() for n in (3, 40)), [-(1 << 63), (1 << 63) - 1]]
    values = np.array([*range(-60, 60), -(1 << 63), (1 << 63) - 1], np.int64).view(np.uint64)
    for column in (pa.array(rows, pa.list_(pa.int64())), pa.array([[1], *rows], pa.list_(pa.int64())).slice(1)):
        for row, listed in zip(rows, substrings._listed(column), strict=True):
            assert substrings._among(values, listed).tolist() == [v in (row or []) for v in values.view(np.int64).tolist()]
