"""The fingerprint tree of the near-duplicate stage, and how its candidates grow with a group."""

import random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import resemblance, simhash
from tests.llm.test_resemblance import brute_force, near_copies


def test_nearest_before_is_that_of_all_pairs(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(4)
    points = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    for i in range(300, 900):
        flipped = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 7), dtype=np.uint64))
        points[i] = points[rng.integers(0, i)] ^ flipped
    found = simhash.nearest_before(points, 3)
    distances = np.bitwise_count(points[:, None] ^ points[None, :]).astype(int)
    for i in range(len(points)):
        least = distances[i, :i].min(initial=4)
        assert (found[i] == i) if least > 3 else (found[i] < i and distances[i, found[i]] == least)


def test_stage_takes_pairs_from_the_tree(spark, monkeypatch):
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen = []
    plain_verified = resemblance.verified

    def verified(pairs, *others):
        out = plain_verified(pairs, *others)
        seen.append(({tuple(r) for r in pairs.select("a", "b").collect()}, {tuple(r) for r in out.collect()}))
        return out

    monkeypatch.setattr(resemblance, "verified", verified)
    found = resemblance.similar_documents(frame, propose=simhash.close_sets).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_force(rows), key=repr)
    seen.clear()
    simhash.keep_first(frame).collect()
    proposed, linked = seen[0]
    assert linked and linked <= proposed and len(seen) > 1
    # What the tree linked is not compared again.
    assert not linked & set().union(*(pairs for pairs, _ in seen[1:]))


def _group(size, seed):
    rng = random.Random(seed)
    hot = [f"w{rng.randrange(10_000)}" for _ in range(150)]
    texts = []
    for _ in range(size):
        own = list(hot)
        for at in rng.sample(range(150), 2):
            own[at] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    return texts


def test_candidates_grow_with_a_group_not_with_its_square(spark, monkeypatch):
    plain_pairs, made = resemblance._pairs, []

    def counted(rows, threshold):
        made[-1] += rows.filter((F.col("root") != F.col("other_root")) & resemblance._fits(threshold)).count()
        return plain_pairs(rows, threshold)

    monkeypatch.setattr(resemblance, "_pairs", counted)
    for size in (50, 200):
        made.append(0)
        texts = [t for group in range(3) for t in _group(size, group)]
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        kept = {r.doc_id for r in simhash.keep_first(frame).collect()}
        assert kept == {d for d, c in brute_force(list(enumerate(texts))) if d == c}
    assert made[1] <= 6 * max(made[0], 200), made
