"""The near-duplicate stage against all pairs of exact Jaccard similarity."""

import random
from collections import defaultdict

import pytest

from lectern.llm import resemblance, simhash
from tests.llm import plain


def brute_force(docs, n=5, threshold=0.8):
    """Per row its component's smallest id, over all pairs that share a shingle."""
    sets = [frozenset(plain.shingles(plain.words(plain.lower(t)), n)) for _, t in docs]
    distinct = sorted(set(sets), key=sorted)
    at = {s: i for i, s in enumerate(distinct)}
    parent = list(range(len(distinct)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, s in enumerate(distinct):
        shared = defaultdict(int)
        for x in s:
            for j in by[x]:
                shared[j] += 1
            by[x].append(i)
        for j, m in shared.items():
            if m >= threshold * (len(s) + len(distinct[j]) - m) - 1e-9:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for (d, _), s in zip(docs, sets, strict=True):
        if d is not None:
            least[find(at[s])] = min(d, least.get(find(at[s]), d))
    return [(d, least.get(find(at[s]))) for (d, _), s in zip(docs, sets, strict=True)]


def near_copies():
    """Copies with some words changed, at similarities on both sides of 0.8, in chains too."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(300))
    line = [word() for _ in range(25)]
    texts = [None, "", " \n", "one", "One", "one two three", "one two  three", "one two four", "one two three four five"]
    for size in (12, 30, 60, 200):
        for _ in range(12):
            first = [word() for _ in range(size)]
            texts.append(" ".join(first))
            for _ in range(4):
                own = list(first)
                for _ in range(rng.randrange(1, 2 + size // 25)):
                    own[rng.randrange(size)] = word()
                texts.append(" ".join(own))
                if rng.random() < 0.4:
                    first = own
    texts += [" ".join(line + [word() for _ in range(rng.randrange(4, 60))]) for _ in range(60)]
    # A group of near copies, all of one text.
    hot = [word() for _ in range(120)]
    for _ in range(80):
        own = list(hot)
        for _ in range(rng.randrange(1, 5)):
            own[rng.randrange(120)] = word()
        texts.append(" ".join(own).upper() if rng.random() < 0.3 else " ".join(own))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts, strict=True), (None, texts[20]), (None, None), (3, "a row with the id of another")]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("pairs_per_row", [8, 0])
def test_components_are_those_of_all_pairs(spark, monkeypatch, pairs_per_row):
    monkeypatch.setattr(resemblance, "PAIRS_PER_ROW", pairs_per_row)
    rows = near_copies()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_force(rows)
    found = resemblance.similar_documents(frame).collect()
    assert _sorted(found) == _sorted(want)
    kept = simhash.keep_first(frame).collect()
    gone = {d for d, c in want if d is not None and d != c}
    assert _sorted(kept) == _sorted(r for r in rows if r[0] not in gone)
    assert resemblance.similar_documents(frame.limit(0)).count() == 0


def test_stage_on_documents_misses_no_pair(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept == {d for d, c in brute_force(rows) if d == c} and not {2, 56} <= kept
