"""Periodic runs against a version that tries every period at every word."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lectern.llm import periods
from lectern.llm.queries import looped, op12_periodic_runs

EMPTY = hashlib.sha256(b"").hexdigest()


def plain_runs(words, min_words=24, exponent=3):
    """Maximal stretches of every period, without those that have a smaller one."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(min_words, exponent * q):
                part = words[i : i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def _runs(words, **kw):
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words], np.int64)
    return periods.find_runs(ids, np.array([0, len(ids)]), **kw).get(0, [])


def _planted(rng):
    words = [rng.choice("abcdefgh") for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(1, 4)):
        base = [rng.choice("abcd") for _ in range(rng.randrange(1, 90))]
        n = rng.randrange(2 * len(base), 5 * len(base) + 30)
        words += (base * (n // len(base) + 1))[:n]
        words += [rng.choice("abcdefgh") for _ in range(rng.randrange(20))]
    return words


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_planted_words(seed):
    words = _planted(random.Random(seed))
    assert _runs(words) == plain_runs(words)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_two_letters(seed):
    rng = random.Random(1000 + seed)
    words = [rng.choice("ab") for _ in range(rng.randrange(10, 400))]
    assert _runs(words, min_words=6) == plain_runs(words, 6)
    words = list("abaababaabaab" * 20)[: rng.randrange(30, 250)]
    assert _runs(words) == plain_runs(words)


def test_runs_do_not_cross_documents():
    ids = np.zeros(60, np.int64)
    assert periods.find_runs(ids, np.array([0, 20, 36, 60])) == {2: [(0, 24, 1)]}
    assert periods.find_runs(ids[:0], np.array([0, 0])) == {}
    with pytest.raises(ValueError):
        periods.find_runs(ids, np.array([0, 60]), min_exponent=2)


def test_long_runs_take_few_extensions(monkeypatch):
    calls = []
    real = periods._agreeing
    monkeypatch.setattr(periods, "_agreeing", lambda *a: calls.append(a) or real(*a))
    assert _runs(["x"] * 200_000) == [(0, 200_000, 1)]
    assert len(calls) == 1


TEXTS = [
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "a b c " * 8),
    (5, "a b c " * 7),
    (6, "start " + "x\ty " * 30 + "end"),
    (7, "same " * 300),
    (8, "same " * 300),
    (8, "same " * 300),
    (None, "q r " * 20),
    (9, "w " * 24 + "v " * 24 + " ".join(f"u{i % 40}" for i in range(130))),
    (10, "café 中文 " * 20 + "café 中文 " * 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, 5, "k") for d, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, start int, _text string").repartition(3)


def _digest(doc_id, words):
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def _key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_digests_and_odd_rows(docs):
    want = [_digest(d, (t or "").encode().split()) for d, t in TEXTS]
    found = periods.run_digests(docs)
    assert _key(found.collect()) == _key(want)
    none = found.filter("doc_id = 1").first()
    assert none.n_runs == 0 and none.start is None and none.runs_sha256 == EMPTY == none.collapsed_sha256
    assert periods.run_digests(docs.limit(0)).count() == 0


def test_runs_as_rows_and_collapsed_texts(docs):
    rows = periods.periodic_runs(docs)
    assert rows.columns == ["doc_id", "start", "length", "period"]
    want = [(d, *r) for d, t in TEXTS for r in plain_runs((t or "").encode().split())]
    assert _key(rows.collect()) == _key(want)
    cut = periods.collapse_runs(docs)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] is None and texts[3] == " \t\n" and texts[4] == "a b c" and texts[7] == "same"
    assert texts[5] == "a b c " * 7 and texts[6] == "start x y end"
    assert periods.periodic_runs(docs.limit(0)).count() == periods.collapse_runs(docs.limit(0)).count() == 0


def plain_loop(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_on_the_small_tables(spark):
    where = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()
    want, planted = [], 0
    for d, t in rows:
        words = (t or "").encode().split()
        assert looped(d, words) == plain_loop(d, words)
        planted += looped(d, words) != words
        if len(words) <= 1500:
            want.append(_digest(d, plain_loop(d, words)))
    assert planted > 10
    ids = {w[0] for w in want}
    found = [tuple(r) for r in op12_periodic_runs(spark, where).collect()]
    assert len(found) == len(rows)
    assert _key(r for r in found if r[0] in ids) == _key(want)
