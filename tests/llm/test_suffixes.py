"""Repeated byte strings against a dictionary of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from lectern.llm import suffixes
from lectern.llm.queries import op13_repeated_bytes

SMALL = "/root/testdata/sf0.001"


def plain_spans(texts, length):
    """Maximal removed runs of every text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 2, int)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1] += 1
                gone[i + 1 + length] -= 1 if i + 1 + length < len(gone) else 0
        covered = np.cumsum(gone)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.concatenate([covered, [False]]).astype(int)))
        out.append((t, list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))))
    return out


def plain_digests(rows, length):
    out = []
    for (d, _), (raw, spans) in zip(rows, plain_spans([t for _, t in rows], length), strict=True):
        left = bytes(b for i, b in enumerate(raw) if not any(x <= i < y for x, y in spans))
        removed = sum(y - x for x, y in spans)
        out.append((d, len(raw), removed, len(spans), hashlib.sha256(left).hexdigest()))
    return out


def _key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def _frame(spark, rows):
    full = [(d, t, 3, "k", 1.5) for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, row int, rank string, spans double").repartition(4)


def _corpus(seed, n=40):
    rng = random.Random(seed)
    shared = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(5, 120))) for _ in range(6)]
    texts = [None, "", "a", "é", "ab" * 60, "x" * 90, "y" * 90 + "x" * 45, "same text " * 9, "same text " * 9]
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 7)):
            s = rng.choice(shared)
            parts.append(s[rng.randrange(len(s)) :] if rng.random() < 0.5 else "".join(rng.choice("efgh ") for _ in range(30)))
        texts.append("".join(parts))
    return [*((10 + i, t) for i, t in enumerate(texts)), (None, texts[-1]), (10, "again " * 3)]


@pytest.mark.parametrize("length", [1, 7, 33, 60])
def test_digests(spark, length):
    rows = _corpus(length)
    found = suffixes.repeated_byte_digests(_frame(spark, rows), length)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert _key(found.collect()) == _key(plain_digests(rows, length))


def test_query_on_the_small_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = plain_digests(rows, 400)
    assert sum(r[2] > 0 for r in want) > 5
    assert _key(op13_repeated_bytes(spark, SMALL).collect()) == _key(want)


def test_texts_longer_than_a_piece(spark):
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefghij", k=2 * suffixes.PIECE_BYTES + 5000))
    at = suffixes.PIECE_BYTES - 300
    passage = text[at : at + 900]
    rows = [(1, text), (2, "z" * 50 + passage + "z" * 60)]
    found = {r.doc_id: r for r in suffixes.cut_repeated_bytes(_frame(spark, rows)).collect()}
    assert [(s.start, s.length) for s in found[1].spans] == [(at, 900)]
    assert found[1].text == text[:at] + text[at + 900 :] and found[2].text == "z" * 110


def test_cut_documents(spark):
    shared = "é" * 30
    rows = [(1, "ab" + shared + "cd"), (2, "x" + shared + "y"), (3, None), (3, None), (4, ""), (5, "short")]
    docs = _frame(spark, rows).withColumnRenamed("rank", "key_a")
    cut = suffixes.cut_repeated_bytes(docs, 40)
    assert cut.columns == ["doc_id", "text", "row", "key_a", "n_bytes", "n_removed", "spans"]
    found = [(r.doc_id, r.text, r.key_a, r.n_removed) for r in cut.collect()]
    assert _key(found) == _key(
        [(1, "abcd", "k", 60), (2, "xy", "k", 60), (3, None, "k", 0), (3, None, "k", 0), (4, "", "k", 0), (5, "short", "k", 0)]
    )
    nothing = docs.limit(0)
    assert suffixes.cut_repeated_bytes(nothing).count() == suffixes.repeated_byte_digests(nothing).count() == 0
    with pytest.raises(ValueError):
        suffixes.cut_repeated_bytes(docs, 0)


@pytest.mark.parametrize("seed", range(6))
def test_ranks_over_many_tasks(spark, seed):
    rng = random.Random(seed)
    spread = [40, 4, 1, 400, 1, 0][seed]
    pairs = [(rng.randrange(2), rng.randrange(spread + 1), i) for i in range([300, 60, 7, 200, 1, 90][seed])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame(pairs, "rank long, name long, at int").repartition(5)
        found = suffixes.repeated_only(rows, "rank", "name", ["at"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    times = Counter(p[:2] for p in pairs)
    assert sorted(r["at"] for r in found) == [p[2] for p in pairs if times[p[:2]] > 1]
    rank_of = {}
    for r in found:
        assert rank_of.setdefault(pairs[r["at"]][:2], r["rank"]) == r["rank"]
    assert len(set(rank_of.values())) == len(rank_of)
    assert sorted(rank_of, key=rank_of.get) == sorted(rank_of)


def test_pieces_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", 50)
    rng = random.Random(2)
    texts = [bytes(rng.choices(b"abc", k=n)) for n in (0, 5, 30, 130, 7, 51, 50, 49, 200)] + [None]
    seen = []
    for raw, starts, row, shift in suffixes._pieces(list(range(10)), texts, 7):
        for i, r, s in zip(starts.tolist(), row.tolist(), shift.tolist(), strict=True):
            assert raw[i : i + 7] == texts[r][i + s : i + s + 7]
            seen.append((r, i + s))
    assert sorted(seen) == [(r, i) for r, t in enumerate(texts) for i in range(len(t or b"") - 6)]
