"""Token alignment against the two libraries and plain interval comparisons."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from lectern.llm import alignment
from lectern.llm.common import tokenizer_file
from lectern.llm.queries import op11_alignment

SMALL = "/root/testdata/sf0.001"
TEXTS = [
    None,
    "",
    " ",
    "one",
    "Hello, wörld! 中文 \U0001f600 it's 12,345.",
    "a  b\n\nc \t d ",
    " leading and trailing ",
    "line\nline\r\nline\tx",
    "odd \x00 \x1c \x85 \xa0 here",
    "a▁b",
    "fine words here",
    "x ▁ y",
    "<|endoftext|> <s> </s> <unk> <0x41>",
    "ġ Ġ Ċ",
    "é ﬁ ​ ﻿",
    "the cat the dog the cat",
    "the cat the dog the cat",
    "unbelievable antidisestablishmentarianism",
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(tokenizer_file(alignment.BYTE_BPE))
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=tokenizer_file(alignment.PIECE_BPE))
    byte_of = {c: i for i, c in enumerate(_byte_level())}

    def tokens(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids]
        right = []
        for i in b.encode(text):
            piece = b.id_to_piece(i)
            raw = bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()
            right.append((i, raw))
        whole = (" " + text).encode()
        if b"".join(r for _, r in left) != whole or b"".join(r for _, r in right) != whole:
            return [], []
        return left, right

    def digests(rows):
        """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, checksum."""
        out, links_of, total = [], [], Counter()
        for d, text in rows:
            left, right = tokens(text)
            ends_a = np.cumsum([len(r) for _, r in left]).tolist()
            ends_b = np.cumsum([len(r) for _, r in right]).tolist()
            links, j = [], 0
            for i, end in enumerate(ends_a):
                start = end - len(left[i][1])
                while j and ends_b[j - 1] > start:
                    j -= 1
                while j < len(right) and ends_b[j] - len(right[j][1]) < end:
                    if ends_b[j] > start:
                        links.append((left[i][0], right[j][0]))
                    j += 1
            groups, i, j = [], 0, 0
            for end in sorted(set(ends_a) & set(ends_b)):
                p, q = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
                ids = (",".join(str(x) for x, _ in side) for side in (left[i:p], right[j:q]))
                groups.append("|".join(ids))
                i, j = p, q
            written = ";".join(groups)
            total.update(links)
            links_of.append(links)
            out.append((d, len(left), len(right), len(groups), len(links), written))
        best = Counter()
        for (_, y), n in total.items():
            best[y] = max(best[y], n)
        return [
            (
                *row[:5],
                sum(total[x] == best[x[1]] for x in links),
                sum(total[x] for x in links),
                hashlib.sha256(row[5].encode()).hexdigest() if row[5] else "",
            )
            for row, links in zip(out, links_of, strict=True)
        ]

    digests.tokens = tokens
    return digests


def _byte_level():
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out, n = [], 0
    for b in range(256):
        out.append(chr(b) if b in printable else chr(256 + n))
        n += b not in printable
    return out


def _key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed", range(20))
def test_gallop(seed):
    rng = np.random.default_rng(seed)
    long = np.unique(rng.integers(0, 200_000, rng.integers(1, 30_000)))
    short = np.sort(rng.integers(0, long[-1] + 1, rng.integers(0, 9_000)))
    assert np.array_equal(alignment.gallop(short, long), np.searchsorted(long, short))


def test_units_give_the_library_ids(plain):
    pair = alignment.TokenPair(
        tokenizer_file(alignment.BYTE_BPE), tokenizer_file(alignment.PIECE_BPE), cache_units=20
    )
    rng = random.Random(5)
    parts = ["the", "cat", " ", "\n", "\t", "é", "x1", "'s", "\xa0", "\x1c", "中", ".", "Ġ", "  "]
    texts = TEXTS + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(30)) for _ in range(300)]
    for text in texts:
        left, right = plain.tokens(text)
        a, b = pair.encode(text)
        assert np.frombuffer(a, "<u4").tolist() == [i for i, _ in left], repr(text)
        assert np.frombuffer(b, "<u4").tolist() == [i for i, _ in right], repr(text)


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(TEXTS), (3, "one"), (3, "one"), (None, "the cat"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(d, t, 1, "p", [2]) for d, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, row int, _text string, pairs array<int>").repartition(3)


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_digests(spark, docs, rows, plain, limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = alignment.alignment_digests(docs, broadcast_pairs=limit)
        assert _key(found.collect()) == _key(plain(rows))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = found._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin [pair" in joins) == bool(limit)


def test_query_on_the_small_tables(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert _key(op11_alignment(spark, SMALL).collect()) == _key(plain(rows))


def test_alignment_as_rows(docs, plain):
    out = alignment.align_documents(docs)
    assert out.columns == ["doc_id", "text", "row", "_text", "ids_a", "ids_b", "last_a", "last_b", "pairs"]
    found = {r.doc_id: r for r in out.filter("doc_id IN (0, 5, 9, 15)").collect()}
    for d, r in found.items():
        left, right = plain.tokens(TEXTS[d])
        assert (r.ids_a, r.ids_b) == ([i for i, _ in left], [i for i, _ in right])
        assert len(r.last_a) == len(r.last_b) and r.last_a[-1:] == ([len(left) - 1] if left else [])
    assert sum(p.links for p in found[15].pairs) >= len(found[15].ids_a)
    nothing = docs.limit(0)
    assert alignment.align_documents(nothing).count() == 0
    assert alignment.alignment_digests(nothing).count() == 0
    with pytest.raises(ValueError):
        alignment.align_documents(docs, text_col="pairs")
