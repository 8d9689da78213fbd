"""Every operator of the training-data package against a plain version of itself."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import (
    decontaminate,
    packing,
    quality,
    sharding,
    simhash,
    substrings,
    token_counts,
    token_files,
    tokens,
    topk,
    warc,
)
from lectern.llm.common import tokenizer_file
from lectern.llm.components import components
from lectern.session import scratch_path
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Score double, mix int, _id int"


def _passage(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefghijklm") + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies, shared passages."""
    shared, long = _passage(1, 70), _passage(2, 40_000)
    texts = [
        None,
        "",
        " \t\n",
        "one",
        "One  two",
        "one two three four five six seven eight nine ten eleven twelve thirteen",
        long,
        long.replace(" ", "  ", 3) + " end",
        _passage(3, 50) + " " + shared + " " + _passage(4, 50),
        _passage(5, 30) + " " + shared,
        shared[:200] + "\n" + shared,
        "café 中文 \U0001f600 " * 30,
        "same " * 100,
        "same " * 90,
    ]
    texts += [_passage(10, 400) + f" v{i}" for i in range(25)]
    out = [(10 + i, t) for i, t in enumerate(texts)]
    return [*out, out[5], (10, "another text with the id of the first"), (None, shared), (None, None), (5, "one")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(d, t, "en", "s", None if t is None else len(t), 1.5, 3, 4) for d, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def small_rows(small):
    return [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_near_duplicates(docs, rows, small, small_rows, nothing):
    for frame, plain_rows in ((docs, rows), (small, small_rows)):
        found = simhash.near_duplicates(frame).select("doc_id", "fingerprint", "component_id").collect()
        assert _sorted(found) == _sorted(plain.near_duplicates(plain_rows))
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id = 5").count() == 1


def test_links_over_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 64)
    rng = random.Random(7)
    fps = set()
    for _ in range(300):
        at = rng.getrandbits(64)
        for _ in range(10):
            fps.add(at)
            at ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    signed = [(fp - (1 << 64) if fp >> 63 else fp,) for fp in fps]
    found = components(simhash.fingerprint_links(spark.createDataFrame(signed, "fp long")), "a", "b")
    groups = defaultdict(set)
    for node, root in found.collect():
        groups[root].add(node % (1 << 64))
    want = defaultdict(set)
    for fp, c in plain.classes(list(fps)).items():
        want[c].add(fp)
    assert _sorted(map(sorted, groups.values())) == _sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_close_pairs_in_small_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(3)
    points = np.unique(rng.integers(0, 1 << 14, 400).astype(np.uint64))
    found = {frozenset((int(a), int(b))) for p, q in simhash.close_pairs(points, 2) for a, b in zip(p, q, strict=True)}
    near = np.bitwise_count(points[:, None] ^ points[None]) <= 2
    assert found == {frozenset((int(a), int(b))) for a, b in zip(*np.nonzero(near), strict=True) if a < b}


def test_quality_uses_texts_alone_and_holds_out(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = {r.doc_id: r for r in quality.quality_scores(small, labels).collect()}
    assert len(found) == small.count()
    for d, r in found.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    # Labels of held-out rows change nothing.
    other = labels.withColumn(
        "quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    again = {r.doc_id: r.score for r in quality.quality_scores(small, other).collect()}
    assert again == {d: r.score for d, r in found.items()}


def test_quality_on_held_out_labels(spark):
    where = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{where}/labels.parquet")
    scored = quality.quality_scores(spark.read.parquet(f"{where}/documents.parquet"), labels)
    held = scored.filter("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert len(held) > 40 and sum(p == q for p, q in held) / len(held) > 0.85


def test_leading_directions_are_those_of_the_decomposition():
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((200, 30)) * 0.8 ** np.arange(30)) @ rng.standard_normal((30, 90))
    found = quality.leading_directions(x.astype(np.float32), 8)
    right = np.linalg.svd(x, full_matrices=False)[2][:8].T
    assert np.allclose(found @ found.T, right @ right.T, atol=1e-3)
    assert quality.leading_directions(np.ones((3, 9), np.float32), 8).shape == (9, 1)


def test_quality_on_odd_rows(docs, rows, nothing, spark):
    labels = spark.createDataFrame([(20, 1), (21, 0), (12, 1), (12, 0), (99, 1)], "doc_id long, quality int")
    assert quality.quality_scores(docs, labels).count() == len(rows)
    kept = quality.keep_good(docs.withColumn("_score", F.lit("own")), labels)
    assert kept.columns == [*docs.columns, "_score"]
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.quality_scores(nothing, labels).count() == 0


def test_repeats(docs, rows, small, small_rows, nothing):
    for frame, plain_rows in ((docs, rows), (small, small_rows)):
        want = [(d, n, gone, plain.sha256(kept)) for d, n, gone, kept in plain.repeats(plain_rows)]
        assert _sorted(substrings.repeat_digests(frame).collect()) == _sorted(want)
    out = substrings.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_words", "n_removed", "factors"]
    spans = {r.doc_id: r.factors for r in out.filter("doc_id IN (19, 20)").collect()}
    assert [(s.start, s.length) for s in spans[19]] == [(30, 70)]
    assert substrings.remove_repeats(nothing).count() == 0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_file(tokens.BYTE_BPE))
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_word_cache_gives_the_library_ids(library, rows, small_rows):
    own = tokens.WordEncoder(tokenizer_file(tokens.BYTE_BPE), cache_words=50)
    odd = ["a\nb", "\na", "a\n\nb", " a", "a ", "a\tb", "it's\nit's 12\n34", "a<|endoftext|>b", "x y", "a\r\nb", "a  b", "Ġa b"]
    odd += ["a... b' c'' d's. e'll! f1. g²! ", "x é. é! é", "Ġ. Ġ! \n.\n!a\nb.", ". ! a. a! a"]
    texts = [t for _, t in [*rows, *small_rows[:80]] if t] + odd
    for text in texts:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library(text)
    for found, text in zip(own.encode(texts), texts, strict=True):
        assert np.frombuffer(found, "<u4").tolist() == library(text)


@pytest.mark.parametrize("which", ["odd", "small"])
def test_packing(docs, rows, small, small_rows, library, which):
    frame, plain_rows = (docs, rows) if which == "odd" else (small, small_rows)
    found = packing.pack_documents(frame).collect()
    want, total = [], 0
    for d, t in plain_rows:
        ids = [*library(t), 2]
        total += len(ids)
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        want += [(d, k, i, j - i, _crc(ids[i:j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert _sorted(r[:5] for r in found) == _sorted(want)
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 1024
    assert len(bins) <= 1.02 * total / 1024 + 2


def test_best_fit_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 7, 3, 5, 4)] == [(0, 0), (1, 0), (1, 7), (2, 0), (0, 6)]
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 5, 9, 5, 4)] == [(0, 0), (1, 0), (2, 0), (1, 5), (3, 0)]


def test_packing_keeps_columns_and_empty_tables(docs, nothing):
    pieces = packing.cut_pieces(docs).withColumns({"mix": F.lit(1), "task": F.lit("t"), "offset": F.lit(9)})
    out = packing.pack(pieces, 50)
    assert set(out.columns) == set(pieces.columns) | {"sequence_id"}
    assert {(r.mix, r.task) for r in out.select("mix", "task").collect()} == {(1, "t")}
    assert packing.pack_documents(nothing).count() == 0


def test_sharding(docs, rows, small, nothing):
    for frame in (docs, small):
        found = sharding.shard_documents(frame).collect()
        assert len(found) == frame.count()
        slots = defaultdict(list)
        for r in found:
            slots[r.shard].append(r.slot)
            assert r.law == "key" and r.grown_shard in (r.shard, 16)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = {d: t or "" for d, t in rows if d and d > 10}
    for r in sharding.shard_documents(docs).filter("doc_id > 10").collect():
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.shard_documents(nothing).count() == 0


def test_shards_follow_weights_and_move_little(spark):
    keys = spark.range(20_000)
    at = F.col("id")
    both = keys.select(
        sharding.rendezvous_shard(at, [1, 2, 1]).alias("a"), sharding.rendezvous_shard(at, [1, 2, 1, 1]).alias("b")
    )
    n = Counter(tuple(r) for r in both.collect())
    held = Counter()
    for (a, b), c in n.items():
        assert b in (a, 3)
        held[a] += c
    assert abs(held[1] / 20_000 - 0.5) < 0.02 and abs(sum(c for (_, b), c in n.items() if b == 3) / 20_000 - 0.2) < 0.02


def _plain_pages(pages):
    least = {}
    for i, html in pages:
        raw = (html or "").encode()
        least[raw] = min(i, least.get(raw, i))
    out = []
    for i, html in pages:
        raw = (html or "").encode()
        first = least[raw] == i
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "response" if first else "revisit", None if first else least[raw]))
    return out


def test_warc(spark, nothing):
    pages = [(i, f"http://h/{i}", t) for i, t in enumerate([None, "", "a", "a", "中" * 40_000, "\r\n\r\nWARC/1.1\r\n" * 9000])]
    pages += [(9, "u\r\nx: y", "中" * 40_000), (2, "again", "a"), (7, None, "\x00 b\n")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = _plain_pages([(i, t) for i, _, t in pages])
    assert _sorted(warc.archive_pages(frame.withColumn("digest", F.lit("x"))).collect()) == _sorted(want)
    assert warc.archive_pages(frame.limit(0)).count() == 0
    small = spark.read.parquet(f"{SMALL}/pages.parquet")
    want = _plain_pages([(r.page_id, r.html) for r in small.select("page_id", "html").collect()])
    assert _sorted(warc.archive_pages(small).collect()) == _sorted(want)


def test_warc_damage_is_named(spark):
    schema = warc._RECORD
    part = ("a", "a", 1, None, "response", 1, "d", b"HTTP/1.1 200 OK\r\n\r\nab", None)
    tail = ("b", "a", 2, 23, "continuation", 1, None, b"cd", None)
    late = ("b", "a", 3, 23, "continuation", 1, None, b"cd", None)
    for records, error, payload in (
        ([tail, part], None, b"abcd"),
        ([part, tail, tail], None, b"abcd"),
        ([part, late], "missing_segment", None),
        ([part], "missing_segment", None),
        ([part, (*tail[:3], 99, *tail[4:])], "wrong_length", None),
    ):
        row = warc.decode_payloads(warc.reassemble(spark.createDataFrame(records, schema))).collect()
        assert [(r.error, r.payload and bytes(r.payload)) for r in row] == [(error, payload)]
    for bad in (b"5\r\nab\r\n0\r\n\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.decode_http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + bad)


def test_token_files(spark, docs, rows, library, nothing):
    manifest = token_files.write_token_files(docs, scratch_path(spark, "t"), docs_per_file=9, tokenizer=None)
    assert manifest.count() > 2
    found = token_files.read_token_files(manifest).orderBy("start").collect()
    at = 0
    want = Counter((d, tuple([*library(t), 0])) for d, t in rows)
    for r in found:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert r.start == at and len(ids) == r.n_tokens
        at += r.n_tokens
        want[(r.doc_id, tuple(ids))] -= 1
    assert not +want and not -want
    ids = [r.doc_id for r in found if r.doc_id is not None]
    assert ids == sorted(ids)
    digests = token_files.token_files(docs, scratch_path(spark, "t")).collect()
    by_start = {r.start: r for r in found}
    assert all(_crc(np.frombuffer(by_start[r.start].ids, "<u2")) == r.ids_crc32 for r in digests)
    assert token_files.token_files(nothing, scratch_path(spark, "t")).count() == 0


def test_leaks(spark, docs, rows, small, small_rows, nothing):
    items = [(1, None), (2, ""), (3, "ONE"), (4, " ".join(_passage(1, 70).split()[5:40])), (4, "one two"), (5, "same same same same same same")]
    items += [(6, _passage(10, 400)), (7, "zebra " + " ".join(_passage(3, 50).split()[:12])), (None, "one")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = [tuple(r)[:4] for r in decontaminate.leak_pairs(docs, frame).collect()]
    assert set(found) == plain.leaks(rows, items)
    blocks = decontaminate.find_leaks(docs, frame, block_bytes=300).select("doc_id", F.explode("leaks"))
    assert {(d, *leak) for d, leak in blocks.collect()} == plain.leaks(rows, items)
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    listed = [(r.item_id, r.text) for r in bench.collect()]
    found = {tuple(r)[:4] for r in decontaminate.leak_pairs(small, bench).collect()}
    assert found == plain.leaks(small_rows, listed) and found
    clean = decontaminate.drop_contaminated(docs.withColumn("_leaks", F.lit(1)), frame)
    assert clean.columns == [*docs.columns, "_leaks"]
    assert decontaminate.leak_pairs(nothing, frame).count() == 0
    assert decontaminate.leak_pairs(docs, frame.limit(0)).count() == 0


def test_token_counts_are_the_library_counts(docs, rows, small_rows, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.unigram_vocabulary(tokenizer_file(token_counts.PIECE_MODEL))
    extra = [("<unk>", 0.0), *[(f"<0x{b:02X}>", 0.0) for b in range(256)]]
    library = Tokenizer(models.Unigram([*extra, *vocabulary], 0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace()
    found = token_counts.count_tokens(docs.select("doc_id", "text", "mix"))
    assert found.columns == ["doc_id", "text", "mix", "n_tokens"]
    for r in found.collect():
        assert r.n_tokens == (len(library.encode(r.text).ids) if r.text else 0), r.text[:60]
    counter = token_counts.UnigramCounter(vocabulary, cache_words=100)
    for _, text in small_rows:
        assert counter.count(text or "") == (len(library.encode(text).ids) if text else 0)
    assert token_counts.count_tokens(nothing).count() == 0


def test_top_k(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.3, 0.0, 0.25, 0.5, 1.0]) for _ in range(7)]) for i in range(230)]
    rows += [(230, None), (250, [None] * 7), (300, [float("nan")] * 7), (350, []), (400, [1.0, 2.0]), (450, [0.5, 1.0])]
    rows += [(None, [1.0] * 7), (50, [0.5] * 7)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    usable = [(i, v) for i, v in rows if i is not None]
    want = plain.top_k(usable, lambda q: q % 50 == 0)
    for parts in (1, 2, 3):
        found = topk.top_k(frame, F.col("vec_id") % 50 == 0, parts=parts).collect()
        assert _sorted(found) == _sorted(want)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0
