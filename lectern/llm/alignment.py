"""Two tokenizers' ids over the same bytes: common borders, groups and overlapping pairs.

Every text is cut by a byte-level BPE (A, of a space and the text) and a piece BPE (B,
which puts that space there itself). The ends of both token lists are byte offsets. The
shorter list is driven into the longer one by galloping: from the rank of a neighbour
found before, steps double until an end is passed, and a binary search closes the gap.
An end found in the other list is a common border; borders cut both lists into groups,
and the ranks of a token's two ends give the tokens of the other side it overlaps.

How often each id pair is linked in the whole corpus is one aggregation over the
documents' distinct pairs. The table of pairs is broadcast if it is measured to be
small; otherwise it is joined by shuffle, where adaptive execution splits frequent pairs.

Units. Neither tokenizer lets a token cross a lone space between two other characters
that are no white space, so texts are encoded unit by unit through a bounded cache.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name, save_stage, tokenizer_file
from lectern.session import lookup_side

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
# Text bytes aligned together, so that array calls are few; a longer text goes alone.
GROUP_BYTES = 400_000
# Units in a generation of a worker's cache.
CACHE_UNITS = 200_000
# The most id pairs that are broadcast; more are joined by shuffle.
BROADCAST_PAIRS = 1_000_000
_SPACE = "▁"
_BREAKS = re.compile(r"(?<=\S) (?=\S)")
_IRREGULAR = re.compile(r"\s\s|^\s|\s$")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


class _ByteTokens:
    """Tokenizer A: ids of a space and a unit; an entry stands for the bytes it spells."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        byte_of = _spelled_bytes()
        names = [self._tokenizer.id_to_token(i) or "" for i in range(self._tokenizer.get_vocab_size())]
        self.spelled = [bytes(byte_of[c] for c in name if c in byte_of) for name in names]

    def ids(self, unit: str) -> list[int]:
        return self._tokenizer.encode_batch_fast([" " + unit], add_special_tokens=False)[0].ids


class _PieceTokens:
    """Tokenizer B: ids of a unit, to which the model adds the space before it."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.vocab_size())]
        if any(re.search(f"[^{_SPACE}]{_SPACE}", name) for name in names):
            raise ValueError("a piece of this model crosses the space between two words")
        self.spelled = [self._bytes(i, name) for i, name in enumerate(names)]

    def _bytes(self, i: int, name: str) -> bytes:
        if self._model.is_byte(i):
            return bytes([int(_BYTE_PIECE.fullmatch(name)[1], 16)])
        return name.replace(_SPACE, " ").encode()

    def ids(self, unit: str) -> list[int]:
        return self._model.encode(unit)


def _spelled_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for.

    Printable Latin-1 characters stand for themselves; the other bytes, in order, are
    written as the characters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Side:
    """One tokenizer with the ids of units it has met, as 32-bit little-endian bytes."""

    def __init__(self, tokens: _ByteTokens | _PieceTokens, cache_units: int):
        self.tokens, self.size = tokens, len(tokens.spelled)
        self.lengths = np.array([len(s) for s in tokens.spelled], np.int64)
        self._opens = np.array([s[:1] == b" " for s in tokens.spelled])
        self._cache_units = cache_units
        # False stands for a unit that its ids do not spell.
        self._known: dict[str, bytes | bool] = {}
        self._old: dict[str, bytes | bool] = {}

    def _spelled(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.spelled.__getitem__, ids.tolist()))

    def _learn_together(self, units: list[str]) -> None:
        """Encode units without blanks in a row: each begins where a token opens with a space."""
        joined = " ".join(units)
        ids = np.array(self.tokens.ids(joined), np.uint32)
        starts = np.flatnonzero(self._opens[ids])
        # If the row is spelled as a whole and cut where its units begin, so is each unit.
        if len(starts) == len(units) and self._spelled(ids) == b" " + joined.encode():
            raw = ids.tobytes()
            cuts = [*(starts * ids.itemsize).tolist(), len(raw)]
            self._known.update(zip(units, map(raw.__getitem__, map(slice, cuts, cuts[1:])), strict=True))

    def _learn(self, units: set[str], new: set[str], regular: bool) -> None:
        """Make all of a text's units known; ``new`` are those that are not."""
        if len(self._known) + len(new) > self._cache_units:
            self._old, self._known = self._known, {}
            new = set(units)
        again = self._old.keys() & new
        self._known.update(zip(again, map(self._old.__getitem__, again), strict=True))
        new -= again
        # The units of a regular text have neither blanks nor white space at their ends.
        clean = list(new) if regular else [u for u in new if u and " " not in u and not _IRREGULAR.search(u)]
        if _SPACE in "".join(clean):
            clean = [u for u in clean if _SPACE not in u]
        if clean:
            self._learn_together(clean)
        for u in new.difference(self._known):
            ids = np.array(self.tokens.ids(u), np.uint32)
            self._known[u] = self._spelled(ids) == b" " + u.encode() and ids.tobytes()

    def encode(self, units: list[str], regular: bool) -> bytes | None:
        """Ids of all units in a row; None if any of them does not spell itself."""
        wanted = set(units)
        new = wanted.difference(self._known)
        if new:
            self._learn(wanted, new, regular)
        # The join refuses the False of a unit that its ids do not spell.
        try:
            return b"".join(map(self._known.__getitem__, units))
        except TypeError:
            return None


class TokenPair:
    """Both tokenizers of an alignment."""

    def __init__(self, byte_bpe: str, piece_bpe: str, cache_units: int = CACHE_UNITS):
        self.a = _Side(_ByteTokens(byte_bpe), cache_units)
        self.b = _Side(_PieceTokens(piece_bpe), cache_units)

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of A and of B; none of either where one does not spell a space and the text."""
        if not text:
            return b"", b""
        regular = not _IRREGULAR.search(text)
        units = text.split(" ") if regular else _BREAKS.split(text)
        a = self.a.encode(units, regular)
        b = None if a is None else self.b.encode(units, regular)
        return (b"", b"") if b is None else (a, b)


_PAIRS: dict[tuple, TokenPair] = {}


def token_pair(byte_bpe: str | None = None, piece_bpe: str | None = None) -> TokenPair:
    """The worker's tokenizers; they live as long as the worker."""
    key = (byte_bpe or tokenizer_file(BYTE_BPE), piece_bpe or tokenizer_file(PIECE_BPE))
    if key not in _PAIRS:
        _PAIRS[key] = TokenPair(*key)
    return _PAIRS[key]


_STRIDES = (4096, 256, 16, 1)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each number of the shorter list the index of the first one in the longer not below it.

    Both are ascending and ``long`` ends at or above ``short``. Widely spaced numbers are
    placed first; those between gallop on from the place of the one before them, all at once.
    """
    ranks, last = np.zeros(len(short), np.int64), len(long) - 1
    for coarser, stride in zip((None, *_STRIDES), _STRIDES, strict=False):
        at = np.arange(0, len(short), stride)
        wanted = short[at]
        low = ranks[at // coarser * coarser] if coarser else np.zeros(len(at), np.int64)
        high, step = low.copy(), 1
        open_ = np.flatnonzero(long[high] < wanted)
        while len(open_):
            low[open_] = high[open_] + 1
            high[open_] = np.minimum(high[open_] + step, last)
            open_ = open_[long[high[open_]] < wanted[open_]]
            step *= 2
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            below = long[middle] < wanted[open_]
            low[open_] = np.where(below, middle + 1, low[open_])
            high[open_] = np.where(below, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        ranks[at] = high
    return ranks


class Aligned:
    """Texts in a row under both tokenizers: common borders and links between tokens."""

    def __init__(self, pair: TokenPair, texts: list[str | None]):
        self.pair = pair
        encoded = [pair.encode(t) for t in texts]
        self.a = np.frombuffer(b"".join(a for a, _ in encoded), np.uint32).astype(np.int64)
        self.b = np.frombuffer(b"".join(b for _, b in encoded), np.uint32).astype(np.int64)
        self.n_a = np.array([len(a) // 4 for a, _ in encoded], np.int64)
        self.n_b = np.array([len(b) // 4 for _, b in encoded], np.int64)
        ends_a, ends_b = np.cumsum(pair.a.lengths[self.a]), np.cumsum(pair.b.lengths[self.b])
        swapped = len(ends_b) < len(ends_a)
        short, long = (ends_b, ends_a) if swapped else (ends_a, ends_b)
        rank = gallop(short, long)
        common = long[rank] == short if len(short) else np.zeros(0, bool)
        borders = np.flatnonzero(common), rank[common]
        # Last token of every group, on either side.
        self.last_a, self.last_b = borders[::-1] if swapped else borders
        # A token reaches from the other side's token at its start to that at its end.
        first = np.zeros(len(rank), np.int64)
        first[1:] = rank[:-1] + common[:-1]
        width = rank - first + 1
        near = np.repeat(np.arange(len(rank)), width)
        far = np.arange(len(near)) - np.repeat(np.cumsum(width) - width - first, width)
        self.link_a, self.link_b = (far, near) if swapped else (near, far)
        self.doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        self.n_links = np.bincount(self.doc_a[self.link_a], minlength=len(texts))
        self.n_groups = np.bincount(self.doc_a[self.last_a], minlength=len(texts))

    def written_groups(self) -> list[bytes]:
        """Each text's groups: ``a1,a2|b1;a3|b2,b3``."""
        total = len(self.a) + len(self.b)
        group_a = np.searchsorted(self.last_a, np.arange(len(self.a)))
        group_b = np.searchsorted(self.last_b, np.arange(len(self.b)))
        # A group's tokens of A stand before its tokens of B.
        place_a = np.arange(len(self.a)) + np.concatenate([[0], self.last_b + 1])[group_a]
        place_b = np.arange(len(self.b)) + self.last_a[group_b] + 1
        code, after = np.empty(total, np.int64), np.zeros(total, np.int64)
        code[place_a], code[place_b] = self.a, self.b
        after[place_a[self.last_a]], after[place_b[self.last_b]] = 1, 2
        written = _written(max(self.pair.a.size, self.pair.b.size))[after, code].tolist()
        ends = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(written[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the distinct linked id pairs: text, ``a * size_b + b``, links."""
        span = self.pair.a.size * self.pair.b.size
        pair = self.a[self.link_a] * self.pair.b.size + self.b[self.link_b]
        keys, times = np.unique(self.doc_a[self.link_a] * span + pair, return_counts=True)
        return keys // span, keys % span, times


_WRITTEN: dict[int, np.ndarray] = {}


def _written(size: int) -> np.ndarray:
    """Every id in decimals, followed by a comma, a bar or a semicolon."""
    if size not in _WRITTEN:
        rows = [[b"%d%s" % (i, sign) for i in range(size)] for sign in (b",", b"|", b";")]
        _WRITTEN[size] = np.array(rows, dtype=object)
    return _WRITTEN[size]


def _text_groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for row, text in enumerate(texts):
        size += len(text or "")
        if size >= GROUP_BYTES:
            yield first, row + 1
            first, size = row + 1, 0
    if first < len(texts):
        yield first, len(texts)


def align_documents(
    docs: DataFrame, text_col: str = "text", byte_bpe: str | None = None, piece_bpe: str | None = None
) -> DataFrame:
    """Every row with its alignment; no row moves.

    Added columns: ``ids_a``, ``ids_b``, ``last_a``, ``last_b`` (of each group the last
    token on either side, so that two arrays hold all groups), ``pairs`` (``a``, ``b``,
    ``links`` of every id pair that is linked in the text). A text that is null, empty or
    not spelled by both tokenizers has empty arrays. A column that already has one of
    these names is replaced; the text's
    column cannot have one of them.
    """
    names = ["ids_a", "ids_b", "last_a", "last_b", "pairs"]
    if text_col in names:
        raise ValueError(f"{text_col} is the name of an output column")
    kept = docs.drop(*names)
    columns = [*kept.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(byte_bpe, piece_bpe)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for i, j in _text_groups(texts):
                x = Aligned(pair, texts[i:j])
                base_a, base_b = np.cumsum(x.n_a) - x.n_a, np.cumsum(x.n_b) - x.n_b
                doc = x.doc_a[x.last_a]
                text, code, links = x.pairs()
                linked = pa.StructArray.from_arrays(
                    [pa.array(code // pair.b.size), pa.array(code % pair.b.size), pa.array(links)],
                    names=["a", "b", "links"],
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(i, j - i).columns[:-1],
                        _lists(x.n_a, pa.array(x.a)),
                        _lists(x.n_b, pa.array(x.b)),
                        _lists(x.n_groups, pa.array(x.last_a - base_a[doc])),
                        _lists(x.n_groups, pa.array(x.last_b - base_b[doc])),
                        _lists(np.bincount(text, minlength=j - i), linked),
                    ],
                    names=columns,
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    arrays = "ids_a array<long>, ids_b array<long>, last_a array<long>, last_b array<long>"
    staged = kept.withColumn(free_name(kept, "_text"), F.col(text_col).cast("string"))
    return staged.mapInArrow(run, f"{schema}, {arrays}, pairs array<struct<a:long,b:long,links:long>>")


def _lists(sizes: np.ndarray, flat: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)


_SUMMARY = (
    "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<long>, links array<int>"
)


def _summaries(docs: DataFrame, byte_bpe: str | None, piece_bpe: str | None) -> DataFrame:
    """Per row its counts, the checksum of its groups, and its distinct pairs as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = token_pair(byte_bpe, piece_bpe)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for i, j in _text_groups(texts):
                x = Aligned(pair, texts[i:j])
                text, code, links = x.pairs()
                sizes = np.bincount(text, minlength=j - i)
                sums = [hashlib.sha256(g).hexdigest() if g else "" for g in x.written_groups()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(i, j - i).columns[:2],
                        *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_links, sums)),
                        _lists(sizes, pa.array(code)),
                        _lists(sizes, pa.array(links.astype(np.int32))),
                    ],
                    names=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"],
                )

    staged = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.col("text").cast("string").alias("text"),
    )
    return staged.mapInArrow(run, _SUMMARY)


def count_pairs(summaries: DataFrame, pairs: str = "pairs", links: str = "links") -> DataFrame:
    """``pair, n`` over all rows: how many links of the corpus hold the pair."""
    each = summaries.select(F.inline(F.arrays_zip(F.col(pairs).alias("pair"), F.col(links).alias("links"))))
    return each.groupBy("pair").agg(F.sum("links").alias("n"))


def alignment_digests(
    docs: DataFrame, byte_bpe: str | None = None, piece_bpe: str | None = None, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """Per document its tokens, groups and links, and how frequent its linked pairs are.

    ``n_best`` counts the links whose pair is the most frequent one of its id of B, ties
    included; ``count_sum`` adds up the corpus counts of all links. Texts that are null,
    empty or not spelled by both tokenizers give zeros and an empty ``groups_sha256``.
    Every row is counted, repeated ones too. Texts are read and tokenized once: what the
    second step needs of them is written to the shared folder.
    """
    staged = save_stage(_summaries(docs, byte_bpe, piece_bpe), "aligned")
    size_b = token_pair(byte_bpe, piece_bpe).b.size
    counted = save_stage(count_pairs(staged).withColumn("b", F.col("pair") % size_b), "pair-counts")
    top = counted.groupBy("b").agg(F.max("n").alias("top"))
    ranked = counted.join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))
    lookup = lookup_side(ranked, "pair-ranks", broadcast_pairs)
    each = staged.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("links").alias("links"))))
    sums = (
        each.join(lookup, "pair")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
            F.sum(F.col("links") * F.col("n")).alias("count_sum"),
        )
    )
    return (
        staged.drop("pairs", "links")
        .join(sums, "row", "left")
        .select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links",
            F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
            F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"),
            "groups_sha256",
        )
    )
