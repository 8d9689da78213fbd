"""Repeated passages by winnowed anchors and hashes of windows, over all documents.

This stands in place of relative Lempel-Ziv parsing: no factor has a reference position.
The whole corpus is indexed by anchors. An anchor is the run of five
words with the least hash among those of a window of thirteen; equal windows have equal
anchors in equal places, and only about a fifth of all runs are anchors. The index is
dealt to blocks by anchor, and every document is looked up in every block that has one
of its anchors.

What stands around an anchor (its stretch: all windows that share it) decides:

* Every document with the anchor has the same stretch: the document with the smallest id
  is the reference, all others copy the stretch as a whole.
* Stretches differ, as at the borders of factors: the windows of the stretch are looked
  up one by one, with a 128-bit hash.

Then, from left to right, windows with an earlier occurrence that overlap or touch are
joined to spans, called factors; their windows may come from several documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, free_name, save_stage
from lectern.llm.words import Group, WordHasher, groups, mixed, runs

WINDOW = 13
ANCHOR = 5
_STEPS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_ANCHORS = "doc_id long, anchor long, low long, high long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours, by doubling the width."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x = np.minimum(x[:-step], x[step:])
        width += step
    return x


class Anchored:
    """Windows of a group of documents: where they start, their anchors and stretches."""

    def __init__(self, group: Group, window: int):
        self.group = group
        least = _sliding_min(runs(group.hashes, ANCHOR), window - ANCHOR + 1)
        start = np.flatnonzero(group.inside(window)[: len(least)]) if len(least) else np.zeros(0, np.int64)
        self.start, self.anchor = start, least[start]
        self.doc = group.doc_of[start]
        new = np.ones(len(start), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (start[1:] != start[:-1] + 1)
        new[1:] |= self.doc[1:] != self.doc[:-1]
        # Stretches: windows in a row that share an anchor in one place.
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, len(start)))
        self.window = window

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, anchor and content hash of every stretch."""
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(_powered(self.group.hashes))])
        begin = self.start[self.first]
        end = begin + self.size - 1 + self.window
        # Position-weighted sums, brought to a common origin by an odd multiplier's inverse.
        total = (prefix[end] - prefix[begin]) * _inverse_powers(begin)
        content = mixed(total ^ (self.size.astype(np.uint64) << np.uint64(48)))
        return self.doc[self.first], self.anchor[self.first], content


_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_TABLES: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of an odd number modulo 2^64, kept as far as they have been needed."""
    known = _TABLES.get(base)
    if known is None or len(known) < n:
        size = max(n, 2 * len(known) if known is not None else 1 << 16)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        known = _TABLES[base] = np.cumprod(factors, dtype=np.uint64)
    return known[:n]


def _powered(hashes: np.ndarray) -> np.ndarray:
    return hashes * _powers(_STEP, len(hashes))


def _inverse_powers(at: np.ndarray) -> np.ndarray:
    return _powers(_BACK, int(at.max(initial=0)) + 1)[at]


def _anchor_rows(window: int):
    """Per document its distinct anchors, with the least and greatest stretch content.

    The greatest is null where it is the least, which keeps the written table small.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for group in groups(as_bytes(batch.column(1)), hasher):
                doc, anchor, content = Anchored(group, window).stretches()
                # Spark compares signed numbers, so the extremes are taken of those.
                anchor, content = anchor.view(np.int64), content.view(np.int64)
                order = np.lexsort((content, anchor, doc))
                doc, anchor, content = doc[order], anchor[order], content[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
                first = np.flatnonzero(new)
                last = (np.append(first[1:], len(doc)) - 1)[: len(first)]
                low, high = content[first], content[last]
                rows = np.array(group.rows, np.int64)[doc[first]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[rows].astype(np.int64)),
                        pa.array(anchor[first]),
                        pa.array(low),
                        pa.array(high, mask=low == high),
                    ],
                    names=["doc_id", "anchor", "low", "high"],
                )

    return run


def _window_hashes(group: Group, other: WordHasher, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every run of a window's length."""
    return runs(group.hashes, window, _STEPS[0]), runs(other.hashes(group.words), window, _STEPS[1])


def _listed(column: pa.ListArray) -> list[np.ndarray]:
    """Each row's numbers in order; a null has none."""
    flat = column.values.to_numpy(zero_copy_only=False)
    ends = column.offsets.to_pylist()
    valid = column.is_valid().to_pylist()
    return [np.sort(flat[i:j]) if v else flat[:0] for i, j, v in zip(ends, ends[1:], valid, strict=False)]


def _among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are among the listed ones, which are in order?"""
    if not len(listed) or not len(values):
        return np.zeros(len(values), bool)
    values = values.view(np.int64)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def _window_rows(window: int):
    """Both hashes of the windows whose stretches differ between documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, other = WordHasher(), WordHasher(seed=1)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            unlike = _listed(batch.column("unlike"))
            for group in groups(as_bytes(batch.column("text")), hasher):
                found = Anchored(group, window)
                asked = np.zeros(len(found.start), bool)
                for k, row in enumerate(group.rows):
                    own = slice(*np.searchsorted(found.doc, [k, k + 1]))
                    asked[own] = _among(found.anchor[own], unlike[row])
                start, doc = found.start[asked], found.doc[asked]
                first, second = _window_hashes(group, other, window)
                first, second = first[start], second[start]
                # A window that a document repeats counts once.
                order = np.lexsort((second, first, doc))
                doc, first, second = doc[order], first[order], second[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])
                rows = np.array(group.rows, np.int64)[doc[new]]
                columns = [pa.array(ids[rows].astype(np.int64)), _signed(first[new]), _signed(second[new])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2"])

    return run


def parse(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Factors ``(start, length)`` in words, from the starts of repeated windows.

    Greedy from the left: a factor grows while the next repeated window overlaps or
    touches it.
    """
    if not len(starts):
        return []
    breaks = np.flatnonzero(np.diff(starts) > window)
    first = starts[np.concatenate([[0], breaks + 1])]
    last = starts[np.concatenate([breaks, [len(starts) - 1]])]
    return [(int(i), int(j - i + window)) for i, j in zip(first, last, strict=True)]


def _starts(
    texts: list[bytes | None],
    copied: list[np.ndarray],
    repeated: list[np.ndarray],
    hasher: WordHasher,
    window: int,
) -> list[np.ndarray]:
    """For each text the starts of its windows that have an earlier occurrence."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    listed = zip(texts, copied, repeated, strict=True)
    for group in groups([t if len(c) or len(r) else None for t, c, r in listed], hasher):
        found = Anchored(group, window)
        hashes = runs(group.hashes, window, _STEPS[0])
        for k, row in enumerate(group.rows):
            own = slice(*np.searchsorted(found.doc, [k, k + 1]))
            start = found.start[own]
            if len(start):
                hit = _among(found.anchor[own], copied[row]) | _among(hashes[start], repeated[row])
                out[row] = start[hit] - group.bounds[k]
    return out


def _removal(text_at: int, window: int):
    """Parse every document and take its factors out of the text."""
    factor = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            texts = as_bytes(batch.column(text_at))
            lists = [_listed(batch.column(batch.num_columns - k)) for k in (2, 1)]
            n_words, n_removed, factors, kept = [], [], [], []
            for text, starts in zip(texts, _starts(texts, *lists, hasher, window), strict=True):
                words = text.split() if text else []
                spans = parse(starts, window)
                n_words.append(len(words))
                n_removed.append(sum(n for _, n in spans))
                factors.append([{"start": i, "length": n} for i, n in spans])
                for i, n in reversed(spans):
                    del words[i : i + n]
                kept.append(b" ".join(words) if spans else text)
            columns = list(batch.columns[: batch.num_columns - 2])
            columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            names = [*batch.schema.names[: batch.num_columns - 2], "n_words", "n_removed", "factors"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(factors, factor)], names=names)

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Take out every word that lies in a window which a smaller id's text also holds.

    Returns the documents' columns, the text without its repeated words, and ``n_words``,
    ``n_removed`` and ``factors`` (start and length in words); columns of these names are
    replaced. Words are cut at ASCII white space. A text that loses nothing stays as it
    is, one that does has its kept words joined by one space. Windows are judged on the
    input. A null text has no words; a null id is neither smaller nor larger than any, so
    its text stays; rows of one id do not count against each other.
    """
    ids = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")
    )
    # Read twice, for the index and to look it up, so that texts are hashed once.
    anchors = save_stage(ids.mapInArrow(_anchor_rows(window), _ANCHORS), "anchors")
    index = anchors.groupBy("anchor").agg(
        F.min("doc_id").alias("first"),
        F.count("*").alias("n"),
        F.min("low").alias("low"),
        F.max(F.coalesce("high", "low")).alias("high"),
    )
    index = index.filter("n > 1").select("anchor", "first", (F.col("low") != F.col("high")).alias("mixed"))
    hits = anchors.select("doc_id", "anchor").join(index, "anchor").filter("mixed OR doc_id > first")
    lists = hits.groupBy("doc_id").agg(
        F.collect_list(F.when(~F.col("mixed"), F.col("anchor"))).alias("copied"),
        F.collect_list(F.when(F.col("mixed"), F.col("anchor"))).alias("unlike"),
    )
    lists = save_stage(lists, "lists")

    asked = lists.filter(F.size("unlike") > 0).select("doc_id", "unlike")
    found = ids.join(asked, "doc_id").mapInArrow(_window_rows(window), "doc_id long, h1 long, h2 long")
    found = save_stage(found, "windows")
    earliest = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    earliest = earliest.filter("n > 1").drop("n")
    repeated = found.join(earliest, ["h1", "h2"]).filter("doc_id > first")
    repeated = save_stage(repeated.groupBy("doc_id").agg(F.collect_list("h1").alias("repeated")), "repeated")

    own = docs.drop("n_words", "n_removed", "factors")
    names = own.columns
    key, other, copied, again = (free_name(own, n) for n in ("_id", "_again", "_copied", "_repeated"))
    known = lists.select(F.col("doc_id").alias(key), F.col("copied").alias(copied))
    found = repeated.select(F.col("doc_id").alias(other), F.col("repeated").alias(again))
    joined = own.join(known, F.col(id_col) == F.col(key), "left").join(
        found, F.col(id_col) == F.col(other), "left"
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    added = "n_words long, n_removed long, factors array<struct<start:int,length:int>>"
    return joined.select(*[F.col(f"`{n}`") for n in names], copied, again).mapInArrow(
        _removal(names.index(text_col), window), f"{schema}, {added}"
    )


def repeat_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: kept words joined by one space."""
    out = remove_repeats(docs.select("doc_id", "text"))
    # A text that lost nothing keeps its own white space, so it is split here again.
    space = "[ \\t-\\r]+"
    kept = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), space), lambda w: w != ""), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))
