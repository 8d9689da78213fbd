"""Repeated byte strings of a fixed length, by distributed prefix doubling.

A window is a string of ``length`` bytes inside one text; it is repeated if it starts at
another position too, in any text. As in a suffix array under construction, positions
are ranked by ever longer prefixes of what follows them: Spark sorts (rank, name) pairs,
where the name is the fingerprint of the string that continues the ranked one, and
numbers the distinct pairs. A position whose pair is alone is unique, and so is every
longer string from it: it takes no part in later rounds.

Ranking every position would sort the whole corpus byte by byte. So positions are first
thinned alike in all copies: the anchor of a window is the position of its least gram
among its first ``reach`` bytes, which depends on the window's content alone. Equal
windows have equal anchors in equal places, and what follows the anchor up to ``length -
reach + 1`` bytes (the core) lies in every window with that anchor. All windows of one
anchor form a stretch.

1. Anchors are ranked by their first quarter of the core, then half of it, then all.
2. What is left is ranked with the whole text of its stretch: a stretch that occurs
   twice consists of repeated windows only.
3. In stretches that do not (the borders of copies), every window start is a position of
   its own and is ranked by its anchor's rank and its whole window. Of the stretches that
   do occur twice and share a core with such a border, one of each kind takes part.

A sort cuts its rows by pair *and* place, so a pair that makes up a third of all rows is
dealt to many tasks. Whether a row is alone depends on its two neighbours; only the rows
at the ends of a task have a neighbour elsewhere, and those (two per task) are compared
on the driver. Equal texts are analysed once. Fingerprints have 64 bits and are compared
within one rank only, which has up to four such fingerprints behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, free_name, save_stage
from lectern.llm.words import mixed

LENGTH = 400
GRAM = 16
# Bytes hashed together, so that array calls are few and memory stays bounded: longer
# texts are cut into pieces that overlap by a window.
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
# Low bits of a sort key hold a position inside a piece.
_PLACE = np.uint64(31)


def _table() -> np.ndarray:
    """A random odd 64-bit number for every byte, the same in every task."""
    return np.random.default_rng(20_000).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _table()
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        factors = np.full(max(n, 2 * PIECE_BYTES), base, np.uint64)
        factors[0] = 1
        known = _POWERS[base] = np.cumprod(factors, dtype=np.uint64)
    return known[:n]


class Names:
    """Fingerprints of any strings inside a piece of text, from sums over its prefixes."""

    def __init__(self, raw: np.ndarray):
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = (self._sums[end] - self._sums[start]) * _powers(_BACK, len(self._sums))[start]
        return mixed(sums + (end - start).astype(np.uint64))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours, by doubling the width."""
    width = 1
    while width < n:
        step = min(width, n - width)
        x = np.minimum(x[:-step], x[step:])
        width += step
    return x


class Layout:
    """How a window of a given length is thinned: gram, reach of the anchor, core."""

    def __init__(self, length: int):
        if length < 1:
            raise ValueError("a window has at least one byte")
        self.length = length
        self.reach = max(1, length // 3)
        self.core = length - self.reach + 1
        self.gram = min(GRAM, self.core)
        # Lengths at which anchors are ranked.
        self.steps = sorted({max(1, -(-self.core // 4)), max(1, -(-self.core // 2)), self.core})


class Stretches:
    """Stretches of one piece: anchor and first and last window start of each."""

    def __init__(self, raw: bytes, starts: np.ndarray, layout: Layout):
        """``starts``: the window starts of the piece, ascending, each with a whole window."""
        bytes_ = np.frombuffer(raw, np.uint8)
        self.names, self.layout = Names(bytes_), layout
        at = np.arange(len(bytes_) - layout.gram + 1)
        grams = self.names.of(at, at + layout.gram)
        keys = (grams >> _PLACE << _PLACE) | at.astype(np.uint64)
        least = _least(keys, layout.reach)[starts]
        anchor = (least & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        self.anchor, self.low = anchor[first], starts[first]
        self.high = starts[np.append(first[1:], len(starts)) - 1]

    def prefixes(self) -> list[np.ndarray]:
        """Names of the strings that lead from each ranked length to the next."""
        begins = [0, *self.layout.steps[:-1]]
        return [self.names.of(self.anchor + i, self.anchor + j) for i, j in zip(begins, self.layout.steps, strict=True)]

    def wholes(self) -> np.ndarray:
        """Names of whole stretches, with their place around the anchor."""
        text = self.names.of(self.low, self.high + self.layout.length)
        return mixed(text + (self.anchor - self.low).astype(np.uint64) * np.uint64(_BASE))


def _pieces(
    rows: list, texts: list[bytes | None], length: int
) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts side by side: bytes, window starts in them, and of each its row and place in its text."""
    raw, starts, of, shift, size = [], [], [], [], 0

    def piece():
        counts = [len(s) for s in starts]
        return (
            b"".join(raw),
            np.concatenate(starts),
            np.repeat(np.array(of, np.int64), counts),
            np.repeat(np.array(shift, np.int64), counts),
        )

    for row, text in zip(rows, texts, strict=True):
        windows = len(text or b"") - length + 1
        for at in range(0, windows, PIECE_BYTES):
            n = min(PIECE_BYTES, windows - at)
            raw.append(text[at : at + n + length - 1])
            starts.append(np.arange(size, size + n))
            of.append(row)
            shift.append(at - size)
            size += len(raw[-1])
            if size >= PIECE_BYTES:
                yield piece()
                raw, starts, of, shift, size = [], [], [], [], 0
    if raw:
        yield piece()


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(texts: DataFrame, layout: Layout) -> DataFrame:
    """One row per stretch: ``row, place`` (anchor), ``before``, ``after``, and its names."""
    steps = len(layout.steps)
    columns = ["row", "place", "before", "after", *(f"name{i}" for i in range(steps)), "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, starts, row, shift in _pieces(batch.column(0).to_pylist(), as_bytes(batch.column(1)), layout.length):
                s = Stretches(raw, starts, layout)
                at = np.searchsorted(starts, s.low)
                fields = [
                    pa.array(row[at]),
                    pa.array((s.anchor + shift[at]).astype(np.int32)),
                    pa.array((s.anchor - s.low).astype(np.int32)),
                    pa.array((s.anchor - s.high).astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(
                    [*fields, *map(_signed, s.prefixes()), _signed(s.wholes())], names=columns
                )

    names = ", ".join(f"name{i} long" for i in range(steps))
    return texts.select("row", "text").mapInArrow(run, f"row long, place int, before int, after int, {names}, whole long")


def repeated_only(rows: DataFrame, rank: str, name: str, place: list[str]) -> DataFrame:
    """The rows whose (rank, name) pair another row has too; ``rank`` is numbered anew.

    ``place`` makes rows different. Rows are sorted by pair and place; each task numbers
    the distinct pairs it meets and drops rows that are alone between their neighbours.
    Of a task's first and last row the neighbour may be in another task: these, at most
    two per task, are settled on the driver. A pair spread over several tasks gets one rank.
    """
    kept = [f.name for f in rows.schema.fields if f.name != name]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        held, pair, ordinal, begun = None, None, 0, False

        def out(batch: pa.RecordBatch, ranks: np.ndarray, alone: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
            keep = pa.array(~alone | edge)
            columns = [pa.array(ranks) if c == rank else batch.column(c) for c in kept]
            columns += [pa.array(edge), pa.array(alone), batch.column(rank), batch.column(name)]
            names = [*kept, "edge", "alone", "old_rank", "old_name"]
            return pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

        for batch in batches:
            if not batch.num_rows:
                continue
            # The last row of a batch waits for the next one.
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            whole = table.to_batches()[0]
            a = whole.column(rank).to_numpy(zero_copy_only=False)
            b = whole.column(name).to_numpy(zero_copy_only=False)
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            opens = np.concatenate([[pair is None or pair != (a[0], b[0])], ~same])
            ranks = base + ordinal + np.cumsum(opens)
            alone = opens & np.concatenate([~same, [True]])
            edge = np.zeros(len(a), bool)
            edge[0] = not begun
            if len(a) > 1:
                begun = True
                yield out(whole.slice(0, len(a) - 1), ranks[:-1], alone[:-1], edge[:-1])
                ordinal, pair = int(ranks[-2] - base), (a[-2], b[-2])
            held = whole.slice(len(a) - 1)
        if held is not None:
            a, b = held.column(rank)[0].as_py(), held.column(name)[0].as_py()
            opens = pair is None or pair != (a, b)
            yield out(held, np.array([base + ordinal + opens]), np.array([opens]), np.array([True]))

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    extra = "edge boolean, alone boolean, old_rank long, old_name long"
    order = [rank, name, *place]
    ranked = save_stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"{schema}, {extra}"), "ranks"
    )
    edges = sorted(tuple(r) for r in ranked.filter("edge").select(rank, "old_rank", "old_name", "alone").collect())
    lonely, renamed = _settle(edges)
    kept_rows = ranked.select(*kept) if not lonely else ranked.join(
        F.broadcast(_numbers(ranked, [(r,) for r in lonely], f"{rank} long")), rank, "left_anti"
    ).select(*kept)
    if renamed:
        names = F.broadcast(_numbers(ranked, list(renamed.items()), f"{rank} long, _to long"))
        kept_rows = kept_rows.join(names, rank, "left").withColumn(rank, F.coalesce("_to", rank)).select(*kept)
    return kept_rows


def _numbers(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def _settle(edges: list[tuple[int, int, int, bool]]) -> tuple[list[int], dict[int, int]]:
    """Ranks to drop and ranks to rename, from the rows at the ends of the sorted tasks.

    Ranks grow with the task's number, so equal pairs of different tasks stand together.
    """
    lonely: list[int] = []
    renamed: dict[int, int] = {}
    i = 0
    while i < len(edges):
        j = i
        while j < len(edges) and edges[j][1:3] == edges[i][1:3]:
            j += 1
        ranks = sorted({e[0] for e in edges[i:j]})
        if len(ranks) == 1 and all(e[3] for e in edges[i:j]):
            lonely.append(ranks[0])
        renamed.update((r, ranks[0]) for r in ranks[1:])
        i = j
    return lonely, renamed


def distinct_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Every different text once: ``row, key_a, key_b, text, copies``; a null is empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(text.alias("text")).select("text", *text_keys(F.col("text")))
    once = keyed.groupBy("key_a", "key_b").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return once.select(F.monotonically_increasing_id().alias("row"), "*")


def text_keys(text) -> list:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit(1), text).alias("key_b")]


def repeated_starts(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Ranges of repeated window starts: ``row, low, high``, in bytes, both inclusive.

    ``texts`` has a unique long ``row`` and a ``text``; it is read twice and should be a
    written table. Ranges may touch. Copies of whole texts are the caller's to know.
    """
    layout = Layout(length)
    place = ["row", "place", "before"]
    left = _anchor_rows(texts, layout).withColumn("rank", F.lit(0).cast("long"))
    for i in range(len(layout.steps)):
        left = repeated_only(left, "rank", f"name{i}", place)
    low, high = F.col("place") - F.col("before"), F.col("place") - F.col("after")
    left = save_stage(left.withColumn("core", F.col("rank")), "cores")
    alike = repeated_only(left, "rank", "whole", place)
    alike = save_stage(alike.select("row", low.alias("low"), high.alias("high"), "core", "rank"), "alike")
    every = left.select("row", low.alias("low"), high.alias("high"), "core")
    bordering = save_stage(every.join(alike, ["row", "low"], "left_anti"), "borders")
    # A window at a border may have its copies inside stretches that occur twice: of
    # those with the same core, one of each kind is looked through too.
    of_kind = alike.groupBy("core", "rank").agg(F.min(F.struct("row", "low", "high")).alias("s"))
    partners = of_kind.join(bordering.select("core").distinct(), "core", "left_semi").select("s.*", "core")
    todo = (
        bordering.select("row", "low", "high", "core")
        .unionByName(partners)
        .groupBy("row")
        .agg(F.collect_list(F.struct("low", "high", "core")).alias("todo"))
    )
    windows = texts.join(todo, "row").select("row", "text", "todo").mapInArrow(
        _window_rows(length), "row long, place int, rank long, name long"
    )
    single = repeated_only(windows, "rank", "name", ["row", "place"])
    return alike.select("row", "low", "high").unionByName(single.select("row", F.col("place").alias("low"), F.col("place").alias("high")))


def _window_rows(length: int):
    """Names of all windows of the listed stretches; a text is hashed piece by piece."""

    def named(row: int, text: bytes, todo: pa.Scalar) -> Iterator[list[np.ndarray]]:
        low, high, rank = (p.to_numpy(zero_copy_only=False).astype(np.int64) for p in todo.values.flatten())
        for at in range(0, len(text) - length + 1, PIECE_BYTES):
            own = (low >= at) & (low < at + PIECE_BYTES)
            if own.any():
                size = high[own] - low[own] + 1
                start = np.repeat(low[own] - np.cumsum(size) + size, size) + np.arange(size.sum())
                # A stretch may begin in one piece and end in the next.
                raw = np.frombuffer(text[at : at + PIECE_BYTES + 2 * length], np.uint8)
                name = Names(raw).of(start - at, start - at + length)
                yield [np.full(len(start), row), start, np.repeat(rank[own], size), name.view(np.int64)]

    def batched(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        columns[1] = columns[1].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "place", "rank", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            rows, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for i, (row, text) in enumerate(zip(rows, texts, strict=True)):
                for part in named(row, text, batch.column(2)[i]):
                    parts.append(part)
                    size += len(part[0])
                    if size >= 50_000:
                        yield batched(parts)
                        parts, size = [], 0
        if parts:
            yield batched(parts)

    return run


def _covered(low: np.ndarray, high: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows of the ranges cover, as begin and end."""
    order = np.argsort(low)
    begin, end = low[order], np.maximum.accumulate(high[order] + length)
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    return list(zip(begin[first].tolist(), end[last].tolist(), strict=True))


_SPANS = "array<struct<start:int,length:int>>"


def _cut_texts(docs: DataFrame, text_col: str, length: int, kept: str, of) -> DataFrame:
    """``key_a, key_b, n_bytes, n_removed, spans, kept`` of every different text."""
    texts = save_stage(distinct_texts(docs, text_col), "texts")
    ranges = repeated_starts(texts, length).groupBy("row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, copies, lists = as_bytes(batch.column(2)), batch.column(3).to_pylist(), batch.column(4)
            out = []
            for i, (text, times) in enumerate(zip(texts, copies, strict=True)):
                if times > 1 and len(text) >= length:
                    spans = [(0, len(text))]
                elif lists[i].is_valid:
                    low, high = (p.to_numpy(zero_copy_only=False).astype(np.int64) for p in lists[i].values.flatten())
                    spans = _covered(low, high, length)
                else:
                    spans = []
                cuts = [0, *(x for span in spans for x in span), len(text)]
                left = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                listed = [{"start": a, "length": b - a} for a, b in spans]
                out.append((len(text), len(text) - len(left), listed, of(left)))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))],
                names=["key_a", "key_b", "n_bytes", "n_removed", "spans", kept],
            )

    joined = texts.join(ranges, "row", "left").select("key_a", "key_b", "text", "copies", "ranges")
    schema = f"key_a long, key_b long, n_bytes long, n_removed long, spans {_SPANS}, {kept} string"
    return joined.mapInArrow(run, schema)


def _valid_text(left: bytes) -> str:
    """A cut may split a character; what is left of it goes."""
    return left.decode(errors="ignore")


def cut_repeated_bytes(docs: DataFrame, length: int = LENGTH, text_col: str = "text") -> DataFrame:
    """The documents without any byte that a repeated window covers.

    All columns stay, the text is cut, and ``n_bytes``, ``n_removed`` and ``spans``
    (``start, length`` of each maximal removed run, in bytes of the input) are added; a
    column that has one of these names is replaced. Of characters that a cut splits
    nothing is kept in the text. A null text stays null; an empty or short one, and an
    empty table, loses nothing. Of equal texts of ``length`` bytes or more all are
    removed whole, as are all other copies.
    """
    names = ["n_bytes", "n_removed", "spans"]
    if text_col in names:
        raise ValueError(f"{text_col} is the name of an output column")
    own = [c for c in docs.columns if c.lower() not in names]
    cut = _cut_texts(docs, text_col, length, "left_text", _valid_text)
    helper = {c: free_name(docs, f"_{c}") for c in [*names, "left_text", "key_a", "key_b"]}
    cut = cut.select(*[F.col(c).alias(helper[c]) for c in cut.columns])
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = [k.alias(helper[f"key_{s}"]) for k, s in zip(text_keys(text), "ab", strict=True)]
    joined = docs.select("*", *keys).join(cut, [helper["key_a"], helper["key_b"]])
    changed = F.when(F.col(helper["n_removed"]) > 0, F.col(helper["left_text"])).otherwise(F.col(f"`{text_col}`"))
    return joined.select(
        *[changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in own],
        *[F.col(helper[c]).alias(c) for c in names],
    )


def repeated_byte_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document its bytes, how many and how many runs of them go, and a checksum of the rest."""
    cut = _cut_texts(docs, "text", length, "kept_sha256", lambda left: hashlib.sha256(left).hexdigest())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    small = cut.select("key_a", "key_b", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(text)).join(
        save_stage(small, "cut"), ["key_a", "key_b"]
    ).drop("key_a", "key_b")
