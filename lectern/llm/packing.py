"""Packing of tokenized documents into sequences of a fixed length.

Bounded-space online best fit: a fixed number of sequences is open at any time. A piece
goes to the open sequence with the least free space that still holds it. If none does,
a new one is opened, and when all are in use the fullest of them closes first. The open
sequences are kept by free space, and one integer has a bit for every free space that
occurs, so finding the best fit is a shift and a lowest-bit test.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import blocks_for, free_name
from lectern.llm.tokens import encode_all

CAPACITY = 1024
OPEN_BINS = 4096
# Pieces per round: each round comes in falling length, and a round's sequences can all
# stay open. Rounds of half the open sequences need 0.3 % more sequences than the ids
# fill, pieces in no order 2.3 % more.
ROUND = 2048
END_ID = 2
# Pieces that one task packs. They are 40 bytes each, without the ids.
PIECES_PER_TASK = 500_000
_PIECES = "doc_id long, piece int, start long, length long"


class BestFit:
    """Places lengths one after another; returns ``(sequence number, offset)``."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free_bits = 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.free_bits ^= 1 << free
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.free_bits >> length
        if length == self.capacity:
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        elif fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open == self.open_bins:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.free_bits |= 1 << left
            self.n_open += 1
        return number, self.capacity - free


def cut_pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer: str | None = None,
    checksums: bool = False,
) -> DataFrame:
    """Tokenize every text, append ``end_id``, cut what is longer than a sequence.

    Pieces of one document are full but for the first, which takes the remainder.
    ``doc_id, piece, start, length, ids`` with ids as little-endian 32-bit bytes, or with
    their checksum ``ids_crc32`` in their place, so that packing moves lengths only. No
    shuffle. A null or empty text is one piece, the end id.
    """
    last, kind = ("ids_crc32", pa.int64()) if checksums else ("ids", pa.binary())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), kind)
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "piece", "start", "length", last],
        )

    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            names = batch.column("doc_id").to_pylist()
            texts = (t.as_py() for t in batch.column("text"))
            for name, ids in zip(names, encode_all(texts, tokenizer), strict=True):
                ids += end
                total = len(ids) // 4
                first = total % capacity or capacity
                bounds = [0, *range(first, total + 1, capacity)]
                for k, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    own = ids[4 * i : 4 * j]
                    out.append((name, k, i, j - i, zlib.crc32(own) if checksums else own))
                if len(out) >= 2000:
                    yield made(out)
                    out = []
            yield made(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"{_PIECES}, {last} {'long' if checksums else 'binary'}")


def pack(
    pieces: DataFrame,
    rows: int,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    pieces_per_task: int = PIECES_PER_TASK,
) -> DataFrame:
    """Add ``sequence_id, offset`` to a frame with ``doc_id, piece, length``.

    ``rows`` is the number of documents, from which the number of tasks follows. Full
    pieces are sequences of their own. Each task packs its share in the order of a
    hash, which mixes lengths and does not depend on how rows arrived: a task that
    runs again places every piece as before. Within a round long pieces come first.
    Rows that repeat are packed repeatedly; columns that have the outputs' names are replaced.
    """
    tasks = blocks_for(rows, pieces_per_task)
    rounds = blocks_for(blocks_for(rows, tasks), ROUND)
    pieces = pieces.drop("sequence_id", "offset")
    others = pieces.columns
    mix, task_col, turn = (free_name(pieces, n) for n in ("mix", "task", "round"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = BestFit(capacity, open_bins)
        for batch in batches:
            spots = [fit.place(n) for n in batch.column("length").to_pylist()]
            task = batch.column(task_col)
            numbers = pa.array([n for n, _ in spots], pa.int64())
            ids = pc.add(pc.multiply(task, 1 << 40), numbers)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in others], ids, pa.array([o for _, o in spots], pa.int64())],
                names=[*others, "sequence_id", "offset"],
            )

    shared = pieces.withColumn(mix, F.xxhash64("doc_id", "piece")).repartition(tasks, mix)
    ordered = (
        shared.withColumn(task_col, F.spark_partition_id().cast("long"))
        .withColumn(turn, F.pmod(F.shiftright(mix, 20), F.lit(rounds)))
        .sortWithinPartitions(turn, F.desc("length"), mix, *others)
    )
    return ordered.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    """Digest of every piece and its place: tokenized where it lies, packed by length."""
    return pack(cut_pieces(docs, checksums=True), docs.count())
