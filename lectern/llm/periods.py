"""Periodic runs of words inside a document, found by seeds and extended along diagonals.

A run is a stretch of words with smallest period q that no neighbouring word extends and
that is long: at least ``min_words`` and at least ``min_exponent`` periods. Two copies of
it, q words apart, overlap in at least k = ``min_words * (e - 1) / e`` words, and a run of
period above k/2 in at least 2q words. So level j takes the k*2^j-grams and looks after
the lags from k*2^(j-1) to k*2^j (level 0: from 1 to k): every run has a seed there.

Occurrences of a gram are paired with the next one only. As the gram is no shorter than
the lag, a nearer occurrence would mean a shorter period, so the next occurrence of some
gram of a run lies exactly its smallest period away. A document thus has at most one pair
per position and level. Each seed is checked and extended word by word along its
diagonal; a table of the furthest position covered per lag drops all later seeds of the
same stretch. Grams are fingerprints, words themselves are numbered exactly.

A document is analysed whole by the task that reads it: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, free_name
from lectern.llm.words import mixed

MIN_WORDS = 24
MIN_EXPONENT = 3
# Words analysed together, so that array calls are few; a longer document goes alone.
GROUP_WORDS = 100_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_APART = np.uint64(0xD6E8FEB86659FD93)

Run = tuple[int, int, int]
Reword = Callable[[int | None, list[bytes]], list[bytes]]


def _joined(grams: np.ndarray, shift: int) -> np.ndarray:
    """Fingerprints of each gram followed by, or overlapped with, the gram ``shift`` on."""
    return mixed(grams[: len(grams) - shift] * _STEP + grams[shift:])


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    found, size = mixed(ids.astype(np.uint64) + np.uint64(1)), 1
    while size < n and len(found):
        shift = min(size, n - size)
        found = _joined(found, min(shift, len(found)))
        size += shift
    return found


def _next_occurrences(grams: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose gram comes again in the same document, and how far on."""
    keys = mixed(grams[at] + doc.astype(np.uint64) * _APART)
    order = np.argsort(keys, kind="stable")
    again = keys[order[1:]] == keys[order[:-1]]
    first, second = at[order[:-1][again]], at[order[1:][again]]
    return first, second - first


def _agreeing(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """First position from ``at`` up to ``stop`` whose word differs from that ``lag`` on."""
    width = 64
    while at < stop:
        to = min(at + width, stop)
        differ = np.flatnonzero(ids[at:to] != ids[at + lag : to + lag])
        if len(differ):
            return at + int(differ[0])
        at, width = to, width * 2
    return stop


def _agreeing_back(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """The least position from which on all words down from ``at`` agree with those ``lag`` on."""
    width = 64
    while at > stop:
        to = max(at - width, stop)
        differ = np.flatnonzero(ids[to:at] != ids[to + lag : at + lag])
        if len(differ):
            return to + int(differ[-1]) + 1
        at, width = to, width * 2
    return stop


def find_runs(
    ids: np.ndarray, bounds: np.ndarray, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT
) -> dict[int, list[Run]]:
    """Runs of documents that lie one after another: ``start, length, period`` per document.

    ``bounds`` holds every document's first position and the end; runs are sorted by
    start and period, and start counts from the document's own first word.
    """
    if min_exponent < 3:
        raise ValueError("a run has at least three periods")
    k = max(1, min_words * (min_exponent - 1) // min_exponent)
    lengths = np.diff(bounds)
    doc_of = np.repeat(np.arange(len(lengths)), lengths)
    open_docs = lengths >= min_words
    grams, low = _grams(ids, k), 0
    found: dict[int, list[Run]] = defaultdict(list)
    while open_docs.any() and len(grams):
        at = np.flatnonzero(open_docs[doc_of[: len(grams)]])
        at = at[at + k <= bounds[1:][doc_of[at]]]
        first, lag = _next_occurrences(grams, at, doc_of[at])
        repeated = np.zeros(len(lengths), bool)
        repeated[doc_of[first]] = True
        fitting = (lag > low) & (lag <= k)
        first, lag = first[fitting], lag[fitting]
        order = np.lexsort((first, lag))
        first, lag = first[order], lag[order]
        follows = np.zeros(len(first), bool)
        follows[1:] = (first[1:] == first[:-1] + 1) & (lag[1:] == lag[:-1])
        covered: dict[int, int] = {}
        for seed, q in zip(first[~follows].tolist(), lag[~follows].tolist(), strict=True):
            if seed < covered.get(q, 0):
                continue
            doc = int(doc_of[seed])
            begin, end = int(bounds[doc]), int(bounds[doc + 1])
            right = _agreeing(ids, seed, q, end - q)
            if right < seed + k:
                continue
            left = _agreeing_back(ids, seed, q, begin)
            covered[q] = right
            length = right + q - left
            if length >= min_words and length >= min_exponent * q:
                found[doc].append((left - begin, length, q))
        # Longer grams repeat only where these do; a longer lag needs a longer document.
        open_docs &= repeated & (lengths >= min_exponent * (k + 1))
        grams, low, k = _joined(grams, min(k, len(grams))), k, 2 * k
    return {doc: sorted(runs, key=lambda r: (r[0], r[2])) for doc, runs in found.items()}


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def _groups(ids: list, texts: list[bytes | None], reword: Reword | None) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Documents as word lists, in groups; with the number of the first one's row."""
    group, size, first = [], 0, 0
    for row, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
        own = text.split() if text else []
        group.append(reword(doc_id, own) if reword else own)
        size += len(own)
        if size >= GROUP_WORDS:
            yield first, group
            group, size, first = [], 0, row + 1
    if group:
        yield first, group


def _analysed(ids: list, texts: list[bytes | None], reword, min_words, min_exponent):
    """Per row, in order: its words and its runs."""
    for _, group in _groups(ids, texts, reword):
        number: dict[bytes, int] = defaultdict(count().__next__)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in group])]).astype(np.int64)
        numbers = np.fromiter((number[w] for ws in group for w in ws), np.int64, bounds[-1])
        runs = find_runs(numbers, bounds, min_words, min_exponent)
        for i, own in enumerate(group):
            yield own, runs.get(i, [])


def periodic_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """One row per run: the document's id, ``start``, ``length`` and ``period`` in words.

    A null or empty text, or one of white space, has no runs; so has an empty table.
    Rows that repeat are analysed each for itself.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            per_row = [r for _, r in _analysed([None] * batch.num_rows, as_bytes(batch.column(1)), None, min_words, min_exponent)]
            rows = np.repeat(np.arange(len(per_row)), [len(r) for r in per_row])
            runs = np.array([x for r in per_row for x in r], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), *(pa.array(runs[:, i]) for i in range(3))],
                names=["doc_id", "start", "length", "period"],
            )

    schema = f"doc_id {kind.simpleString()}, start long, length long, period long"
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return found.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


def collapse_runs(
    docs: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT
) -> DataFrame:
    """The documents with each run cut down to its first period.

    All other columns stay. A text with a run gets its kept words joined by one space;
    every other text, null and empty ones too, is returned as it was.
    """
    schema = docs.schema
    helper = free_name(docs, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(batch.num_columns - 1))
            analysed = _analysed([None] * len(texts), texts, None, min_words, min_exponent)
            new = [
                b" ".join(collapsed(words, runs)) if runs else text
                for text, (words, runs) in zip(texts, analysed, strict=True)
            ]
            cut = pa.array(new, pa.binary()).cast(pa.string())
            columns = [
                cut if f.name == text_col else c for f, c in zip(schema.fields, batch.columns[:-1], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    staged = docs.withColumn(helper, F.col(text_col))
    return staged.mapInArrow(run, schema)


_DIGEST = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def run_digests(
    docs: DataFrame,
    reword: Reword | None = None,
    min_words: int = MIN_WORDS,
    min_exponent: int = MIN_EXPONENT,
) -> DataFrame:
    """Per document its runs in short: count, the most repetitive one, two checksums.

    ``reword`` may change a document's words, given its id, before they are analysed. The
    most repetitive run has the greatest exact length by period; ties go to the smaller
    start, then to the smaller period. Without runs its four columns are null and the
    checksum of the runs is that of nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            out = []
            for words, runs in _analysed(ids, texts, reword, min_words, min_exponent):
                best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                kept = b" ".join(collapsed(words, runs))
                out.append(
                    (
                        len(runs),
                        *(best or (None, None, None)),
                        1000 * best[1] // best[2] if best else None,
                        hashlib.sha256(listed.encode()).hexdigest(),
                        hashlib.sha256(kept).hexdigest(),
                    )
                )
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))],
                names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
            )

    staged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return staged.mapInArrow(run, _DIGEST)
