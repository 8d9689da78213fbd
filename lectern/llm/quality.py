"""Quality scores by nearest-neighbour voting in a latent semantic space.

A text's features are its byte trigrams, hashed to a fixed number of places, with
log frequencies and inverse document frequencies counted over all documents, and four
shares that trigrams do not show: repeated words, capitals, symbols, digits. A truncated
singular value decomposition of a bounded sample of labelled texts gives the latent
space. The sample's latent vectors are broadcast; every document is multiplied with all
of them, block by block, and its nearest ones vote with their similarities.

The sample is bounded by ``SAMPLE_PER_CLASS`` and so is everything that the driver or a
broadcast holds; features, document frequencies and scores cover every document.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, free_name, save_stage

PLACES = 4096
RANK = 48
NEIGHBOURS = 25
# Labelled texts of each class that the classifier is fitted on, at most.
SAMPLE_PER_CLASS = 2048
THRESHOLD = 0.3
# A similarity counts as its power, so that near neighbours weigh more than far ones.
SHARPNESS = 8.0
# Length of a share of one, beside the unit vector of the trigrams.
SHARE_WEIGHT = 2.0
# Vectors beyond the rank that subspace iteration carries, its rounds and its start.
_SPARE, _ROUNDS, _START = 16, 12, 42
_SLICE = 1 << 20
_CAPITALS = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-")


def trigram_counts(text: bytes | None) -> np.ndarray:
    """How often each place is hit by the text's byte trigrams; slices bound the memory."""
    out = np.zeros(PLACES, np.int64)
    raw = b" " + (text or b"") + b" "
    for at in range(0, max(1, len(raw) - 2), _SLICE):
        a = np.frombuffer(raw[at : at + _SLICE + 2], np.uint8).astype(np.uint32)
        if len(a) > 2:
            code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
            place = (code * np.uint32(2654435761)) >> np.uint32(32 - PLACES.bit_length() + 1)
            out += np.bincount(place, minlength=PLACES)
    return out


def shares(text: bytes | None) -> list[float]:
    """Shares of words equal to the word before, and of capitals, symbols and digits."""
    words = (text or b"").split()
    if not words:
        return [0.0] * 4
    again = sum(map(operator.eq, words, itertools.islice(words, 1, None)))
    groups = (_CAPITALS, _SYMBOLS, _DIGITS)
    return [again / len(words), *[1 - len(text.translate(None, g)) / len(text) for g in groups]]


class Features:
    """Log frequencies of places and shares of many texts, one row per text."""

    def __init__(self, counts: np.ndarray, of_shares: list[list[float]]):
        """Takes ``counts`` over: a float32 matrix is changed in place."""
        self.places = counts.astype(np.float32, copy=False).reshape(-1, PLACES)
        np.log1p(self.places, out=self.places)
        self.shares = np.array(of_shares, np.float32).reshape(-1, 4)

    def weighted(self, weights: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.places), PLACES + 4), np.float32)
        np.multiply(self.places, weights, out=out[:, :PLACES])
        out[:, :PLACES] /= np.maximum(np.linalg.norm(out[:, :PLACES], axis=1, keepdims=True), 1e-12)
        np.multiply(self.shares, SHARE_WEIGHT, out=out[:, PLACES:])
        return out


def features(texts: list[bytes | None]) -> Features:
    return Features(np.array([trigram_counts(t) for t in texts], np.float32), [shares(t) for t in texts])


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """For each place the number of documents that hit it, and the number of documents.

    Each task sums its own documents up; the sums have one row per place.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(PLACES, np.int64), 0
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                total += trigram_counts(text) > 0
                n += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, PLACES), pa.int32()), pa.array([n, *total.tolist()], pa.int64())],
            names=["place", "n"],
        )

    rows = docs.select(text_col).mapInArrow(count, "place int, n long")
    sums = dict(rows.groupBy("place").agg(F.sum("n").alias("n")).collect())
    return np.array([sums.get(p, 0) for p in range(PLACES)], np.float64), sums.get(-1, 0)


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt from; a null id is one of them."""
    part = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(part == 0, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS
) -> tuple[Features, np.ndarray]:
    """At most ``per_class`` labelled texts of each class, chosen by a hash of their id.

    Ids are chosen before texts are read: the two lists are bounded, and their join
    with the documents is a broadcast of that bounded list.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
    known = known.filter("quality = high").select("doc_id", "quality")
    # Labels may name documents that are gone; only those that are here are chosen from.
    known = save_stage(known.join(docs.select("doc_id").distinct(), "doc_id"), "labels")
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [known.filter(F.col("quality") == q).orderBy(*order).limit(per_class) for q in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id")
    texts = rows.agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def latent_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            raw = [trigram_counts(t).astype("<i4").tobytes() for t in texts]
            own = pa.array([shares(t) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array(raw, pa.binary()), own],
                names=["doc_id", "quality", "counts", "shares"],
            )

    counted = texts.select("doc_id", "quality", "text").mapInArrow(
        latent_features, "doc_id long, quality int, counts binary, shares array<double>"
    )
    counts, of_shares, marks = np.zeros((2 * per_class, PLACES), np.float32), [], []
    for row in counted.orderBy("doc_id").toLocalIterator():
        counts[len(marks)] = np.frombuffer(row.counts, "<i4")
        of_shares.append(row.shares)
        marks.append(row.quality)
    return Features(counts[: len(marks)], of_shares), np.array(marks, np.float64)


@dataclass(frozen=True)
class Model:
    """The latent space, the labelled vectors in it and their labels."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: Features) -> np.ndarray:
        """Unit vectors of weighted features in the latent space."""
        return _unit(x.weighted(self.weights) @ self.basis)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """Share of label 1 among the nearest vectors, weighted by similarity.

        Without any labelled text every score is the prior, one half.
        """
        if not len(self.vectors):
            return np.full(len(texts), self.prior)
        near = min(NEIGHBOURS, len(self.vectors))
        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            own = self.latent(features(texts[at : at + 256]))
            cosine = own @ self.vectors.T
            best = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            sim = np.take_along_axis(cosine, best, 1).astype(np.float64)
            weight = np.clip(sim, 1e-3, 1.0) ** SHARPNESS
            votes = (weight * self.labels[best]).sum(1) + self.prior * 1e-9
            out[at : at + 256] = votes / (weight.sum(1) + 1e-9)
        return np.clip(out, 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def leading_directions(x: np.ndarray, rank: int) -> np.ndarray:
    """The first right singular vectors of a matrix, by subspace iteration.

    Needs no memory beside the matrix but some vectors more than ``rank``; the start is
    fixed, so the same matrix gives the same directions.
    """
    k = min(rank + _SPARE, *x.shape)
    q = np.random.default_rng(_START).standard_normal((x.shape[1], k), np.float32)
    for _ in range(_ROUNDS):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    _, values, turn = np.linalg.svd(x @ q, full_matrices=False)
    keep = values[:rank] > 1e-4 * max(values[0], 1e-12)
    return (q @ turn[:rank].T)[:, keep]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, rank: int = RANK) -> Model:
    """Fit the latent space and keep the sample's vectors.

    The decomposition works on the matrix of the sample, at most ``2 * per_class``
    rows; it is a driver-side step of bounded size.
    """
    held, n = document_frequencies(docs)
    weights = (np.log((1 + n) / (1 + held)) + 1).astype(np.float32)
    sample, marks = labelled_sample(docs, labels, per_class)
    if not len(marks):
        nothing = np.zeros((0, rank), np.float32)
        return Model(weights, np.zeros((PLACES + 4, rank), np.float32), nothing, marks, 0.5)
    x = sample.weighted(weights)
    basis = leading_directions(x, rank)
    return Model(weights, basis, _unit(x @ basis), marks, float(marks.mean()))


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", output: str = "score") -> DataFrame:
    """Add every document's score, from its text alone; rows stay where they are.

    A null text scores as an empty one. A column that has the output's name is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop(output)
    names = kept.columns
    at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = sent.value.score(as_bytes(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, output])

    return kept.mapInArrow(score, f"{schema}, `{output}` double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = fit(docs, labels)
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, as they came."""
    name = free_name(docs, "_score")
    scored = score_documents(docs, fit(docs, labels), output=name)
    return scored.filter(F.col(name) >= THRESHOLD).drop(name)
