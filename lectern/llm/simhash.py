"""Near duplicates by SimHash fingerprints in a vantage-point tree.

A fingerprint has a bit set where more than half of the text's shingle hashes have it.
The tree is grown on a bounded sample of fingerprints: each node has a vantage point and
a radius, inner fingerprints lie within the radius, outer ones beyond it. The tree only
deals work out; every fingerprint is searched.

By the triangle inequality two fingerprints within ``max_bits`` of one another, one
inner and one outer, are both closer to the border than that. So an inner fingerprint
within ``max_bits`` of the border goes to the outer branch too, and every such pair
meets in a leaf. A leaf's task searches it with a vantage-point tree of its own, down to
small blocks that are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, free_name, save_stage
from lectern.llm.components import components
from lectern.llm.resemblance import similar_documents

SHINGLE = 3
MAX_BITS = 2
# Reach of the tree where similar sets are sought: at four bits and more it hardly prunes.
SET_BITS = 3
SEED = 42
# Fingerprints that the tree is grown on, at most, and how many a leaf should search.
SAMPLE = 65_536
LEAF = 16_384
# Fingerprints that are compared without another vantage point.
BLOCK = 1_024
_SLICE = 65_536


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1])
    stops = ends[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        spans = zip(starts[at : at + _SLICE].tolist(), stops[at : at + _SLICE].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], SEED) for i, j in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` with the fingerprint as a signed 64-bit integer; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _radius(distances: np.ndarray) -> int:
    """The median distance, lowered where nothing would lie beyond it."""
    return int(min(np.median(distances), int(distances.max()) - 1))


@dataclass(frozen=True)
class Node:
    vantage: np.uint64
    radius: int
    inner: Node | int
    outer: Node | int


class Tree:
    """A vantage-point tree over a sample; its leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaf: int):
        self.leaves = 0
        self.root = self._grow(sample, leaf)

    def _grow(self, sample: np.ndarray, leaf: int) -> Node | int:
        if len(sample) > leaf:
            vantage = sample[len(sample) // 2]
            distances = _distance(sample, vantage)
            radius = _radius(distances)
            if radius >= 0:
                near = distances <= radius
                return Node(vantage, radius, self._grow(sample[near], leaf), self._grow(sample[~near], leaf))
        self.leaves += 1
        return self.leaves - 1

    def deal(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaf and positions of the points that are searched in it."""
        stack: list[tuple[Node | int, np.ndarray]] = [(self.root, np.arange(len(points)))]
        while stack:
            node, at = stack.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                yield node, at
                continue
            distances = _distance(points[at], node.vantage).astype(np.int64)
            stack.append((node.inner, at[distances <= node.radius]))
            stack.append((node.outer, at[distances > node.radius - reach]))


def _blocks(points: np.ndarray, reach: int) -> Iterator[np.ndarray]:
    """Positions, ascending, that are compared with one another; pairs within ``reach`` meet."""
    stack = [np.arange(len(points))]
    while stack:
        at = stack.pop()
        own = points[at]
        if len(at) > BLOCK:
            distances = _distance(own, own[len(own) // 2]).astype(np.int64)
            radius = _radius(distances)
            inner, outer = at[distances <= radius], at[distances > radius - reach]
            if radius >= 0 and max(len(inner), len(outer)) < 0.9 * len(at):
                stack += [inner, outer]
                continue
        yield at


def close_pairs(points: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within ``reach`` bits; a pair may come more than once."""
    for at in _blocks(points, reach):
        own = points[at]
        for i in range(0, len(at), 256):
            near = np.bitwise_count(own[i : i + 256, None] ^ own[None, i:]) <= reach
            a, b = np.nonzero(near)
            a, b = a + i, b + i
            ahead = a < b
            if ahead.any():
                yield at[a[ahead]], at[b[ahead]]


def nearest_before(points: np.ndarray, reach: int) -> np.ndarray:
    """Of each point the position of the nearest one before it within ``reach`` bits, else its own."""
    found, best = np.arange(len(points)), np.full(len(points), reach + 1, np.uint8)
    for at in _blocks(points, reach):
        own = points[at]
        for i in range(0, len(at), 128):
            rows = at[i : i + 128]
            distances = np.bitwise_count(own[i : i + 128, None] ^ own[None, : i + len(rows)])
            distances[:, i:][np.triu_indices(len(rows))] = 255
            nearest = distances.argmin(axis=1)
            distance = distances[np.arange(len(rows)), nearest]
            better = distance < best[rows]
            best[rows[better]], found[rows[better]] = distance[better], at[nearest[better]]
    return found


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest position that each position is linked with, within one task."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            low = np.minimum(root[a], root[b])
            if (root[a] == root[b]).all():
                break
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
    return root


def _in_leaves(fps: DataFrame, max_bits: int, sample: int, partner: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``a, b``: fingerprints and the ones at the positions that ``partner`` finds in a leaf's sorted ones.

    ``fps`` has distinct ``fp``.
    """
    count = fps.count()
    # A leaf holds its share of the fingerprints, as far as the sample can tell.
    chosen = fps.orderBy(F.xxhash64("fp"), "fp").limit(sample)
    known = chosen.toArrow()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    per_leaf = max(16, LEAF * len(known) // max(1, count))
    tree = Tree(known, per_leaf)
    sent = fps.sparkSession.sparkContext.broadcast(tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for leaf, at in sent.value.deal(points, max_bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), leaf), pa.int32()), pa.array(points[at].view(np.int64))],
                    names=["leaf", "fp"],
                )

    def search(group: pa.Table) -> pa.Table:
        points = np.sort(group["fp"].to_numpy())
        partners = points[partner(points.view(np.uint64))]
        linked = partners != points
        return pa.table({"a": points[linked], "b": partners[linked]})

    dealt = fps.select("fp").mapInArrow(deal, "leaf int, fp long")
    return dealt.groupBy("leaf").applyInArrow(search, "a long, b long")


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, sample: int = SAMPLE) -> DataFrame:
    """Links ``a, b`` that join exactly the fingerprints linked within ``max_bits``.

    ``fps`` has distinct ``fp``. A leaf hands on one link per fingerprint that has one,
    to the smallest of its group there, not all pairs.
    """
    return _in_leaves(fps, max_bits, sample, lambda points: local_roots(len(points), close_pairs(points, max_bits)))


def close_sets(sets: DataFrame, max_bits: int = SET_BITS, sample: int = SAMPLE) -> DataFrame:
    """Pairs ``a, b`` of nodes whose fingerprints lie within ``max_bits``, few for each node.

    ``sets`` has ``node, fp``. Of equal fingerprints the smallest node stands for all and
    is paired with each; it is paired with the nearest smaller one of every leaf it is in.
    """
    least = save_stage(sets.groupBy("fp").agg(F.min("node").alias("lowest")), "distinct")
    near = _in_leaves(least.select("fp"), max_bits, sample, lambda points: nearest_before(points, max_bits))
    ends = near.join(least.toDF("a", "node"), "a").join(least.toDF("b", "other"), "b")
    equal = sets.join(least.toDF("fp", "other"), "fp").filter("node <> other")
    both = ends.select("node", "other").unionByName(equal.select("node", "other"))
    return both.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``doc_id, fp, fingerprint, component_id`` of every document.

    Texts are lower-cased (A-Z) and split at ASCII white space. A text shorter than a
    shingle is one shingle of all its words; a null or empty one has fingerprint 0.
    ``component_id`` is the smallest id reachable over links; equal texts have equal
    fingerprints and so one component. A row with a null id takes part; a component of
    such rows alone has a null id.
    """
    own = save_stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = save_stage(own.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "distinct")
    roots = components(fingerprint_links(least.select("fp"), max_bits), "a", "b")
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return own.join(classes, "fp").select(
        "doc_id",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each class of similar documents the rows with the smallest id, as they came.

    Classes are those of ``resemblance``: five-word shingles with an exact Jaccard
    similarity of 0.8 or more. The tree of fingerprints proposes pairs, which are
    verified; similar pairs that lie further apart in bits than the tree reaches are
    found by their rare shingles. Rows that repeat the kept id all stay, and so do rows
    without an id.
    """
    classes = similar_documents(docs, id_col, text_col, propose=close_sets)
    name = free_name(docs, "_gone")
    gone = classes.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")
