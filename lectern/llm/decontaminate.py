"""Benchmark items inside documents, found by containment of their shingles.

A short item in a long document has a tiny Jaccard similarity, so documents are not
sketched; items are. Items are partitioned by size. In a size class the sketch of an
item is its ``k`` smallest shingle hashes (a bottom-k MinHash), with ``k`` one more than
the shingles that the largest item of the class may lack. By the pigeonhole principle a
document that contains enough of an item holds one of them, so the search loses
nothing; what it finds is verified on the shingles themselves.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, free_name
from lectern.llm.words import WordHasher, groups, runs

SHINGLE = 5
THRESHOLD = 0.8
# Item text that is sent to all tasks at once; a larger benchmark is taken in blocks.
BLOCK_BYTES = 16 << 20
_LEAK = "array<struct<item_id:bigint,shared:int,shingles:int>>"


def shingles_of(words: list[bytes], n: int) -> list[bytes]:
    """All runs of n words; the whole sequence if it is shorter; none without words."""
    if len(words) < n:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def sketch_size(shingles: int, threshold: float) -> int:
    """Smallest hashes of which a document with enough of the item must hold one."""
    return shingles - math.ceil(threshold * shingles - 1e-9) + 1


class Index:
    """Sketches of one block of items, and their shingles to verify against."""

    def __init__(self, items: list[tuple[int, str | None]], n: int, threshold: float):
        self.n, self.threshold = n, threshold
        hasher = WordHasher()
        self.items: list[tuple[int, dict[bytes, int]]] = []
        by_hash: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            words = (text or "").encode().lower().split()
            own = dict.fromkeys(shingles_of(words, n))
            if not own:
                continue
            hashes = runs(hasher.hashes(words), min(n, len(words)))
            # The class of sizes from 2^c to 2^(c+1) - 1 shares one sketch size.
            largest = (1 << len(own).bit_length()) - 1
            for h in np.unique(hashes)[: sketch_size(largest, threshold)].tolist():
                by_hash[h].append(len(self.items))
            self.items.append((item_id, own))
        self.by_hash = dict(by_hash)
        self.sketch = np.array(sorted(by_hash), np.uint64)

    def leaks(self, words: list[bytes], hits: list[int]) -> list[dict]:
        """Items that a document contains, among those whose sketch it hit."""
        found = []
        own = set(shingles_of(words, self.n))
        for at in sorted({i for h in hits for i in self.by_hash[h]}):
            item_id, shingles = self.items[at]
            shared = sum(s in own for s in shingles)
            if shared >= self.threshold * len(shingles) - 1e-9:
                found.append({"item_id": item_id, "shared": shared, "shingles": len(shingles)})
        return found

    def search(self, texts: list[bytes | None], hasher: WordHasher) -> list[list[dict]]:
        found: list[list[dict]] = [[] for _ in texts]
        if not len(self.sketch):
            return found
        for group in groups((t.lower() if t else t for t in texts), hasher):
            hashes = runs(group.hashes, self.n)
            spot = np.minimum(np.searchsorted(self.sketch, hashes), len(self.sketch) - 1)
            hit = (self.sketch[spot] == hashes) & group.inside(self.n)[: len(hashes)]
            hits: dict[int, list[int]] = defaultdict(list)
            for at in np.flatnonzero(hit).tolist():
                hits[int(group.doc_of[at])].append(int(hashes[at]))
            for doc in np.flatnonzero((group.lengths < self.n) & (group.lengths > 0)).tolist():
                i, j = group.bounds[doc], group.bounds[doc + 1]
                h = int(runs(group.hashes[i:j], int(j - i))[0])
                if h in self.by_hash:
                    hits[doc].append(h)
            for doc, own in hits.items():
                words = group.words[group.bounds[doc] : group.bounds[doc + 1]]
                found[group.rows[doc]] = self.leaks(words, list(set(own)))
        return found


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks that keep each block's text within the bound, measured beforehand."""
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)
    return max(1, math.ceil((items.agg(size).first()[0] or 0) / block_bytes))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    output: str = "leaks",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add to every document the items of which it holds at least ``threshold``.

    ``items`` has ``item_id, text``. Texts are lower-cased (A-Z) and split at ASCII
    white space; shingles count once. A text with fewer words than a shingle is one
    shingle of all its words; an empty or null one has none and matches nothing.
    Documents stay where they are: blocks of items of a checked size go to them. An
    item row that repeats is reported repeatedly. Leaks are ordered by item.
    """
    blocks = item_blocks(items, block_bytes)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string"))
    out = docs.withColumn(output, F.array().cast(_LEAK))
    for block in range(blocks):
        mine = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        # Bounded by block_bytes; the order makes the result stable.
        pairs = [(r.item_id, r.text) for r in mine.orderBy("item_id", "text").collect()]
        out = _search_block(out, Index(pairs, shingle, threshold), text_col, output)
    return out


def _search_block(docs: DataFrame, index: Index, text_col: str, output: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(index)
    text_at, out_at = docs.columns.index(text_col), docs.columns.index(output)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = sent.value.search(as_bytes(batch.column(text_at)), hasher)
            before = batch.column(out_at).to_pylist()
            joined = [a + b for a, b in zip(before, found, strict=True)]
            columns = list(batch.columns)
            columns[out_at] = pa.array(joined, batch.schema.field(out_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(search, docs.schema)


def leak_pairs(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document and item: ``doc_id, item_id, shared, shingles, containment``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    found = find_leaks(rows, items).select("doc_id", F.explode_outer("leaks").alias("leak"))
    return found.filter("leak IS NOT NULL").select(
        "doc_id",
        "leak.item_id",
        "leak.shared",
        "leak.shingles",
        (F.col("leak.shared") / F.col("leak.shingles")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that contain no item, with the columns they came with."""
    name = free_name(docs, "_leaks")
    return find_leaks(docs, items, output=name).filter(F.size(name) == 0).drop(name)
