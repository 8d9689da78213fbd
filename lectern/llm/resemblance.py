"""Near duplicates by the exact Jaccard similarity of their word shingles.

All pairs that reach the threshold are found, by prefix filtering: shingles have one
global order, and two sets that are similar enough share one of each other's first
``n - ceil(threshold * n) + 1`` shingles. Any order is right; here shingles that are
frequent in a sample of documents come last, so that common lines seldom lie in a
prefix.

A shared shingle becomes a pair only if three more exact tests let it: that it is not
known to be a later one than the first that both sets have, its places in both orders
(the first shared one has nothing shared before it), and a mark of 512 bits per set in
which every shingle flips one bit. Bits in which two marks differ are no more than the
shingles that only one of the sets has, so a pair with more of them than the threshold
allows is ruled out without its texts. All are conditions of the join: sets of a large
group that are alike, but not enough, make no rows, and a pair makes about one row. What
passes is verified on all shingles, hashed to 64 bits, of the texts, which are read from
the documents again; a text that many others are compared with is sent once for a block
of them.

Texts with equal sets are taken together first. A caller may propose pairs (``simhash``
does, from its tree); they are verified before any join, and sets that they link are not
compared again. A large group of near copies would still have a square number of links.
Only components are asked for, so in every shingle that has more than a few pairs for
each of its sets, sets are first compared with a few leaders, and pairs that are linked
already are left out; when no such shingle is left, or a round of leaders leaves more
than half of their pairs, all pairs between different components are compared.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import as_bytes, save_stage
from lectern.llm.components import components
from lectern.llm.words import WordHasher, groups, runs

SHINGLE = 5
THRESHOLD = 0.8
# Documents whose shingles are counted for the order, and frequent shingles kept, at most.
SAMPLE = 30_000
FREQUENT = 262_144
# Leaders of a prefix shingle in one round, and pairs for each of its rows that are all compared.
LEADERS = 8
PAIRS_PER_ROW = 8
# Words of 64 bits in a set's mark.
MARK_WORDS = 8
# Texts that are verified against one text in one block.
BLOCK_PAIRS = 1024
# Shingles at the start of a prefix that its postings carry along.
FIRSTS = 4
_SLICE = 65_536
_MARK = [f"m{k}" for k in range(MARK_WORDS)]
_FIRST = [f"f{k}" for k in range(FIRSTS)]
_SETS = "doc_id long, key binary, size int, high long, low long, fp long, prefix array<long>, "
_SETS += ", ".join(f"{m} long" for m in _MARK)


def prefix_size(shingles: int, threshold: float) -> int:
    """Shingles in order of which a similar set must hold one."""
    return shingles - math.ceil(threshold * shingles - 1e-9) + 1


def hashed_sets(texts: list[bytes | None], n: int, hasher: WordHasher) -> Iterator[tuple[int, np.ndarray]]:
    """Row and distinct shingle hashes of every text."""
    for group in groups((t.lower() if t else t for t in texts), hasher):
        hashes = runs(group.hashes, n)
        for row, i, j in zip(group.rows, group.bounds[:-1].tolist(), group.bounds[1:].tolist(), strict=True):
            own = hashes[i : j - n + 1] if j - i >= n else runs(group.hashes[i:j], j - i) if j > i else hashes[:0]
            yield row, np.unique(own)


def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of shingles that several sampled documents have."""
    rate = max(1, math.ceil(docs.count() / SAMPLE))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for _, own in hashed_sets(as_bytes(batch.column(0)), n, hasher):
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["shingle"])

    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0).select("text")
    counted = chosen.mapInArrow(shingles, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    found = counted.filter("n > 2").orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    hashes, counts = (found[c].to_numpy() for c in ("shingle", "n"))
    hashes = hashes.view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def set_mark(own: np.ndarray) -> np.ndarray:
    """The bits that are flipped when every hash of a set flips one."""
    bits = np.bincount((own >> np.uint64(7)).astype(np.int64) % (64 * MARK_WORDS), minlength=64 * MARK_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view("<i8")


def set_fingerprint(own: np.ndarray) -> np.ndarray:
    """SimHash of a set: the bits that more than half of its hashes have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), _SLICE):
        rows = own[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(own), bitorder="little").view("<i8")[0]


def prefixes(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Every document's key, its set's size, 128-bit hash, SimHash, prefix and mark."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, n))

    def prefix(own: np.ndarray) -> np.ndarray:
        hashes, counts = sent.value
        often = np.zeros(len(own), np.int64)
        if len(hashes):
            spot = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            often = np.where(hashes[spot] == own, counts[spot], 0)
        return own[np.lexsort((own, often))[: prefix_size(len(own), threshold)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            sizes, keys, prints, firsts, marks = [], [], [], [], []
            for _, own in hashed_sets(as_bytes(batch.column(2)), n, hasher):
                sizes.append(len(own))
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                prints.append(set_fingerprint(own))
                firsts.append(prefix(own).view(np.int64) if len(own) else own.view(np.int64))
                marks.append(set_mark(own))
            key = np.array([np.frombuffer(k, "<i8") for k in keys], np.int64).reshape(-1, 2)
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int32())]
            columns += [pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array(prints, pa.int64())]
            columns.append(pa.array(firsts, pa.list_(pa.int64())))
            mark = np.array(marks, np.int64).reshape(-1, MARK_WORDS)
            columns += [pa.array(mark[:, k]) for k in range(MARK_WORDS)]
            names = ["doc_id", "key", "size", "high", "low", "fp", "prefix", *_MARK]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "key", "text").mapInArrow(run, _SETS)


def jaccard_reaches(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Are two sets of distinct hashes similar enough?"""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def verified(pairs: DataFrame, keys: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs ``a, b`` whose texts are similar enough.

    ``keys`` has ``node, doc_id, key`` of every set, ``texts`` the documents' ``doc_id,
    key, text``. The text of ``b`` is sent once for a block of its pairs, before theirs.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, hasher = np.zeros(0, np.uint64), WordHasher()
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            opens = batch.column("a").is_null().to_numpy(zero_copy_only=False)
            for row, own in hashed_sets(as_bytes(batch.column("text")), n, hasher):
                if opens[row]:
                    head = own
                else:
                    good[row] = jaccard_reaches(own, head, threshold)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(BLOCK_PAIRS)).alias("blocks"))
    dealt = pairs.join(sizes, "b").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks"))).drop("blocks")
    wanted = dealt.select("b", "block", "a", F.col("a").alias("node"))
    heads = dealt.select("b", "block").distinct().select("b", "block", F.lit(None).cast("long").alias("a"), "b")
    wanted = save_stage(wanted.unionByName(heads.toDF("b", "block", "a", "node")), "wanted")
    ends = wanted.select("node").distinct().join(keys, "node")
    same = (texts["key"] == ends["key"]) & texts["doc_id"].eqNullSafe(ends["doc_id"])
    # Rows that repeat an id and its text are one text.
    named = texts.join(ends, same).select("node", "text").dropDuplicates(["node"])
    rows = wanted.join(named, "node").select("b", "block", "a", "text").repartition("b", "block")
    ordered = rows.sortWithinPartitions("b", "block", F.col("a").asc_nulls_first())
    return ordered.mapInArrow(check, "a long, b long")


Propose = Callable[[DataFrame], DataFrame]


def _fits(threshold: float) -> Column:
    """Can two sets with these marks, whose first shared shingle has these places, be similar enough?

    False too where one of the first shingles of both shows that they share an earlier one.
    """
    both = F.col("size") + F.col("other_size")
    shared = F.least(F.col("size") - F.col("at"), F.col("other_size") - F.col("other_at"))
    places = [(j, k) for j in range(FIRSTS) for k in range(FIRSTS)]
    # A prefix that is shorter has a null, but no posting behind that place.
    met = [(F.col(f"f{j}") == F.col(f"other_f{k}")) & (F.col("at") > j) & (F.col("other_at") > k) for j, k in places]
    differing = reduce(add, [F.bit_count(F.col(m).bitwiseXOR(F.col(f"other_{m}"))) for m in _MARK])
    placed = shared * (1 + threshold) >= threshold * both - 1e-9
    return placed & (differing * (1 + threshold) <= (1 - threshold) * both + 1e-9) & ~reduce(or_, met)


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of ``node`` and ``other_node`` in different components."""
    fine = rows.filter((F.col("root") != F.col("other_root")) & _fits(threshold))
    a, b = F.greatest("node", "other_node"), F.least("node", "other_node")
    return fine.select(a.alias("a"), b.alias("b")).distinct()


def _relabelled(live: DataFrame, links: DataFrame) -> DataFrame:
    """Postings with the roots that the links give, of shingles that several components have."""
    roots = components(links, "a", "b").withColumnRenamed("root", "newer")
    rooted = live.join(roots, "node", "left").withColumn("root", F.coalesce("newer", "root")).drop("newer")
    rooted = save_stage(rooted, "postings")
    open_ = rooted.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y")
    return save_stage(rooted.join(open_.select("shingle"), "shingle", "left_semi"), "postings")


def similar_links(
    prefixed: DataFrame, texts: DataFrame, n: int, threshold: float, propose: Propose | None = None
) -> DataFrame | None:
    """Links ``a, b`` that join exactly the nodes linked by similar pairs.

    ``prefixed`` has a row for each distinct set: ``node, doc_id, key, size, fp, prefix``
    and the mark; ``texts`` has ``doc_id, key, text``. Pairs that ``propose`` gives for
    ``node, fp`` are verified first.
    """
    keys = prefixed.select("node", "doc_id", "key")
    carried = [*_MARK, *_FIRST]
    marks = prefixed.select("node", *_MARK, *[F.get("prefix", F.lit(k)).alias(f) for k, f in enumerate(_FIRST)])
    posted = prefixed.select("node", "size", F.posexplode("prefix").alias("at", "shingle"))
    shared = posted.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select("shingle")
    # The planner takes an exploded array for one row; a merge join keeps it from broadcasting postings.
    live = save_stage(posted.hint("merge").join(shared, "shingle").withColumn("root", F.col("node")), "postings")
    fields = ["node", "size", "at", "root", *carried]
    links, leading, turn, before = None, True, 0, math.inf
    if propose is not None:
        proposed = save_stage(propose(prefixed.filter("size > 0").select("node", "fp")), "proposed")
        links = save_stage(verified(proposed, keys, texts, n, threshold), "similar")
        live = live if links.isEmpty() else _relabelled(live, links)
    while True:
        per_root = live.groupBy("shingle", "root").agg(F.count("*").cast("double").alias("n"))
        per_shingle = per_root.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        pairs = (F.col("n") * F.col("n") - F.col("own")) / 2
        busy = save_stage(per_shingle.select("shingle", pairs.alias("pairs"), (pairs > PAIRS_PER_ROW * F.col("n")).alias("busy")), "counts")
        crossing = busy.agg(F.sum("pairs"), F.sum(F.when(F.col("busy"), F.col("pairs")))).first()
        if not crossing[0]:
            return links
        last = not leading or not crossing[1] or crossing[1] > before / 2
        before = crossing[1]
        if last:
            marked = live.join(marks, "node").select("shingle", *fields)
            other = marked.select("shingle", *[F.col(c).alias(f"other_{c}") for c in fields])
            found = marked.hint("merge").join(other, "shingle").filter("node > other_node")
        else:
            led = live.join(busy.filter("busy").select("shingle"), "shingle", "left_semi")
            marked = led.join(marks, "node").select("shingle", *fields)
            salts = [F.xxhash64("node", F.lit(turn * LEADERS + k)) for k in range(LEADERS)]
            member = F.struct("node", "size", "at", "root")
            leaders = led.groupBy("shingle").agg(*[F.min_by(member, s).alias(f"l{k}") for k, s in enumerate(salts)])
            listed = F.array_distinct(F.array(*[f"l{k}" for k in range(LEADERS)]))
            other = leaders.select("shingle", F.explode(listed).alias("other")).select("shingle", "other.*")
            other = other.join(marks, "node").select("shingle", *[F.col(c).alias(f"other_{c}") for c in fields])
            found = marked.hint("merge").join(other, "shingle")
        pairs = save_stage(_pairs(found, threshold), "candidates")
        new = save_stage(verified(pairs, keys, texts, n, threshold), "similar")
        links = new if links is None else save_stage(links.unionByName(new), "similar")
        if last:
            return links
        leading, turn = not new.isEmpty(), turn + 1
        if leading:
            live = _relabelled(live, links)


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
    propose: Propose | None = None,
) -> DataFrame:
    """``doc_id, component_id`` of every document, linked where Jaccard reaches ``threshold``.

    Texts are lower-cased (A-Z) and split at ASCII white space; shingles count once. A
    text shorter than a shingle is one shingle of all its words. Texts without words are
    linked with each other. ``component_id`` is the smallest id of the component; a row
    with a null id takes part, and a component of such rows alone has a null id.
    ``propose`` makes pairs ``a, b`` of nodes from ``node, fp``, the sets' fingerprints;
    it speeds the search up and leaves the result as it is.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    own = prefixes(rows, shingle, threshold).withColumn("row", F.monotonically_increasing_id())
    own = save_stage(own, "sets")
    sets = own.groupBy("high", "low").agg(F.min("row").alias("node"), F.min("doc_id").alias("lowest"))
    sets = save_stage(sets, "distinct")
    firsts = own.withColumnRenamed("row", "node").join(sets.select("node"), "node", "left_semi")
    links = similar_links(firsts, rows, shingle, threshold, propose)
    rooted = sets.withColumn("root", F.col("node"))
    if links is not None:
        roots = components(links, "a", "b")
        rooted = sets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    classes = rooted.join(named, "root").select("high", "low", "component_id")
    return own.select("doc_id", "high", "low").join(classes, ["high", "low"]).select("doc_id", "component_id")
