"""Exact top-k inner products in three phases with a uniform threshold.

A task scores a block of queries against a block of vectors. Vectors are cut into parts
of consecutive dimensions, and a total score is the sum of the part scores.

1. Every part of a block gathers its own k best vectors per query. Their exact totals
   give, per query, a cutoff: the k-th best of them. No result can score less.
2. The cutoff goes back with the queries. A vector whose every part score is below the
   cutoff's equal share scores below the cutoff, so the parts collect only entries that
   reach the share.
3. The other part scores of the collected vectors are added, and the totals are ranked.

A task holds all parts of its block, so entries are completed where they are collected.
It hands on the k best totals per query and block, never a row per collected pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import blocks_for, save_stage

SCALE = 256
PARTS = 2
VECTORS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 2048
QUERIES_AT_ONCE = 256
_GROUP = ["dim", "vec_block", "query_block"]
_QUERY = ["query_id", "query_copy"]
_VECTOR = ["vec_id", "vec_copy"]
_SCORES = "dim int, query_id long, query_copy int, vec_id long, vec_copy int, score long"
_NAMES = ["dim", *_QUERY, *_VECTOR, "score"]


def _blocks(ids: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*ids), F.lit(n)).cast("int")


def integer_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``vec_id, vec_copy, dim, v``: components as floor(256 * x), x as double.

    Vectors that are null, empty or hold a null or non-finite component are left out, as
    are rows without an id. Rows that share an id are told apart by ``vec_copy``.
    """
    x = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    present = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    rows = df.filter(present & F.coalesce(fine, F.lit(False)))
    rows = rows.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.size(vector).alias("dim"),
        F.transform(x, lambda c: F.floor(c * SCALE)).alias("v"),
    )
    copy = F.row_number().over(Window.partitionBy("vec_id").orderBy("dim", "v"))
    return rows.withColumn("vec_copy", (copy - 1).cast("int"))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _numeric(v: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in a type whose sums of products are exact."""
    top = max(1, int(np.abs(v).max(initial=0))) * max(1, int(np.abs(q).max(initial=0)))
    top *= max(1, v.shape[1])
    if top < 1 << 53:
        return v.astype(np.float64), q.astype(np.float64)
    if top >= 1 << 62:
        raise OverflowError("inner products of these vectors do not fit 64 bits")
    return v, q


def _empty() -> pa.Table:
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
    return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=_NAMES)


def _keys(table: pa.Table, names: list[str]) -> pd.MultiIndex:
    return pd.MultiIndex.from_arrays([table[n].to_numpy() for n in names])


def _reaching(line: np.ndarray, n: int) -> np.ndarray:
    """Places of the n highest values and of all that equal the last of them."""
    if len(line) <= n:
        return np.arange(len(line))
    return np.flatnonzero(line >= np.partition(line, -n)[-n])


def _score_block(k: int, parts: int):
    """A task's work for phase 1 (queries without a cutoff) and phases 2 and 3 (with one)."""

    def score(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _empty()
        v, q = _numeric(_matrix(vectors["v"], vectors.num_rows), _matrix(queries["v"], queries.num_rows))
        width = -(-v.shape[1] // parts)
        cuts = [slice(p * width, (p + 1) * width) for p in range(parts)]
        own = _keys(vectors, _VECTOR).get_indexer(_keys(queries, _QUERY))
        shares = [c if c is None else -(-c // parts) for c in queries["cutoff"].to_pylist()]
        gather = queries["gather"].to_pylist()
        names, copies = vectors["vec_id"].to_numpy(), vectors["vec_copy"].to_numpy()
        qi, vi, totals = [], [], []
        for at in range(0, len(q), QUERIES_AT_ONCE):
            by_part = [q[at : at + QUERIES_AT_ONCE, c] @ v[:, c].T for c in cuts]
            for row in range(len(by_part[0])):
                i = at + row
                lines = [s[row] for s in by_part]
                if gather[i]:
                    # One more than k, for the query itself may be among them.
                    near = np.unique(np.concatenate([_reaching(line, k + 1) for line in lines]))
                elif shares[i] is None:
                    near = np.arange(len(names))
                else:
                    near = np.flatnonzero(np.logical_or.reduce([line >= shares[i] for line in lines]))
                near = near[near != own[i]]
                total = sum(line[near] for line in lines)
                top = _reaching(total, k)
                near, total = near[top], total[top]
                order = np.lexsort((copies[near], names[near], -total))[:k]
                qi.append(np.full(len(order), i))
                vi.append(near[order])
                totals.append(total[order].astype(np.int64))
        qi, vi, totals = (pa.array(np.concatenate(x)) for x in (qi, vi, totals))
        ends = [queries[n].take(qi) for n in _QUERY] + [vectors[n].take(vi) for n in _VECTOR]
        dims = pa.array(np.full(len(totals), key[0].as_py()), pa.int32())
        return pa.Table.from_arrays([dims, *ends, totals], names=_NAMES)

    return score


class _Search:
    """The blocks of vectors and queries, and the passes over them."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int, parts: int):
        self.k, self.parts = k, parts
        self.vec_blocks = blocks_for(vectors.count(), VECTORS_PER_BLOCK)
        self.query_blocks = blocks_for(queries.count(), QUERIES_PER_BLOCK)
        copies = F.explode(F.sequence(F.lit(0), F.lit(self.query_blocks - 1))).alias("query_block")
        placed = vectors.withColumn("vec_block", _blocks(_VECTOR, self.vec_blocks))
        self.vectors = placed.select("dim", "vec_block", copies, *_VECTOR, "v")
        self.queries = queries.withColumn("query_block", _blocks(_QUERY, self.query_blocks))

    def score(self, cutoffs: DataFrame | None) -> DataFrame:
        """The k best totals per query and block that a pass finds."""
        queries = self.queries
        if cutoffs is None:
            queries = queries.withColumn("cutoff", F.lit(None).cast("long"))
        else:
            queries = queries.join(cutoffs, ["dim", *_QUERY], "left")
        # Queries go to every block of vectors: one copy per block, no pairs.
        blocks = F.explode(F.sequence(F.lit(0), F.lit(self.vec_blocks - 1))).alias("vec_block")
        everywhere = queries.withColumn("gather", F.lit(cutoffs is None)).select("*", blocks)
        grouped = self.vectors.groupBy(*_GROUP).cogroup(everywhere.groupBy(*_GROUP))
        return grouped.applyInArrow(_score_block(self.k, self.parts), _SCORES)


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's k best other rows.

    Ties go to the smaller id. Vectors are compared with those of their own length. Of
    rows that share an id each is a candidate and, if it is a query, a query of its own.
    A query without other rows has no result; an empty table gives an empty result.
    Components so large that an inner product may not fit 64 bits end the job with an
    ``OverflowError``.
    """
    vectors = save_stage(integer_vectors(df, id_col, vector), "vectors")
    own_names = {"vec_id": "query_id", "vec_copy": "query_copy"}
    queries = save_stage(vectors.filter(is_query).withColumnsRenamed(own_names), "queries")
    search = _Search(vectors, queries, k, parts)

    per_query = Window.partitionBy("dim", *_QUERY).orderBy(F.desc("score"), "vec_id", "vec_copy")
    rank = F.row_number().over(per_query)
    gathered = search.score(None).withColumn("rank", rank)
    cutoffs = gathered.filter(F.col("rank") == k).select("dim", *_QUERY, F.col("score").alias("cutoff"))
    final = search.score(save_stage(cutoffs, "cutoffs")).withColumn("rank", rank)
    return final.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
