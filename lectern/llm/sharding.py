"""Rendezvous hashing of record keys over weighted shards.

Every shard draws a number from a hash of the key and its own number; the lowest wins.
A new shard changes no other draw, so rows move only into it; a heavier shard draws
lower in proportion to its weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import blocks_for

SHARDS = 16
# Rows of a shard that one task numbers.
ROWS_PER_BLOCK = 100_000
_DIGITS = 12


def _draw(key: Column, shard: int, weight: float) -> Column:
    """Minus the logarithm of a number between 0 and 1, over the shard's weight."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"/{shard}")))
    unit = (F.conv(F.left(digest, F.lit(_DIGITS)), 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
    return -F.log(unit) / F.lit(float(weight))


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that holds a key: the lowest draw, then the lowest number.

    A null key is one key like any other.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above zero")
    draws = [F.struct(_draw(key, s, w).alias("draw"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def number_slots(df: DataFrame, shard: str, order: Sequence[str], rows: int, output: str = "slot") -> DataFrame:
    """Number the rows of every shard from 0 without a gap.

    A shard is cut into blocks by a hash; rows are numbered within their block, and
    block counts are summed up to each block's base. No task holds a whole shard.
    """
    n_shards = df.select(shard).distinct().count() if rows else 0
    blocks = blocks_for(rows, ROWS_PER_BLOCK * max(1, n_shards))
    cut = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = cut.groupBy(shard, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy(shard, "_block").orderBy(*order))
    numbered = cut.withColumn("_rank", within).join(bases, [shard, "_block"])
    return numbered.withColumn(output, F.col("_base") + F.col("_rank") - 1).drop(
        "_block", "_rank", "_base"
    )


def shard_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown_weight: float = 1.0,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every document.

    The law is ``key``: the id and the shard weights decide, so documents with equal
    texts may part. ``size`` is the text's UTF-8 bytes plus one, a null text being
    empty; repeated rows share a shard and get slots of their own; null ids share one.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.col("doc_id")
    placed = sized.withColumn("law", F.lit("key"))
    placed = placed.withColumn("shard", rendezvous_shard(key, weights))
    grown = rendezvous_shard(key, [*weights, grown_weight])
    placed = placed.withColumn("grown_shard", grown)
    out = number_slots(placed, "shard", ["doc_id", "size", "text_crc32"], docs.count())
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
