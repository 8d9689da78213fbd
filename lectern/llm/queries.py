"""The registered queries of this package: each runs its operator over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import (
    alignment,
    decontaminate,
    packing,
    periods,
    quality,
    sharding,
    simhash,
    substrings,
    suffixes,
    token_counts,
    token_files,
    topk,
    warc,
)
from lectern.llm.common import documents
from lectern.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", "fingerprint", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_scores(documents(spark, sf_dir), labels)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_digests(documents(spark, sf_dir))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(documents(spark, sf_dir), scratch_path(spark, "ids"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leak_pairs(documents(spark, sf_dir), items)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.count_tokens(docs).select("doc_id", "n_tokens")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(documents(spark, sf_dir))


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the query looks at: about a tenth of the documents end in a loop."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + period]
    return (words[:a] + loop * ((n - a) // period + 1))[:n]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(documents(spark, sf_dir), looped)


def op13_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_byte_digests(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_quality": op2_quality,
    "op3_repeats": op3_repeats,
    "op4_pack": op4_pack,
    "op5_shard": op5_shard,
    "op6_warc": op6_warc,
    "op7_token_files": op7_token_files,
    "op8_decontaminate": op8_decontaminate,
    "op9_token_counts": op9_token_counts,
    "op10_top_k": op10_top_k,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_repeated_bytes": op13_repeated_bytes,
}
