"""A training-data pipeline: five stages, each over all that the stage before it kept.

Every stage is one operator of ``lectern.llm``. ``run`` writes each stage's result as
Parquet to the shared folder and reads it back for the next, so a lost executor costs
part of one stage. No stage can be expressed in SQL as a whole (the first fits a
classifier, the last calls a tokenizer), so there is no ``ORACLE_SQL``; the tests hold
near duplicates, repeated passages and decontamination against plain versions, packing
against the tokenizer's library, and the classifier by its recall on held-out labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontaminate, packing, quality, simhash, substrings
from lectern.llm.common import documents, save_stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest-neighbour classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id holds are taken out of the text."""
    cut = substrings.remove_repeats(docs).drop("n_words", "n_removed", "factors")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every remaining document in a training sequence."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", reject_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = save_stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
