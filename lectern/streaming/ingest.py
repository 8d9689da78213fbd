"""Incremental feature extraction with Structured Streaming.

:func:`run_available` is stateless: each new file is parsed and measured once, the
checkpoint remembers which files were taken, and a rerun continues from there.
:func:`run_missing` also knows what the sink holds: a stimulus that comes again, under
another file name or in a batch that is run a second time, adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.functions.text import with_text_features
from lectern.session import save_once
from lectern.sources.front_matter import with_front_matter, with_known_keys
from lectern.sources.sinks import read_if_present, skip_existing


def stream_texts(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Whole text files as they arrive: ``(path, content)``."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def measured_stimuli(texts: DataFrame) -> DataFrame:
    """Front matter, typed keys and text features, for a batch or a stream."""
    parsed = with_known_keys(with_front_matter(texts)).withColumnRenamed(
        "example_count", "declared_examples"
    )
    measured = with_text_features(parsed, "body", F.col("declared_examples"))
    return measured.drop("declared_examples")


def run_available(df: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available now as parquet, then stop."""
    query = (
        df.writeStream.format("parquet")
        .option("path", out_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def first_of_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; rows without a key all stay.

    Rows are combined before they are shuffled, so a key with most rows costs little.
    """
    rank = F.struct(*order) if order else F.lit(0)
    chosen = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*df.columns), rank).alias("_row"))
    return chosen.select("_row.*").unionByName(df.filter(F.col(key).isNull()))


def run_missing(
    df: DataFrame, out_path: str, checkpoint: str, key: str, order: Sequence[str] = (), run_id: str = "0"
) -> StreamingQuery:
    """Append everything available now whose key the sink does not hold yet, then stop.

    Each batch has a folder of its own in the sink, named by ``run_id`` and batch number,
    and replaces it as a whole: a batch that died half-way is run again and overwrites what
    it left. It is compared with the keys of all other folders, so neither a file that
    is uploaded again under another name nor a batch that is replayed adds a row. Among
    equal keys of one batch the first by ``order`` is kept. Rows without a key (files that
    could not be read) are written as they come. A new checkpoint needs a new ``run_id``.
    The sink is its own ledger: nothing else has to be written together with it.
    """
    spark = df.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        folder = f"{run_id}-{number:09d}"
        # Computed once: the batch is read for its keys and for its rows.
        rows = first_of_key(save_once(batch, "batch"), key, order)
        written = read_if_present(spark, out_path)
        if written is not None and "batch" in written.columns:
            rows = skip_existing(rows, written.filter(F.col("batch") != folder).select(key), key)
        rows.write.mode("overwrite").parquet(f"{out_path}/batch={folder}")

    query = (
        df.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
