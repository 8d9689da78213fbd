"""The stimuli index and its key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the declared key of the stimuli index.
STIMULUS_KEY = ("unit_id", "condition", "variant")


def stimuli_index(featured: DataFrame, path: str = "path", modality: Column | None = None) -> DataFrame:
    """Eleven index columns from parsed, featured stimuli."""
    return featured.select(
        "stimulus_id",
        "unit_id",
        "condition",
        F.col(path).alias("text"),
        (F.lit("text") if modality is None else modality).alias("modality"),
        F.col("duration_seconds").alias("duration"),
        F.col("words").alias("word_count"),
        F.col("fk_grade").alias("readability"),
        "equation_count",
        "example_count",
        "variant",
    )


def key_violations(df: DataFrame, key: Sequence[str] = STIMULUS_KEY) -> DataFrame:
    """Keys held by more than one row; counts combine before the shuffle."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def fk_violations(df: DataFrame, parents: DataFrame, key: str = "unit_id") -> DataFrame:
    """Key values without a parent row, with the number of rows that use them.

    Rows are counted per key before the anti join, so a hot key is one row in it.
    """
    used = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return used.join(parents.select(key), key, "left_anti")
