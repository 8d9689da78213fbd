"""Unit answer audit and the correctness gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.errors import QUARANTINE
from lectern.functions.numeric import DEFAULT_TOLERANCE
from lectern.operators.validators import check_answers
from lectern.sources.units import problem_rows

# Share of answers that must be correct.
REFERENCE_THRESHOLD = 1.0
CONDITION_THRESHOLD = 0.99


def audit_units(
    units: DataFrame, tol: float = DEFAULT_TOLERANCE, mode: str = QUARANTINE
) -> DataFrame:
    """Check all five rows of every unit; ``ok`` says whether a row came out as it must."""
    checked = check_answers(problem_rows(units), tol=tol, mode=mode)
    return checked.withColumn(
        "ok", F.coalesce(F.col("passed") == F.col("expect_pass"), F.lit(False))
    )


def correctness_gate(
    checked: DataFrame, by: str, thresholds: dict[str, float], default: float = CONDITION_THRESHOLD
) -> DataFrame:
    """Share of rows with ``ok`` per group, against that group's threshold."""
    limit = F.lit(default)
    for group, threshold in thresholds.items():
        limit = F.when(F.col(by) == group, F.lit(threshold)).otherwise(limit)
    return (
        checked.groupBy(by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("ok").alias("n_correct"),
            F.count("error").alias("n_errors"),
        )
        .withColumn("share", F.col("n_correct").cast("double") / F.col("n").cast("double"))
        .withColumn("gate", F.col("share") >= limit)
    )
