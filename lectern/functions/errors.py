"""Row-level error policy shared by all operators.

An operator computes a value column and an error column (NULL, or a short code).
``quarantine`` keeps the row with a NULL value and its code; ``strict`` fails the
job on the first bad row, as the single-machine functions would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUARANTINE = "quarantine"
STRICT = "strict"


def check_mode(mode: str) -> str:
    if mode not in (QUARANTINE, STRICT):
        raise ValueError(f"mode must be {QUARANTINE!r} or {STRICT!r}, got {mode!r}")
    return mode


def first_error(*rules: tuple[str, Column]) -> Column:
    """Code of the first rule whose condition holds, else NULL."""
    out = F.lit(None).cast("string")
    for code, condition in reversed(rules):
        out = F.when(condition, F.lit(code)).otherwise(out)
    return out


def guarded(value: Column, error: Column) -> Column:
    """``value`` on clean rows, NULL on rows with an error.

    The value sits in a CASE branch, so ANSI division is never reached on rows
    the error column rejects.
    """
    return F.when(error.isNull(), value)


def enforce(df: DataFrame, mode: str, error: str = "error") -> DataFrame:
    """Apply the mode to a frame that carries an error column."""
    if check_mode(mode) == QUARANTINE:
        return df
    failed = F.raise_error(F.concat(F.lit("bad row: "), F.col(error))).cast("string")
    return df.withColumn(error, F.when(F.col(error).isNotNull(), failed))
