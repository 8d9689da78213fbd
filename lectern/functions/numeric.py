"""Number comparison and rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TOLERANCE = 1e-6


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def numeric_close(a: Column, b: Column, tol: float = DEFAULT_TOLERANCE) -> Column:
    """Relative-or-absolute closeness; NaN is close to nothing, an infinity only to itself.

    Spark orders NaN above every number and calls NaN equal to NaN, so both cases
    are ruled out before the plain comparison.
    """
    a, b, t = a.cast("double"), b.cast("double"), F.lit(float(tol))
    near = F.abs(a - b) <= F.greatest(t * F.greatest(F.abs(a), F.abs(b)), t)
    return ~F.isnan(a) & ~F.isnan(b) & ((a == b) | (is_finite(a) & is_finite(b) & near))


def answer_text(x: Column) -> Column:
    """A number as an author writes it: digits only, no ``.0`` and no exponent.

    A double has 17 significant digits; what was written with more is kept as text by
    its source. Numbers beyond 38 digits keep their exponent.
    """
    x = x.cast("double")
    size = F.abs(x)
    whole = is_finite(x) & (x == F.floor(x)) & (size < F.lit(1e38))
    small = is_finite(x) & (size < F.lit(1e-3)) & (size >= F.lit(1e-17))
    large = is_finite(x) & (size >= F.lit(1e7)) & (size < F.lit(1e19))
    digits = F.when(small | large, x).cast("decimal(38,18)").cast("string")
    return (
        F.when(whole, F.when(whole, x).cast("decimal(38,0)").cast("string"))
        .when(small | large, F.rtrim(digits, F.lit("0")))
        .otherwise(x.cast("string"))
    )
