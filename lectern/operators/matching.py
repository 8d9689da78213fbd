"""Comparing conditions with an anchor condition.

Features are first averaged to one *cell* per (unit, condition); with one text per
cell that is the text itself. Everything after works on cells, so a unit or a
condition that holds a large share of all texts costs nothing extra: averages,
variances and covariances combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.errors import QUARANTINE, enforce, first_error, guarded

# Fixed values of the matching rules.
MIN_UNITS = 10
SMD_TARGET = 0.10
CALIPER_TOLERANCE = 0.10
READABILITY_SPREAD = 1.0


def numeric_features(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Columns that take part in deltas: numbers and booleans."""
    kinds = (T.NumericType, T.BooleanType)
    return [
        f.name for f in df.schema.fields if isinstance(f.dataType, kinds) and f.name not in exclude
    ]


def condition_cells(
    df: DataFrame, features: Sequence[str], unit: str, condition: str
) -> DataFrame:
    """Mean of every feature, and number of texts, per (unit, condition)."""
    return df.groupBy(unit, condition).agg(
        F.count(F.lit(1)).alias("n_texts"),
        *[F.avg(F.col(f).cast("double")).alias(f) for f in features],
    )


def _anchor_value(feature: str, unit: str, condition: str, anchor: str) -> Column:
    """The anchor cell's value, on every cell of the unit.

    The window holds one row per condition, whatever the number of texts.
    """
    return F.max(F.when(F.col(condition) == anchor, F.col(feature))).over(Window.partitionBy(unit))


def anchor_deltas(
    cells: DataFrame,
    features: Sequence[str],
    unit: str,
    condition: str,
    anchor: str,
    mode: str = QUARANTINE,
) -> DataFrame:
    """Other minus anchor, for every feature and every non-anchor cell, in long form."""
    wide = cells.withColumns(
        {
            **{f"anchor_{f}": _anchor_value(f, unit, condition, anchor) for f in features},
            "has_anchor": F.max(F.col(condition) == anchor).over(Window.partitionBy(unit)),
        }
    ).filter(F.col(condition) != anchor)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                (F.col(f) - F.col(f"anchor_{f}")).alias("delta"),
            )
            for f in features
        ]
    )
    error = F.when(~F.col("has_anchor"), "no_anchor")
    out = wide.select(unit, condition, error.alias("error"), F.explode(rows).alias("r"))
    return enforce(out.select(unit, condition, "r.feature", "r.delta", "error"), mode)


def numeric_entries(features: Column) -> Column:
    """A JSON object's numbers and booleans, as a map of doubles; a boolean counts as 0 or 1.

    Text that looks like a number is no number; nulls, lists and objects have no entry.
    """
    kinds = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*|BOOLEAN)$"
    values = F.from_json(features, "map<string,variant>")
    numeric = F.map_filter(values, lambda _, v: F.schema_of_variant(v).rlike(kinds))
    return F.transform_values(numeric, lambda _, v: F.try_variant_get(v, "$", "double"))


def map_deltas(anchor: Column, other: Column) -> Column:
    """Other minus anchor for every key that two maps of numbers share, as a map."""
    both = F.map_zip_with(anchor, other, lambda _, a, b: b - a)
    return F.map_filter(both, lambda _, d: d.isNotNull())


def feature_map_deltas(
    df: DataFrame, features: str, unit: str, condition: str, anchor: str, mode: str = QUARANTINE
) -> DataFrame:
    """Other minus anchor for the features that both hold: ``unit, condition, feature, delta, error``.

    ``features`` is a JSON object per text, with keys that may differ from row to row.
    Entries are averaged to one cell per (unit, condition, feature) before anything else
    moves, so a unit with most of the texts is as small as any other. A condition that
    shares no feature with its anchor has no rows; one whose unit has no anchor text has
    one row with ``no_anchor``, and texts that are no JSON object count as without entries.
    """
    entries = df.select(unit, condition, F.explode_outer(numeric_entries(F.col(features))).alias("feature", "x"))
    cells = entries.groupBy(unit, condition, "feature").agg(F.avg("x").alias("x"))
    is_anchor = F.col(condition) == anchor
    here = Window.partitionBy(unit)
    shared = Window.partitionBy(unit, "feature")
    wide = cells.withColumns(
        {
            "has_anchor": F.coalesce(F.max(is_anchor).over(here), F.lit(False)),
            "base": F.max(F.when(is_anchor, F.col("x"))).over(shared),
            "first": F.row_number().over(Window.partitionBy(unit, condition).orderBy("feature")) == 1,
        }
    ).filter(~F.coalesce(is_anchor, F.lit(False)))
    delta = F.when(F.col("has_anchor"), F.col("x") - F.col("base"))
    kept = wide.withColumn("delta", delta).filter(
        F.col("delta").isNotNull() | (~F.col("has_anchor") & F.col("first"))
    )
    out = kept.select(
        unit,
        condition,
        F.when(F.col("has_anchor"), F.col("feature")).alias("feature"),
        "delta",
        F.when(~F.col("has_anchor"), "no_anchor").alias("error"),
    )
    return enforce(out, mode)


def anchors_of(
    df: DataFrame, features: Sequence[str], unit: str, condition: str, anchor: str
) -> DataFrame:
    """One row per unit: the anchor condition's mean features, as ``anchor_<feature>``."""
    return (
        df.filter(F.col(condition) == anchor)
        .groupBy(unit)
        .agg(*[F.avg(F.col(f).cast("double")).alias(f"anchor_{f}") for f in features])
    )


def caliper(anchor: Column, other: Column, tolerance: float) -> tuple[Column, Column, Column]:
    """``(relative_difference, passed, error)`` of one value against its anchor."""
    error = first_error(
        ("no_anchor", anchor.isNull()),
        ("no_value", other.isNull()),
        ("zero_anchor", anchor == 0),
    )
    ratio = guarded(F.abs(other - anchor) / anchor, error)
    return ratio, ratio <= F.lit(float(tolerance)), error


def duration_caliper(
    others: DataFrame,
    anchors: DataFrame,
    unit: str,
    value: str = "duration_seconds",
    tolerance: float = CALIPER_TOLERANCE,
    mode: str = QUARANTINE,
) -> DataFrame:
    """Every text of the other conditions against its unit's anchor.

    ``anchors`` has one row per unit, so the join never multiplies rows. Passed
    through :func:`lectern.session.lookup_side` it is broadcast if few units have
    one; otherwise adaptive execution splits the partitions of hot units.
    """
    joined = others.join(anchors.select(unit, f"anchor_{value}"), unit, "left")
    ratio, passed, error = caliper(
        F.col(f"anchor_{value}"), F.col(value).cast("double"), tolerance
    )
    out = joined.withColumns(
        {
            "relative_difference": ratio,
            "tolerance": F.lit(float(tolerance)),
            "passed": passed,
            "error": error,
        }
    )
    return enforce(out, mode)


def group_moments(df: DataFrame, features: Sequence[str], group: str) -> DataFrame:
    """Count, mean and sample variance of every feature: one wide row per group."""
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [
            F.count(x).alias(f"n_{f}"),
            F.avg(x).alias(f"mean_{f}"),
            F.var_samp(x).alias(f"var_{f}"),
        ]
    return df.groupBy(group).agg(*aggs)


def standardized_mean_differences(
    units: DataFrame,
    features: Sequence[str],
    condition: str,
    anchor: str,
    min_units: int = MIN_UNITS,
    mode: str = QUARANTINE,
) -> DataFrame:
    """(anchor mean - condition mean) over the pooled deviation, per feature.

    ``units`` holds one row per unit and condition. Refused with a code when a
    group is smaller than ``min_units`` or the pooled deviation is zero. The table is
    aggregated once, and the anchor's moments are put beside the other conditions' in
    that small result.
    """
    moments = group_moments(units, features, condition)
    every = F.struct(*[F.col(c) for c in moments.columns if c != condition])
    # One row per condition, so the window over all of them is small however large the table.
    goal = F.max(F.when(F.col(condition) == anchor, every)).over(Window.partitionBy(F.lit(0)))
    others = moments.withColumn("goal", goal).filter(F.col(condition) != anchor)
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.col(f"goal.n_{f}").alias("n_anchor"),
                F.col(f"n_{f}").alias("n"),
                (F.col(f"goal.mean_{f}") - F.col(f"mean_{f}")).alias("difference"),
                F.sqrt((F.col(f"goal.var_{f}") + F.col(f"var_{f}")) / 2).alias("pooled"),
            )
            for f in features
        ]
    )
    staged = others.select(condition, F.explode(rows).alias("r")).select(condition, "r.*")
    error = first_error(
        ("no_anchor", F.col("n_anchor").isNull()),
        ("min_units", (F.col("n") < min_units) | (F.col("n_anchor") < min_units)),
        ("zero_pooled_deviation", F.col("pooled") == 0),
    )
    out = staged.withColumn("error", error).select(
        condition,
        "feature",
        "n_anchor",
        "n",
        guarded(F.col("difference") / F.col("pooled"), F.col("error")).alias("smd"),
        "error",
    )
    return enforce(out, mode)


def smd_gate(smds: DataFrame, condition: str, target: float = SMD_TARGET) -> DataFrame:
    """Does every feature of a condition that has a difference stay below the target?

    Features whose difference is refused, such as one that never varies, are counted in
    ``n_refused`` and do not decide; a condition without any defined one is not matched.
    """
    largest = F.max(F.abs("smd"))
    return smds.groupBy(condition).agg(
        F.count("smd").alias("n_features"),
        F.count_if(F.col("smd").isNull()).alias("n_refused"),
        largest.alias("max_abs_smd"),
        F.coalesce(largest < F.lit(float(target)), F.lit(False)).alias("matched"),
    )


def _pairs(features: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(features)) for j in range(i, len(features))]


def _covariances(features: Sequence[str]) -> list[Column]:
    """Count of complete cases, then the upper triangle of the covariance matrix.

    ``covar_samp`` alone would drop rows pair by pair.
    """
    complete = F.lit(True)
    for f in features:
        complete = complete & F.col(f).isNotNull()
    x = {f: F.when(complete, F.col(f).cast("double")) for f in features}
    return [F.count_if(complete).alias("n")] + [
        F.covar_samp(x[features[i]], x[features[j]]).alias(f"c_{i}_{j}")
        for i, j in _pairs(features)
    ]


def feature_covariance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Sample covariance (n - 1) of every feature pair, one aggregation, long form."""
    rows = F.array(
        *[
            F.struct(
                F.lit(features[i]).alias("feature_a"),
                F.lit(features[j]).alias("feature_b"),
                F.col(f"c_{i}_{j}").alias("covariance"),
            )
            for i, j in _pairs(features)
        ]
    )
    return df.agg(*_covariances(features)).select("n", F.explode(rows).alias("r")).select(
        "r.*", "n"
    )


def invert_covariance(cov: np.ndarray, n: int, min_units: int) -> tuple[np.ndarray | None, str | None]:
    """``(inverse, error)`` of one covariance matrix estimated from ``n`` rows."""
    if n < min_units:
        return None, "min_units"
    scale = np.sqrt(np.diag(cov))
    if not np.isfinite(cov).all() or (scale == 0).any():
        return None, "singular_covariance"
    # Rank is judged on the correlation matrix, free of units.
    if np.linalg.matrix_rank(cov / np.outer(scale, scale), tol=1e-9) < len(cov):
        return None, "singular_covariance"
    return np.linalg.inv(cov), None


def _inverse_udf(p: int, min_units: int):
    """Pandas UDF for the one row that holds the covariance triangle."""

    @F.pandas_udf("inverse array<double>, error string")
    def invert(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for counts, triangles in batches:
            out = []
            for n, triangle in zip(counts, triangles):
                cov = np.zeros((p, p))
                cov[np.triu_indices(p)] = triangle
                inverse, error = invert_covariance(cov + np.triu(cov, 1).T, n, min_units)
                out.append((None if inverse is None else inverse.ravel().tolist(), error))
            yield pd.DataFrame(out, columns=["inverse", "error"])

    return invert


def inverse_covariance(
    sample: DataFrame, features: Sequence[str], min_units: int = MIN_UNITS
) -> DataFrame:
    """One row: the flattened inverse covariance matrix, or why there is none."""
    triangle = F.array(*[F.col(f"c_{i}_{j}") for i, j in _pairs(features)])
    stats = sample.agg(*_covariances(features)).select("n", triangle.alias("triangle"))
    invert = _inverse_udf(len(features), min_units)
    return stats.select(invert("n", "triangle").alias("m")).select("m.inverse", "m.error")


def mahalanobis_to_anchor(
    cells: DataFrame,
    features: Sequence[str],
    unit: str,
    condition: str,
    anchor: str,
    min_units: int = MIN_UNITS,
    mode: str = QUARANTINE,
) -> DataFrame:
    """Distance of every cell from its unit's anchor cell.

    The covariance comes from all cells and reaches the distance expression as a
    scalar subquery over the same aggregated cells, which Spark computes once.
    Distances are taken along anchor pairs only.
    """
    p = len(features)
    inverse = inverse_covariance(cells, features, min_units).select(F.struct("*")).scalar()
    staged = cells.withColumns(
        {f"d_{i}": F.col(f) - _anchor_value(f, unit, condition, anchor) for i, f in enumerate(features)}
    ).withColumn("m", inverse).filter(F.col(condition) != anchor)
    missing = F.lit(False)
    for i in range(p):
        missing = missing | F.col(f"d_{i}").isNull()
    square = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            cell = F.get(F.col("m.inverse"), F.lit(i * p + j))
            square = square + F.col(f"d_{i}") * cell * F.col(f"d_{j}")
    error = F.coalesce(F.col("m.error"), F.when(missing, "incomplete_vector"))
    out = staged.withColumn("error", error).select(
        unit, condition, guarded(F.sqrt(square), F.col("error")).alias("distance"), "error"
    )
    return enforce(out, mode)


def readability_spread(
    cells: DataFrame,
    unit: str,
    condition: str,
    grade: str = "fk_grade",
    threshold: float = READABILITY_SPREAD,
) -> DataFrame:
    """Grades per condition, their spread, and whether it exceeds the threshold.

    ``cells`` has one row per (unit, condition), so the map holds one entry per condition.
    """
    graded = F.when(F.col(grade).isNotNull(), F.struct(F.col(condition), F.col(grade)))
    return (
        cells.groupBy(unit)
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(graded))).alias("grades"),
            (F.max(grade) - F.min(grade)).alias("spread"),
        )
        .withColumn("flagged", F.col("spread") > F.lit(float(threshold)))
    )
