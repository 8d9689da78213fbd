"""Covariance and Mahalanobis distance of wide vector columns.

A vector of 64 numbers has 2,080 covariances: too many aggregate expressions, but one
small matrix per task. Each task centres and multiplies its own rows with numpy and hands
on count, means and co-moments; Spark merges them cell by cell, and the result never
leaves the executors. Sums of raw products are never formed: they would lose all digits
of vectors that lie far from zero. A task
holds a matrix of width x width: reduce vectors of many thousand positions first, as
with :func:`lectern.operators.accumulation.parcel_means`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.errors import first_error, guarded
from lectern.operators.matching import MIN_UNITS, invert_covariance


def vector_error(vector: str, width: int) -> Column:
    """Code of a vector that takes no part: absent, of another width, or with gaps."""
    x = F.col(vector)
    gap = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")))
    return first_error(
        ("bad_vector", x.isNull() | (F.size(x) != width)),
        ("incomplete_vector", gap),
    )


def _moments(df: DataFrame, vector: str, width: int, anchor: Column | None = None) -> DataFrame:
    """Mergeable centred moments of the vectors that take part, one set of cells per task.

    A cell ``task, i, j, n, mi, mj, c`` holds the number of vectors, two means and the sum
    of products of the deviations from them. Where ``j`` is the width, the cell holds the
    number and mean of the anchors. Batches are centred before they are multiplied and
    merged by the difference of their means, so large common offsets cancel nothing.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(width), np.zeros((width, width))
        known, marked = 0, np.zeros(width)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            x = flat.reshape(-1, width)
            if not len(x):
                continue
            own = x.mean(axis=0)
            centred = x - own
            # What rounding left in the batch's mean.
            own += centred.mean(axis=0)
            centred = x - own
            apart, total = own - mean, n + len(x)
            products += centred.T @ centred + np.outer(apart, apart) * (n * len(x) / total)
            mean = mean + apart * (len(x) / total)
            n = total
            chosen = x[batch.column(1).to_numpy(zero_copy_only=False).astype(bool)]
            if len(chosen):
                known += len(chosen)
                marked += (chosen - marked).sum(axis=0) / known
        if n:
            i, j = np.triu_indices(width)
            edge = np.arange(width)
            task = TaskContext.get().partitionId()
            cells = [
                np.concatenate([i, edge]).astype("int32"),
                np.concatenate([j, np.full(width, width)]).astype("int32"),
                np.concatenate([np.full(len(i), n), np.full(width, known)]).astype("int64"),
                np.concatenate([mean[i], marked]),
                np.concatenate([mean[j], np.zeros(width)]),
                np.concatenate([products[i, j], np.zeros(width)]),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells[0]), task, "int32")), *map(pa.array, cells)],
                names=["task", "i", "j", "n", "mi", "mj", "c"],
            )

    flag = F.lit(False) if anchor is None else anchor
    whole = df.filter(vector_error(vector, width).isNull()).select(vector, flag.alias("anchor"))
    parts = whole.mapInArrow(multiply, "task int, i int, j int, n long, mi double, mj double, c double")
    # A cell has one part per task, whatever the number of vectors; they merge in order.
    listed = F.array_sort(F.collect_list(F.struct("task", "n", "mi", "mj", "c")))
    return parts.groupBy("i", "j").agg(listed.alias("parts")).select("i", "j", _merged("parts").alias("m")).select("i", "j", "m.*")


def _merged(parts: str) -> Column:
    nothing = F.struct(
        F.lit(0).cast("long").alias("n"),
        *[F.lit(0.0).alias(c) for c in ("mi", "mj", "c")],
    )

    def merge(a: Column, b: Column) -> Column:
        total = a.n + b.n
        share = F.when(total > 0, b.n / total).otherwise(0.0)
        return F.struct(
            total.alias("n"),
            (a.mi + (b.mi - a.mi) * share).alias("mi"),
            (a.mj + (b.mj - a.mj) * share).alias("mj"),
            (a.c + b.c + (b.mi - a.mi) * (b.mj - a.mj) * a.n * share).alias("c"),
        )

    return F.aggregate(parts, nothing, merge)


def vector_covariance(df: DataFrame, vector: str, width: int) -> DataFrame:
    """Sample covariance of every pair of vector positions: ``i, j, covariance, n``.

    Vectors with a :func:`vector_error` are left out. One pass over the table.
    """
    cells = _moments(df, vector, width).filter(F.col("j") < width)
    return cells.select(
        F.col("i").cast("long").alias("i"),
        F.col("j").cast("long").alias("j"),
        F.when(F.col("n") > 1, F.col("c") / (F.col("n") - 1)).alias("covariance"),
        "n",
    )


def _whitening(width: int, min_units: int):
    """UDF for the one row of moments: rows of a square root of the inverse, the anchors' mean."""

    @F.pandas_udf("root array<array<double>>, mean array<double>, error string")
    def solve(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        i, j = np.triu_indices(width + 1)
        keep = (i < width) | (j < width)
        i, j = i[keep], j[keep]
        for counts, means, products in batches:
            out = []
            for n, m, c in zip(counts, means, products, strict=True):
                if len(n) == 0:
                    out.append((None, None, "min_units"))
                    continue
                edge = j == width
                total, known = int(n[~edge][0]), int(n[edge][0])
                upper = np.zeros((width, width))
                upper[i[~edge], j[~edge]] = c[~edge] / max(total - 1, 1)
                inverse, error = invert_covariance(upper + np.triu(upper, 1).T, total, min_units)
                if error is None and known == 0:
                    error = "no_anchor"
                if error:
                    out.append((None, None, error))
                else:
                    root = np.linalg.cholesky((inverse + inverse.T) / 2).T
                    out.append((root.tolist(), m[edge].tolist(), None))
            yield pd.DataFrame(out, columns=["root", "mean", "error"])

    return solve


def mahalanobis_to_mean(
    df: DataFrame, vector: str, is_anchor: Column, width: int, min_units: int = MIN_UNITS
) -> DataFrame:
    """Distance of every non-anchor vector from the anchor rows' mean vector.

    Covariance and mean come from one pass over the vectors that take part; others keep
    their row and get their :func:`vector_error`. The matrix is inverted in one row of a
    query and comes back as a scalar subquery, so nothing passes through the driver.
    """
    flagged = df.withColumn("anchor", F.coalesce(is_anchor, F.lit(False)))
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "n", "mi", "c")))
    row = _moments(flagged, vector, width, F.col("anchor")).agg(cells.alias("cells"))
    parts = row.select(
        F.transform("cells", lambda x: x.n).alias("n"),
        F.transform("cells", lambda x: x.mi).alias("mi"),
        F.transform("cells", lambda x: x.c).alias("c"),
    )
    solved = parts.select(_whitening(width, min_units)("n", "mi", "c").alias("m"))
    model = solved.select("m").scalar()
    staged = flagged.filter(~F.col("anchor")).drop("anchor").withColumn("m", model)
    error = F.coalesce(F.col("m.error"), vector_error(vector, width))
    apart = F.zip_with(F.col(vector), F.col("m.mean"), lambda x, y: x.cast("double") - y)
    staged = staged.withColumn("error", error).withColumn("d", F.when(F.col("error").isNull(), apart))

    def dot(weights: Column) -> Column:
        return F.aggregate(F.zip_with(weights, "d", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    square = F.aggregate(F.transform("m.root", dot), F.lit(0.0), lambda s, y: s + y * y)
    return staged.withColumn("distance", guarded(F.sqrt(square), F.col("error"))).drop("m", "d")
