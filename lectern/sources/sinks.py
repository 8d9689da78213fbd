"""Table sinks, and the load that skips what is written already."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.errors import QUARANTINE, enforce
from lectern.functions.text import FEATURES
from lectern.session import fits_broadcast, save_once

_BUCKETS = 64
# Rows of a wide matrix that are stacked together.
_STACK_ROWS = 200


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """The condition and the eight features, one row per stimulus, replacing the target.

    Parquet is laid out by condition; CSV has a header row.
    """
    rows = df.select("condition", *FEATURES)
    writer = rows.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.partitionBy("condition").parquet(path)


def skip_existing(
    new: DataFrame, written: DataFrame, key: str | Sequence[str], broadcast_keys: int = 1_000_000
) -> DataFrame:
    """Rows of ``new`` whose key is not in ``written``; rows without a key are kept.

    The keys are compared first, without the payload, and the missing ones written
    to the shared folder. If their measured list fits, it is broadcast and the payload
    is filtered where it lies. If it does not, as on a first large load, the list of
    written keys is broadcast in its place. Only where neither fits does one anti join
    shuffle the payload.
    """
    keys = [key] if isinstance(key, str) else list(key)
    done = written.select(*keys)
    missing = save_once(new.select(*keys).distinct().join(done, keys, "left_anti"), "missing-keys")
    if not fits_broadcast(missing, broadcast_keys):
        known = save_once(done.distinct(), "written-keys")
        few = fits_broadcast(known, broadcast_keys)
        return new.join(F.broadcast(known) if few else known, keys, "left_anti")
    wanted = missing.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return new.join(F.broadcast(wanted), same, "left_semi")


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at the path, or None where nothing has been written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def save_missing(df: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    """Write the stimuli that the target does not hold yet; a rerun adds nothing.

    With ``overwrite`` the rows of the given stimuli are replaced and all others
    kept. The table is laid out in a fixed number of key buckets, so a replacement
    rewrites only the buckets it touches. Rows are rebalanced by bucket before the
    write: adaptive execution cuts large buckets and joins small ones, and no task
    writes a file into every bucket.
    """
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int"))
    old = read_if_present(df.sparkSession, path)
    writer_mode = "append"
    if old is not None and overwrite:
        # Read three times below, so computed once.
        rows = save_once(rows, "replacement")
        # At most one row per bucket; as constants they prune the target's partitions.
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
        kept = old.filter(F.col("bucket").isin(touched)).join(
            rows.select(key).distinct(), key, "left_anti"
        )
        rows = rows.unionByName(kept.select(*rows.columns))
        writer_mode = "overwrite"
    elif old is not None:
        rows = skip_existing(rows, old, key)
    (
        rows.hint("rebalance", "bucket")
        .write.mode(writer_mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )


def vertex_columns(columns: Sequence[str], prefix: str = "vertex_") -> list[str]:
    """The columns named by the prefix and a number, in the order of their numbers."""
    numbered = [(int(c.removeprefix(prefix)), c) for c in columns if re.fullmatch(re.escape(prefix) + "[0-9]+", c)]
    return [c for _, c in sorted(numbered)]


def matrix_rows(
    wide: DataFrame, stimulus_id: str, timestep: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """A wide prediction matrix as ``(stimulus_id, timestep, values)`` rows.

    Without ``columns`` the vertex columns are taken in the order of the numbers in their
    names, wherever they stand. Arrow batches are stacked to one list column, so a
    thousand columns are no thousand expressions. A missing value is null. Files of many
    thousand columns are read by :func:`read_matrices`, without a plan of that width.
    """
    chosen = list(columns) if columns is not None else vertex_columns(wide.columns)
    if not chosen:
        raise ValueError("the table has no vertex columns")

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Some rows at a time: a batch of ten thousand would be held twice.
            for at in range(0, batch.num_rows, _STACK_ROWS):
                part = batch.slice(at, _STACK_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), _stacked(part.columns[2:])],
                    names=[stimulus_id, timestep, "values"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in wide.schema.fields}
    schema = f"`{stimulus_id}` {kinds[stimulus_id]}, `{timestep}` {kinds[timestep]}, values array<float>"
    return wide.select(stimulus_id, timestep, *chosen).mapInArrow(stack, schema)


def _stacked(columns: Sequence[pa.Array]) -> pa.Array:
    """Number columns of one length side by side, as one list per row."""
    vertices = [c.cast(pa.float32()) for c in columns]
    block = np.column_stack([v.to_numpy(zero_copy_only=False) for v in vertices]).astype(np.float32)
    gaps = np.column_stack([v.is_null().to_numpy(zero_copy_only=False) for v in vertices])
    values = pa.array(block.ravel(), pa.float32(), mask=gaps.ravel() if gaps.any() else None)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1, dtype=np.int32) * len(vertices)), values)


def read_matrices(spark: SparkSession, path: str | list[str], mode: str = QUARANTINE) -> DataFrame:
    """Prediction files, one per stimulus with a column per vertex, as one row per timestep.

    Returns ``path, timestep, values, error``: ``timestep`` numbers a file's rows from 0 and
    ``values`` holds the vertex columns in the order of the numbers in their names; other
    columns are left out. Spark deals the files out and reads them; a task decodes one
    file after another, so no plan has a column per vertex. A file that is no Parquet
    (``bad_parquet``) or has no vertex column of numbers (``no_vertices``) is one row.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for first, part in _matrix_parts(content.as_buffer()):
                    n = 1 if isinstance(part, str) else part.num_rows
                    failed = isinstance(part, str)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * n),
                            pa.nulls(1, pa.int64()) if failed else pa.array(np.arange(first, first + n)),
                            pa.nulls(1, pa.list_(pa.float32())) if failed else _stacked(part.columns),
                            pa.array([part if failed else None] * n, pa.string()),
                        ],
                        names=["path", "timestep", "values", "error"],
                    )

    # Few files to a batch: each is a matrix.
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "path string, timestep long, values array<float>, error string"
    return enforce(files.mapInArrow(decode, schema), mode)


def _matrix_parts(content: pa.Buffer) -> Iterator[tuple[int, pa.RecordBatch | str]]:
    """Some rows after the other of a Parquet file's vertex columns, or the code of what is wrong."""
    try:
        file = pq.ParquetFile(pa.BufferReader(content))
        columns = vertex_columns(file.schema_arrow.names)
        if not columns:
            yield 0, "no_vertices"
            return
        first = 0
        for part in file.iter_batches(_STACK_ROWS, columns=columns):
            yield first, part.select(columns)
            first += part.num_rows
    except pa.ArrowInvalid:
        yield 0, "bad_parquet"
