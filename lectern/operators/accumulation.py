"""Aggregations over response matrices and ordered event series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.functions.errors import QUARANTINE, enforce
from lectern.operators.matching import standardized_mean_differences
from lectern.session import lookup_side, save_once

# The longest atlas, and so the longest row, that is averaged.
MAX_VERTICES = 2_000_000
# Values averaged together by a task.
BLOCK_VALUES = 4_000_000


def parcel_means(
    matrix: DataFrame,
    atlas: DataFrame,
    keys: Sequence[str],
    values: str = "values",
    mode: str = QUARANTINE,
    max_vertices: int = MAX_VERTICES,
) -> DataFrame:
    """Mean over the vertices of each parcel: ``*keys, parcel, mean_value, error``.

    ``atlas`` maps every ``vertex`` (array position, from 0) to a ``parcel``. It is as
    long as one row's array; its size is checked, and it is sent to the tasks as a sparse
    averaging matrix, one parcel number per vertex. Each block of rows is averaged in two
    counting passes over its values, whatever the number of parcels, and nothing is
    shuffled: rows that share their keys are averaged apart.

    Nulls take no part in a mean; a parcel of nulls has a null mean. Of a row shorter
    than the atlas only the parcels it reaches come out; a null or empty row gives no
    rows. A row longer than the atlas gives one row with ``error`` = ``beyond_atlas``, or
    fails the job in strict mode. An atlas with gaps or repeated vertices is a ValueError.
    """
    vertices = atlas.select(F.col("vertex").cast("long").alias("vertex"), "parcel").limit(max_vertices + 1).toArrow()
    vertices = vertices.combine_chunks().sort_by("vertex")
    number = vertices.column("vertex").to_numpy()
    if len(number) > max_vertices:
        raise ValueError(f"the atlas has more than {max_vertices} vertices")
    if vertices.column("vertex").null_count or not np.array_equal(number, np.arange(len(number))):
        raise ValueError("atlas vertices are not 0, 1, 2, ...")
    coded = pc.dictionary_encode(vertices.column("parcel").combine_chunks(), null_encoding="encode")
    parcels, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    # Which parcels the first n vertices reach: those whose first vertex is below n.
    first = np.full(len(parcels), len(code), np.int64)
    np.minimum.at(first, code, np.arange(len(code)))

    def block(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column(len(keys))
        size = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten()
        beyond = size > len(code)
        row_of = np.repeat(np.arange(len(size)), size)
        vertex = np.arange(len(row_of)) - np.repeat(np.cumsum(size) - size, size)
        known = ~flat.is_null().to_numpy(zero_copy_only=False) & ~beyond[row_of]
        cell = row_of[known] * len(parcels) + code[vertex[known]]
        value = flat.to_numpy(zero_copy_only=False).astype(float)[known]
        cells = len(size) * len(parcels)
        count = np.bincount(cell, minlength=cells)
        total = np.bincount(cell, weights=value, minlength=cells)
        reached = (first[None] < size[:, None]) & ~beyond[:, None]
        row, parcel = np.nonzero(reached)
        at = row * len(parcels) + parcel
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = pa.array(total[at] / count[at], mask=count[at] == 0)
        bad = np.flatnonzero(beyond)
        place = pa.array(np.concatenate([row, bad]))
        columns = [rows.column(i).take(place) for i in range(len(keys))]
        columns += [
            pa.concat_arrays([parcels.take(pa.array(parcel)), pa.nulls(len(bad), parcels.type)]),
            pa.concat_arrays([mean, pa.nulls(len(bad), pa.float64())]),
            pa.array([None] * len(row) + ["beyond_atlas"] * len(bad), pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "parcel", "mean_value", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK_VALUES // max(1, len(code)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                yield block(batch.slice(at, step))

    types = {f.name: f.dataType.simpleString() for f in [*matrix.schema.fields, *atlas.schema.fields]}
    own = ", ".join(f"`{k}` {types[k]}" for k in keys)
    rows = matrix.select(*keys, F.col(values).cast("array<double>").alias("values"))
    out = rows.mapInArrow(run, f"{own}, parcel {types['parcel']}, mean_value double, error string")
    return enforce(out, mode)


def range_pieces(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Rows numbered by range partition: ``piece`` grows with (key, order).

    The ranges are fixed once per query, so a task that is run again gets the same.
    """
    return df.repartitionByRange(key, *order).withColumn("piece", F.spark_partition_id())


def decayed_total(
    events: DataFrame,
    key: str,
    order: Sequence[str],
    gain: Column,
    delta: float,
    eta: float,
    start: float = 0.0,
) -> DataFrame:
    """Final state of ``n <- (1 - delta) * n + eta * gain`` per key, in event order.

    The fold is linear, so an event counts with ``(1 - delta)`` to the number of
    events after it. Events are range-partitioned by key and order, which cuts a
    key with most of the events over many tasks; each task's piece of a key is
    ranked and summed to a count and a number, and pieces, numbered in range
    order, meet per key.
    """
    keep = F.lit(1.0 - delta)
    pieces = range_pieces(events.select(key, *order, (F.lit(eta) * gain).alias("x")), key, order)
    inside = Window.partitionBy(key, "piece").orderBy(*[F.col(c).desc() for c in order])
    ranked = pieces.withColumn("later", F.row_number().over(inside) - 1)
    sums = ranked.groupBy(key, "piece").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("x") * F.pow(keep, F.col("later"))).alias("x"),
    )
    after = Window.partitionBy(key).orderBy(F.col("piece").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = sums.withColumn("later", F.coalesce(F.sum("n").over(after), F.lit(0)))
    return placed.groupBy(key).agg(
        F.sum("n").alias("n_events"),
        (
            F.lit(start) * F.pow(keep, F.sum("n")) + F.sum(F.col("x") * F.pow(keep, F.col("later")))
        ).alias("state"),
    )


def with_lookup_gain(
    events: DataFrame, lookup: DataFrame, on: str, amount: str, factor: str, name: str = "gain"
) -> DataFrame:
    """Events with ``name`` = their amount times the factor that a look-up table holds for them.

    The table has one row per ``on``. It is computed and measured first: if it is small it
    is broadcast, otherwise it is joined by shuffle, where adaptive execution splits
    frequent values. An event without a factor has a null gain.
    """
    table = lookup_side(lookup.select(F.col(on).alias("_on"), F.col(factor).cast("double").alias("_factor")), "gains")
    joined = events.join(table, F.col(on) == F.col("_on"), "left")
    return joined.withColumn(name, F.col(amount) * F.col("_factor")).drop("_on", "_factor")


def decayed_trajectory(
    events: DataFrame,
    key: str,
    order: Sequence[str],
    gain: str,
    delta: float,
    eta: float,
    start: float = 0.0,
) -> DataFrame:
    """State of ``n <- (1 - delta) * n + eta * gain`` after every event: ``key, *order, step, state``.

    ``step`` counts a key's events from 1. An event with a null gain decays the state and
    adds nothing; events that ``order`` does not tell apart follow in any order.

    The step is an affine map, and maps in a row are one again: over n events the state
    becomes ``(1 - delta)^n`` times the state before plus what the events add alone. So
    events are range-partitioned by key and order, which deals a key with most of them to
    many tasks; each task folds its piece of a key from zero; the few pieces of keys that
    lie in several tasks are composed in order; and the state before a piece is applied
    to its events where they lie. Events move once. Only keys cut by a range border have
    a state to hand on: at most two pieces per task, which are broadcast.
    """
    keep = 1.0 - delta

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, begun, last, state, step = TaskContext.get().partitionId(), False, None, 0.0, 0
        for batch in batches:
            steps, states = [], []
            for own, x in zip(batch.column(0).to_pylist(), batch.column("x").to_pylist(), strict=True):
                if own != last or not begun:
                    begun, last, state, step = True, own, 0.0, 0
                state, step = keep * state + x, step + 1
                steps.append(step)
                states.append(state)
            columns = [*batch.columns[:-1], pa.array([piece] * len(steps), pa.int32())]
            columns += [pa.array(steps, pa.int64()), pa.array(states, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, *order, "piece", "own_step", "own_state"])

    added = F.coalesce(F.lit(eta) * F.col(gain).cast("double"), F.lit(0.0))
    moved = events.select(key, *order, added.alias("x")).repartitionByRange(key, *order)
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    own = ", ".join(f"`{c}` {types[c]}" for c in [key, *order])
    folded = moved.sortWithinPartitions(key, *order).mapInArrow(
        fold, f"{own}, piece int, own_step long, own_state double"
    )
    # Read twice: for the pieces' maps and for the events themselves.
    folded = save_once(folded, "pieces")
    pieces = folded.groupBy(key, "piece").agg(F.max(F.struct("own_step", "own_state")).alias("m"))
    cut = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("piece", "m"))).alias("maps"))
    before = F.broadcast(
        cut.filter(F.size("maps") > 1)
        .select(F.col(key).alias("_key"), F.inline(_states_before(F.col("maps"), keep, start)))
    )
    here = F.col(key).eqNullSafe(F.col("_key")) & (F.col("piece") == F.col("_piece"))
    entering = F.coalesce(F.col("_state"), F.lit(float(start)))
    return folded.join(before, here, "left").select(
        key,
        *order,
        (F.col("own_step") + F.coalesce(F.col("_steps"), F.lit(0))).alias("step"),
        (F.pow(F.lit(keep), F.col("own_step")) * entering + F.col("own_state")).alias("state"),
    )


def _states_before(maps: Column, keep: float, start: float) -> Column:
    """Per piece, in order, the events before it and the state that enters it."""
    nothing = F.struct(
        F.array().cast("array<struct<_piece:int,_steps:bigint,_state:double>>").alias("done"),
        F.lit(0).cast("long").alias("steps"),
        F.lit(float(start)).alias("state"),
    )

    def compose(acc: Column, piece: Column) -> Column:
        here = F.struct(piece.piece.alias("_piece"), acc.steps.alias("_steps"), acc.state.alias("_state"))
        return F.struct(
            F.array_append(acc.done, here).alias("done"),
            (acc.steps + piece.m.own_step).alias("steps"),
            (F.pow(F.lit(keep), piece.m.own_step) * acc.state + piece.m.own_state).alias("state"),
        )

    return F.aggregate(maps, nothing, compose, lambda acc: acc.done)


def scenario_contrasts(
    df: DataFrame, values: Sequence[str], scenario: str, anchor: str, min_units: int
) -> DataFrame:
    """Standardised mean difference of every scenario from the anchor scenario."""
    return standardized_mean_differences(df, values, scenario, anchor, min_units)
