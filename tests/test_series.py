"""Parcel means and the decayed total against plain loops."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import accumulation as A


def test_parcel_means(spark):
    matrix = spark.createDataFrame([("s", 0, [1.0, 2.0, 3.0]), ("s", 1, [4.0, 5.0, 9.0])], "s string, t int, values array<float>")
    atlas = spark.createDataFrame([(2, "back"), (0, "front"), (1, "back")], "vertex int, parcel string")
    got = {(r["t"], r["parcel"]): r["mean_value"] for r in A.parcel_means(matrix, atlas, ["s", "t"]).collect()}
    assert got == {(0, "front"): 1.0, (0, "back"): 2.5, (1, "front"): 4.0, (1, "back"): 7.0}


def test_parcel_means_refuse_an_atlas_with_gaps(spark):
    matrix = spark.createDataFrame([("s", [1.0, 2.0])], "s string, values array<float>")
    atlas = spark.createDataFrame([(0, "a"), (2, "b")], "vertex int, parcel string")
    with pytest.raises(Exception, match="atlas vertices"):
        A.parcel_means(matrix, atlas, ["s"]).collect()


@pytest.mark.parametrize("atlas", [[(0, "a"), (0, "b"), (1, "a")], [(1, "a")], [(None, "a"), (0, "a")]])
def test_parcel_means_refuse_repeated_and_missing_vertices(spark, atlas):
    matrix = spark.createDataFrame([("s", [1.0, 2.0])], "s string, values array<float>")
    with pytest.raises(ValueError, match="atlas vertices"):
        A.parcel_means(matrix, spark.createDataFrame(atlas, "vertex int, parcel string"), ["s"])
    with pytest.raises(ValueError, match="more than 1"):
        A.parcel_means(matrix, spark.createDataFrame(atlas * 2, "vertex int, parcel string"), ["s"], max_vertices=1)


def test_parcel_means_of_odd_rows(spark):
    nan = float("nan")
    rows = [("long", [1.0] * 4), ("short", [3.0]), ("none", None), ("empty", []), ("gap", [None, None, 5.0]), ("nan", [nan, 1.0, 2.0])]
    matrix = spark.createDataFrame([(*r, 1.5) for r in rows], "s string, values array<double>, mean_value double")
    atlas = spark.createDataFrame([(2, 7), (0, 9), (1, None)], "vertex int, parcel long")
    out = A.parcel_means(matrix, atlas, ["s"])
    assert out.columns == ["s", "parcel", "mean_value", "error"]
    got = {(r["s"], r["parcel"]): (r["mean_value"], r["error"]) for r in out.collect()}
    assert got.pop(("nan", 9))[0] != got.get(("nan", 9))
    assert got == {
        ("long", None): (None, "beyond_atlas"),
        ("short", 9): (3.0, None),
        ("gap", 9): (None, None),
        ("gap", None): (None, None),
        ("gap", 7): (5.0, None),
        ("nan", None): (1.0, None),
        ("nan", 7): (2.0, None),
    }
    with pytest.raises(Exception, match="beyond_atlas"):
        A.parcel_means(matrix, atlas, ["s"], mode="strict").collect()
    assert A.parcel_means(matrix.limit(0), atlas, ["s"]).count() == 0
    assert {r["error"] for r in A.parcel_means(matrix, atlas.limit(0), ["s"]).collect()} == {"beyond_atlas"}


def test_parcel_means_of_wide_rows(spark):
    """20,000 vertices in 360 parcels, against numpy, with blocks of a few rows."""
    rng = np.random.default_rng(3)
    x, code = rng.normal(5, 1, size=(25, 20_000)).astype(np.float32), rng.integers(0, 360, 20_000)
    matrix = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "t int, values array<float>").repartition(3)
    atlas = spark.createDataFrame(list(enumerate(code.tolist())), "vertex int, parcel int")
    got = {(r["t"], r["parcel"]): r["mean_value"] for r in A.parcel_means(matrix, atlas, ["t"]).collect()}
    assert len(got) == 25 * 360
    for t in range(25):
        want = np.bincount(code, x[t].astype(float)) / np.bincount(code)
        assert np.allclose([got[t, p] for p in range(360)], want)


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_trajectories(spark, uncoalesced, partitions):
    uncoalesced(partitions)
    rows, df = hot_events(spark)
    rows = [(None if k == "cold" else k, ts, i, None if i % 9 == 0 else g) for k, ts, i, g in rows]
    df = spark.createDataFrame(rows, "k string, ts timestamp, i int, g double").repartition(7)
    out = A.decayed_trajectory(df, "k", ["ts", "i"], "g", 0.05, 0.7, start=3.0)
    assert out.columns == ["k", "ts", "i", "step", "state"]
    got = {r["i"]: (r["step"], r["state"]) for r in out.collect()}
    assert len(got) == len(rows)
    for key in ("hot", None, "single"):
        state = 3.0
        for n, (_, _, i, g) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]), 1):
            state = 0.95 * state + 0.7 * (g or 0.0)
            assert got[i] == (n, pytest.approx(state, rel=1e-9))
    assert A.decayed_trajectory(df.limit(0), "k", ["ts", "i"], "g", 0.05, 0.7).count() == 0


def test_trajectories_shuffle_events_once(spark, uncoalesced):
    uncoalesced(40)
    _, df = hot_events(spark)
    plan = A.decayed_trajectory(df, "k", ["ts", "i"], "g", 0.1, 1.0)._jdf.queryExecution().executedPlan().toString()
    events, pieces = plan.split("BroadcastExchange")
    assert "BroadcastHashJoin" in events and "Exchange" not in events and "Exchange hashpartitioning" in pieces


def test_lookup_gain(spark):
    events = spark.createDataFrame([("a", 2.0), ("b", 3.0), (None, 1.0)], "c string, e double")
    table = spark.createDataFrame([("a", 10)], "c string, z int")
    out = A.with_lookup_gain(events, table, "c", "e", "z")
    assert out.columns == ["c", "e", "gain"]
    assert {r["c"]: r["gain"] for r in out.collect()} == {"a": 20.0, "b": None, None: None}


@pytest.fixture()
def uncoalesced(spark):
    """Adaptive execution would join the small range partitions of a test into one."""

    def set_partitions(n: int):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield set_partitions
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def hot_events(spark):
    rng = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [
        (k, start + timedelta(seconds=rng.randint(0, 200_000) // 600 * 600), i, rng.gauss(1, 1))
        for i, k in enumerate(["hot"] * 400 + ["cold"] * 5 + ["single"])
    ]
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, i int, g double").repartition(7)


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_decayed_total(spark, uncoalesced, partitions):
    uncoalesced(partitions)
    rows, df = hot_events(spark)
    got = A.decayed_total(df, "k", ["ts", "i"], F.col("g"), 0.05, 0.7, start=3.0).collect()
    assert {r["k"]: r["n_events"] for r in got} == {"hot": 400, "cold": 5, "single": 1}
    for r in got:
        state = 3.0
        for _, _, _, gain in sorted((x for x in rows if x[0] == r["k"]), key=lambda x: (x[1], x[2])):
            state = (1 - 0.05) * state + 0.7 * gain
        assert r["state"] == pytest.approx(state, rel=1e-9)


def test_a_hot_key_is_cut_into_ordered_pieces(spark, uncoalesced):
    uncoalesced(40)
    _, df = hot_events(spark)
    found = A.range_pieces(df, "k", ["ts", "i"]).filter("k = 'hot'").select("piece", "ts", "i").collect()
    assert len({r["piece"] for r in found}) > 20
    assert max(sum(r["piece"] == p for r in found) for p in {r["piece"] for r in found}) < 60
    ordered = sorted(found, key=lambda r: (r["ts"], r["i"]))
    assert [r["piece"] for r in ordered] == sorted(r["piece"] for r in found)
