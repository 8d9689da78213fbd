"""Deltas, caliper, SMD, covariance, Mahalanobis and readability against brute force."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import matching as M
from lectern.operators import vectors as VEC

SCHEMA = "u string, c string, a double, b double"


def sample(n: int = 12, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    return [
        (f"u{i}", c, rng.gauss(100, 20) + 5 * k, rng.gauss(5, 2))
        for i in range(n)
        for k, c in enumerate(("anchor", "x", "y"))
    ]


def test_published_smd_value(spark):
    a = [430, 420, 440, 410, 450, 425, 435, 415, 445, 400]
    b = [400, 410, 405, 415, 395, 420, 402, 408, 398, 412]
    rows = [("anchor", float(x)) for x in a] + [("x", float(x)) for x in b]
    df = spark.createDataFrame(rows, "c string, v double")
    got = M.standardized_mean_differences(df, ["v"], "c", "anchor").first()
    assert got["smd"] == pytest.approx(1.6210895145469448, rel=1e-12)
    assert (got["n"], got["n_anchor"], got["error"]) == (10, 10, None)


def test_smd_matches_statistics_module(spark):
    rows = sample()
    got = {
        (r["c"], r["feature"]): r["smd"]
        for r in M.standardized_mean_differences(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "c", "anchor").collect()
    }
    for c in ("x", "y"):
        for k, f in ((2, "a"), (3, "b")):
            left = [r[k] for r in rows if r[1] == "anchor"]
            right = [r[k] for r in rows if r[1] == c]
            pooled = ((statistics.variance(left) + statistics.variance(right)) / 2) ** 0.5
            want = (statistics.mean(left) - statistics.mean(right)) / pooled
            assert got[c, f] == pytest.approx(want, rel=1e-9)


def test_smd_refusals(spark):
    few = spark.createDataFrame([("anchor", 1.0), ("x", 2.0)], "c string, v double")
    assert M.standardized_mean_differences(few, ["v"], "c", "anchor").first()["error"] == "min_units"
    flat = spark.createDataFrame([(c, 0.1) for c in ("anchor", "x") for _ in range(10)], "c string, v double")
    row = M.standardized_mean_differences(flat, ["v"], "c", "anchor").first()
    assert (row["smd"], row["error"]) == (None, "zero_pooled_deviation")
    lost = M.standardized_mean_differences(flat, ["v"], "c", "nobody").first()
    assert lost["error"] == "no_anchor"
    with pytest.raises(Exception, match="min_units"):
        M.standardized_mean_differences(few, ["v"], "c", "anchor", mode="strict").collect()


def test_smd_gate(spark):
    smds = spark.createDataFrame([("x", 0.05), ("x", -0.09), ("y", 0.05), ("y", -0.1), ("z", None)], "c string, smd double")
    got = {r["c"]: r["matched"] for r in M.smd_gate(smds, "c").collect()}
    assert got == {"x": True, "y": False, "z": False}


def test_deltas(spark):
    rows = [("u", "anchor", 435.0, 8.0), ("u", "x", 414.0, 7.5), ("v", "x", 1.0, 1.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert M.numeric_features(df) == ["a", "b"]
    cells = M.condition_cells(df, ["a", "b"], "u", "c")
    got = {(r["u"], r["feature"]): (r["delta"], r["error"]) for r in M.anchor_deltas(cells, ["a", "b"], "u", "c", "anchor").collect()}
    assert got == {
        ("u", "a"): (-21.0, None), ("u", "b"): (-0.5, None),
        ("v", "a"): (None, "no_anchor"), ("v", "b"): (None, "no_anchor"),
    }


def test_booleans_count_as_numbers(spark):
    df = spark.createDataFrame([("u", "anchor", True, "t"), ("u", "x", False, "t")], "u string, c string, f boolean, s string")
    assert M.numeric_features(df) == ["f"]
    cells = M.condition_cells(df.withColumn("f", F.col("f").cast("int")), ["f"], "u", "c")
    assert M.anchor_deltas(cells, ["f"], "u", "c", "anchor").first()["delta"] == -1.0


def test_caliper(spark):
    others = spark.createDataFrame(
        [("pass", 460.0), ("fail", 600.0), ("zero", 1.0), ("none", 1.0), ("negative", 5.0), ("null", None)], "u string, d double"
    )
    anchors = spark.createDataFrame(
        [("pass", 430.0), ("fail", 430.0), ("zero", 0.0), ("negative", -2.0), ("null", 1.0)], "u string, anchor_d double"
    )
    got = {r["u"]: r for r in M.duration_caliper(others, anchors, "u", "d").collect()}
    assert len(got) == 6
    assert got["pass"]["passed"] and got["pass"]["relative_difference"] == pytest.approx(30 / 430)
    assert got["fail"]["passed"] is False and got["fail"]["tolerance"] == 0.1
    assert got["zero"]["error"] == "zero_anchor" and got["zero"]["passed"] is None
    assert got["none"]["error"] == "no_anchor" and got["null"]["error"] == "no_value"
    assert got["negative"]["passed"] and got["negative"]["relative_difference"] == -3.5


def test_anchors_are_one_row_per_unit(spark):
    df = spark.createDataFrame([("u", "anchor", 1.0, 0.0), ("u", "anchor", 3.0, 0.0), ("u", "x", 9.0, 0.0)], SCHEMA)
    assert [tuple(r) for r in M.anchors_of(df, ["a"], "u", "c", "anchor").collect()] == [("u", 2.0)]


def test_covariance_uses_complete_cases(spark):
    rows = sample() + [("u99", "x", None, 3.0), ("u98", "x", 1e6, None)]
    got = {(r["feature_a"], r["feature_b"]): (r["covariance"], r["n"]) for r in M.feature_covariance(spark.createDataFrame(rows, SCHEMA), ["a", "b"]).collect()}
    want = np.cov(np.array([r[2:] for r in sample()]), rowvar=False)
    for (i, j), pair in {(0, 0): ("a", "a"), (0, 1): ("a", "b"), (1, 1): ("b", "b")}.items():
        assert got[pair] == (pytest.approx(want[i, j], rel=1e-9), 36)


def test_mahalanobis_matches_numpy(spark):
    rows = sample()
    got = {
        (r["u"], r["c"]): r["distance"]
        for r in M.mahalanobis_to_anchor(spark.createDataFrame(rows, SCHEMA), ["a", "b"], "u", "c", "anchor").collect()
    }
    inverse = np.linalg.inv(np.cov(np.array([r[2:] for r in rows]), rowvar=False))
    at = {(r[0], r[1]): np.array(r[2:]) for r in rows}
    assert len(got) == 24
    for (u, c), distance in got.items():
        d = at[u, c] - at[u, "anchor"]
        assert distance == pytest.approx(float(np.sqrt(d @ inverse @ d)), rel=1e-9)


def test_mahalanobis_refusals(spark):
    rows = sample()
    few = spark.createDataFrame(rows[:3], SCHEMA)
    assert {r["error"] for r in M.mahalanobis_to_anchor(few, ["a", "b"], "u", "c", "anchor").collect()} == {"min_units"}
    collinear = spark.createDataFrame(rows, SCHEMA).withColumn("d", F.col("a") * 60 / 220)
    out = M.mahalanobis_to_anchor(collinear, ["a", "b", "d"], "u", "c", "anchor").collect()
    assert {(r["distance"], r["error"]) for r in out} == {(None, "singular_covariance")}
    constant = spark.createDataFrame(rows, SCHEMA).withColumn("d", F.lit(1.0))
    assert M.mahalanobis_to_anchor(constant, ["a", "d"], "u", "c", "anchor").first()["error"] == "singular_covariance"
    lonely = spark.createDataFrame([*rows, ("solo", "x", 1.0, 1.0)], SCHEMA)
    errors = {r["u"]: r["error"] for r in M.mahalanobis_to_anchor(lonely, ["a", "b"], "u", "c", "anchor").collect()}
    assert errors["solo"] == "incomplete_vector" and errors["u1"] is None


def test_readability(spark):
    df = spark.createDataFrame(
        [("u", "anchor", 5.6), ("u", "x", 2.8), ("v", "anchor", 1.0), ("v", "x", 2.0), ("w", "x", None)], "u string, c string, fk_grade double"
    )
    got = {r["u"]: r for r in M.readability_spread(df, "u", "c").collect()}
    assert got["u"]["flagged"] and got["u"]["spread"] == pytest.approx(2.8)
    assert got["u"]["grades"] == {"anchor": 5.6, "x": 2.8}
    assert got["v"]["flagged"] is False and got["v"]["spread"] == 1.0
    assert got["w"]["spread"] is None and got["w"]["grades"] == {}


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 7)) @ rng.normal(size=(7, 7)) + 3
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "i int, v array<double>, label int").repartition(5)


def test_vector_covariance(wide):
    x, df = wide
    want = np.cov(x, rowvar=False)
    rows = VEC.vector_covariance(df, "v", 7).collect()
    assert len(rows) == 28
    for r in rows:
        assert r["covariance"] == pytest.approx(want[r["i"], r["j"]], rel=1e-8, abs=1e-9) and r["n"] == 60


@pytest.mark.parametrize(("offset", "tol"), [(0.0, 1e-9), (1e8, 1e-6), (-1e12, 1e-2)])
@pytest.mark.parametrize("tasks", [1, 9])
def test_covariance_of_vectors_far_from_zero(spark, offset, tol, tasks):
    """Means of some 1e8 and variances of 1: raw sums of products would keep no digit.

    The tolerance follows the spacing of doubles around the offset, 1e-4 for the last.
    """
    x = np.random.default_rng(1).normal(size=(40, 3)) + offset
    rows = [(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, v array<double>, label int").repartition(tasks)
    centred = x - x.mean(axis=0)
    want = centred.T @ centred / 39
    for r in VEC.vector_covariance(df, "v", 3).collect():
        assert r["covariance"] == pytest.approx(want[r["i"], r["j"]], rel=tol, abs=tol)
    inverse, goal = np.linalg.inv(want), x[::2].mean(axis=0)
    for r in VEC.mahalanobis_to_mean(df, "v", F.col("label") == 0, 3).collect():
        d = x[r["i"]] - goal
        assert r["distance"] == pytest.approx(float(np.sqrt(d @ inverse @ d)), rel=max(1e-7, 2 * tol))


def test_vectors_of_another_width_take_no_part(spark, wide):
    """Neither a long row nor a row with a gap changes a sum, in whatever task they are."""
    x, df = wide
    odd = spark.createDataFrame([(-1, [1.0] * 8, 0), (-2, [None] * 7, 0), (-3, [float("nan")] * 7, 0)], df.schema)
    rows = VEC.vector_covariance(df.union(odd).repartition(9), "v", 7).collect()
    want = np.cov(x, rowvar=False)
    assert {r["n"] for r in rows} == {60}
    assert all(r["covariance"] == pytest.approx(want[r["i"], r["j"]], rel=1e-8, abs=1e-9) for r in rows)


def test_vector_mahalanobis_brute_force(spark, wide):
    x, df = wide
    odd = spark.createDataFrame([(100, None, 1), (101, [1.0], 1), (102, [1.0] * 6 + [None], 1), (103, [2.0] * 9, 0)], df.schema)
    got = {r["i"]: r for r in VEC.mahalanobis_to_mean(df.union(odd), "v", F.col("label") == 0, 7).collect()}
    inverse = np.linalg.inv(np.cov(x, rowvar=False))
    goal = x[::3].mean(axis=0)
    assert len(got) == 43 and got[102]["error"] == "incomplete_vector"
    for i in range(60):
        if i % 3:
            d = x[i] - goal
            assert got[i]["distance"] == pytest.approx(float(np.sqrt(d @ inverse @ d)), rel=1e-8)
    assert got[100]["error"] == got[101]["error"] == "bad_vector"
    assert VEC.mahalanobis_to_mean(df.limit(5), "v", F.col("label") == 0, 7).first()["error"] == "min_units"
