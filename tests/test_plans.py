"""What the plans must keep: no cross joins, pushed filters, one pass over the text."""

import os

import pytest

from lectern.plans.workload import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

PYTHON = (
    "mahalanobis_to_anchor", "vector_covariance", "vector_mahalanobis", "parcel_means", "decayed_trajectories",
    "segment_onsets",
)


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_needless_python(spark, name):
    plan = physical(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("name", ["duration_caliper"])
def test_condition_filter_reaches_the_scan(spark, name):
    df = QUERIES[name](spark, SF)
    assert "PushedFilters: [IsNotNull(lang), Not(EqualTo(lang,en))]" in physical(df)


@pytest.mark.parametrize("name", ["anchor_deltas", "smd_gate", "readability_spread", "mahalanobis_to_anchor"])
def test_text_is_not_shuffled_by_key(spark, name):
    """Only the spreading of a small scan moves text; hash exchanges move numbers."""
    lines = physical(QUERIES[name](spark, SF)).split("\n")
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = next(x for x in lines[i + 1 :] if "Project" in x or "Aggregate" in x)
            assert "text#" not in below.split("functions=")[0].split("keys=")[-1]


@pytest.mark.parametrize("name", ["word_onsets", "split_turns"])
def test_explode_leaves_no_filter_at_the_scan(spark, name):
    assert "DataFilters: []" in physical(QUERIES[name](spark, SF))


def test_features_run_inside_whole_stage_codegen(spark):
    plan = QUERIES["text_features"](spark, SF)
    plan.collect()
    final = physical(plan).split("Initial Plan")[0]
    assert all("*(" in line for line in final.split("\n") if "Project [doc_id" in line)
    text = [line for line in final.split("\n") if "ReadSchema" in line][0]
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in text


def test_key_violations_do_not_read_the_text(spark):
    assert "text:string" not in physical(QUERIES["key_violations"](spark, SF))


def test_covariance_reuses_the_cells(spark):
    df = QUERIES["mahalanobis_to_anchor"](spark, SF)
    df.collect()
    assert "ReusedExchange" in physical(df)


@pytest.mark.parametrize("name", ["smd_by_feature", "smd_gate", "smd_min_units_guard", "scenario_contrasts"])
def test_differences_scan_their_table_once(spark, name):
    df = QUERIES[name](spark, SF)
    df.collect()
    assert physical(df).split("Initial Plan")[0].count("FileScan") == 1


@pytest.mark.parametrize("name", ["vector_covariance", "vector_mahalanobis"])
def test_vectors_are_multiplied_once(spark, name):
    assert physical(QUERIES[name](spark, SF)).count("MapInArrow") == 1


def test_parcel_means_shuffle_no_vectors(spark):
    assert "Exchange hashpartitioning(vec_id" not in physical(QUERIES["parcel_means"](spark, SF))
