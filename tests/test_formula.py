"""Formulas in columns against Python's own arithmetic."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import formula as X
from lectern.operators import validators as V


def _random_formula(rng, depth=0):
    if depth > 3 or rng.random() < 0.25:
        return rng.choice(["P", "V", "x_1", "2", "0.5", "10.", ".25"])
    kind = rng.random()
    if kind < 0.15:
        return "-" + _random_formula(rng, depth + 1)
    if kind < 0.4:
        return "(" + _random_formula(rng, depth + 1) + ")"
    return _random_formula(rng, depth + 1) + rng.choice([" + ", "-", "*", " / "]) + _random_formula(rng, depth + 1)


def test_values_are_those_of_python(spark):
    rng = random.Random(4)
    texts = [_random_formula(rng) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("p", X.postfix(F.col("t")))
    symbols = [X._symbol_value(F.lit(s), F.lit(3)).alias(s) for s in ("P", "V", "x_1")]
    rows = df.select("i", X.value_at(F.col("p"), F.lit(3)).alias("v"), *symbols).collect()
    for r in rows:
        try:
            want = eval(texts[r["i"]], {s: r[s] for s in ("P", "V", "x_1")})
        except ZeroDivisionError:
            want = None
        assert r["v"] == (want if want is None else pytest.approx(want, rel=1e-12)), texts[r["i"]]


@pytest.mark.parametrize(
    "text",
    ["", " ", "P -", "* P", "P V", "2P", "(P", "P)", "()", "P ** 2", "P - (V", "P; V", "f(P)", "1..2", "P - ) V (", "é"],
)
def test_no_formula(spark, text):
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in df.select(X.postfix(F.col("t"))).collect()] == [None, None]


AGREE = [
    ("P - V", "P-V", True),
    ("P - V", "-V + P", True),
    ("P - V", "- - P - V", True),
    ("(P - V) / P", "1 - V/P", True),
    ("(P*P - V*V)/(P+V)", "P - V", True),
    ("P - V - 1", "P - (V - 1)", False),
    ("8/4/2", "1", True),
    ("P - V", "V - P", False),
    ("P / (V - V)", "P", False),
    ("P / (V - V)", "P / 0", False),
    ("P", "Q", False),
    ("P", "P (", None),
    (None, "P", None),
]


def test_agreement(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(AGREE)], "i int, a string, b string")
    out = df.select("i", X.formulas_agree(X.postfix(F.col("a")), X.postfix(F.col("b"))).alias("same")).collect()
    assert {r["i"]: r["same"] for r in out} == {i: want for i, (_, _, want) in enumerate(AGREE)}


RATIO, MARGIN = "contribution_margin_ratio", "contribution_margin_expr"
COSTS = {"price": "10", "variable_cost": "4.0"}
ANSWERS = [
    (RATIO, COSTS, "0.6", True, None),
    (RATIO, COSTS, "6e-1", True, None),
    (RATIO, COSTS, "0.7", False, None),
    (RATIO, COSTS, "P - V", None, "bad_answer"),
    (RATIO, COSTS, None, None, "null_answer"),
    (RATIO, {"price": "ten", "variable_cost": "4"}, "0.6", None, "bad_param"),
    (RATIO, {"price": "10"}, "0.6", None, "missing_param"),
    (RATIO, {**COSTS, "quantity": "1"}, "0.6", None, "unexpected_param"),
    (MARGIN, {}, "P - V", True, None),
    (MARGIN, {}, "P + V", False, None),
    (MARGIN, {"price": "a", "variable_cost": "b"}, "-(b - a)", True, None),
    (MARGIN, {"price": "a"}, "P - V", False, None),
    (MARGIN, {"cost": "a"}, "P - V", None, "unexpected_param"),
    (MARGIN, {"price": "a b"}, "P - V", None, "bad_symbol"),
    (MARGIN, {}, "P - V)", None, "bad_formula"),
    (MARGIN, {}, "12", False, None),
    (MARGIN, {}, None, None, "null_answer"),
    ("nobody", {"price": "x"}, "1", None, "unknown_validator"),
]


def test_authored_answers(spark):
    rows = [(i, *r[:3], "own") for i, r in enumerate(ANSWERS)]
    df = spark.createDataFrame(rows, "i int, validator string, params map<string,string>, answer string, note string")
    out = V.check_authored_answers(df)
    assert out.columns == [*df.columns, "error", "expected", "passed", "detail"]
    got = {r["i"]: r for r in out.collect()}
    for i, (_, _, _, passed, error) in enumerate(ANSWERS):
        assert (got[i]["passed"], got[i]["error"]) == (passed, error), ANSWERS[i]
        assert (got[i]["expected"] is None) == (error is not None)
    assert got[10]["expected"] == "a - b" and got[0]["expected"] == "0.6"
    assert V.check_authored_answers(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="bad row: "):
        V.check_authored_answers(df, mode="strict").collect()


def test_formula_pairs_are_compared_once_and_rows_stay(spark):
    df = spark.createDataFrame([(MARGIN, {"price": "P"}, "P - V")] * 50, "validator string, params map<string,string>, answer string")
    plan = V.check_authored_answers(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "Python" not in plan
