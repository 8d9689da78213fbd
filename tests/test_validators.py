"""Validators, registry, numeric closeness and the unit audit."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions.numeric import answer_text, numeric_close
from lectern.operators import validators as V
from lectern.operators.audit import audit_units, correctness_gate
from lectern.sources.units import UNIT_SCHEMA, read_units, units_index, write_units_index

NAN, INF = math.nan, math.inf

KNOWN = [
    ("break_even_quantity", {"fixed_costs": 120000.0, "price": 80.0, "variable_cost": 50.0}, 4000.0, None),
    ("break_even_revenue", {"fixed_costs": 120000.0, "price": 80.0, "variable_cost": 50.0}, 320000.0, None),
    ("target_profit_quantity", {"fixed_costs": 120000.0, "target_profit": 60000.0, "price": 80.0, "variable_cost": 50.0}, 6000.0, None),
    ("price_for_break_even_quantity", {"fixed_costs": 90000.0, "quantity": 3000.0, "variable_cost": 12.0}, 42.0, None),
    ("contribution_margin_ratio", {"price": 80.0, "variable_cost": 50.0}, 0.375, None),
    ("break_even_quantity", {"fixed_costs": 1.0, "price": 50.0, "variable_cost": 50.0}, None, "non_positive_margin"),
    ("break_even_revenue", {"fixed_costs": 1.0, "price": 50.0, "variable_cost": 50.0}, None, "non_positive_margin"),
    ("target_profit_quantity", {"fixed_costs": 1.0, "target_profit": 1.0, "price": 50.0, "variable_cost": 50.0}, None, "non_positive_margin"),
    ("contribution_margin_ratio", {"price": 50.0, "variable_cost": 50.0}, None, "non_positive_margin"),
    ("contribution_margin_ratio", {"price": 0.0, "variable_cost": -1.0}, None, "zero_price"),
    ("break_even_quantity", {"fixed_costs": -1.0, "price": 50.0, "variable_cost": 50.0}, None, "negative_fixed_costs"),
    ("price_for_break_even_quantity", {"fixed_costs": 1.0, "quantity": 0.0, "variable_cost": 1.0}, None, "non_positive_quantity"),
    ("price_for_break_even_quantity", {"fixed_costs": 1.0, "quantity": 2.0, "variable_cost": 99.0}, 99.5, None),
    ("target_profit_quantity", {"fixed_costs": 0.0, "target_profit": -30.0, "price": 5.0, "variable_cost": 2.0}, -10.0, None),
    ("break_even_quantity", {"fixed_costs": 1.0, "price": NAN, "variable_cost": 1.0}, None, "nan_param"),
    ("break_even_quantity", {"fixed_costs": 1.0, "price": 2.0}, None, "missing_param"),
    ("contribution_margin_ratio", {"price": 2.0, "variable_cost": 1.0, "quantity": 3.0}, None, "unexpected_param"),
    ("contribution_margin_expr", {}, None, "symbolic_validator"),
    ("does_not_exist", {"price": 2.0}, None, "unknown_validator"),
]


def test_dispatch_known_answers(spark):
    rows = [(i, name, params) for i, (name, params, _, _) in enumerate(KNOWN)]
    df = spark.createDataFrame(rows, "i int, validator string, params map<string,double>")
    expected, error = V.dispatch(F.col("validator"), F.col("params"))
    for r in df.select("i", expected.alias("expected"), error.alias("error")).collect():
        assert (r["expected"], r["error"]) == KNOWN[r["i"]][2:], KNOWN[r["i"]]


def test_evaluate_over_columns(one):
    for name, params, want, code in KNOWN[:10]:
        schema = ", ".join(f"{p} double" for p in params)
        assert one(params, schema, *V.evaluate(name, **{p: F.col(p) for p in params})) == (want, code)


def test_check_answers(spark):
    costs = {"fixed_costs": 120000.0, "price": 80.0, "variable_cost": 50.0}
    rows = [
        ("break_even_quantity", costs, 4000.0), ("break_even_quantity", costs, 1500.0),
        ("break_even_quantity", costs, None), ("nope", costs, 1.0), ("break_even_quantity", costs, 4000.003),
    ]
    df = spark.createDataFrame(rows, "validator string, params map<string,double>, answer double")
    got = [(r["passed"], r["error"]) for r in V.check_answers(df).collect()]
    assert got == [(True, None), (False, None), (None, "null_answer"), (None, "unknown_validator"), (True, None)]
    assert V.check_answers(df).first()["detail"] == "answer=4000 expected=4000 tol=1e-06"
    with pytest.raises(Exception, match="unknown_validator|null_answer"):
        V.check_answers(df, mode="strict").collect()


def test_registry():
    assert V.registered() == sorted(V.registered()) and len(V.registered()) == 6
    assert V.get("break_even_quantity").kind == V.NUMERIC
    with pytest.raises(KeyError):
        V.get("does_not_exist")
    with pytest.raises(ValueError):
        V.register("break_even_quantity", ("x",))(lambda x: x)
    with pytest.raises(ValueError):
        V.register("other", ("x",), kind="magic")


def test_user_validator_joins_the_dispatch(spark):
    @V.register("double_it", ("x",), [("negative", lambda p: p["x"] < 0)])
    def double_it(x):
        return x * 2

    try:
        df = spark.createDataFrame([("double_it", {"x": 4.0}), ("double_it", {"x": -4.0})], "v string, p map<string,double>")
        expected, error = V.dispatch(F.col("v"), F.col("p"))
        assert [tuple(r) for r in df.select(expected, error).collect()] == [(8.0, None), (None, "negative")]
    finally:
        V.unregister("double_it")


def test_user_validator_may_be_a_pandas_udf(spark):
    @F.pandas_udf("double")
    def half(x: pd.Series) -> pd.Series:
        return x / 2

    V.register("half_it", ("x",))(lambda x: half(x))
    try:
        df = spark.createDataFrame([("half_it", {"x": 4.0}, 2.0), ("half_it", {}, 2.0)], "validator string, params map<string,double>, answer double")
        got = [(r["expected"], r["passed"], r["error"]) for r in V.check_answers(df).collect()]
        assert got == [(2.0, True, None), (None, None, "missing_param")]
    finally:
        V.unregister("half_it")


def test_numeric_close_equals_isclose(spark):
    values = [0.0, -0.0, 1.0, 1.0 + 1e-7, 1.0 + 1e-5, 1e-7, -1e-7, 1e12, 1e12 + 1, 1e12 + 1e7, INF, -INF, NAN, 4000.0]
    pairs = [(a, b) for a in values for b in values]
    df = spark.createDataFrame(pairs, "a double, b double")
    for (a, b), r in zip(pairs, df.select(numeric_close(F.col("a"), F.col("b"))).collect()):
        assert r[0] == math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6), (a, b)


def test_answer_text(one):
    for value, want in ((4000.0, "4000"), (1e7, "10000000"), (0.375, "0.375"), (-2.0, "-2"), (1e300, "1.0E300"), (1e15, "1000000000000000"), (1e-5, "0.00001"), (12345678.5, "12345678.5")):
        assert one({"x": value}, "x double", answer_text(F.col("x"))) == want


def test_formula_equivalence(spark):
    points = spark.createDataFrame([(float(p), float(v)) for p in range(1, 9) for v in range(8)], "P double, V double")
    got = {
        r["formula"]: (r["points"], r["one_sided"], r["disagreements"], r["equivalent"])
        for r in V.formula_equivalence(
            points, {"same": ("P - V", "-(V - P)"), "other": ("P - V", "P + V"), "undefined": ("P / nullif(V, 0)", "P / nullif(V, 0)"), "partial": ("CASE WHEN P > 7 THEN P - V END", "P - V")}
        ).collect()
    }
    assert got["same"] == (64, 0, 0, True)
    assert got["other"] == (64, 0, 56, False)
    assert got["undefined"] == (56, 0, 0, True)
    assert got["partial"] == (8, 56, 56, False)
    assert V.check_formula(points, "contribution_margin_expr", "P - V").first()["equivalent"]
    assert not V.check_formula(points, "contribution_margin_expr", "P * V").first()["equivalent"]
    with pytest.raises(ValueError):
        V.check_formula(points, "break_even_quantity", "P")


UNIT = """{"unit_id": "u1", "domain": "d", "concept": "c", "difficulty": 2, "prerequisites": ["p", "q"],
 "canonical_problem": {"prompt": "?", "validator": "break_even_quantity",
   "params": {"fixed_costs": 120000, "price": 80, "variable_cost": 50}, "answer": 4000},
 "common_misconception": {"description": "x", "wrong_answer": 1500, "wrong_method": "y"},
 "practice_problem": {"validator": "break_even_quantity",
   "params": {"fixed_costs": 45000, "price": 25, "variable_cost": 10}, "answer": 3000},
 "near_transfer": {"prompt": "?", "validator": "target_profit_quantity",
   "params": {"fixed_costs": 120000, "target_profit": 60000, "price": 80, "variable_cost": 50}, "answer": 6000},
 "far_transfer": {"prompt": "?", "validator": "price_for_break_even_quantity",
   "params": {"fixed_costs": 90000, "quantity": 3000, "variable_cost": 12}, "answer": 42}}"""


@pytest.fixture()
def units(spark, tmp_path):
    folder = tmp_path / "units"
    folder.mkdir()
    (folder / "u1.json").write_text(UNIT)
    (folder / "u2.json").write_text(UNIT.replace('"u1"', '"u2"').replace("1500", "4000").replace('"answer": 42', '"answer": 43'))
    return read_units(spark, f"{folder}/*.json")


def test_units_scan_and_index(spark, units, tmp_path):
    assert units.drop("error").schema == UNIT_SCHEMA
    row = units_index(units).filter("unit_id = 'u1'").first()
    assert row["prerequisites"] == "p;q" and row["reference_answer"] == 4000.0
    assert row["validator_transfer"] == "price_for_break_even_quantity" and row["transfer_answer"] == 42.0
    write_units_index(units, str(tmp_path / "index"))
    write_units_index(units, str(tmp_path / "index"))
    back = spark.read.csv(str(tmp_path / "index"), header=True, escape='"')
    assert back.count() == 2 and len(back.columns) == 11
    params = back.filter("unit_id = 'u1'").select(
        F.from_json("validator_reference_params", "map<string,double>")
    ).first()[0]
    assert params == {"fixed_costs": 120000.0, "price": 80.0, "variable_cost": 50.0}


def test_unit_audit_and_gate(units):
    audit = {(r["unit_id"], r["problem"]): r for r in audit_units(units).collect()}
    assert len(audit) == 10
    assert all(audit["u1", p]["ok"] for p in ("canonical_problem", "practice_problem", "near_transfer", "far_transfer"))
    assert audit["u1", "misconception_correctly_fails"]["passed"] is False
    assert audit["u1", "misconception_correctly_fails"]["ok"]
    assert not audit["u2", "misconception_correctly_fails"]["ok"]
    assert not audit["u2", "far_transfer"]["ok"]
    gates = {r["problem"]: r for r in correctness_gate(audit_units(units), "problem", {"canonical_problem": 1.0}).collect()}
    assert gates["canonical_problem"]["gate"] and gates["canonical_problem"]["share"] == 1.0
    assert not gates["far_transfer"]["gate"] and gates["far_transfer"]["n_correct"] == 1


def test_malformed_unit_file_is_quarantined(spark, units, tmp_path):
    (tmp_path / "units" / "u3.json").write_text('{"unit_id": "u3", "domain": ')
    path = f"{tmp_path}/units/*.json"
    assert sorted((r["unit_id"] or "", r["error"]) for r in read_units(spark, path).collect()) == [
        ("", "malformed_json"), ("u1", None), ("u2", None),
    ]
    with pytest.raises(Exception, match="malformed_json"):
        read_units(spark, path, mode="strict").collect()
    (tmp_path / "units" / "u3.json").write_text(UNIT.replace('"u1"', '"u3"').replace('"difficulty": 2', '"difficulty": "x"'))
    odd = read_units(spark, path).filter("error IS NOT NULL").first()
    assert (odd["unit_id"], odd["difficulty"], odd["error"]) == ("u3", None, "bad_field")
    lines = tmp_path / "lines.json"
    lines.write_text(UNIT.replace("\n", " ") + "\n" + UNIT.replace("\n", " ").replace('"u1"', '"u2"') + "\n")
    assert read_units(spark, str(lines), one_per_file=False).filter("error IS NULL").count() == 2


def test_validators_that_leave_the_jvm_are_flagged(spark):
    @F.pandas_udf("double")
    def halved(x: pd.Series) -> pd.Series:
        return x / 2

    @F.udf("boolean")
    def odd(x):
        return x % 2 == 1

    V.register("half", ("x",))(lambda x: F.abs(halved(x)) + 1)
    V.register("guarded_half", ("x",), [("odd", lambda p: odd(p["x"]))])(lambda x: x / 2)
    V.register("whole", ("x",))(lambda x: x)
    try:
        rows = {r["validator"]: r for r in V.describe_validators(spark).collect()}
    finally:
        for name in ("half", "guarded_half", "whole"):
            V.unregister(name)
    assert {n for n, r in rows.items() if r["leaves_jvm"]} == {"half", "guarded_half"}
    assert rows["guarded_half"]["guards"] == ["odd"] and rows["break_even_revenue"]["params"] == ["fixed_costs", "price", "variable_cost"]
    assert rows["contribution_margin_expr"]["kind"] == "symbolic"
