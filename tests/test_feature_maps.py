"""Feature maps of mixed kinds, and answers as they were written."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import matching as M
from lectern.plans.report import dialogue_checks
from lectern.sources.units import parse_units, read_units

MAPS = [
    ("u", "en", '{"a": 1, "b": 2.5, "flag": true, "name": "x", "code": "12", "gone": null, "list": [1]}'),
    ("u", "en", '{"a": 3, "big": 12345678901234567890}'),
    ("u", "de", '{"a": 10, "flag": false, "name": "y", "code": "13", "extra": 1}'),
    ("u", "fr", '{"extra": 1}'),
    ("u", "es", "no json"),
    ("v", "de", '{"a": 1, "b": 2}'),
    ("v", "fr", None),
    (None, "de", '{"a": 1}'),
]


def test_feature_map_deltas(spark):
    df = spark.createDataFrame(MAPS, "unit string, lang string, features string")
    out = M.feature_map_deltas(df, "features", "unit", "lang", "en")
    assert out.columns == ["unit", "lang", "feature", "delta", "error"]
    rows = sorted((tuple(r) for r in out.collect()), key=repr)
    assert rows == sorted(
        [
            ("u", "de", "a", 8.0, None),
            ("u", "de", "flag", -1.0, None),
            ("v", "de", None, None, "no_anchor"),
            ("v", "fr", None, None, "no_anchor"),
            (None, "de", None, None, "no_anchor"),
        ],
        key=repr,
    )
    assert M.feature_map_deltas(df.limit(0), "features", "unit", "lang", "en").count() == 0
    with pytest.raises(Exception, match="no_anchor"):
        M.feature_map_deltas(df, "features", "unit", "lang", "en", mode="strict").collect()


def test_map_deltas_of_one_row(spark):
    df = spark.createDataFrame([(MAPS[0][2], MAPS[2][2])], "a string, b string")
    found = df.select(M.map_deltas(M.numeric_entries(F.col("a")), M.numeric_entries(F.col("b")))).first()[0]
    assert found == {"a": 9.0, "flag": -1.0}


def _unit(answer: str) -> str:
    return '{"unit_id": "u", "canonical_problem": {"validator": "v", "params": {"x": 1}, "answer": %s}}' % answer


@pytest.mark.parametrize(
    ("written", "number", "text"),
    [
        ("4000.0", 4000.0, "4000.0"),
        ("4000", 4000.0, "4000"),
        ("1234567890123456789", 1234567890123456789.0, "1234567890123456789"),
        ('"P - V"', None, "P - V"),
        ("null", None, None),
    ],
)
def test_authored_answers_keep_their_text(spark, tmp_path, written, number, text):
    (tmp_path / "u.json").write_text(_unit(written))
    units = read_units(spark, str(tmp_path / "*.json"), authored=True)
    row = units.select("canonical_problem.answer", "canonical_problem.answer_text", "error").first()
    assert tuple(row) == (number, text, None)
    parsed = parse_units(spark.createDataFrame([(_unit(written),)], "j string"), "j", authored=True)
    assert tuple(parsed.select("canonical_problem.answer", "canonical_problem.answer_text").first()) == (number, text)


@pytest.mark.parametrize(("said", "leaked"), [("It is 1234567890123456789.", True), ("It is 1234567890123456800.", False)])
def test_leakage_searches_what_was_written(spark, said, leaked):
    units = parse_units(spark.createDataFrame([(_unit("1234567890123456789"),)], "j string"), "j", authored=True)
    body = f"TUTOR: {said}\n\nLEARNER: Is it 5?\n\nTUTOR: Not quite.\n"
    stimuli = spark.createDataFrame([("s", "u", "ai_scaffolding", body)], "stimulus_id string, unit_id string, condition string, body string")
    row = dialogue_checks(stimuli, units).first()
    assert row["final_answer"] == "1234567890123456789" and row["leaked"] == leaked
