"""Front-matter parsing: files, errors, traps and coercion."""

import pytest
from pyspark.sql import functions as F

from lectern.sources.front_matter import coerce, load_stimuli, with_front_matter

GOOD = "---\nstimulus_id: s1\nunit_id: u1\ncondition: traditional\nvariant: primary\nexample_count: 1\nlearner_error_scripted: False\n---\n\nBody one.\n---\nBody two.\n\n"

CASES = {
    GOOD: (None, "Body one.\n---\nBody two."),
    "no front matter here": ("missing_opening", None),
    "": ("missing_opening", None),
    "text\n---\na: 1\n---\n": ("missing_opening", None),
    "﻿---\na: 1\n---\nx": ("missing_opening", None),
    "---\nkey: value\nbody without an end": ("missing_closing", None),
    "---": ("missing_closing", None),
    "---\nkey value\n---\nx": ("malformed_line", None),
    "---\n---\nx": ("empty_front_matter", None),
    "---\n\n  \n---\nx": ("empty_front_matter", None),
    "---\r\na: 1\r\n---\r\nx\r\ny\r\n": (None, "x\ny"),
    " --- \na: 1\n ---\t\n\n\nx": (None, "x"),
    "---\na: 1\n---": (None, ""),
    "---\na: 1\n ---- \nb: 2\n---\n  x ": ("malformed_line", None),
    "---\na: 1\n ----: \nb: 2\n---\n  x ": (None, "  x "),
}


@pytest.fixture(scope="module")
def parsed(spark):
    texts = list(CASES)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    return {texts[r["i"]]: r for r in with_front_matter(df).collect()}


@pytest.mark.parametrize("text", list(CASES), ids=range(len(CASES)))
def test_error_and_body(parsed, text):
    error, body = CASES[text]
    assert (parsed[text]["error"], parsed[text]["body"]) == (error, body)


def test_meta_takes_first_colon_and_last_duplicate(spark):
    text = "---\na: 1:2\n  b  :  x y \na: 3 : 4\n: nameless\n---\n"
    df = spark.createDataFrame([(text,)], "content string")
    assert with_front_matter(df).first()["meta"] == {"a": "3 : 4", "b": "x y", "": "nameless"}


def test_null_content_and_strict_mode(spark):
    df = spark.createDataFrame([(None,)], "content string")
    assert with_front_matter(df).first()["error"] == "null_content"
    with pytest.raises(Exception, match="missing_opening"):
        with_front_matter(spark.createDataFrame([("x",)], "content string"), mode="strict").collect()


def test_coercion(one):
    cases = {
        "true": ("bool", True, None), "FALSE": ("bool", False, None), "12": ("int", None, 12),
        "-7": ("int", None, -7), "+7": ("int", None, 7), "1_000": ("int", None, 1000),
        "1__0": ("string", None, None), "_1": ("string", None, None), "5.0": ("string", None, None),
        "": ("string", None, None), "99999999999999999999": ("string", None, None),
        "007": ("int", None, 7),
    }
    for raw, want in cases.items():
        got = one({"v": raw}, "v string", coerce(F.col("v")))
        assert (got.raw, got.kind, got.bool_val, got.long_val) == (raw, *want)


def test_load_files_of_several_conditions(spark, tmp_path):
    for condition in ("traditional", "ai_scaffolding"):
        folder = tmp_path / condition
        folder.mkdir()
        (folder / "u1.txt").write_text(GOOD.replace("traditional", condition).replace("s1", condition))
    (tmp_path / "ai_scaffolding" / "broken.txt").write_text("nothing here")
    rows = {r["path"].split("/")[-2] + "/" + r["path"].split("/")[-1]: r for r in load_stimuli(spark, f"{tmp_path}/*/*.txt").collect()}
    assert len(rows) == 3
    good = rows["ai_scaffolding/u1.txt"]
    assert good["condition"] == "ai_scaffolding" and good["unit_id"] == "u1"
    assert good["example_count"] == 1 and good["learner_error_scripted"] is False
    assert "---" in good["body"] and good["error"] is None
    broken = rows["ai_scaffolding/broken.txt"]
    assert broken["error"] == "missing_opening" and broken["condition"] is None
