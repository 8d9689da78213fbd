"""The acceptance slice end to end, over files of our own."""

import re

import pytest

from lectern.plans.report import measure, report_tables, run_slice
from lectern.sources.front_matter import load_stimuli
from lectern.sources.units import read_units
from tests.test_validators import UNIT


def padded(text: str, words: int) -> str:
    """The text with words at its end, up to a number of words."""
    return text + " more" * (words - len(re.findall("[A-Za-z0-9']+", text)))


PROSE = "Fixed costs of 120,000 are paid once. Each unit leaves thirty. So one divides them, and gets 4,000 units here."
SCAFFOLD = (
    "TUTOR: Fixed costs are 120,000. How many units?\n\nLEARNER: I get 1,500 units.\n\nTUTOR: Hint: subtract first.\n\n"
    "LEARNER: Then it is thirty?\n\nTUTOR: Hint: divide now.\n\nLEARNER: It is 4,000.\n\nTUTOR: Right."
)
SUBSTITUTE = (
    "TUTOR: Fixed costs are 120,000. How many units?\n\nLEARNER: I get 1,500 units.\n\n"
    "TUTOR: No, subtract, then divide: 4,000 units. Keep this in mind.\n\nLEARNER: I see, thanks."
)


def write(folder, unit, condition, body):
    target = folder / condition
    target.mkdir(exist_ok=True)
    (target / f"{unit}.txt").write_text(
        f"---\nstimulus_id: {unit}_{condition}\nunit_id: {unit}\ncondition: {condition}\nvariant: primary\n"
        f"example_count: 1\nlearner_error_scripted: true\n---\n{body}\n"
    )


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("slice")
    (folder / "units").mkdir()
    (folder / "units" / "u1.json").write_text(UNIT)
    (folder / "units" / "u2.json").write_text(UNIT.replace('"u1"', '"u2"').replace("1500", "4000"))
    stimuli = folder / "stimuli"
    stimuli.mkdir()
    for unit in ("u1", "u2"):
        write(stimuli, unit, "traditional", padded(PROSE, 62 if unit == "u1" else 90))
        write(stimuli, unit, "ai_scaffolding", padded(SCAFFOLD, 60))
        write(stimuli, unit, "ai_substitution", padded(SUBSTITUTE, 60))
    units = read_units(spark, f"{folder}/units/*.json")
    loaded = load_stimuli(spark, f"{stimuli}/*/*.txt")
    return loaded, units, report_tables(units, loaded), folder


def test_sections(tables):
    t = tables[2]
    assert t["validator_results"].count() == 10
    assert t["features"].count() == 6 and t["features"].filter("error IS NOT NULL").count() == 0
    assert t["anchor_deltas"].count() == 2 * 2 * 8
    assert t["duration_caliper"].count() == 4
    assert {r["error"] for r in t["smd"].collect()} == {"min_units"}
    assert t["readability"].count() == 2


def test_dialogue_section(tables):
    rows = {(r["unit_id"], r["condition"]): r for r in tables[2]["dialogue"].collect()}
    scaffold, substitute = rows["u1", "ai_scaffolding"], rows["u1", "ai_substitution"]
    assert (scaffold["leaked"], scaffold["first_attempt_turn_index"], scaffold["policy_ok"]) == (False, 1, True)
    assert (scaffold["guiding_question"], scaffold["hint"], scaffold["answer_reveal"]) == (1, 2, 1)
    assert substitute["labels"] == ["guiding_question", "answer_reveal"] and substitute["policy_ok"]
    assert scaffold["final_answer"] == "4000"


def test_acceptance(tables):
    rows = {r["unit_id"]: r for r in tables[2]["acceptance"].collect()}
    assert rows["u1"]["answers_ok"] and not rows["u2"]["answers_ok"]
    assert rows["u1"]["no_leak"] and rows["u1"]["policy_ok"]
    assert not rows["u2"]["caliper_ok"] and not rows["u2"]["accepted"]
    assert rows["u1"]["caliper_ok"] and rows["u1"]["accepted"]


def test_features_may_come_from_a_written_table(spark, tables, tmp_path):
    loaded, units, lazy, _ = tables
    measure(loaded).write.parquet(str(tmp_path / "features"))
    again = report_tables(units, loaded, spark.read.parquet(str(tmp_path / "features")))
    assert sorted(map(tuple, again["acceptance"].collect())) == sorted(map(tuple, lazy["acceptance"].collect()))


def test_run_slice_writes_every_section(spark, tables, tmp_path):
    _, _, lazy, folder = tables
    for _ in range(2):
        run_slice(spark, f"{folder}/units/*.json", f"{folder}/stimuli/*/*.txt", str(tmp_path))
    for name, table in lazy.items():
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == table.count(), name
    written = spark.read.parquet(f"{tmp_path}/acceptance")
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, lazy["acceptance"].collect()))
