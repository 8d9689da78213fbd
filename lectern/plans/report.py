"""The acceptance report as result tables, and one acceptance row per unit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.errors import QUARANTINE
from lectern.functions.numeric import answer_text
from lectern.functions.text import FEATURES, with_text_features
from lectern.functions.turns import (
    LABELS,
    SCAFFOLDING,
    TRADITIONAL,
    follows_policy,
    label_count,
    tutor_labels,
    with_attempt,
    with_leakage,
)
from lectern.operators import matching as M
from lectern.operators.audit import audit_units
from lectern.session import lookup_side
from lectern.sources.front_matter import load_stimuli
from lectern.sources.units import read_units

_UNIT, _CONDITION = "unit_id", "condition"


def dialogue_checks(
    stimuli: DataFrame, units: DataFrame, anchor: str = TRADITIONAL, mode: str = QUARANTINE
) -> DataFrame:
    """Leakage, tutor labels and reveal policy of every non-anchor stimulus.

    Turns are read before the join with the canonical answers, so the join moves
    the text before the first attempt and the labels, not the bodies. Answers that were
    read with their text are searched as they were written.
    """
    problem = units.schema["canonical_problem"].dataType
    written = F.col("canonical_problem.answer_text") if "answer_text" in problem.names else None
    number = answer_text(F.col("canonical_problem.answer"))
    answers = units.select(_UNIT, (number if written is None else written).alias("final_answer"))
    talks = stimuli.filter(F.col(_CONDITION) != anchor).select(
        "stimulus_id", _UNIT, _CONDITION, "body"
    )
    read = with_attempt(talks, "body", keep_turns=True)
    read = read.withColumn("labels", tutor_labels(F.col("turns"))).drop("turns")
    checked = with_leakage(read.join(answers, _UNIT, "left"), "final_answer", mode)
    policy = follows_policy(F.col(_CONDITION), F.col("labels"), F.col("leaked"))
    return checked.withColumns(
        {
            **{label: label_count(F.col("labels"), label) for label in LABELS},
            "policy_ok": policy,
        }
    )


def measure(stimuli: DataFrame, mode: str = QUARANTINE) -> DataFrame:
    """Features of loaded stimuli; worked examples are taken from their front matter."""
    bodies = stimuli.withColumnRenamed("example_count", "declared_examples")
    featured = with_text_features(bodies, "body", F.col("declared_examples"), mode=mode)
    return featured.drop("declared_examples")


def report_tables(
    units: DataFrame,
    stimuli: DataFrame,
    featured: DataFrame | None = None,
    anchor: str = TRADITIONAL,
    mode: str = QUARANTINE,
) -> dict[str, DataFrame]:
    """All sections as lazy frames; nothing runs until one is read.

    ``stimuli`` is the output of :func:`lectern.sources.front_matter.load_stimuli`.
    Five sections read features: pass ``featured``, read back from a written
    feature table, and the texts are measured once for all of them.
    """
    if featured is None:
        featured = measure(stimuli, mode)
    cells = M.condition_cells(featured, FEATURES, _UNIT, _CONDITION)
    audit = audit_units(units, mode=mode)
    deltas = M.anchor_deltas(cells, FEATURES, _UNIT, _CONDITION, anchor, mode)
    anchors = M.anchors_of(featured, ["duration_seconds"], _UNIT, _CONDITION, anchor)
    caliper = _calipers(featured, anchors, anchor, mode)
    smd = M.standardized_mean_differences(cells, FEATURES, _CONDITION, anchor, mode=mode)
    spread = M.readability_spread(cells, _UNIT, _CONDITION)
    dialogue = dialogue_checks(stimuli, units, anchor, mode)
    return {
        "validator_results": audit,
        "features": featured.select("stimulus_id", _UNIT, _CONDITION, *FEATURES, "error"),
        "anchor_deltas": deltas,
        "duration_caliper": caliper,
        "smd": smd,
        "dialogue": dialogue,
        "readability": spread,
        "acceptance": unit_acceptance(audit, cells, dialogue, anchor),
    }


def _calipers(
    featured: DataFrame, anchors: DataFrame, anchor: str, mode: str = QUARANTINE
) -> DataFrame:
    others = featured.filter(F.col(_CONDITION) != anchor).select(
        "stimulus_id", _UNIT, _CONDITION, "duration_seconds"
    )
    return M.duration_caliper(others, anchors, _UNIT, mode=mode)


def unit_acceptance(
    audit: DataFrame, cells: DataFrame, dialogue: DataFrame, anchor: str = TRADITIONAL
) -> DataFrame:
    """One acceptance row per unit from the audit, the condition cells and the dialogues."""
    return acceptance(
        _UNIT,
        audit.groupBy(_UNIT).agg(F.bool_and("ok").alias("answers_ok")),
        matching_gates(cells, _UNIT, _CONDITION, anchor),
        dialogue_gates(dialogue, _UNIT),
    )


def run_slice(
    spark: SparkSession,
    units_path: str,
    stimuli_path: str | list[str],
    out: str,
    anchor: str = TRADITIONAL,
    one_unit_per_file: bool = True,
) -> None:
    """The whole acceptance run: every section as a parquet table below ``out``.

    Features and dialogues are written first and read back, so that each text is
    measured once and its turns are read once.
    """
    units = read_units(spark, units_path, one_unit_per_file)
    stimuli = load_stimuli(spark, stimuli_path)

    def save(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    featured = save("features", measure(stimuli))
    tables = report_tables(units, stimuli, featured, anchor)
    anchors = M.anchors_of(featured, ["duration_seconds"], _UNIT, _CONDITION, anchor)
    tables["duration_caliper"] = _calipers(featured, lookup_side(anchors, "anchors"), anchor)
    audit = save("validator_results", tables["validator_results"])
    dialogue = save("dialogue", tables["dialogue"])
    for name in ("anchor_deltas", "duration_caliper", "smd", "readability"):
        save(name, tables[name])
    cells = M.condition_cells(featured, ["duration_seconds", "fk_grade"], _UNIT, _CONDITION)
    save("acceptance", unit_acceptance(audit, cells, dialogue, anchor))


def matching_gates(cells: DataFrame, unit: str, condition: str, anchor: str) -> DataFrame:
    """Caliper gate and readability flag per unit, in one pass over its condition cells."""
    near = Window.partitionBy(unit)
    is_anchor = F.col(condition) == anchor
    goal = F.max(F.when(is_anchor, F.col("duration_seconds"))).over(near)
    _, passed, _ = M.caliper(F.col("goal"), F.col("duration_seconds"), M.CALIPER_TOLERANCE)
    fits = F.coalesce(passed, F.lit(False)) | is_anchor
    spread = F.max("fk_grade") - F.min("fk_grade")
    return (
        cells.withColumn("goal", goal)
        .groupBy(unit)
        .agg(
            F.bool_and(fits).alias("caliper_ok"),
            (spread > F.lit(M.READABILITY_SPREAD)).alias("readability_flagged"),
        )
    )


def dialogue_gates(dialogue: DataFrame, unit: str) -> DataFrame:
    """No scaffolded leak, and every reveal policy kept, per unit."""
    leak = (F.col("condition") == SCAFFOLDING) & F.coalesce("leaked", F.lit(False))
    return dialogue.groupBy(unit).agg(
        (~F.bool_or(leak)).alias("no_leak"),
        F.bool_and(F.coalesce("policy_ok", F.lit(True))).alias("policy_ok"),
    )


def acceptance(unit: str, answers: DataFrame, matching: DataFrame, dialogue: DataFrame) -> DataFrame:
    """One row per unit from sides that hold one row per unit each.

    A readability flag is reported but rejects nothing.
    """
    out = answers.join(matching, unit, "left").join(dialogue, unit, "left")
    accepted = F.lit(True)
    for gate in ("answers_ok", "caliper_ok", "no_leak", "policy_ok"):
        accepted = accepted & F.coalesce(F.col(gate), F.lit(False))
    return out.withColumn("accepted", accepted)
