"""The registered queries: one callable per operator, over whole tables.

Each takes ``(spark, sf_dir)`` and returns a DataFrame; a few first compute a small
side, the missing keys or the stream's output in the shared folder. Sums are rounded
where the order of addition may differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import turns as TU
from lectern.functions.numeric import numeric_close
from lectern.operators import accumulation as A
from lectern.operators import dialogue as D
from lectern.operators import matching as M
from lectern.operators import segments
from lectern.operators import validators as V
from lectern.operators import vectors
from lectern.operators.audit import REFERENCE_THRESHOLD, audit_units, correctness_gate
from lectern.plans import inputs as I
from lectern.plans import report as R
from lectern.plans.report import acceptance, dialogue_gates
from lectern.session import few_splits, lookup_side, save_once, scratch_path
from lectern.sources.front_matter import coerce, with_front_matter, with_known_keys
from lectern.sources.sinks import skip_existing
from lectern.sources.stimuli import fk_violations, key_violations, stimuli_index
from lectern.sources.units import parse_units, units_index
from lectern.streaming.ingest import run_available, run_missing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

UNIT, CONDITION, ANCHOR = I.UNIT, I.CONDITION, I.ANCHOR
VECTOR = ("words", "sentences", "lexical_diversity")


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def _r(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def _featured_output(df: DataFrame) -> DataFrame:
    exact = [c for c in X.FEATURES if c not in ("fk_grade", "lexical_diversity", "duration_seconds")]
    return df.select(
        "doc_id", UNIT, CONDITION, *exact, "syllables",
        _r("fk_grade"), _r("lexical_diversity"), _r("duration_seconds"), "error",
    )


def _cells(spark: SparkSession, sf: str, features=X.FEATURES) -> DataFrame:
    return M.condition_cells(I.featured(spark, sf), features, UNIT, CONDITION)


# ---------------------------------------------------------------- text


@query("text_features")
def text_features(spark, sf):
    return _featured_output(I.featured(spark, sf))


@query("syllable_totals")
def syllable_totals(spark, sf):
    return I.documents(spark, sf).select("doc_id", X.syllable_count(F.col("text")).alias("syllables"))


@query("word_tokens")
def word_tokens(spark, sf):
    words = X.words_list(F.col("text"))
    return I.documents(spark, sf).select("doc_id", F.array_join(words, " ").alias("tokens"))


@query("word_onsets")
def word_onsets(spark, sf):
    rows = X.explode_word_onsets(I.documents(spark, sf).select("doc_id", "text"))
    return rows.select("doc_id", F.col("word_idx").cast("long").alias("word_idx"), "word", _r("onset_s"))


@query("number_normalize")
def number_normalize(spark, sf):
    spiked = F.replace(F.col("text"), F.lit(". "), F.lit(" 1,2,3 4\t5, 6  7. "))
    clean = X.normalize_numbers(spiked)
    return I.documents(spark, sf).select(
        "doc_id", F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("digest")
    )


@query("word_band_gate")
def word_band_gate(spark, sf):
    body = F.col("text")
    return I.documents(spark, sf).select(
        "doc_id", X.whitespace_words(body).alias("n_words"), X.in_word_band(body).alias("in_band")
    )


# ---------------------------------------------------------------- matching


@query("anchor_deltas")
def anchor_deltas(spark, sf):
    out = M.anchor_deltas(_cells(spark, sf), X.FEATURES, UNIT, CONDITION, ANCHOR)
    return out.withColumn("delta", F.round("delta", 6))


@query("duration_caliper")
def duration_caliper(spark, sf):
    """Texts are measured once; anchors and others are two views of the written numbers."""
    seconds = X.duration_seconds(F.col("text")).alias("duration_seconds")
    timed = save_once(I.documents(spark, sf).select("doc_id", UNIT, CONDITION, seconds), "timed")
    anchors = lookup_side(
        M.anchors_of(timed, ["duration_seconds"], UNIT, CONDITION, ANCHOR), "anchors"
    )
    others = timed.filter(F.col(CONDITION) != ANCHOR)
    out = M.duration_caliper(others, anchors, UNIT)
    return out.select(
        "doc_id", UNIT, CONDITION, _r("relative_difference"), "tolerance", "passed", "error"
    )


@query("readability_spread")
def readability_spread(spark, sf):
    out = M.readability_spread(_cells(spark, sf, ["fk_grade"]), UNIT, CONDITION)
    return out.select(
        UNIT, F.size("grades").cast("long").alias("n_conditions"), _r("spread"), "flagged"
    )


@query("smd_by_feature")
def smd_by_feature(spark, sf):
    out = M.standardized_mean_differences(_cells(spark, sf), X.FEATURES, CONDITION, ANCHOR)
    return out.withColumn("smd", F.round("smd", 6))


@query("smd_gate")
def smd_gate(spark, sf):
    smds = M.standardized_mean_differences(_cells(spark, sf), X.FEATURES, CONDITION, ANCHOR)
    return M.smd_gate(smds, CONDITION).withColumn("max_abs_smd", F.round("max_abs_smd", 6))


@query("smd_min_units_guard")
def smd_min_units_guard(spark, sf):
    """Documents as units and sources as conditions: small sources are refused."""
    out = M.standardized_mean_differences(
        I.featured(spark, sf), ["words", "fk_grade"], UNIT, "src0", min_units=50
    )
    return out.withColumn("smd", F.round("smd", 6))


@query("feature_covariance")
def feature_covariance(spark, sf):
    out = M.feature_covariance(I.featured(spark, sf), [*VECTOR, "fk_grade"])
    return out.withColumn("covariance", F.round("covariance", 4))


@query("mahalanobis_to_anchor")
def mahalanobis_to_anchor(spark, sf):
    out = M.mahalanobis_to_anchor(_cells(spark, sf, VECTOR), VECTOR, UNIT, CONDITION, ANCHOR)
    return out.withColumn("distance", F.round("distance", 6))


# ---------------------------------------------------------------- answers


def _line_validator(name: str, extra: dict[str, str]) -> Query:
    def run(spark, sf):
        params = {p: F.expr(extra.get(p, p)) for p in V.get(name).params}
        expected, error = V.evaluate(name, **params)
        return I.priced_lines(spark, sf).select(
            "l_orderkey", "l_linenumber", expected.alias("expected"), error.alias("error")
        )

    return run


for _key, _name, _extra in (
    ("break_even_quantity", "break_even_quantity", {}),
    ("break_even_revenue", "break_even_revenue", {}),
    ("target_profit_quantity", "target_profit_quantity", {"target_profit": "fixed_costs * 0.5D"}),
    ("price_for_break_even", "price_for_break_even_quantity", {"quantity": "l_quantity - 1D"}),
    ("contribution_margin_ratio", "contribution_margin_ratio", {}),
):
    QUERIES[_key] = _line_validator(_name, _extra)


@query("margin_guard_violations")
def margin_guard_violations(spark, sf):
    lines = I.priced_lines(spark, sf)
    ok = V.margin_is_positive(F.col("price"), F.col("variable_cost"))
    return lines.filter(~ok).select("l_orderkey", "l_linenumber", "price", "variable_cost")


@query("numeric_close")
def numeric_closeness(spark, sf):
    close = numeric_close(F.col("price"), F.col("variable_cost"), 0.05)
    return I.priced_lines(spark, sf).select("l_orderkey", "l_linenumber", close.alias("close"))


@query("validator_dispatch")
def validator_dispatch(spark, sf):
    expected, error = V.dispatch(F.col("validator"), F.col("params"))
    return I.part_problems(spark, sf).select(
        "p_partkey", "validator", expected.alias("expected"), error.alias("error")
    )


@query("answer_check")
def answer_check(spark, sf):
    out = V.check_answers(I.part_problems(spark, sf))
    return out.select("p_partkey", "validator", "answer", "expected", "passed", "error")


@query("authored_answers")
def authored_answers(spark, sf):
    """Numbers and formulas as text, in one table; every outcome occurs."""
    out = V.check_authored_answers(I.part_authored_answers(spark, sf))
    return out.select("p_partkey", "validator", "passed", "error")


@query("authored_unit_answers")
def authored_unit_answers(spark, sf):
    """Answers of units as numbers and as their authors wrote them."""
    units = parse_units(I.part_authored_units(spark, sf), "json", authored=True)
    return units.select("unit_id", "canonical_problem.answer", "canonical_problem.answer_text")


@query("feature_map_deltas")
def feature_map_deltas(spark, sf):
    out = M.feature_map_deltas(I.document_feature_maps(spark, sf), "features", "unit", "lang", "en")
    return out.withColumn("delta", F.round("delta", 6) + 0.0)


def _part_units(spark: SparkSession, sf: str) -> DataFrame:
    return parse_units(I.part_unit_json(spark, sf), "json")


@query("unit_answer_audit")
def unit_answer_audit(spark, sf):
    return audit_units(_part_units(spark, sf)).select(
        "unit_id", "problem", "validator", "answer", "expected", "passed", "error", "ok"
    )


@query("correctness_gate")
def correctness_gates(spark, sf):
    out = correctness_gate(
        audit_units(_part_units(spark, sf)), "problem", {"canonical_problem": REFERENCE_THRESHOLD}
    )
    return out.withColumn("share", F.round("share", 6))


@query("formula_equivalence")
def formula_equivalence(spark, sf):
    points = I.priced_lines(spark, sf).select(
        F.col("price").alias("P"), F.col("variable_cost").alias("V"), F.col("fixed_costs").alias("F")
    )
    return V.formula_equivalence(
        points,
        {
            "margin": (V.formula("contribution_margin_expr"), "-(V - P)"),
            "ratio": ("(P - V) / P", "1 - V / P"),
            "quantity": ("F / nullif(P - V, 0)", "F / P"),
            "partial": ("CASE WHEN P > 1000 THEN P - V END", "P - V"),
        },
    )


# ---------------------------------------------------------------- sources


@query("units_scan")
def units_scan(spark, sf):
    u = _part_units(spark, sf)
    return u.select(
        "unit_id", "domain", "concept", "difficulty",
        F.size("prerequisites").cast("long").alias("n_prerequisites"),
        F.col("canonical_problem.answer").alias("reference_answer"),
        F.col("common_misconception.wrong_answer").alias("wrong_answer"),
        F.col("practice_problem.params")["fixed_costs"].alias("practice_fixed_costs"),
        F.col("near_transfer.params")["target_profit"].alias("target_profit"),
        F.col("far_transfer.validator").alias("far_validator"),
    )


@query("units_index")
def units_indexed(spark, sf):
    def param(column: str, name: str) -> Column:
        return F.get_json_object(column, f"$.{name}").cast("double")

    out = units_index(_part_units(spark, sf))
    return out.select(
        "unit_id", "domain", "concept", "difficulty", "prerequisites", "validator_reference",
        param("validator_reference_params", "fixed_costs").alias("reference_fixed_costs"),
        param("validator_reference_params", "variable_cost").alias("reference_variable_cost"),
        "reference_answer", "validator_transfer",
        param("validator_transfer_params", "quantity").alias("transfer_quantity"),
        "transfer_answer",
    )


@query("front_matter_scan")
def front_matter_scan(spark, sf):
    out = with_known_keys(with_front_matter(I.fronted_documents(spark, sf)))
    return out.select(
        "doc_id", "error", "stimulus_id", "unit_id", "condition", "variant", "example_count",
        "learner_error_scripted",
        F.length("body").cast("long").alias("body_chars"), F.md5("body").alias("body_digest"),
    )


@query("front_matter_coerce")
def front_matter_coerce(spark, sf):
    out = I.raw_values(spark, sf).select("doc_id", coerce(F.col("value")).alias("c"))
    return out.select("doc_id", "c.*")


def _indexed(spark: SparkSession, sf: str) -> DataFrame:
    texts = I.featured(spark, sf)
    return stimuli_index(
        texts.select(
            F.concat_ws("_", UNIT, CONDITION, "doc_id").alias("stimulus_id"),
            F.col(UNIT).alias("unit_id"),
            I.condition_name().alias("condition"),
            F.concat(F.lit("stimuli/"), F.col("doc_id")).alias("path"),
            F.when(F.col("doc_id") % 3 == 0, "primary").otherwise(
                F.concat(F.lit("robustness_"), F.col("doc_id") % 3)
            ).alias("variant"),
            *X.FEATURES,
        )
    )


@query("stimuli_index")
def stimuli_indexed(spark, sf):
    return _indexed(spark, sf).withColumns(
        {"duration": F.round("duration", 6), "readability": F.round("readability", 6)}
    )


@query("key_violations")
def key_violations_found(spark, sf):
    return key_violations(_indexed(spark, sf))


@query("fk_violations")
def fk_violations_found(spark, sf):
    used = I.table(spark, sf, "documents").select("doc_id")
    return fk_violations(used, I.table(spark, sf, "labels"), "doc_id")


@query("segment_onsets")
def segment_onsets(spark, sf):
    """Words before and in every segment of every document, and when the first of them starts."""
    placed = segments.with_word_offsets(I.document_segments(spark, sf), "doc_id", ["seq"])
    onset = F.lit(60.0) * F.col("words_before").cast("double") / F.lit(X.WORDS_PER_MINUTE)
    return placed.select(
        "doc_id", "seq", "words_before", "n_words",
        F.when(F.col("n_words") > 0, F.round(onset, 6)).alias("onset_s"),
    )


@query("incremental_anti_load")
def incremental_anti_load(spark, sf):
    """Features of the documents that are not among the labelled ones."""
    new = skip_existing(I.documents(spark, sf), I.table(spark, sf, "labels"), "doc_id")
    return _featured_output(X.with_text_features(new, "text", F.lit(1)))


@query("stream_features")
def stream_features(spark, sf):
    """The documents through the streaming job, read back from its sink."""
    batch = I.table(spark, sf, "documents")
    # A pattern that only this name meets: a stream reads folders and patterns, no files.
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/[d]ocuments.parquet")
    texts = stream.select("doc_id", "text", UNIT, CONDITION)
    n = few_splits(batch)
    texts = texts.repartition(n) if n else texts
    out = scratch_path(spark, "stream-features")
    run_available(X.with_text_features(texts, "text", F.lit(1)), f"{out}/table", f"{out}/checkpoint")
    return _featured_output(spark.read.parquet(f"{out}/table"))


@query("stream_distinct_texts")
def stream_distinct_texts(spark, sf):
    """The documents as an inbox: what comes again under another id adds nothing to the sink."""
    batch = I.table(spark, sf, "documents")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/[d]ocuments.parquet")
    texts = stream.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))
    out = scratch_path(spark, "stream-distinct")
    # The second run meets the same files with an empty checkpoint, as after a lost one.
    for run in ("first", "again"):
        run_missing(texts, f"{out}/table", f"{out}/checkpoint-{run}", "digest", ["doc_id"], run_id=run)
    return spark.read.parquet(f"{out}/table").select("digest", "doc_id", "n_chars")


# ---------------------------------------------------------------- dialogues


def _read_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    read = TU.with_attempt(I.transcripts(spark, sf), "body", keep_turns=True)
    read = read.withColumn("labels", TU.tutor_labels(F.col("turns"))).drop("turns")
    return TU.with_leakage(read, "final_answer")


@query("split_turns")
def split_turns(spark, sf):
    turns = I.transcripts(spark, sf).select("doc_id", TU.split_turns(F.col("body")).alias("turns"))
    return D.explode_turns(turns).select(
        "doc_id", "pos", "speaker",
        F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"),
    )


@query("leakage_check")
def leakage_check(spark, sf):
    read = TU.with_attempt(I.transcripts(spark, sf), "body")
    out = TU.with_leakage(read, "final_answer")
    return out.select("doc_id", "leaked", "first_attempt_turn_index", "error")


@query("turn_label_sequence")
def turn_label_sequence(spark, sf):
    labels = TU.tutor_labels(TU.split_turns(F.col("body")))
    return I.transcripts(spark, sf).select("doc_id", F.array_join(labels, ",").alias("labels"))


@query("turn_policy_gate")
def turn_policy_gate(spark, sf):
    out = _read_transcripts(spark, sf)
    ok = TU.follows_policy(F.col("condition"), F.col("labels"), F.col("leaked"))
    return out.select("doc_id", "condition", ok.alias("policy_ok"))


@query("first_attempt")
def first_attempt(spark, sf):
    return D.first_attempts(I.conversation_turns(spark, sf), "conv_id")


@query("leakage_turn_table")
def leakage_turn_table(spark, sf):
    return D.turn_leakage(I.conversation_turns(spark, sf), "conv_id", "final_answer")


@query("turn_labels")
def turn_labels(spark, sf):
    return D.label_turns(I.conversation_turns(spark, sf)).select("conv_id", "pos", "label")


@query("turn_label_counts")
def turn_label_counts(spark, sf):
    return D.label_counts(D.label_turns(I.conversation_turns(spark, sf)), "condition")


# ---------------------------------------------------------------- report


@query("acceptance_summary")
def acceptance_summary(spark, sf):
    """Every part is a unit whose problem must validate and whose text is the document
    of the same number, measured against its source's anchor."""
    parts = V.check_answers(I.part_problems(spark, sf)).select(
        F.col("p_partkey").alias("doc_id"), F.coalesce("passed", F.lit(False)).alias("answers_ok")
    )
    numbers = I.featured(spark, sf).select("doc_id", UNIT, CONDITION, "duration_seconds", "fk_grade")
    texts = save_once(numbers, "measured")
    anchors = lookup_side(
        M.anchors_of(texts, ["duration_seconds", "fk_grade"], UNIT, CONDITION, ANCHOR), "anchors"
    )
    others = texts.filter(F.col(CONDITION) != ANCHOR).join(anchors, UNIT, "left")
    _, passed, _ = M.caliper(
        F.col("anchor_duration_seconds"), F.col("duration_seconds"), M.CALIPER_TOLERANCE
    )
    gap = F.abs(F.col("fk_grade") - F.col("anchor_fk_grade"))
    measured = others.select(
        "doc_id",
        F.coalesce(passed, F.lit(False)).alias("caliper_ok"),
        (gap > M.READABILITY_SPREAD).alias("readability_flagged"),
    )
    talks = _read_transcripts(spark, sf).filter(F.col("condition") != TU.TRADITIONAL)
    policy = TU.follows_policy(F.col("condition"), F.col("labels"), F.col("leaked"))
    gates = dialogue_gates(talks.withColumn("policy_ok", policy), "doc_id")
    return acceptance("doc_id", parts, measured, gates)


@query("dialogue_answers")
def dialogue_answers(spark, sf):
    """Every dialogue against its unit's canonical answer."""
    checked = R.dialogue_checks(I.unit_stimuli(spark, sf), I.dialogue_units(spark, sf))
    return checked.select(
        "stimulus_id", "unit_id", "condition", "final_answer", "leaked", "policy_ok", "error"
    )


@query("unit_acceptance")
def unit_acceptance(spark, sf):
    """One acceptance row per unit: answers, caliper, readability spread and dialogues."""
    units, stimuli = I.dialogue_units(spark, sf), I.unit_stimuli(spark, sf)
    checked = V.check_answers(units.select("unit_id", "canonical_problem.*"))
    audit = checked.select("unit_id", F.coalesce("passed", F.lit(False)).alias("ok"))
    texts = stimuli.select("unit_id", "condition", "text")
    featured = X.with_text_features(texts, "text", F.lit(1))
    cells = M.condition_cells(featured, ["duration_seconds", "fk_grade"], "unit_id", "condition")
    cells = save_once(cells, "cells")
    return R.unit_acceptance(audit, cells, R.dialogue_checks(stimuli, units))


# ---------------------------------------------------------------- matrices and series


@query("parcel_means")
def parcel_means(spark, sf):
    matrix = I.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("values"))
    width = matrix.agg(F.max(F.size("values")).alias("n"))
    vertices = width.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("vertex"))
    atlas = vertices.withColumn("parcel", F.col("vertex").cast("long") % 8)
    out = A.parcel_means(matrix, atlas, ["vec_id"]).drop("error")
    return out.withColumn("mean_value", F.round("mean_value", 6))


@query("vector_covariance")
def vector_covariance(spark, sf):
    out = vectors.vector_covariance(I.table(spark, sf, "embeddings"), "embedding", I.VECTOR_WIDTH)
    # Adding zero turns a rounded -0.0 into 0.0.
    return out.withColumn("covariance", F.round("covariance", 8) + 0.0)


@query("vector_mahalanobis")
def vector_mahalanobis(spark, sf):
    """Every vector of the other labels from the mean vector of label 0."""
    out = vectors.mahalanobis_to_mean(
        I.table(spark, sf, "embeddings"), "embedding", F.col("label") == 0, I.VECTOR_WIDTH
    )
    return out.select("vec_id", "label", F.round("distance", 6).alias("distance"), "error")


@query("decayed_totals")
def decayed_totals(spark, sf):
    gain = F.col("value") * F.length("event_type").cast("double")
    out = A.decayed_total(
        I.table(spark, sf, "events"), "user_id", ["ts", "event_id"], gain,
        delta=0.1, eta=0.5, start=1.0,
    )
    return out.withColumn("state", F.round("state", 6))


@query("decayed_trajectories")
def decayed_trajectories(spark, sf):
    """State of every user after every event; the gain's factor is looked up per user group."""
    first = F.get("embedding", F.lit(0)).cast("double")
    factors = I.table(spark, sf, "embeddings").groupBy("label").agg(F.avg(first).alias("factor"))
    events = I.table(spark, sf, "events").withColumn("label", (F.col("user_id") % 10).cast("int"))
    gains = A.with_lookup_gain(events, factors, "label", "value", "factor")
    out = A.decayed_trajectory(gains, "user_id", ["ts", "event_id"], "gain", delta=0.1, eta=0.5, start=1.0)
    return out.withColumn("state", F.round("state", 6) + 0.0)


@query("scenario_contrasts")
def scenario_contrasts(spark, sf):
    events = I.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    out = A.scenario_contrasts(events, ["value", "k"], "event_type", "click", M.MIN_UNITS)
    return out.withColumn("smd", F.round("smd", 6))
