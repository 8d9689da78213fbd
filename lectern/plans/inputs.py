"""Inputs of the registered queries, derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import with_text_features
from lectern.functions.turns import (
    LEARNER,
    SCAFFOLDING,
    SUBSTITUTION,
    TRADITIONAL,
    TUTOR,
)
from lectern.session import spread

UNIT = "source"
CONDITION = "lang"
ANCHOR = "en"
# Documents in a row that make up one unit of the acceptance run.
UNIT_DOCUMENTS = 8
# Positions of an embedding, as its table declares.
VECTOR_WIDTH = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as texts of a unit (source) in a condition (language)."""
    return spread(table(spark, sf, "documents").select("doc_id", "text", UNIT, CONDITION))


def featured(spark: SparkSession, sf: str) -> DataFrame:
    return with_text_features(documents(spark, sf), "text", F.lit(1))


# ---------------------------------------------------------------- answers


def priced_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with a price, the part's cost and the order's fixed costs."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_quantity",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    parts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("variable_cost")
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("fixed_costs")
    )
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey")


def _part_params() -> dict[str, Column]:
    size = F.col("p_size").cast("double")
    base = F.col("p_retailprice") * 100.0
    return {
        "fixed_costs": F.when(F.col("p_partkey") % 13 == 0, -base).otherwise(base),
        "target_profit": F.col("p_retailprice") * 10.0,
        "price": F.col("p_retailprice"),
        "variable_cost": size * 20.0,
        "quantity": size - 1.0,
    }


def _params(*names: str) -> Column:
    values = _part_params()
    return F.create_map(*[x for n in names for x in (F.lit(n), values[n])])


def _stated() -> dict[str, Column]:
    """What an author would state, NULL where the formula has no value."""
    p = _part_params()
    margin = F.nullif(p["price"] - p["variable_cost"], F.lit(0.0))
    quantity = F.nullif(p["quantity"], F.lit(0.0))
    return {
        "break_even_quantity": p["fixed_costs"] / margin,
        "break_even_revenue": p["fixed_costs"] / margin * p["price"],
        "target_profit_quantity": (p["fixed_costs"] + p["target_profit"]) / margin,
        "price_for_break_even_quantity": p["fixed_costs"] / quantity + p["variable_cost"],
        "contribution_margin_ratio": (p["price"] - p["variable_cost"]) / p["price"],
    }


def _slip() -> Column:
    """Every seventh part states a wrong answer."""
    return F.when(F.col("p_partkey") % 7 == 0, 1.0).otherwise(0.0)


_COSTS = ("fixed_costs", "price", "variable_cost")
_ASKED = (
    ("break_even_quantity", _COSTS),
    ("break_even_revenue", _COSTS),
    ("target_profit_quantity", (*_COSTS, "target_profit")),
    ("price_for_break_even_quantity", ("fixed_costs", "quantity", "variable_cost")),
    ("contribution_margin_ratio", ("price", "variable_cost")),
)


def part_problems(spark: SparkSession, sf: str) -> DataFrame:
    """One answered problem per part; every sixth names a validator nobody knows."""
    name, params, answer = F.lit("no_such_validator"), _params("price"), F.lit(0.0)
    for i, (validator, asked) in enumerate(_ASKED):
        here = F.col("p_partkey") % 6 == i
        name = F.when(here, validator).otherwise(name)
        params = F.when(here, _params(*asked)).otherwise(params)
        answer = F.when(here, _stated()[validator]).otherwise(answer)
    return spread(table(spark, sf, "part")).select(
        "p_partkey",
        name.alias("validator"),
        params.alias("params"),
        (answer + _slip()).alias("answer"),
    )


# Answers to the contribution margin formula, as authors write it.
AUTHORED_FORMULAS = (
    "P - V", "-(V - P)", "(P*P - V*V) / (P + V)", "P + V", "P - 2*V + V/1.0", "P - (V", "P - W", "x - y",
)


def part_authored_answers(spark: SparkSession, sf: str) -> DataFrame:
    """One answer per part as text: a ratio for even keys, a formula for odd ones."""
    price, cost = F.col("p_retailprice"), F.col("p_size").cast("double") * 20.0
    numeric = F.col("p_partkey") % 2 == 0
    variant = F.floor(F.col("p_partkey") / 2) % len(AUTHORED_FORMULAS)
    own_symbols = F.create_map(F.lit("price"), F.lit("x"), F.lit("variable_cost"), F.lit("y"))
    usual = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    numbers = F.create_map(F.lit("price"), price.cast("string"), F.lit("variable_cost"), cost.cast("string"))
    written = F.element_at(F.array(*[F.lit(x) for x in AUTHORED_FORMULAS]), (variant + 1).cast("int"))
    return spread(table(spark, sf, "part")).select(
        "p_partkey",
        F.when(numeric, "contribution_margin_ratio").otherwise("contribution_margin_expr").alias("validator"),
        F.when(numeric, numbers).when(variant == 7, own_symbols).otherwise(usual).alias("params"),
        F.when(numeric, ((price - cost) / price + _slip()).cast("string")).otherwise(written).alias("answer"),
    )


def part_authored_units(spark: SparkSession, sf: str) -> DataFrame:
    """One unit file per part, with answers that a double or a rewriting would change."""
    key = F.col("p_partkey")
    answer = (
        F.when(key % 4 == 0, F.concat(key.cast("string"), F.lit(".0")))
        .when(key % 4 == 1, F.concat(F.lit("12345678901234"), F.lpad((key % 100000).cast("string"), 5, "0")))
        .when(key % 4 == 2, F.lit('"P - V"'))
        .otherwise(key.cast("string"))
    )
    text = F.concat(
        F.lit('{"unit_id": "part_'), key.cast("string"), F.lit('", "canonical_problem": {"answer": '), answer, F.lit("}}")
    )
    return spread(table(spark, sf, "part")).select(text.alias("json"))


def document_feature_maps(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON object of features per document; which keys it has depends on the document."""
    odd = F.col("doc_id") % 2 == 1
    features = F.struct(
        F.col("n_chars").alias("chars"),
        F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") / 2.0).alias("half"),
        F.when(odd, F.col("n_chars") > 1000).alias("long"),
        F.when(F.col("lang") != "en", F.lit(1.5)).alias("foreign"),
        F.col("lang").alias("lang"),
        F.lit("12").alias("code"),
    )
    unit = F.concat_ws("/", F.col("source"), (F.col("doc_id") % 7).cast("string"))
    return table(spark, sf, "documents").select(unit.alias("unit"), "lang", F.to_json(features).alias("features"))


def part_unit_json(spark: SparkSession, sf: str) -> DataFrame:
    """One unit per part, as the JSON text of a unit file."""

    def problem(validator: str, asked: tuple[str, ...], slip: bool, prompt: bool = True) -> Column:
        answer = _stated()[validator] + (_slip() if slip else F.lit(0.0))
        fields = [F.lit("How much?").alias("prompt")] if prompt else []
        return F.struct(
            *fields,
            F.lit(validator).alias("validator"),
            _params(*asked).alias("params"),
            answer.alias("answer"),
        )

    asked = dict(_ASKED)
    p = _part_params()
    unit = F.struct(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("unit_id"),
        F.col("p_type").alias("domain"),
        F.col("p_brand").alias("concept"),
        (F.col("p_partkey") % 5 + 1).cast("int").alias("difficulty"),
        F.split("p_name", " ").alias("prerequisites"),
        problem("break_even_quantity", asked["break_even_quantity"], slip=True).alias(
            "canonical_problem"
        ),
        F.struct(
            F.lit("ignores variable costs").alias("description"),
            (p["fixed_costs"] / p["price"]).alias("wrong_answer"),
            F.lit("fixed costs / price").alias("wrong_method"),
        ).alias("common_misconception"),
        problem("break_even_revenue", asked["break_even_revenue"], False, prompt=False).alias(
            "practice_problem"
        ),
        problem("target_profit_quantity", asked["target_profit_quantity"], False).alias(
            "near_transfer"
        ),
        problem(
            "price_for_break_even_quantity", asked["price_for_break_even_quantity"], slip=True
        ).alias("far_transfer"),
    )
    return spread(table(spark, sf, "part")).select(F.to_json(unit).alias("json"))


# ---------------------------------------------------------------- dialogues


def answer_of(key: str) -> Column:
    """The answer a dialogue is about, written plainly: 1000 to 1999."""
    return F.concat(F.lit("1"), _tail(key))


def _tail(key: str) -> Column:
    return F.lpad((F.col(key) % 1000).cast("string"), 3, "0")


def condition_name() -> Column:
    return (
        F.when(F.col(CONDITION) == ANCHOR, TRADITIONAL)
        .when(F.col(CONDITION) == "fr", SCAFFOLDING)
        .otherwise(SUBSTITUTION)
    )


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a transcript: lines take turns as tutor, learner and continuation.

    A fifth of them state the answer before the learner tries, a fifth split it
    over two tutor turns, and a fifth hold no attempt.
    """
    return documents(spark, sf).select(
        "doc_id",
        UNIT,
        condition_name().alias("condition"),
        answer_of("doc_id").alias("final_answer"),
        _dialogue("doc_id").alias("body"),
    )


def _dialogue(key: str) -> Column:
    """A document's text as a transcript about the answer of ``key``."""
    k = F.col("doc_id") % 5
    tail = _tail(key)

    def line(text: Column, i: Column) -> Column:
        tutor = F.concat(
            F.lit(f"{TUTOR}: "),
            F.when(i % 12 == 0, "Hint: ").otherwise(""),
            F.when((i == 4) & (k == 1), F.concat(tail, F.lit(" it is. "))).otherwise(""),
            F.when((i == 4) & (k == 0), F.concat(F.lit("It is 1,"), tail, F.lit(". "))).otherwise(""),
            text,
            F.when((i % 12 == 4) & (F.col("doc_id") % 2 == 0), "?").otherwise(""),
        )
        learner = F.concat(
            F.lit(f"{LEARNER}: "),
            text,
            F.when((i >= 6) & (k != 2), F.concat(F.lit(" I get 1,"), tail)).otherwise(""),
        )
        other = F.concat(text, F.when((i == 1) & (k == 1), " so 1").otherwise(""))
        return F.when(i % 4 == 0, tutor).when(i % 4 == 2, learner).otherwise(other)

    return F.array_join(F.transform(F.split("text", "\n"), line), "\n")


def unit_stimuli(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as stimuli of units: text, and its transcript about the unit's answer."""
    numbered = documents(spark, sf).withColumn("unit", F.floor(F.col("doc_id") / UNIT_DOCUMENTS))
    return numbered.select(
        F.col("doc_id").alias("stimulus_id"),
        _unit_id(F.col("unit")).alias("unit_id"),
        condition_name().alias("condition"),
        "text",
        _dialogue("unit").alias("body"),
    )


def _unit_id(number: Column) -> Column:
    return F.concat(F.lit("unit_"), number.cast("string"))


def dialogue_units(spark: SparkSession, sf: str) -> DataFrame:
    """One unit per part, whose canonical answer is whole; every seventh states a wrong one."""
    number = F.col("p_partkey") - 1
    goal = (number % 1000 + 1000).cast("double")
    cost = F.col("p_size").cast("double")
    quantity = cost + 10.0
    params = F.create_map(
        F.lit("fixed_costs"), (goal - cost) * quantity, F.lit("quantity"), quantity, F.lit("variable_cost"), cost
    )
    problem = F.struct(
        F.lit("price_for_break_even_quantity").alias("validator"),
        params.alias("params"),
        (goal + _slip()).alias("answer"),
    )
    parts = spread(table(spark, sf, "part"))
    return parts.select(_unit_id(number).alias("unit_id"), problem.alias("canonical_problem"))


def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with speakers, attempts, hints, questions and leaks.

    The given turns hold neither digits nor question marks, so these are added by
    turn and conversation number: the answer early in every fifth conversation,
    and split over two tutor turns in another fifth.
    """
    k = F.col("conv_id") % 5
    turn, tail = F.col("turn"), _tail("conv_id")
    speaker = F.when(F.col("role") == "user", LEARNER).when(F.col("role") == "assistant", TUTOR)
    learner = F.concat(
        F.col("text"),
        F.when((turn >= 4) & (k != 2), F.concat(F.lit(" I get 1,"), tail)).otherwise(""),
    )
    tutor = F.concat(
        F.when(turn % 3 == 1, "Hint: ").otherwise(""),
        F.when((k == 1) & (turn >= 2), F.concat(tail, F.lit(" it is. "))).otherwise(""),
        F.col("text"),
        F.when(turn % 3 == 0, "?").otherwise(""),
        F.when((k == 0) & (turn <= 2), F.concat(F.lit(" It is 1,"), tail)).otherwise(""),
        F.when((k == 1) & (turn <= 2), " so 1").otherwise(""),
    )
    turns = spread(table(spark, sf, "conversations"))
    return turns.select(
        "conv_id",
        F.col("turn").alias("pos"),
        speaker.alias("speaker"),
        F.when(speaker == LEARNER, learner).when(speaker == TUTOR, tutor).otherwise(F.col("text")).alias("text"),
        answer_of("conv_id").alias("final_answer"),
        F.when(F.col("conv_id") % 2 == 0, SCAFFOLDING).otherwise(SUBSTITUTION).alias("condition"),
    )


# ---------------------------------------------------------------- front matter


def fronted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents behind ten variants of front matter, good and broken."""
    doc = F.col("doc_id").cast("string")
    ids = F.concat(
        F.lit("stimulus_id: "), doc, F.lit("\nunit_id: "), F.col(UNIT),
        F.lit("\ncondition: "), F.col(CONDITION),
    )
    known = F.concat(ids, F.lit("\nvariant: primary\nexample_count: 1\nlearner_error_scripted: TRUE"))
    rest = F.concat(F.lit("\n"), F.col("text"))
    fence = F.lit("---\n")
    closed = F.concat(fence, known, F.lit("\n---"), rest)
    variants = [
        closed,
        F.col("text"),
        F.concat(fence, known, rest),
        F.concat(fence, ids, F.lit("\nno colon here\n---"), rest),
        F.concat(F.lit("---\n \n---"), rest),
        F.concat(fence, known, F.lit("\nvariant: robustness_1\nvariant: robustness_2\n---"), rest),
        F.replace(closed, F.lit("\n"), F.lit("\r\n")),
        F.concat(fence, known, F.lit("\nunit_id: a:b: c\n---"), rest),
        F.concat(F.lit(" --- \n"), known, F.lit("\n\t---  \n\n"), rest),
        F.concat(fence, F.lit("\n\n  example_count :  1_000  \n\n"), ids, F.lit("\n---"), rest),
    ]
    content = variants[0]
    for i, variant in enumerate(variants[1:], 1):
        content = F.when(F.col("doc_id") % 10 == i, variant).otherwise(content)
    return documents(spark, sf).select("doc_id", content.alias("content"))


def raw_values(spark: SparkSession, sf: str) -> DataFrame:
    """One front-matter value per document, of every kind."""
    doc = F.col("doc_id").cast("string")
    variants = [
        F.lit("TRUE"), F.lit("False"), doc, F.concat(F.lit("-"), doc),
        F.concat(F.lit("1_000_"), doc), F.concat(F.lit("9999999999999999999"), doc),
        F.col(UNIT), F.concat(doc, F.lit(".0")), F.lit(""), F.concat(F.lit("1__"), doc),
    ]
    value = variants[0]
    for i, variant in enumerate(variants[1:], 1):
        value = F.when(F.col("doc_id") % 10 == i, variant).otherwise(value)
    return table(spark, sf, "documents").select("doc_id", value.alias("value"))


SEGMENT_CHARS = 200


def document_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The documents cut into segments of 200 characters, wherever that falls."""
    docs = spread(table(spark, sf, "documents")).select("doc_id", "text")
    places = F.sequence(F.lit(0), F.ceil(F.length("text") / SEGMENT_CHARS).cast("int") - 1)
    cut = docs.filter(F.length("text") > 0).select("doc_id", "text", F.explode_outer(places).alias("seq"))
    return cut.select("doc_id", "seq", F.substring(F.col("text"), F.col("seq") * SEGMENT_CHARS + 1, F.lit(SEGMENT_CHARS)).alias("text"))
