"""Knowledge-unit files: nested schema, scan, flat index and problem rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.errors import QUARANTINE, enforce

_PARAMS = T.MapType(T.StringType(), T.DoubleType())


def _problem(prompt: bool = True, answer: T.DataType = T.DoubleType()) -> T.StructType:
    head = [T.StructField("prompt", T.StringType())] if prompt else []
    return T.StructType(
        head
        + [
            T.StructField("validator", T.StringType()),
            T.StructField("params", _PARAMS),
            T.StructField("answer", answer),
        ]
    )


def _unit_schema(answer: T.DataType) -> T.StructType:
    # The fields of a unit file.
    fields = [
        T.StructField("unit_id", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("concept", T.StringType()),
        T.StructField("difficulty", T.IntegerType()),
        T.StructField("prerequisites", T.ArrayType(T.StringType())),
        T.StructField("canonical_problem", _problem(answer=answer)),
        T.StructField(
            "common_misconception",
            T.StructType(
                [
                    T.StructField("description", T.StringType()),
                    T.StructField("wrong_answer", answer),
                    T.StructField("wrong_method", T.StringType()),
                ]
            ),
        ),
        T.StructField("practice_problem", _problem(prompt=False, answer=answer)),
        T.StructField("near_transfer", _problem(answer=answer)),
        T.StructField("far_transfer", _problem(answer=answer)),
    ]
    return T.StructType(fields)


UNIT_SCHEMA = _unit_schema(T.DoubleType())
# The same with answers as the text that the author wrote.
AUTHORED_SCHEMA = _unit_schema(T.StringType())

# The problems whose stated answer must validate.
PROBLEMS = ("canonical_problem", "practice_problem", "near_transfer", "far_transfer")
MISCONCEPTION = "misconception_correctly_fails"


_CORRUPT = "_corrupt_record"


def read_units(
    spark: SparkSession,
    path: str | list[str],
    one_per_file: bool = True,
    mode: str = QUARANTINE,
    authored: bool = False,
) -> DataFrame:
    """Unit objects, one per file or (for large collections) one per line.

    With ``authored`` every answer also keeps its text, see :func:`with_authored_answers`.
    Adds ``error``: an object that is not JSON is a row of NULLs, and one with a
    field of the wrong type has that field NULL, both with a code.
    """
    fields = (AUTHORED_SCHEMA if authored else UNIT_SCHEMA).fields
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    read = spark.read.schema(schema).option("columnNameOfCorruptRecord", _CORRUPT)
    units = read.json(path, multiLine=one_per_file)
    bad = F.col(_CORRUPT).isNotNull()
    error = F.when(bad & F.col("unit_id").isNull(), "malformed_json").when(bad, "bad_field")
    units = units.withColumn("error", error).drop(_CORRUPT)
    return enforce(with_authored_answers(units) if authored else units, mode)


def parse_units(df: DataFrame, json_text: str, authored: bool = False) -> DataFrame:
    """Unit objects held as JSON text in a column."""
    schema = AUTHORED_SCHEMA if authored else UNIT_SCHEMA
    units = df.select(F.from_json(json_text, schema).alias("u")).select("u.*")
    return with_authored_answers(units) if authored else units


def with_authored_answers(units: DataFrame) -> DataFrame:
    """Units read with answers as text: ``answer_text`` beside the number in ``answer``.

    A whole number of any length and a point with a zero after it stay as they were
    written. An answer that is no number, such as a formula, has a null number.
    """
    places = [(p, "answer") for p in PROBLEMS] + [("common_misconception", "wrong_answer")]
    return units.withColumns(
        {
            p: F.col(p)
            .withField(f"{field}_text", F.col(f"{p}.{field}"))
            .withField(field, F.col(f"{p}.{field}").try_cast("double"))
            for p, field in places
        }
    )


def units_index(units: DataFrame) -> DataFrame:
    """Flat index: reference problem, far-transfer problem, params as JSON text."""
    return units.select(
        "unit_id",
        "domain",
        "concept",
        "difficulty",
        F.array_join("prerequisites", ";").alias("prerequisites"),
        F.col("canonical_problem.validator").alias("validator_reference"),
        F.to_json("canonical_problem.params").alias("validator_reference_params"),
        F.col("canonical_problem.answer").alias("reference_answer"),
        F.col("far_transfer.validator").alias("validator_transfer"),
        F.to_json("far_transfer.params").alias("validator_transfer_params"),
        F.col("far_transfer.answer").alias("transfer_answer"),
    )


def write_units_index(units: DataFrame, path: str) -> None:
    """The index as CSV with a header, quotes inside a value doubled; replaces the target."""
    units_index(units).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _row(name: str, problem: str, answer: Column, expect_pass: bool) -> Column:
    return F.struct(
        F.lit(name).alias("problem"),
        F.col(f"{problem}.validator").alias("validator"),
        F.col(f"{problem}.params").alias("params"),
        answer.alias("answer"),
        F.lit(expect_pass).alias("expect_pass"),
    )


def problem_rows(units: DataFrame) -> DataFrame:
    """Five rows per unit: the four problems, and the misconception's wrong answer
    put to the canonical problem, where it must fail."""
    rows = [_row(p, p, F.col(f"{p}.answer"), True) for p in PROBLEMS]
    wrong = F.col("common_misconception.wrong_answer")
    rows.append(_row(MISCONCEPTION, "canonical_problem", wrong, False))
    return units.select("unit_id", F.explode(F.array(*rows)).alias("r")).select("unit_id", "r.*")
