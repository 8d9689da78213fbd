"""Dialogue turns and turn labels as Column expressions over one body text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.errors import QUARANTINE, enforce, first_error, guarded
from lectern.functions.text import normalize_numbers, strip

# The two speakers, the marker that opens a hint, the three labels.
TUTOR = "TUTOR"
LEARNER = "LEARNER"
HINT_MARKER = "hint:"
HINT = "hint"
GUIDING_QUESTION = "guiding_question"
ANSWER_REVEAL = "answer_reveal"
LABELS = (GUIDING_QUESTION, HINT, ANSWER_REVEAL)

# The three conditions and what the scaffolding policy asks for.
TRADITIONAL = "traditional"
SCAFFOLDING = "ai_scaffolding"
SUBSTITUTION = "ai_substitution"
MIN_QUESTIONS = 1
MIN_HINTS = 2

# (?d) keeps "\n" the only line end. Cutting in front of a marker needs no
# repeated group, so a turn of any number of lines is safe for the Java stack.
_CUT = f"(?dm)^(?=(?:{TUTOR}|{LEARNER}):)"
_OPENING = f"^({TUTOR}|{LEARNER}):"


def has_digit(text: Column) -> Column:
    return text.rlike("[0-9]")


def split_turns(body: Column) -> Column:
    """``array<struct<speaker,text>>`` in order; text before the first marker is dropped."""
    pieces = F.filter(F.split(body, _CUT), lambda p: p.rlike(_OPENING))
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.regexp_extract(p, _OPENING, 1).alias("speaker"),
            strip(F.regexp_replace(p, _OPENING, "")).alias("text"),
        ),
    )


def first_attempt_index(turns: Column) -> Column:
    """0-based position of the first learner turn with a digit, NULL if none."""
    tries = F.transform(turns, lambda t: (t.speaker == LEARNER) & has_digit(t.text))
    at = F.array_position(tries, F.lit(True))
    return F.when(at > 0, (at - 1).cast("long"))


def said_before(turns: Column, first_attempt: Column) -> Column:
    """Number-normalised tutor text preceding the first attempt.

    The texts are joined first and normalised afterwards, so digits of two
    neighbouring turns can fuse, as the check is defined.
    """
    tutor = F.filter(
        F.slice(turns, F.lit(1), first_attempt.cast("int")), lambda t: t.speaker == TUTOR
    )
    return normalize_numbers(F.array_join(F.transform(tutor, lambda t: t.text), " "))


def turn_label(text: Column) -> Column:
    opened = F.lower(strip(text)).startswith(HINT_MARKER)
    return (
        F.when(opened, HINT).when(text.contains("?"), GUIDING_QUESTION).when(
            text.isNotNull(), ANSWER_REVEAL
        )
    )


def tutor_labels(turns: Column) -> Column:
    """Labels of the tutor turns, in turn order."""
    said = F.filter(turns, lambda t: t.speaker == TUTOR)
    return F.transform(said, lambda t: turn_label(t.text))


def label_count(labels: Column, label: str) -> Column:
    return F.size(F.filter(labels, lambda x: x == label)).cast("long")


def with_attempt(df: DataFrame, body: str, keep_turns: bool = False) -> DataFrame:
    """Add ``first_attempt_turn_index``, the tutor text ``said`` before it, and ``error``.

    A narrow projection. The body is dropped: what follows, such as a join with
    the answers, moves only the text that can leak.
    """
    staged = df.withColumn("turns", split_turns(F.col(body))).drop(body)
    staged = staged.withColumn("first_attempt_turn_index", first_attempt_index(F.col("turns")))
    error = first_error(
        ("no_turns", F.coalesce(F.size("turns") == 0, F.lit(True))),
        ("no_attempt", F.col("first_attempt_turn_index").isNull()),
    )
    out = staged.withColumn("error", error).withColumn(
        "said", guarded(said_before(F.col("turns"), F.col("first_attempt_turn_index")), F.col("error"))
    )
    return out if keep_turns else out.drop("turns")


def with_leakage(df: DataFrame, answer: str, mode: str = QUARANTINE) -> DataFrame:
    """After :func:`with_attempt`: is the normalised answer inside ``said``?

    Adds ``leaked`` and ``detail`` and drops ``said``.
    """
    wanted = normalize_numbers(F.col(answer))
    error = F.coalesce(F.col("error"), F.when(wanted.isNull(), "null_answer"))
    staged = df.withColumn("error", error).withColumn(
        "leaked", guarded(F.col("said").contains(wanted), F.col("error"))
    )
    detail = F.concat(
        F.lit("final_answer='"),
        wanted,
        F.lit("' found_before_attempt="),
        F.when(F.col("leaked"), "True").otherwise("False"),
    )
    out = staged.withColumn("detail", guarded(detail, F.col("error"))).drop("said")
    return enforce(out, mode)


def follows_policy(condition: Column, labels: Column, leaked: Column) -> Column:
    """Does a dialogue keep to its condition's reveal policy?

    Substitution reveals in the tutor turn after the learner's first error;
    scaffolding asks, hints at least twice and does not leak. Other conditions
    have no policy (NULL).
    """
    substitution = F.coalesce(F.get(labels, F.lit(1)) == ANSWER_REVEAL, F.lit(False))
    scaffolding = (
        (label_count(labels, GUIDING_QUESTION) >= MIN_QUESTIONS)
        & (label_count(labels, HINT) >= MIN_HINTS)
        & F.coalesce(~leaked, F.lit(False))
    )
    return F.when(condition == SUBSTITUTION, substitution).when(
        condition == SCAFFOLDING, scaffolding
    )
