"""Content checks on turn tables: one row per turn, conversations of any length.

A body in one row is handled by :mod:`lectern.functions.turns` without a shuffle.
Here a conversation is spread over many rows, and one conversation may hold a
large share of all turns, so nothing gathers a whole conversation: rows are cut
to bounded summaries first, and summaries are merged block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.errors import QUARANTINE, enforce, first_error, guarded
from lectern.functions.text import normalize_numbers, strip
from lectern.functions.turns import LABELS, LEARNER, TUTOR, has_digit, turn_label
from lectern.operators.accumulation import range_pieces
from lectern.session import save_once

# Turns per block at each merge level; what is left is merged per conversation.
BLOCK = 1024
LEVELS = 2
# A character that stands for cut-out text and so can be part of no match.
_GAP = "\u0000"


def explode_turns(df: DataFrame, turns: str = "turns") -> DataFrame:
    """One row per turn of a ``split_turns`` array: ``pos, speaker, text``.

    The outer form keeps the optimizer from testing the array's size below the
    explode, which would split every body a second time.
    """
    others = [c for c in df.columns if c != turns]
    rows = df.select(*others, F.posexplode_outer(turns).alias("pos", "t"))
    return rows.filter(F.col("pos").isNotNull()).select(
        *others, F.col("pos").cast("long").alias("pos"), "t.speaker", "t.text"
    )


def first_attempts(turns: DataFrame, conversation: str, mode: str = QUARANTINE) -> DataFrame:
    """Index of each conversation's first learner turn with a digit.

    The index counts tutor and learner turns only, from 0: it is the number of such
    turns before the attempt. Both passes count before they shuffle, and no text moves.
    """
    spoken = F.col("speaker").isin(TUTOR, LEARNER)
    attempt = (F.col("speaker") == LEARNER) & has_digit(F.col("text"))
    marks = turns.select(conversation, "pos", F.coalesce(spoken, F.lit(False)).alias("spoken"))
    firsts = turns.groupBy(conversation).agg(
        F.count_if(spoken).alias("n_turns"), F.min(F.when(attempt, F.col("pos"))).alias("at")
    )
    earlier = (
        marks.join(firsts.select(F.col(conversation).alias("_key"), "at"), F.col(conversation).eqNullSafe(F.col("_key")))
        .filter("spoken AND pos < at")
        .groupBy("_key")
        .agg(F.count("*").alias("earlier"))
    )
    out = firsts.join(earlier, F.col(conversation).eqNullSafe(F.col("_key")), "left").select(
        conversation,
        "n_turns",
        F.when(F.col("at").isNotNull(), F.coalesce("earlier", F.lit(0))).alias("first_attempt_turn_index"),
    )
    error = first_error(
        ("no_turns", F.col("n_turns") == 0),
        ("no_attempt", F.col("first_attempt_turn_index").isNull()),
    )
    return enforce(out.withColumn("error", error), mode)


def dense_positions(turns: DataFrame, conversation: str) -> DataFrame:
    """Replace ``ord`` by 0, 1, 2, ... within each conversation, in the order of ``ord``.

    Positions may be timestamps or global numbers. Rows are range-partitioned, which
    cuts a long conversation over many tasks; pieces are numbered by their counts.
    """
    pieces = save_once(range_pieces(turns, conversation, ["ord"]), "turns")
    counts = pieces.groupBy(conversation, "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy(conversation).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col(conversation).alias("_key"),
        F.col("piece").alias("_piece"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
    )
    inside = Window.partitionBy(conversation, "piece").orderBy("ord")
    same = F.col(conversation).eqNullSafe(F.col("_key")) & (F.col("piece") == F.col("_piece"))
    ranked = pieces.withColumn("rank", F.row_number().over(inside)).join(bases, same)
    dense = ranked.withColumn("ord", F.col("base") + F.col("rank") - 1)
    return dense.select(turns.columns)


def _ends(text: Column, reach: Column) -> Column:
    """The text with its middle cut out, keeping ``reach`` characters at both ends.

    A match that crosses the edge of a text lies within ``reach`` of it, so
    joining the ends finds exactly the crossing matches.
    """
    cut = F.concat(F.left(text, reach), F.lit(_GAP), F.right(text, reach))
    return F.when(F.length(text) > 2 * reach, cut).otherwise(text)


def _merge(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Merge blocks of one key in order, up to the first block with an attempt.

    ``n_turns`` counts a block's spoken turns, ``attempt`` those before its first attempt.
    """
    last = F.min(F.when(F.col("attempt").isNotNull(), F.col("ord")))
    grouped = blocks.groupBy(*keys).agg(
        F.max("answer").alias("answer"),
        F.sum("n_turns").alias("n_turns"),
        last.alias("last"),
        F.min_by("attempt", F.when(F.col("attempt").isNotNull(), F.col("ord"))).alias("attempt"),
        F.sort_array(F.collect_list(F.struct("ord", "n_turns", "said", "hit"))).alias("parts"),
    )
    before = F.aggregate(
        F.filter("parts", lambda p: p.ord < F.col("last")), F.lit(0).cast("long"), lambda n, p: n + p.n_turns
    )
    grouped = grouped.withColumn("attempt", before + F.col("attempt"))
    kept = F.filter("parts", lambda p: F.col("last").isNull() | (p.ord <= F.col("last")))
    staged = grouped.withColumn("parts", kept)
    said = F.filter(F.transform("parts", lambda p: p.said), lambda x: x.isNotNull())
    joined = F.when(F.size(said) > 0, F.array_join(said, " "))
    staged = staged.withColumn("said", joined)
    crossing = normalize_numbers(F.col("said")).contains(F.col("answer"))
    hit = F.exists("parts", lambda p: p.hit) | F.coalesce(crossing, F.lit(False))
    return staged.select(
        *keys,
        "answer",
        "n_turns",
        "attempt",
        hit.alias("hit"),
        _ends(F.col("said"), _reach(F.col("answer"))).alias("said"),
    )


def _reach(answer: Column) -> Column:
    """Twice the answer's length covers a separator after every digit; two for context."""
    return (2 * F.length(answer) + 2).cast("int")


def turn_leakage(
    turns: DataFrame, conversation: str, answer: str, mode: str = QUARANTINE
) -> DataFrame:
    """Does the answer appear in tutor text before the first attempt?

    ``turns`` holds ``conversation, pos, speaker, text`` and the answer text on
    every row. Tutor texts are joined and then normalised by definition, so the
    answer may straddle turns. Each turn is cut to a found-flag and its two ends,
    bounded by the answer's length, before anything is shuffled; turns are numbered
    without gaps and blocks of consecutive turns merged level by level. The attempt's
    index counts tutor and learner turns only.
    """
    staged = turns.select(
        conversation,
        F.col("pos").alias("ord"),
        (F.col("speaker") == TUTOR).alias("tutor"),
        (F.col("speaker") == LEARNER).alias("learner"),
        strip(F.col("text")).alias("text"),
        normalize_numbers(F.col(answer)).alias("answer"),
    )
    text, ans, tutor = F.col("text"), F.col("answer"), F.col("tutor")
    blocks = staged.select(
        conversation,
        "ord",
        "answer",
        F.when(tutor | F.col("learner"), 1).otherwise(0).cast("long").alias("n_turns"),
        F.when(F.col("learner"), F.when(has_digit(text), 0)).cast("long").alias("attempt"),
        F.coalesce(F.when(tutor, normalize_numbers(text).contains(ans)), F.lit(False)).alias("hit"),
        F.when(tutor & ans.isNotNull(), _ends(text, _reach(ans))).alias("said"),
    )
    blocks = dense_positions(blocks, conversation)
    for _ in range(LEVELS):
        blocks = blocks.withColumn("block", F.floor(F.col("ord") / BLOCK))
        blocks = _merge(blocks, [conversation, "block"]).withColumnRenamed("block", "ord")
    out = _merge(blocks, [conversation])
    error = first_error(
        ("no_turns", F.col("n_turns") == 0),
        ("no_attempt", F.col("attempt").isNull()),
        ("null_answer", F.col("answer").isNull()),
    )
    out = out.withColumn("error", error).select(
        conversation,
        guarded(F.col("hit"), F.col("error")).alias("leaked"),
        F.col("attempt").alias("first_attempt_turn_index"),
        "error",
    )
    return enforce(out, mode)


def label_turns(turns: DataFrame) -> DataFrame:
    """Tutor turns with their label; rows stay where they are."""
    return turns.filter(F.col("speaker") == TUTOR).withColumn("label", turn_label(F.col("text")))


def label_counts(labelled: DataFrame, by: str) -> DataFrame:
    """Number of tutor turns per label, one row per group."""
    return labelled.groupBy(by).agg(
        *[F.count_if(F.col("label") == label).alias(label) for label in LABELS]
    )
