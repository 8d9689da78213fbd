"""Word positions in texts that are held in many rows.

A text may be cut anywhere, also inside a word: a word belongs to the segment in which it
starts and counts once. What a stretch of segments adds to its text is a small summary
that merges in order: how many words it has, whether it opens and closes inside a word.
Segments are range-partitioned by text and place, which deals a text with most of them
to many tasks; each task sums up its piece; the few pieces of texts that lie in several
tasks are composed; and each segment gets the number of words before it where it lies.
Segments move once, and no task needs a whole text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WORDS_PER_MINUTE, word_count, words_list
from lectern.session import save_once

_WORD = "[A-Za-z0-9']"


def with_word_offsets(
    segments: DataFrame, key: str, order: Sequence[str], text: str = "text"
) -> DataFrame:
    """Add ``words_before``, ``continued`` and ``n_words`` to every segment of every text.

    ``words_before`` counts the words of the text that start before the segment,
    ``n_words`` those that start in it, and ``continued`` tells whether it opens with the
    rest of a word that started earlier. A null segment is empty; empty segments part no
    word. ``order`` must tell the segments of a text apart. All other columns stay.
    """
    own = [c for c in segments.columns if c not in ("words_before", "continued", "n_words")]
    body = F.coalesce(F.col(text), F.lit(""))
    summed = segments.select(
        *own,
        word_count(body).cast("long").alias("_n"),
        body.rlike(rf"\A{_WORD}").alias("_head"),
        body.rlike(rf"{_WORD}\z").alias("_tail"),
        (body == "").alias("_blank"),
    )
    at = {name: i for i, name in enumerate(summed.columns)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, begun, last, words, tail = TaskContext.get().partitionId(), False, None, 0, None
        for batch in batches:
            before, inside = [], []
            columns = [batch.column(at[c]).to_pylist() for c in (key, "_n", "_head", "_tail", "_blank")]
            for k, n, head, ends, blank in zip(*columns, strict=True):
                if k != last or not begun:
                    begun, last, words, tail = True, k, 0, None
                before.append(words)
                inside.append(tail)
                words += n - (head and tail is True)
                tail = tail if blank else ends
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([piece] * len(before), pa.int32()),
                    pa.array(before, pa.int64()),
                    pa.array(inside, pa.bool_()),
                ],
                names=[*batch.schema.names, "_piece", "_before", "_inside"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in summed.schema.fields)
    placed = summed.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = save_once(placed.mapInArrow(scan, f"{kinds}, _piece int, _before long, _inside boolean"), "segments")

    # A piece's summary: its last segment closes it, its first one with text opens it.
    opened = F.max(F.when(F.col("_inside").isNull() & ~F.col("_blank"), F.col("_head"))).alias("head")
    gained = F.col("_n") - (F.col("_head") & F.coalesce("_inside", F.lit(False))).cast("long")
    closed = F.when(F.col("_blank"), F.col("_inside")).otherwise(F.col("_tail"))
    last = F.max_by(F.struct((F.col("_before") + gained).alias("words"), closed.alias("tail")), F.struct(*order))
    pieces = placed.groupBy(key, "_piece").agg(last.alias("end"), opened)
    summary = F.array_sort(F.collect_list(F.struct("_piece", "end", F.coalesce("head", F.lit(False)).alias("head"))))
    cut = pieces.groupBy(key).agg(summary.alias("pieces")).filter(F.size("pieces") > 1)
    # Only texts cut by a range border are listed: at most two pieces per task.
    entering = F.broadcast(cut.select(F.col(key).alias("_key"), F.inline(_entering(F.col("pieces")))))
    here = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_piece") == F.col("_at"))
    enters = F.coalesce("_enters", F.lit(False))
    continued = F.col("_head") & F.coalesce("_inside", enters)
    # A word that enters the piece was counted again by its first segment with text.
    twice = (F.col("_inside").isNotNull() & enters & F.col("_opens")).cast("long")
    return placed.join(entering, here, "left").select(
        *own,
        (F.col("_before") + F.coalesce("_words", F.lit(0)) - F.coalesce(twice, F.lit(0))).alias("words_before"),
        continued.alias("continued"),
        (F.col("_n") - continued.cast("long")).alias("n_words"),
    )


def _entering(pieces: Column) -> Column:
    """Per piece, in order: words before it, and whether a word enters it and it opens with one."""
    nothing = F.struct(
        F.array().cast("array<struct<_at:int,_words:bigint,_enters:boolean,_opens:boolean>>").alias("done"),
        F.lit(0).cast("long").alias("words"),
        F.lit(False).alias("tail"),
    )

    def compose(acc: Column, piece: Column) -> Column:
        here = F.struct(
            piece._piece.alias("_at"), acc.words.alias("_words"), acc.tail.alias("_enters"), piece.head.alias("_opens")
        )
        return F.struct(
            F.array_append(acc.done, here).alias("done"),
            (acc.words + piece.end.words - (acc.tail & piece.head).cast("long")).alias("words"),
            F.coalesce(piece.end.tail, acc.tail).alias("tail"),
        )

    return F.aggregate(pieces, nothing, compose, lambda acc: acc.done)


def explode_segment_onsets(
    segments: DataFrame, key: str, order: Sequence[str], text: str = "text", wpm: float = WORDS_PER_MINUTE
) -> DataFrame:
    """One row per word: ``key, *order, word_idx, part, onset_s``.

    ``order`` is the place of the segment in which the word starts, ``word_idx`` its
    number in the whole text from 0, and ``part`` what the segment holds of it.
    """
    placed = with_word_offsets(segments, key, order, text)
    rows = placed.select(
        key, *order, "words_before", "continued", F.posexplode_outer(words_list(F.col(text))).alias("_j", "part")
    )
    rows = rows.filter(F.col("_j").isNotNull() & ~(F.col("continued") & (F.col("_j") == 0)))
    index = F.col("words_before") + F.col("_j") - F.col("continued").cast("long")
    return rows.select(
        key, *order, index.alias("word_idx"), "part", (F.lit(60.0) * index.cast("double") / F.lit(float(wpm))).alias("onset_s")
    )
