"""Observable text features as Column expressions.

All of them are built-in JVM expressions over one text column: no explode, no
shuffle, no Python. Counting uses one linear regular expression per feature, with
possessive runs so that a very long word or line cannot make it backtrack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.errors import QUARANTINE, enforce, first_error

# Letter classes are spelled out because Java matches an explicit
# character list faster than a union of ranges.
VOWELS = "aeiouyAEIOUY"
CONSONANTS = "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"
LETTERS = VOWELS + CONSONANTS
WORD_CHARS = LETTERS + "0123456789'"
SENTENCE_ENDS = r".!?\n"
# Every whitespace character of Python's str.strip() except the newline.
BLANKS = r"\t\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same characters and the newline, as text.
SPACES = (
    "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORDS_PER_MINUTE = 220.0
FK_PER_SENTENCE_WORD = 0.39
FK_PER_WORD_SYLLABLE = 11.8
FK_OFFSET = 15.59

WORD = f"[{WORD_CHARS}]+"
SENTENCE = f"[^{SENTENCE_ENDS}{BLANKS}][^{SENTENCE_ENDS}]*"
# One match per syllable of a text framed by " " and " a" (the last match is the
# frame's own). Inside a word: a vowel run with the consonants after it, or one that
# ends the word unless on "e". Between words: a silent run left over, the gap, and
# the next word's opening consonants, vowels and consonants.
SYLLABLE = (
    f"[{VOWELS}]++(?:[{CONSONANTS}]++|(?<![eE]))"
    f"|[{VOWELS}]*+[^{LETTERS}]++[{CONSONANTS}]*+[{VOWELS}]*+[{CONSONANTS}]*+"
)
# From the start of a piece to its second mark: "=" then a digit or operator, or
# the other way round.
EQUATION = (
    f"(?<![^{SENTENCE_ENDS}])[^{SENTENCE_ENDS}=0-9+\\-*/]*+"
    f"(?:=[^{SENTENCE_ENDS}0-9+\\-*/]*+[0-9+\\-*/]|[0-9+\\-*/][^{SENTENCE_ENDS}=]*+=)"
)

FEATURES = (
    "words",
    "characters",
    "sentences",
    "fk_grade",
    "equation_count",
    "example_count",
    "lexical_diversity",
    "duration_seconds",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def strip(text: Column) -> Column:
    """Remove all Unicode whitespace at both ends (a plain ``trim`` removes only spaces)."""
    return F.btrim(text, F.lit(SPACES))


def universal_newlines(text: Column) -> Column:
    return F.when(text.contains("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def words_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return _count(text, WORD)


def character_count(text: Column) -> Column:
    return F.length(text).cast("long")


def sentence_count(text: Column) -> Column:
    """Non-blank pieces between runs of full stop, ``!``, ``?`` and newline."""
    return _count(text, SENTENCE)


def syllable_count(text: Column) -> Column:
    """Sum over all words of the vowel-group heuristic.

    Digits and apostrophes are dropped first, so the letters on both sides of
    them join as they do inside one word.
    """
    letters = F.regexp_replace(text, "[0-9']+", "")
    return _count(F.concat(F.lit(" "), letters, F.lit(" a")), SYLLABLE) - 1


def equation_count(text: Column) -> Column:
    """Sentence pieces with ``=`` and, beside it, a digit or arithmetic operator."""
    return F.when(text.contains("="), _count(text, EQUATION)).when(text.isNotNull(), F.lit(0)).cast("long")


def alphabetic_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def type_token_ratio(tokens: Column) -> Column:
    n = F.size(tokens)
    return F.when(n > 0, F.size(F.array_distinct(tokens)).cast("double") / n.cast("double")).when(
        n == 0, F.lit(0.0)
    )


def lexical_diversity(text: Column) -> Column:
    return type_token_ratio(alphabetic_tokens(text))


def reading_seconds(words: Column, wpm: float = WORDS_PER_MINUTE) -> Column:
    return F.lit(60.0) * words.cast("double") / F.lit(float(wpm))


def duration_seconds(text: Column, wpm: float = WORDS_PER_MINUTE) -> Column:
    return reading_seconds(word_count(text), wpm)


def grade_from_counts(words: Column, sentences: Column, syllables: Column) -> Column:
    """Flesch-Kincaid grade; NULL when there is no word or no sentence."""
    w, s, y = (c.cast("double") for c in (words, sentences, syllables))
    grade = (
        F.lit(FK_PER_SENTENCE_WORD) * (w / s)
        + F.lit(FK_PER_WORD_SYLLABLE) * (y / w)
        - F.lit(FK_OFFSET)
    )
    return F.when((words > 0) & (sentences > 0), grade)


def fk_grade(text: Column) -> Column:
    return grade_from_counts(word_count(text), sentence_count(text), syllable_count(text))


def word_onsets(text: Column, wpm: float = WORDS_PER_MINUTE) -> Column:
    """Start second of every word, as one array per text."""
    return F.transform(
        words_list(text), lambda _, i: F.lit(60.0) * i.cast("double") / F.lit(float(wpm))
    )


def normalize_numbers(text: Column) -> Column:
    """Drop one comma or whitespace character standing between two digits."""
    return F.regexp_replace(text, rf"([0-9])[,{BLANKS}\n](?=[0-9])", "$1")


def whitespace_words(text: Column) -> Column:
    """Number of pieces ``str.split()`` would return."""
    return _count(text, rf"[!-~[^{BLANKS}\n]]++")


def in_word_band(text: Column, target: float = 430.0, tolerance: float = 0.15) -> Column:
    n = whitespace_words(text)
    return n.between(target * (1 - tolerance), target * (1 + tolerance))


def with_text_features(
    df: DataFrame,
    text: str = "text",
    example_count: Column | None = None,
    wpm: float = WORDS_PER_MINUTE,
    mode: str = QUARANTINE,
    keep_text: bool = False,
) -> DataFrame:
    """Add the eight features, the syllable total and an error code.

    One narrow projection: counts are staged first so that the grade and the
    duration reuse them, and the text itself is dropped unless asked for.
    """
    body = F.col(text)
    examples = F.lit(None) if example_count is None else example_count
    error = first_error(
        ("null_text", F.col("words").isNull()),
        ("empty_text", (F.col("words") == 0) | (F.col("sentences") == 0)),
    )
    if "error" in df.columns:
        error = F.coalesce(F.col("error"), error)
    counted = df.withColumns(
        {
            "words": word_count(body),
            "characters": character_count(body),
            "sentences": sentence_count(body),
            "syllables": syllable_count(body),
            "equation_count": equation_count(body),
            "example_count": examples.cast("long"),
            "lexical_diversity": lexical_diversity(body),
        }
    )
    if not keep_text:
        counted = counted.drop(text)
    out = counted.withColumns(
        {
            "fk_grade": grade_from_counts(F.col("words"), F.col("sentences"), F.col("syllables")),
            "duration_seconds": reading_seconds(F.col("words"), wpm),
            "error": error,
        }
    )
    return enforce(out, mode)


def explode_word_onsets(
    df: DataFrame, text: str = "text", wpm: float = WORDS_PER_MINUTE
) -> DataFrame:
    """One row per word: ``word_idx``, ``word`` and ``onset_s``.

    The outer form keeps the optimizer from testing the word count below the
    explode, which would match every text a second time.
    """
    others = [c for c in df.columns if c != text]
    rows = df.select(
        *others, F.posexplode_outer(words_list(F.col(text))).alias("word_idx", "word")
    )
    return rows.filter(F.col("word_idx").isNotNull()).withColumn(
        "onset_s", F.lit(60.0) * F.col("word_idx").cast("double") / F.lit(float(wpm))
    )
