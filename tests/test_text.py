"""Text features against brute force, known answers and traps."""

import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X



def brute(text: str) -> dict:
    """All features, word by word and piece by piece."""
    # What counts as a word and what ends a sentence.
    words = re.findall(r"[A-Za-z0-9']+", text)
    pieces = re.split(r"[.!?\n]+", text)
    syllables = 0
    for word in words:
        letters = "".join(c for c in word.lower() if c in string.ascii_lowercase)
        runs = len(re.findall("[aeiouy]+", letters))
        silent = 1 if letters[-1:] == "e" and runs > 1 else 0
        syllables += max(runs - silent, 1) if letters else 0
    n_sentences = sum(1 for p in pieces if p.strip())
    tokens = re.findall("[a-z]+", text.lower())
    grade = None
    if words and n_sentences:
        grade = 0.39 * len(words) / n_sentences + 11.8 * syllables / len(words) - 15.59
    return {
        "words": len(words),
        "characters": len(text),
        "sentences": n_sentences,
        "syllables": syllables,
        "equation_count": sum(
            1 for p in pieces if "=" in p and set(p) & set("0123456789+-*/")
        ),
        "lexical_diversity": len(set(tokens)) / len(tokens) if tokens else 0.0,
        "fk_grade": grade,
        "duration_seconds": len(words) * 60 / 220,
    }


def corpus() -> list[str]:
    rng = random.Random(7)
    words = [
        "the", "area", "don't", "queue", "eye", "rhythm", "x", "e", "bee", "be", "agree", "a1b2e",
        "1e3", "co-operate", "café", "é", "'", "42", "SCALE", "Apple", "tee'e", "zzz", "hmm",
        "=", "a=b", "1=2", "+", "-", "*", "/", "==", " ", "\U0001F600", " ", "\x1c",
    ]
    ends = [" ", " ", " ", ". ", "! ", "?", "\n", "\n\n", "...", "\t", "\r\n", ""]
    texts = [
        "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(1, 60)))
        for _ in range(400)
    ]
    pool = "aeiouybcdE'1 .=+-!?\né"
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    return texts + ["", " ", "\n", "Dog.", " .", "\x1c", "K İ"]


def test_features_match_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r["i"]: r for r in X.with_text_features(df, "t", F.lit(2)).collect()}
    for i, text in enumerate(texts):
        for name, want in brute(text).items():
            got = rows[i][name]
            if want is None or isinstance(want, int):
                assert got == want, (name, text)
            else:
                assert got == pytest.approx(want, abs=1e-12), (name, text)
        assert rows[i]["example_count"] == 2
        assert (rows[i]["error"] == "empty_text") == (rows[i]["fk_grade"] is None)


def test_known_answers(one):
    assert one({"t": "Dog."}, "t string", X.fk_grade(F.col("t"))) == pytest.approx(-3.40, abs=1e-9)
    assert one({"t": "word " * 220}, "t string", X.duration_seconds(F.col("t"))) == pytest.approx(60.0)
    assert one({"t": "word " * 220}, "t string", X.duration_seconds(F.col("t"), 110)) == pytest.approx(120.0)
    assert one({"t": ""}, "t string", X.fk_grade(F.col("t"))) is None
    assert one({"t": " . "}, "t string", X.sentence_count(F.col("t"))) == 0


def test_equations(one):
    cases = {"Total = 3": 1, "a = b": 0, "a-b = c": 1, "x=1. y=2! z = w\n4=4": 3, "1 + 2": 0, "=": 0, "==5": 1}
    for text, want in cases.items():
        assert one({"t": text}, "t string", X.equation_count(F.col("t"))) == want, text


def test_word_lists_and_onsets(spark, one):
    assert one({"t": "It's café no. 5"}, "t string", X.words_list(F.col("t"))) == ["It's", "caf", "no", "5"]
    onsets = one({"t": "a b. c\nd"}, "t string", X.word_onsets(F.col("t")))
    assert onsets == pytest.approx([60 * i / 220 for i in range(4)])
    rows = X.explode_word_onsets(spark.createDataFrame([(1, "a b. c"), (2, "")], "i int, t string"), "t").collect()
    assert [(r["i"], r["word_idx"], r["word"]) for r in rows] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]
    assert rows[0]["onset_s"] == 0.0


def test_number_normalisation(one):
    cases = {
        "1,2,3": "123", "1 12": "112", "4,000 units": "4000 units", "a 1": "a 1", "1, 2": "1, 2",
        "1 2": "12", "1\n2": "12", "1  2": "1  2", ",1,": ",1,",
    }
    for text, want in cases.items():
        assert one({"t": text}, "t string", X.normalize_numbers(F.col("t"))) == want, text


def test_word_band(one):
    for n, want in ((365, False), (366, True), (494, True), (495, False)):
        text = "wo-rd  \n" * n
        assert one({"t": text}, "t string", X.whitespace_words(F.col("t")), X.in_word_band(F.col("t"))) == (n, want)


def test_strip_and_newlines(one):
    assert one({"t": " \x1c a b \n"}, "t string", X.strip(F.col("t"))) == "a b"
    assert one({"t": "a\r\nb\rc\n"}, "t string", X.universal_newlines(F.col("t"))) == "a\nb\nc\n"


def test_strict_mode_fails_on_empty_text(spark):
    df = spark.createDataFrame([("",)], "t string")
    with pytest.raises(Exception, match="empty_text"):
        X.with_text_features(df, "t", mode="strict").collect()
    with pytest.raises(ValueError):
        X.with_text_features(df, "t", mode="lenient")


@pytest.mark.parametrize(
    "text",
    ["a" * 300_000, "z" * 300_000, "ba" * 150_000, "bce" + "e" * 300_000, "1" * 300_000, "=" + "x" * 300_000,
     "x1" * 150_000, " " * 300_000, "1," * 150_000],
    ids=lambda t: t[:4] + "...",
)
def test_very_long_words_stay_linear(one, text):
    """A backtracking pattern would need minutes here, or overflow the stack."""
    words, syllables, equations, plain = one(
        {"t": text}, "t string", X.word_count(F.col("t")), X.syllable_count(F.col("t")), X.equation_count(F.col("t")),
        F.length(X.normalize_numbers(X.strip(F.col("t")))),
    )
    want = brute(text)
    assert (words, syllables, equations) == (want["words"], want["syllables"], want["equation_count"])
    assert plain <= len(text) and not math.isnan(plain)


# Published counts of the three texts, with their grade and seconds.
@pytest.mark.parametrize(
    "words, sentences, syllables, grade, seconds",
    [
        (448, 51, 675, 5.614900210, 122.181818),
        (430, 54, 556, 2.773229974, 117.272727),
        (434, 54, 599, 3.830619560, 118.363636),
    ],
)
def test_published_grades_and_durations(one, words, sentences, syllables, grade, seconds):
    row = {"w": words, "s": sentences, "y": syllables}
    found = one(
        row, "w int, s int, y int",
        X.grade_from_counts(F.col("w"), F.col("s"), F.col("y")), X.reading_seconds(F.col("w")),
    )
    assert found == pytest.approx((grade, seconds), abs=1e-6)
