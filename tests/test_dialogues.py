"""Turn splitting, labels, leakage: bodies in one row and turns over many rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.functions import turns as TU
from lectern.operators import dialogue as D

LEAKY = "TUTOR: The answer is 4,000 units. Now, what is 2 plus 2?\n\nLEARNER: Is it 5?\n\nTUTOR: Not quite.\n"
CLEAN = "TUTOR: What is 2 plus 2?\n\nLEARNER: Is it 5?\n\nTUTOR: Hint: count on.\n\nLEARNER: Is it 4?\n\nTUTOR: Yes, 4.\n"


def brute_turns(body: str) -> list[tuple[str, str]]:
    """Line by line: a marker opens a turn, other lines continue it."""
    out: list[list] = []
    for line in body.split("\n"):
        opened = re.match("(TUTOR|LEARNER):", line)
        if opened:
            out.append([opened[1], line[opened.end():]])
        elif out:
            out[-1][1] += "\n" + line
    return [(speaker, text.strip()) for speaker, text in out]


def brute_leak(turns: list[tuple[str, str]], answer: str):
    def plain(text):
        out = ""
        for k, ch in enumerate(text):
            around = 0 < k < len(text) - 1 and text[k - 1] in "0123456789" and text[k + 1] in "0123456789"
            out += "" if around and (ch == "," or ch.isspace()) else ch
        return out

    first = next((k for k, (who, t) in enumerate(turns) if who == "LEARNER" and re.search("[0-9]", t)), None)
    if first is None:
        return None, None
    said = " ".join(t for who, t in turns[:first] if who == "TUTOR")
    return plain(answer) in plain(said), first


def leakage(spark, bodies: list[tuple[str, str]]) -> list:
    df = spark.createDataFrame([(i, b, a) for i, (b, a) in enumerate(bodies)], "i int, body string, answer string")
    return TU.with_leakage(TU.with_attempt(df, "body"), "answer").orderBy("i").collect()


def random_bodies(n: int) -> list[str]:
    rng = random.Random(11)
    bits = ["TUTOR: ", "LEARNER: ", "LEARNER:", " TUTOR: ", "x", "1", "23", "4,", ",", " ", "\n", "\n", "\r", " ", "Hint: ", "?", "é", "TUTOR:"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_split_matches_line_walk(spark):
    bodies = random_bodies(800) + ["", "intro\nTUTOR: a\nb\n\nLEARNER:   c  \n", "TUTOR:", "no markers"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    for r in df.select("i", TU.split_turns(F.col("body")).alias("t")).collect():
        assert [(t.speaker, t.text) for t in r["t"]] == brute_turns(bodies[r["i"]]), repr(bodies[r["i"]])


def test_turn_of_twenty_thousand_lines(one):
    body = "TUTOR: start\n" + "line\n" * 20_000 + "LEARNER: end 1"
    turns = one({"b": body}, "b string", TU.split_turns(F.col("b")))
    assert [t.speaker for t in turns] == ["TUTOR", "LEARNER"] and turns[0].text.count("\n") == 20_000


def test_leakage_known_cases(spark):
    rows = leakage(spark, [(CLEAN, "4"), (LEAKY, "4000"), ("TUTOR: Hello.\n\nLEARNER: Hi?\n", "4000"), ("plain text", "1"), (CLEAN, None)])
    assert [(r["leaked"], r["first_attempt_turn_index"], r["error"]) for r in rows] == [
        (False, 1, None), (True, 1, None), (None, None, "no_attempt"), (None, None, "no_turns"), (None, 1, "null_answer"),
    ]
    assert rows[1]["detail"] == "final_answer='4000' found_before_attempt=True"
    with pytest.raises(Exception, match="no_turns"):
        df = spark.createDataFrame([("x", "1")], "body string, answer string")
        TU.with_leakage(TU.with_attempt(df, "body"), "answer", mode="strict").collect()


def test_leakage_by_substring_and_across_turns(spark):
    fused = "TUTOR: it is 12\nTUTOR: 34 ok\nLEARNER: 9"
    rows = leakage(spark, [("TUTOR: about 14\nLEARNER: 9", "4"), (fused, "1234"), (fused, "12 34"), (fused, "123")])
    assert [r["leaked"] for r in rows] == [True, True, True, True]


def test_leakage_matches_brute_force(spark):
    bodies = [(b, a) for b in random_bodies(500) for a in ("1", "123", "4,23")]
    for (body, answer), r in zip(bodies, leakage(spark, bodies)):
        want = brute_leak(brute_turns(body), answer)
        assert (r["leaked"], r["first_attempt_turn_index"]) == want, (body, answer)


def test_labels(one):
    cases = {
        "Hint: think": "hint", "  HINT: a?": "hint", "hint a?": "guiding_question", "What?": "guiding_question",
        "It is 4.": "answer_reveal", "": "answer_reveal",
    }
    for text, want in cases.items():
        assert one({"t": text}, "t string", TU.turn_label(F.col("t"))) == want
    labels = TU.tutor_labels(TU.split_turns(F.col("b")))
    assert one({"b": CLEAN}, "b string", labels) == ["guiding_question", "hint", "answer_reveal"]


def test_policy(spark):
    q, h, a = "guiding_question", "hint", "answer_reveal"
    rows = [
        ("ai_substitution", [q, a], False, True), ("ai_substitution", [a, q], False, False), ("ai_substitution", [a], False, False),
        ("ai_scaffolding", [q, h, h, a], False, True), ("ai_scaffolding", [q, h], False, False),
        ("ai_scaffolding", [q, h, h], True, False), ("ai_scaffolding", [q, h, h], None, False), ("traditional", [q], False, None),
    ]
    df = spark.createDataFrame(rows, "c string, l array<string>, leaked boolean, want boolean")
    for r in df.withColumn("got", TU.follows_policy(F.col("c"), F.col("l"), F.col("leaked"))).collect():
        assert r["got"] == r["want"], r


def as_turn_table(spark, talks: list[tuple[list, str]]):
    rows = [(i, pos, who, text, answer) for i, (turns, answer) in enumerate(talks) for pos, (who, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv int, pos long, speaker string, text string, answer string").repartition(6)


def random_talks(n: int, longest: int) -> list[tuple[list, str]]:
    rng = random.Random(23)
    bits = ["1", "2", "1,", ",2", "12", "x", "?", "", "1 2", "ab 1", "2 cd", "long text " * 3]
    talks = []
    for _ in range(n):
        size = rng.randint(1, longest)
        quiet = rng.randint(0, size)
        talk = []
        for pos in range(size):
            who = rng.choice(["TUTOR", "TUTOR", "LEARNER"])
            text = rng.choice(bits)
            if who == "LEARNER" and pos < quiet:
                text = "no idea"
            talk.append((who, text.strip()))
        talks.append((talk, rng.choice(["12", "1212", "121", "1", "212121", "99", "x 1"])))
    return talks


@pytest.mark.parametrize("block", [2, 3, 1024])
def test_turn_table_leakage_matches_brute_force(spark, monkeypatch, block):
    """Small blocks force every merge level, cut ends and blocks without tutor turns."""
    monkeypatch.setattr(D, "BLOCK", block)
    talks = random_talks(300, 30)
    got = {r["conv"]: r for r in D.turn_leakage(as_turn_table(spark, talks), "conv", "answer").collect()}
    leaks = 0
    for i, (turns, answer) in enumerate(talks):
        want = brute_leak(turns, answer)
        assert (got[i]["leaked"], got[i]["first_attempt_turn_index"]) == want, (turns, answer)
        leaks += bool(want[0])
    assert 30 < leaks < 270


def test_turn_table_leakage_of_one_hot_conversation(spark):
    """40,000 turns in one conversation, the answer split over two of them far apart from any edge."""
    turns = spark.range(40_000).select(
        F.lit(1).alias("conv"),
        F.col("id").alias("pos"),
        F.when(F.col("id") == 39_999, "LEARNER").otherwise("TUTOR").alias("speaker"),
        F.when(F.col("id") == 30_719, "so 4").when(F.col("id") == 30_720, "000 it is").when(
            F.col("id") == 39_999, "I get 7"
        ).otherwise("more words").alias("text"),
        F.lit("4000").alias("answer"),
    )
    got = D.turn_leakage(turns, "conv", "answer").collect()
    assert [(r["leaked"], r["first_attempt_turn_index"], r["error"]) for r in got] == [(True, 39_999, None)]


def test_first_attempts_and_errors(spark):
    talks = [
        ([("TUTOR", "1"), ("LEARNER", "no"), ("LEARNER", "2")], "1"), ([("TUTOR", "1"), ("LEARNER", "no")], "1"), ([("SYSTEM", "1")], "1"),
    ]
    table = as_turn_table(spark, talks)
    got = {r["conv"]: (r["first_attempt_turn_index"], r["error"]) for r in D.first_attempts(table, "conv").collect()}
    assert got == {0: (2, None), 1: (None, "no_attempt"), 2: (None, "no_turns")}
    leaks = {r["conv"]: (r["leaked"], r["error"]) for r in D.turn_leakage(table, "conv", "answer").collect()}
    assert leaks == {0: (True, None), 1: (None, "no_attempt"), 2: (None, "no_turns")}


def test_attempt_index_counts_spoken_turns_only(spark):
    """System turns before and between, and positions that are neither dense nor from 0."""
    talk = [("SYSTEM", "1"), ("TUTOR", "so 12"), ("SYSTEM", "2"), (None, "3"), ("LEARNER", "no"), ("LEARNER", "4"), ("TUTOR", "5")]
    rows = [(7, 10**9 * (i + 1), who, text, "12") for i, (who, text) in enumerate(talk)]
    table = spark.createDataFrame(rows, "conv int, pos long, speaker string, text string, answer string").repartition(3)
    assert D.first_attempts(table, "conv").first()["first_attempt_turn_index"] == 2
    row = D.turn_leakage(table, "conv", "answer").first()
    assert (row["first_attempt_turn_index"], row["leaked"]) == (2, True)


def test_label_counts_fill_zeros(spark):
    table = as_turn_table(spark, [([("TUTOR", "Why?"), ("LEARNER", "Hint: no"), ("TUTOR", "Hint: b")], "1")])
    row = D.label_counts(D.label_turns(table), "conv").first()
    assert (row["guiding_question"], row["hint"], row["answer_reveal"]) == (1, 1, 0)


def test_explode_turns(spark):
    df = spark.createDataFrame([(5, CLEAN)], "i int, body string").select("i", TU.split_turns(F.col("body")).alias("turns"))
    rows = D.explode_turns(df).collect()
    assert [(r["i"], r["pos"], r["speaker"]) for r in rows[:2]] == [(5, 0, "TUTOR"), (5, 1, "LEARNER")] and len(rows) == 5
