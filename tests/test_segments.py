"""Word positions over segments against the joined text."""

import random
import re

import pytest

from lectern.operators import segments as S


@pytest.fixture(params=[1, 5, 60])
def tasks(spark, request):
    """Adaptive execution would join the small range partitions of a test into one."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _segments(seed):
    rng = random.Random(seed)
    rows = []
    for key, n in (("hot", 400), ("long word", 120), ("few", 3), (None, 40)):
        for i in range(n):
            kind = rng.random()
            if key == "long word" and kind < 0.8:
                text = rng.choice(["", "ab", "it's", None])
            elif kind < 0.2:
                text = rng.choice(["", None, " ", "\n", "é", "-"])
            else:
                text = "".join(rng.choice("ab1' .é") for _ in range(rng.randrange(1, 12)))
            rows.append((key, i // 7, i % 7, text, 1))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_offsets_are_those_of_the_joined_text(spark, tasks, seed):
    rows = _segments(seed)
    df = spark.createDataFrame(rows, "k string, page int, line int, text string, n_words int").repartition(6)
    out = S.with_word_offsets(df, "k", ["page", "line"])
    assert out.columns == ["k", "page", "line", "text", "words_before", "continued", "n_words"]
    got = {(r["k"], r["page"], r["line"]): r for r in out.collect()}
    onsets = {(r["k"], r["word_idx"]): r for r in S.explode_segment_onsets(df, "k", ["page", "line"]).collect()}
    assert len(got) == len(rows)
    total = 0
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        joined, bounds = "", []
        for r in own:
            bounds.append(len(joined))
            joined += r[3] or ""
        starts = [m.start() for m in re.finditer("[A-Za-z0-9']+", joined)]
        total += len(starts)
        for r, at in zip(own, bounds, strict=True):
            end = at + len(r[3] or "")
            found = got[r[:3]]
            assert found["words_before"] == sum(s < at for s in starts)
            assert found["n_words"] == sum(at <= s < end for s in starts)
            inside = at > 0 and re.fullmatch("[A-Za-z0-9']{2}", joined[at - 1 : at + 1]) is not None
            assert found["continued"] == (inside and end > at)
            for i, s in enumerate(starts):
                if at <= s < end:
                    row = onsets[key, i]
                    assert (row["page"], row["line"], row["onset_s"]) == (*r[1:3], 60.0 * i / 220)
                    assert joined[s:end].startswith(row["part"])
    assert len(onsets) == total


def test_segments_move_once_and_a_hot_text_is_dealt_out(spark, tasks):
    df = spark.createDataFrame(_segments(3), "k string, page int, line int, text string, n int").repartition(6)
    out = S.with_word_offsets(df, "k", ["page", "line"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    segments, pieces = plan.split("BroadcastExchange")
    assert "Exchange" not in segments and "text#" not in pieces
    files = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles()})
    pieces_of_hot = files.filter("k = 'hot'").select("_piece").distinct().count()
    assert pieces_of_hot == 1 if tasks == 1 else pieces_of_hot > tasks / 3


def test_nothing(spark):
    df = spark.createDataFrame([], "k string, i int, text string")
    assert S.with_word_offsets(df, "k", ["i"]).count() == S.explode_segment_onsets(df, "k", ["i"]).count() == 0
