"""Stages of the pipeline, each on its own input, against plain versions."""

import random

import corpus_pipeline
from tests.llm import plain
from tests.llm.test_resemblance import brute_force, near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows(frame):
    return sorted((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


def test_stages_keep_what_plain_versions_keep(spark, tmp_path):
    rng = random.Random(5)
    rows = [(d, t) for d, t in near_copies() if d is not None and t]
    rows = list({d: (d, t) for d, t in rows}.values())
    item = " ".join(f"item{rng.randrange(999)}" for _ in range(20))
    shared = " ".join(f"pass{rng.randrange(999)}" for _ in range(30))
    rows += [(1000 + i, f"{shared} tail{i} " + " ".join(f"w{i}x{k}" for k in range(40))) for i in range(4)]
    rows += [(1100 + i, " ".join(f"d{i}x{k}" for k in range(50)) + " " + item) for i in range(3)]
    full = [(d, t, "en", "s", len(t)) for d, t in rows]
    docs = spark.createDataFrame(full, SCHEMA).repartition(3)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = _rows(stages["near duplicates"](spark, docs, str(tmp_path)))
    assert kept == sorted((d, t) for (d, t), (_, c) in zip(rows, brute_force(rows), strict=True) if d == c)
    assert len(kept) < len(rows)
    cut = {d: t.split() for d, t in _rows(stages["repeated passages"](spark, docs, str(tmp_path)))}
    assert cut == {d: left.decode().split() for d, _, _, left in plain.repeats(rows)}
    clean = _rows(stages["benchmark decontamination"](spark, docs, str(tmp_path)))
    leaking = {d for d, *_ in plain.leaks(rows, [(1, item)])}
    assert clean == sorted(r for r in rows if r[0] not in leaking) and len(leaking) == 3
