"""Sinks, key checks, the idempotent load and the stream."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.sources import sinks
from lectern.sources.front_matter import load_stimuli
from lectern.sources.stimuli import fk_violations, key_violations, stimuli_index
from lectern.streaming import ingest
from lectern.streaming.ingest import measured_stimuli, run_available, run_missing, stream_texts


def stimulus(unit: str, condition: str, text: str, variant: str = "primary") -> str:
    return (
        f"---\nstimulus_id: {unit}_{condition}\nunit_id: {unit}\ncondition: {condition}\n"
        f"variant: {variant}\nexample_count: 1\nlearner_error_scripted: false\n---\n{text}\n"
    )


@pytest.fixture()
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text(stimulus("u1", "traditional", "One two three. Four = 4."))
    (folder / "b.txt").write_text(stimulus("u1", "ai_scaffolding", "One two."))
    return folder


def test_feature_sinks(spark, inbox, tmp_path):
    rows = measured_stimuli(load_texts(spark, inbox))
    sinks.write_features(rows, str(tmp_path / "p"))
    sinks.write_features(rows, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 2 and len(back.columns) == 9
    assert back.filter("condition = 'traditional'").first()["equation_count"] == 1
    sinks.write_features(rows, str(tmp_path / "c"), "csv")
    csv = spark.read.csv(str(tmp_path / "c"), header=True)
    assert csv.columns[0] == "condition" and csv.filter("words = 2").count() == 1


def load_texts(spark, inbox):
    return spark.read.text(f"{inbox}/*.txt", wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def test_save_missing_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "preds")

    def preds(values: dict[str, float]):
        rows = [(s, t, [v + t, v]) for s, v in values.items() for t in range(3)]
        return spark.createDataFrame(rows, "stimulus_id string, timestep int, values array<float>")

    def stored():
        rows = spark.read.parquet(path).filter("timestep = 2").collect()
        return {r["stimulus_id"]: r["values"][1] for r in rows}

    sinks.save_missing(preds({"a": 1.0, "b": 2.0}), path, "stimulus_id")
    sinks.save_missing(preds({"a": 9.0, "c": 3.0}), path, "stimulus_id")
    assert stored() == {"a": 1.0, "b": 2.0, "c": 3.0}
    sinks.save_missing(preds({"a": 9.0, "c": 3.0}), path, "stimulus_id")
    assert spark.read.parquet(path).count() == 9
    sinks.save_missing(preds({"a": 7.0, "d": 4.0}), path, "stimulus_id", overwrite=True)
    assert stored() == {"a": 7.0, "b": 2.0, "c": 3.0, "d": 4.0}
    assert spark.read.parquet(path).count() == 12


def test_replacement_keeps_bucket_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "_BUCKETS", 1)
    path = str(tmp_path / "one")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    sinks.save_missing(rows, path, "k")
    sinks.save_missing(rows.filter("k = 'a'").withColumn("v", F.lit(5)), path, "k", overwrite=True)
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 5), ("b", 2)}


@pytest.mark.parametrize("limit", [0, 1, 100])
def test_skip_existing_both_ways(spark, limit):
    """Broadcast of the missing keys and plain anti join give the same rows."""
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e")], "k int, v string")
    old = spark.createDataFrame([(2,), (9,), (None,)], "k int")
    got = sinks.skip_existing(new, old, "k", broadcast_keys=limit)
    assert {r["v"] for r in got.collect()} == {"a", "b", "d", "e"} and got.columns == ["k", "v"]


def test_matrix_rows(spark):
    wide = spark.createDataFrame([("s", 0, 1.0, 2.0)], "stimulus_id string, timestep int, vertex_00000 double, vertex_00001 double")
    row = sinks.matrix_rows(wide, "stimulus_id", "timestep", ["vertex_00000", "vertex_00001"]).first()
    assert row["values"] == [1.0, 2.0]


def test_index_and_key_checks(spark, inbox):
    (inbox / "c.txt").write_text(stimulus("u1", "ai_scaffolding", "Again."))
    (inbox / "d.txt").write_text(stimulus("u9", "traditional", "Lost."))
    index = stimuli_index(measured_stimuli(load_texts(spark, inbox)))
    assert len(index.columns) == 11 and index.count() == 4
    assert {r["modality"] for r in index.collect()} == {"text"}
    assert [tuple(r) for r in key_violations(index).collect()] == [("u1", "ai_scaffolding", "primary", 2)]
    units = spark.createDataFrame([("u1",)], "unit_id string")
    assert [tuple(r) for r in fk_violations(index, units).collect()] == [("u9", 1)]


def test_stream_takes_each_file_once(spark, inbox, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        run_available(measured_stimuli(stream_texts(spark, str(inbox), max_files=1)), out, checkpoint)
        return {r["stimulus_id"]: r["words"] for r in spark.read.parquet(out).collect()}

    assert run() == {"u1_traditional": 5, "u1_ai_scaffolding": 2}
    (inbox / "c.txt").write_text(stimulus("u2", "traditional", "Only."))
    (inbox / "d.txt").write_text("no front matter")
    assert run() == {"u1_traditional": 5, "u1_ai_scaffolding": 2, "u2_traditional": 1, None: None}
    assert spark.read.parquet(out).count() == 4
    assert spark.read.parquet(out).filter("stimulus_id IS NULL").first()["error"] == "missing_opening"


def test_a_stimulus_that_comes_again_adds_nothing(spark, inbox, tmp_path):
    out = str(tmp_path / "out")

    def run(checkpoint="cp", run_id="0"):
        texts = measured_stimuli(stream_texts(spark, str(inbox), max_files=2))
        run_missing(texts, out, str(tmp_path / checkpoint), "stimulus_id", ["path"], run_id)
        rows = spark.read.parquet(out).collect()
        return sorted((r["stimulus_id"], r["words"]) for r in rows if r["stimulus_id"]), len(rows)

    first = [("u1_ai_scaffolding", 2), ("u1_traditional", 5)]
    assert run() == (first, 2)
    assert run() == (first, 2)
    # Another file name, another text, the same key; twice, and once with a new key.
    (inbox / "again.txt").write_text(stimulus("u1", "traditional", "Not the first."))
    (inbox / "more.txt").write_text(stimulus("u1", "traditional", "Nor this."))
    (inbox / "new1.txt").write_text(stimulus("u2", "traditional", "Only one here."))
    (inbox / "new2.txt").write_text(stimulus("u2", "traditional", "Later."))
    (inbox / "bad.txt").write_text("no front matter")
    got, n = run()
    assert got[:2] == first and got[2][0] == "u2_traditional" and (len(got), n) == (3, 4)
    # All files again, with a checkpoint that was lost.
    again, n = run("other", "1")
    assert again == got and n == 5


def test_a_killed_batch_is_replayed_whole(spark, inbox, tmp_path, monkeypatch):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    real = ingest.skip_existing
    (tmp_path / "in" / "a.txt").rename(tmp_path / "in" / "c.txt")

    def run():
        texts = measured_stimuli(stream_texts(spark, str(inbox), max_files=1))
        return run_missing(texts, out, checkpoint, "stimulus_id", ["path"])

    def dies(*args):
        # The batch has written rows when it is killed, and its number is not committed.
        args[0].write.mode("append").parquet(f"{out}/batch=0-000000001")
        raise RuntimeError("killed")

    monkeypatch.setattr(ingest, "skip_existing", dies)
    with pytest.raises(Exception, match="killed"):
        run()
    assert spark.read.parquet(out).count() == 2
    monkeypatch.setattr(ingest, "skip_existing", real)
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["stimulus_id"] for r in rows) == ["u1_ai_scaffolding", "u1_traditional"]


def test_first_of_key(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), (None, 2, "z"), (None, 1, "w"), ("b", 1, None)], "k string, i int, v string")
    assert sorted(tuple(r) for r in ingest.first_of_key(df, "k", ["i"]).filter("k IS NOT NULL").collect()) == [("a", 1, "y"), ("b", 1, None)]
    assert ingest.first_of_key(df, "k", ["i"]).count() == 4


def test_wide_matrices_are_stacked_in_the_order_of_their_names(spark):
    wide = spark.createDataFrame(
        [("s", 0, 10.0, 2.0, 1.5, None), ("s", 1, 11.0, None, 2.5, "x")],
        "stimulus_id string, timestep int, vertex_10 double, vertex_2 float, vertex_00001 double, vertex_x string",
    )
    rows = sinks.matrix_rows(wide, "stimulus_id", "timestep").collect()
    assert [r["values"] for r in rows] == [[1.5, 2.0, 10.0], [2.5, None, 11.0]]
    assert sinks.matrix_rows(wide.limit(0), "stimulus_id", "timestep").count() == 0
    with pytest.raises(ValueError, match="no vertex columns"):
        sinks.matrix_rows(wide.select("stimulus_id", "timestep"), "stimulus_id", "timestep")


def test_twenty_thousand_columns(spark, tmp_path):
    n = 20_000
    x = np.random.default_rng(1).normal(size=(5, n)).astype(np.float32)
    order = np.random.default_rng(2).permutation(n)
    for name, rows in (("a", x[:3]), ("b", x[3:])):
        columns = {"second": list(range(len(rows)))} | {f"vertex_{i:05d}": rows[:, i] for i in order}
        pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
    (tmp_path / "c.parquet").write_bytes(b"no parquet")
    pq.write_table(pa.table({"second": [1, 2]}), tmp_path / "d.parquet")
    rows = sinks.read_matrices(spark, str(tmp_path / "*.parquet")).collect()
    got = {(r["path"][-9], r["timestep"]): r for r in rows}
    assert len(got) == len(rows) == 7
    for i, key in enumerate([("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]):
        assert got[key]["values"] == x[i].tolist() and got[key]["error"] is None
    assert (got["c", None]["error"], got["d", None]["error"]) == ("bad_parquet", "no_vertices")
    with pytest.raises(Exception, match="bad_parquet"):
        sinks.read_matrices(spark, str(tmp_path / "c.parquet"), mode="strict").collect()


def test_batch_equals_stream_columns(spark, inbox):
    assert measured_stimuli(load_texts(spark, inbox)).schema == measured_stimuli(stream_texts(spark, str(inbox))).schema
    assert load_stimuli(spark, f"{inbox}/*.txt").count() == 2


class Session:
    """The two things the folder is chosen by."""

    def __init__(self, master: str, folder: str | None):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = SimpleNamespace(master=master, applicationId="app")


def test_shared_dir_comes_from_the_session(spark):
    assert session.scratch_path(Session("yarn", "/shared/place"), "x").startswith("/shared/place/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session("yarn", None))
    assert session.shared_dir(spark) == session.shared_dir(spark)


def test_spread_only_touches_scans_with_few_splits(spark):
    few, many = spark.range(10, numPartitions=1), spark.range(100, numPartitions=50)
    assert session.spread(few).rdd.getNumPartitions() == 8
    assert session.spread(many) is many


def test_broadcast_limits_rows_and_bytes(spark):
    table = spark.createDataFrame([("x" * 1000,)] * 10, "k string")
    assert session.fits_broadcast(table, 10)
    assert not session.fits_broadcast(table, 9)
    assert not session.fits_broadcast(table, 10, max_bytes=9_000)
    assert session.fits_broadcast(table.limit(0), 0)


def test_lookup_side_is_broadcast_only_when_small(spark):
    side = spark.range(5)

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert "broadcast" in plan(spark.range(9).join(session.lookup_side(side, "s"), "id"))
    large = session.lookup_side(side, "s", max_rows=4)
    assert "broadcast" not in plan(spark.range(9).join(large, "id")) and large.count() == 5
