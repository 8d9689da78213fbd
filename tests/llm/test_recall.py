"""The classifier by its recall of both labels on held-out rows."""

from pyspark.sql import functions as F

from lectern.llm import quality


def test_classifier_finds_both_labels(spark):
    where = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{where}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels).filter("held_out").join(labels, "doc_id")
    found = scored.groupBy("quality").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("recall"))
    recall = {r.quality: (r.n, r.recall) for r in found.collect()}
    assert recall[0][1] > 0.5 and recall[1][1] > 0.8
