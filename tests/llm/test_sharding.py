"""Shard numbers against rendezvous hashing in plain Python."""

import hashlib
import math
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import sharding
from lectern.llm.queries import op5_shard

SMALL = "/root/testdata/sf0.001"


def plain_shard(key, weights):
    """The shard whose draw, from the first twelve digits of an MD5 sum, is lowest."""
    text = "" if key is None else str(key)
    draws = []
    for shard, weight in enumerate(weights):
        digits = hashlib.md5(f"{text}/{shard}".encode()).hexdigest()[:12]
        draws.append((-math.log((int(digits, 16) + 0.5) / 16**12) / weight, shard))
    return min(draws)[1]


@pytest.mark.parametrize("weights", [[1.0], [1.0] * 16, [1.0, 2.0, 0.5, 4.0]])
def test_shard_of_a_key(spark, weights):
    keys = [None, -7, 0, *range(1, 3000, 7), 2**62]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    found = df.select("k", sharding.rendezvous_shard(F.col("k"), weights).alias("s")).collect()
    assert {r["k"]: r["s"] for r in found} == {k: plain_shard(k, weights) for k in keys}


def test_query_on_the_small_tables(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = op5_shard(spark, SMALL).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = {}
    for d, text in rows:
        raw = (text or "").encode()
        want[d] = (len(raw) + 1, zlib.crc32(raw), "key", plain_shard(d, [1.0] * 16), plain_shard(d, [1.0] * 17))
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in found}
    assert len(found) == len(rows) and got == want
    assert all(s == g or g == 16 for *_, s, g in got.values())
