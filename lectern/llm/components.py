"""Connected components of a table of links, by alternating star operations.

Large star: every node links its larger neighbours to the smallest node it knows. Small
star: it links its smaller neighbours and itself to that node. Both keep components
whole; they end when every node links straight to its component's smallest node. No
step holds a node's neighbours together: minima are pre-aggregated and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import save_stage


def _minimum(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _minimum(both).select("a", F.least("a", "m").alias("m"))
    larger = both.join(least, "a").filter("b > a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = _minimum(links)
    linked = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _mark(links: DataFrame) -> tuple:
    sums = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    return tuple(sums.first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` of every node that a link names; the root is the smallest node.

    Links may repeat and point either way; a link from a node to itself names nothing.
    Each round is a table in the shared folder, so plans stay short and lost executors
    cost at most a round.
    """
    ends = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    table = save_stage(ends.filter("a <> b").distinct(), "links")
    mark = _mark(table)
    while mark[0]:
        table = save_stage(_small_star(_large_star(table)), "links")
        before, mark = mark, _mark(table)
        if before == mark:
            break
    roots = table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return table.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
