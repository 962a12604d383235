"""Connected components of a graph of links, by alternating stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Hang every node's neighbours (those above it, or those below it and itself) on their smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = storage.skew_join(edges, least, "u")
    if larger_only:
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
    return near.select(pairs.alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node that has a link; root is the component's smallest node.

    ``edges`` has two long columns u, v in any order; nulls and loops are ignored. Every round
    ends in a table in the shared folder, and the driver sees only two sums of it, so a lost
    executor repeats one round at most. No table holds more rows than there are links.
    """
    now = storage.materialize(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = storage.materialize(_star(_star(both, True), False), "stars")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
