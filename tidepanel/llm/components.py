"""Connected components as Spark jobs: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.store import cut

MAX_ROUNDS = 50


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) -> (node long, component long): the smallest node reachable, for nodes that have an edge.

    Self-loops and repeated edges are ignored. Each round is two aggregations and two equi-joins whose large keys Spark
    can split; every round is cut in the shared folder. Ends when a round changes nothing.
    """
    state = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(MAX_ROUNDS):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select((F.col("u") + 0).alias("k"), "m")
        large = both.join(low, both.u == low.k).where("v > u").select("v", "m")
        large = large.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select((F.col("u") + 0).alias("k"), "m")
        small = large.join(low, large.u == low.k).select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x")).select("x.u", F.col("x.m").alias("v")).where("u <> v").distinct()
        state = cut(small)
        now = state.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    out = state.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
