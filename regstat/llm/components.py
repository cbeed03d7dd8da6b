"""Connected components of a distributed edge list (large star, small star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regstat.llm.common import cut


def _minima(pairs: DataFrame) -> DataFrame:
    """Per node the smallest of itself and its neighbours."""
    return (pairs.groupBy("u").agg(F.min("v").alias("m"))
            .select(F.col("u").alias("_u"), F.least("u", "m").alias("m")))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step on edges u > v; every step
    keeps the components and brings nodes nearer to their smallest node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = (both.join(_minima(both), F.col("u") == F.col("_u")).filter("v > u")
             .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    linked = large.join(_minima(large), F.col("u") == F.col("_u"))
    return (linked.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(linked.select("u", F.col("m").alias("v"))).distinct())


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; the component is
    its smallest node. ``edges``: (u, v) of one orderable type, any direction;
    loops and repeats are ignored. Each step ends in a reliable checkpoint;
    the steps end when the edge set no longer changes (stars are a fixed
    point), after about log2 of the longest path."""
    now = cut(edges.filter("u <> v")
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)),
                            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(max_steps):
        if not before[0]:
            break
        now = cut(_stars(now))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
