"""Connected components by alternating large and small stars; each round is a written table, nothing comes to the driver but a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.llm.common import Work, lookup


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(pairs: DataFrame, rows: int) -> DataFrame:
    """Pairs (x, y) with m, the least y of each x. Minima are combined before the shuffle and looked up, so the pairs of a hub stay dealt over many tasks."""
    return lookup(pairs, pairs.groupBy("x").agg(F.min("y").alias("m")), "x", rows)


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (src, dst: long) that isn't a root itself; root is the smallest node reachable."""
    e = work.table(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    state = _state(e)
    while state[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select("v", "u"))
        large = _with_least(both, 2 * state[0]).where("y > x").select(F.col("y").alias("x"), F.least("x", "m").alias("y")).distinct()
        large = work.table(large, "large")
        small = _with_least(large, state[0])
        stars = small.select("x", "m").union(small.where("y <> m").select("y", "m")).distinct().toDF("u", "v")
        new = work.table(stars, "stars")
        work.drop(e, large)
        before, state, e = state, _state(new), new
        if state == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
