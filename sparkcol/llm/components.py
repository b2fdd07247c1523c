"""Connected components over DataFrames of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(pairs: DataFrame, keep: str) -> DataFrame:
    """Each pair (u, v) becomes (v, m), m the least node among u and its partners in ``pairs``."""
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return pairs.where(keep).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges`` (a, b: long) -> (node, root), root being the least node of the component; nodes without edges are left out.

    Every round links nodes to the least neighbour they see, first along larger then along smaller neighbours, until
    each component is a star. Hubs are safe: minima are pre-aggregated and materialised, so that what joins them comes straight
    from an exchange and adaptive execution can split a hub's rows.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, "v > u").where("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = cut(down.groupBy("u").agg(F.min("v").alias("m")))
        small = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        new = cut(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct())
        was, state, now = state, _state(new), new
        if state == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
    raise RuntimeError("components did not settle")
