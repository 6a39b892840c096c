"""Connected components by alternating star contraction, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorlens.llm.shared import stored


def state_of(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) of longs to (id, root): every id that has an edge, with the smallest id of its component.

    Large star hangs all larger neighbours of a node on its smallest one, small star the smaller ones; the two
    alternate until every component is one star. Rounds grow with the logarithm of the path length.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = stored(e, "edges")
    before = state_of(e)
    while before[0]:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = state_of(e)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(roots)
