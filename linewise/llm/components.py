"""Connected components by repeated smallest-neighbour hooking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.llm.common import written


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node of
    its component.

    In each round every node tells its neighbours its smallest neighbour; they
    hook to that.  The graph shrinks to stars in a logarithmic number of
    rounds.  Each round is written to the shared folder, so lineage stays short
    and no round is lost with an executor; nothing but a count and a checksum
    comes to the driver."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), name)

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        return r[0], r[1]

    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        told = both.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = written(told.unionByName(least.select("a", F.col("low").alias("b"))).filter("a > b").distinct(), name)
        after = state(now)
        if after == before:
            break
        before = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
