"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import drop_table, written


def connected(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node that can be reached.

    Each step hangs nodes on the smallest of their neighbours; the minimum is pre-aggregated before it is shuffled,
    and the join back is one that adaptive execution can split, so a node with very many neighbours is no obstacle.
    The rows of each round are written to the shared folder, so no lineage grows and a lost executor costs one round.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # A smaller neighbour that isn't the smallest is hung on the smallest too.
        large = large.distinct()
        parent = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(parent, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        step = written(small.distinct(), "edges")
        counted = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(now)
        now = step
        if counted == before:
            break
        before = counted
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
