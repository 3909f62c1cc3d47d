"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so nothing about the graph reaches the driver but two
numbers a round. Each round is written to the shared folder, which cuts its lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuadro.session import materialise


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node of its component) for every node that has an edge.

    Null ends and loops are left out; repeated edges count once; no edges give an empty result.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                      .where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u <> v").distinct(), "edges")
    seen = _state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialise(small, "edges")
        after = _state(now)
        if after == seen:
            break
        seen = after
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free digest of the edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
