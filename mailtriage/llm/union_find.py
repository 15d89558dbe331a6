"""Connected components of an edge table, as a loop of DataFrame jobs."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailtriage.session import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(id, root)`` for every node that is not the smallest of its component.

    Union-find by alternating contraction: each round hangs every larger neighbour of a node on the
    smallest neighbour (large step), then every node's parents on its smallest parent (small step).
    Edges always point from a larger to a smaller id, so the loop ends with one star per component, after
    about log(longest chain) rounds. A node with very many neighbours is only ever aggregated by partial
    ``min`` and joined by a shuffle that AQE may split. Each round is written to the shared work folder.

    Null ends and loops are ignored; repeated edges count once; no edges give an empty table.
    """
    state = cut(edges.where("a is not null and b is not null and a <> b")
                .select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("root")).distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("id", "root").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == last:
            return state
        last = mark
        both = state.select("id", "root").unionAll(state.select(F.col("root"), F.col("id"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("id"), F.col("m").alias("root"))
                 .distinct())
        large = cut(large, "large")
        lowest = large.groupBy("id").agg(F.min("root").alias("m"))
        small = (large.join(lowest, "id").where("root <> m").select(F.col("root").alias("id"), F.col("m").alias("root"))
                 .unionAll(lowest.select("id", F.col("m").alias("root"))).distinct())
        state = cut(small, "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
