"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (pre-aggregated before its shuffle) and an equi-join, written to the shared
folder, so a node that a third of all edges meet is neither collected nor sent through one task; AQE splits
its join partition.  The steps end when the edges stop changing, after a number of rounds that is
logarithmic in the longest path.  Only counts and sums reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.tables import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge in ``edges`` (a, b: long); root is the component's smallest node.

    Null ends and loops are dropped, repeated edges count once; an empty table gives no rows.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e = materialize(oriented(edges))
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = oriented(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hang = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = materialize(oriented(hang.union(low.select("a", F.col("m").alias("b")))))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
