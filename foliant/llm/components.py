"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.session import cut


SALTS = 32


def _with_least(edges: DataFrame) -> DataFrame:
    """Adds m, the least v of each u. Minima are combined by (u, salt), then by u, and go back by (u, salt): a hub's edges are dealt to many tasks."""
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    least = dealt.groupBy("u", "salt").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))
    return dealt.join(least.select("u", "m", F.explode("salts").alias("salt")), ["u", "salt"]).select("u", "v", "m")


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b) but the roots; root is the smallest node reachable.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest of
    them, until nothing changes: then each node is linked to its root alone. Each round is cut by a
    checkpoint. Null ends and loops are ignored, repeated links count once. No links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = cut(edges)
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        # The least neighbour itself stays linked, the others are linked to it.
        edges = cut(_with_least(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
