"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rota.session import cut_lineage


def _large(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to the smallest node among it and
    its neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.where("b > a").join(low, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return (moved.unionAll(low.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct())


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an undirected link table; root is the
    smallest node of the component. Links of a node to itself and repeated
    links change nothing; an empty table gives no rows.

    Each round is two joins on a node with its own smallest neighbour and ends
    in a checkpoint; a component of diameter d settles in about log d rounds.
    When it has settled each link goes from a node straight to its root.
    """
    links = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
                        .where("a <> b").distinct())
    seen = None
    for _ in range(rounds):
        links = cut_lineage(_small(_large(links)))
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                      .first())
        if state == seen or not state[0]:
            roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
