"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmill.session import unsized, written


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                                          F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least m of its u.

    They meet by the bits of u inverted, so that both sides are dealt anew: the runtime splits the rows of a hub where a join
    reads two exchanges, not where one side is an aggregate already dealt by u.
    """
    key = F.bitwise_not("u").alias("k")
    return pairs.select(key, "v").join(unsized(least.select(key, "m")), "k")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung below the least of the node and its neighbours."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (_with_least(pairs.filter("v > u"), least).filter("v <> m")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung below the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = _with_least(down, least).filter("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), where root is the least node that can be reached.

    Large-star and small-star steps alternate until the edges no longer change; each round's edges are
    written to the shared folder, so that no round's loss costs the earlier ones. A step shuffles each edge
    a few times and no step gathers a node's neighbours: a hub is a key of a join and of a minimum.
    Loops (a = b) and rows with a null are left out; an empty table gives an empty result.
    """
    now = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if row["n"] == 0 or (row["n"], row["h"]) == state:
            break
        state = (row["n"], row["h"])
        now = written(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
