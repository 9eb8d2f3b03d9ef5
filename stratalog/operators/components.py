"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove, store_at


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).head()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    return (
        both.where(F.col("lo") > F.col("hi"))
        .join(least, "hi")
        .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .where(F.col("hi") != F.col("lo"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.where(F.col("hi") != F.col("lo")).unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node reachable.

    Each round hands every node's larger neighbours to its least neighbour
    (large star), then its smaller ones (small star), so a component of any
    diameter shrinks to a star in a logarithmic number of rounds. Aggregates
    are partial before the shuffle and the joins are plain inner joins, which
    adaptive execution splits where one node has very many edges. Null ends
    and self-loops are ignored. Rounds are stored as files, of which the next
    one reads as many to a task as their size allows, so that few links are
    few tasks; a round's files go when the next ones are there.
    """
    a, b = F.col(src), F.col(dst)
    now, path = store_at(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    seen = _digest(now)
    if seen[0]:
        for _ in range(max_rounds):
            old = path
            now, path = store_at(_small_star(_large_star(now)), "links")
            remove(edges.sparkSession, old)
            digest = _digest(now)
            if digest == seen:
                break
            seen = digest
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
