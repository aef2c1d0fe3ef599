"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, tidy


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


#: Edges of a task.
EDGES = 1 << 16


def _hung(edges: DataFrame) -> DataFrame:
    """(a, b, m): edges with the least neighbour of ``a``."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): for each node of an edge the smallest node it reaches.

    A union-find without a shared forest: alternating star contractions. In
    the large-star step each node hangs its larger neighbours on the smallest
    one in reach; in the small-star step it hangs itself and its smaller
    neighbours there. Both keep what is connected connected, and after a
    number of rounds logarithmic in the longest path only stars are left.

    A node's minimum is joined back to the edges, so a node with millions of
    edges is no list in any task; it is aggregated before the shuffle, and the
    join's partitions can be split. Each round's edges go to
    the shared folder, which cuts the lineage. Null ends and self-loops are
    no edges; an empty table has no nodes.
    """
    a, b = F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")
    now = cut(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(a, b).distinct())
    seen = _digest(now)
    while seen[0]:
        # Tasks in proportion to the edges: late rounds have few, which would otherwise be many small files.
        tasks = max(1, seen[0] // EDGES)
        now = now.coalesce(tasks)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        large = _hung(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).coalesce(tasks)
        small = _hung(large)
        ends = F.explode(F.array(F.col("a"), F.when(F.col("b") != F.col("m"), F.col("b")))).alias("a")
        after = cut(small.select(ends, F.col("m").alias("b")).where("a is not null").coalesce(tasks).distinct().coalesce(tasks))
        digest = _digest(after)
        tidy(edges.sparkSession)  # of the round's shuffles
        now, done, seen = after, digest == seen, digest
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select("b", "b").distinct().toDF("node", "component"))
