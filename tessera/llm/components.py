"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is an aggregation and a join, so no vertex's neighbours meet in one task's memory. The smallest neighbours are
written to the shared folder first: then both sides of the join come straight from a shuffle, and Spark splits the partition of
a vertex with very many edges. After each round the edges are written. The rounds end when the edges are stars around
their smallest nodes. No edges: no rows; loops and repeated edges change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved


#: Edges that a task takes at least; a round of few edges so has few tasks, however many partitions its shuffles have.
EDGES = 1 << 16


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", tasks)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(tasks).distinct()


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = saved(down.groupBy("u").agg(F.min("v").alias("m")), "least", tasks)
    linked = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _stars(edges: DataFrame, tasks: int) -> bool:
    """Whether each u has one edge, to a smaller v that has none itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), (F.col("u") < F.col("v")).cast("int").alias("wrong"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(0).alias("wrong")))
    by = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"), F.max("wrong").alias("wrong"))
    return by.filter("wrong = 1 or up > 1 or up = 1 and n > 1").coalesce(tasks).isEmpty()


def components(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """node, component (its smallest node) for all nodes with an edge to another one; edges: u, v (long). limit: tasks that are enough for the edges, where known."""
    now = saved(edges.filter("u <> v").select("u", "v").distinct(), "edges", limit)
    tasks = -(-now.count() // EDGES) + 5  # a round makes no more edges than the one before
    while not _stars(now, tasks):
        now = saved(_small_star(saved(_large_star(now, tasks), "edges", tasks), tasks), "edges", tasks)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
