"""Connected components of a link table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splicelake.llm.common import discard, stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of ``links``; the root is the smallest node of its component.

    Each round every node goes to its smallest neighbour or stays, links are renamed, and
    links inside one node vanish; the rounds end when none is left. Only their
    number reaches the driver. Every round's tables are written, so no lineage grows.
    """
    spark = links.sparkSession
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges, edges_at = stage(ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x <> y").distinct())
    roots, roots_at = stage(edges.select(F.col("x").alias("node"), F.col("x").alias("root")).distinct())
    while edges.limit(1).count():
        step, step_at = stage(edges.groupBy("x").agg(F.least("x", F.min("y")).alias("to")))
        new_roots, new_roots_at = stage(
            roots.join(step, roots["root"] == step["x"], "left").select("node", F.coalesce("to", "root").alias("root"))
        )
        left = edges.join(step, "x").select("y", F.col("to").alias("x1"))
        right = step.select(F.col("x").alias("y"), F.col("to").alias("y1"))
        new_edges, new_edges_at = stage(
            left.join(right, "y").filter("x1 <> y1").select(F.col("x1").alias("x"), F.col("y1").alias("y")).distinct()
        )
        discard(spark, edges_at, roots_at, step_at)
        edges, edges_at, roots, roots_at = new_edges, new_edges_at, new_roots, new_roots_at
    return roots
