"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, so a node with very many
neighbours is pre-aggregated on the map side and its join can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvspark.llm.common import shuffle_partitions, written

# Edges in a task that writes a step's table: small tables are not cut into a file a shuffle partition.
TASK_EDGES = 1 << 14


def _progress(edges: DataFrame) -> tuple[int, bool]:
    """Number of edges, and whether they are stars already: each end has one root, and no root has another."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child")))
    node = ends.groupBy("node").agg(F.sum("child").alias("roots"), F.min("child").alias("child"))
    row = node.agg(F.sum("roots").alias("edges"),
                   F.count_if((F.col("roots") > 1) | ((F.col("roots") == 1) & (F.col("child") == 0))).alias("open")).first()
    return row["edges"] or 0, row["open"] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); root is the smallest node reached.

    Loops and repeated edges have no effect; an edge with a null end is left out; an empty
    table gives an empty result.
    """
    a, b = edges.columns
    e = (edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = written(e, "edges")
    held, stars = _progress(e)
    p = shuffle_partitions(e.sparkSession)
    while not stars:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = written(small.coalesce(min(p, -(-held // TASK_EDGES))), "edges")
        held, stars = _progress(e)
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))
