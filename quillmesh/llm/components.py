"""Connected components of a graph whose edges lie in a DataFrame, by alternating star contractions.

Each round hangs every node's larger neighbours onto its smallest one, then every node's smaller neighbours and the
node itself onto the smallest. The number of rounds grows with the logarithm of the largest component. A hub's edges
are only ever aggregated to a minimum (with partial aggregates before the shuffle) and joined back to it, never
gathered. Each round's edges are checkpointed in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.shared import shared_dir


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from the larger node u to the smaller node v here."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Columns node and root: for every node of an edge the smallest node of its component.

    Edges with a null end are left out; loops give a component of one node; repeated edges and both directions count
    once; an empty table gives none. Both ends must be of one type with an order.
    """
    spark = edges.sparkSession
    shared_dir(spark)
    a, b = F.col(u), F.col(v)
    given = edges.filter(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    given = given.distinct().checkpoint()
    links = given.filter("u != v")
    loops = given.filter("u = v").select(F.col("u").alias("node"))
    seen = None
    while True:
        links = _small_star(_large_star(links)).checkpoint()
        # Stars are stable: each node has one edge, and no edge's end has one itself.
        mark = tuple(links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    hung = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = links.select(F.col("v").alias("node")).unionAll(loops).distinct().join(links.select(F.col("u").alias("node")), "node", "left_anti")
    return hung.unionByName(roots.select("node", F.col("node").alias("root")))
