"""Exact nearest neighbours that read few cells: vectors by their nearest centroid, cells by a lower bound.

By the triangle inequality no vector of a cell is nearer to a query than the centroid is, less the cell's radius. A search
reads the cells of the least bounds first; once k accepted hits are known, only cells (and in them only distances to the
centroid) that can hold a nearer one are read. What is accepted is judged before the limit, so the answer is that of a scan.
Vectors without an embedding are never found.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillmesh.operators.retrieval import distance

#: Centroids, and the vectors of the sample that they are fitted on; both are bounds of what the driver holds.
CELLS, SAMPLE, ROUNDS = 64, 4_096, 6
#: Room for rounding in comparisons of distances, of their size.
SLACK = 1e-9


def nearest(embedding: Column, centroids: Sequence[Sequence[float]]) -> Column:
    """The nearest centroid's number and its distance: struct of (far, cell)."""
    table = F.from_json(F.lit(json.dumps([[float(x) for x in c] for c in centroids])), "array<array<double>>")

    def far(c: Column, k: Column) -> Column:
        pairs = F.zip_with(embedding, c, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
        return F.struct(F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)).alias("far"), k.alias("cell"))

    return F.array_min(F.transform(table, far))


def fitted(sample: list[list[float]], cells: int) -> list[list[float]]:
    """Centroids of a sample: distinct vectors that lie far apart, then moved to their vectors' means."""
    import numpy as np

    x = np.unique(np.array(sample, np.float64), axis=0)
    if not len(x):
        return []
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(cells, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    centers = x[chosen]
    for _ in range(ROUNDS):
        of = ((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)).argmin(1)
        centers = np.array([x[of == k].mean(0) if (of == k).any() else c for k, c in enumerate(centers)])
    return centers.tolist()


@dataclass
class VectorIndex:
    """Vectors under a folder by cell, with ``to_center``; ``centroids`` and ``cells`` (number, radius, vectors) are bounded by CELLS."""

    spark: SparkSession
    folder: str
    centroids: list[list[float]]
    cells: list[tuple[int, float, int]]
    schema: StructType

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/vectors")

    def bounds(self, query: Sequence[float]) -> list[tuple[float, int, float, int]]:
        """Lower bound, cell, distance to its centroid and number of vectors, the nearest first."""
        out = []
        for cell, radius, n in self.cells:
            d = math.dist(self.centroids[cell], query)
            out.append((max(0.0, d - radius - SLACK * (d + radius)), cell, d, n))
        return sorted(out)

    def within(self, asked: Sequence[tuple[float, int, float, int]], reach: float) -> DataFrame:
        """The vectors of some cells that can lie within ``reach`` of the query."""
        rows = self.vectors.filter(F.col("cell").isin([cell for _, cell, _, _ in asked]))
        if reach == math.inf:
            return rows
        to_query = F.create_map(*[F.lit(x) for _, cell, d, _ in asked for x in (cell, d)])[F.col("cell")]
        return rows.filter(F.abs(F.col("to_center") - to_query) <= reach + SLACK * (reach + 1))

    def search(self, query: Sequence[float], k: int, accept: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
        """The k nearest of the vectors that are accepted, ties by ``key``, with ``distance``.

        ``accept`` is given rows with their distance and returns those that may be shown; of rows that exclude each other
        (one a title) it must leave the nearest.
        """
        order, taken, enough = self.bounds(query), 0, 4 * k
        reach = math.inf
        while taken < len(order) and reach == math.inf:
            # The nearest cells with enough vectors; where too few of these are accepted, four times as many.
            seen = taken = 0
            while taken < len(order) and seen < enough:
                seen, taken = seen + order[taken][3], taken + 1
            best = self._best(self.within(order[:taken], math.inf), query, k, accept, key).select("distance").collect()
            if len(best) == k:
                reach = best[-1]["distance"]
            enough *= 4
        asked = [x for x in order if x[0] <= reach + SLACK * (reach + 1)] if reach < math.inf else order
        return self._best(self.within(asked, reach), query, k, accept, key)

    def _best(self, rows: DataFrame, query: Sequence[float], k: int, accept: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
        near = accept(rows.withColumn("distance", distance(F.col("embedding"), query)).drop("cell", "to_center"))
        return near.orderBy("distance", key).limit(k)


def build(vectors: DataFrame, key: str, folder: str, cells: int = CELLS) -> VectorIndex:
    """Write the vectors by cell. The centroids are fitted on a bounded sample by a hash of the key; every vector is indexed."""
    sample = vectors.select("embedding", F.xxhash64(key).alias("h")).orderBy("h").limit(SAMPLE).collect()
    centroids = fitted([list(r["embedding"]) for r in sample], cells)
    spark = vectors.sparkSession
    found = nearest(F.col("embedding"), centroids) if centroids else F.lit(None).cast("struct<far:double,cell:int>")
    placed = vectors.withColumn("at", found).withColumns({"cell": F.col("at.cell"), "to_center": F.col("at.far")}).drop("at")
    ordered = placed.repartitionByRange("cell", "to_center").sortWithinPartitions("cell", "to_center")
    ordered.write.partitionBy("cell").parquet(f"{folder}/vectors")
    made = VectorIndex(spark, folder, centroids, [], placed.schema)
    held = made.vectors.groupBy("cell").agg(F.max("to_center").alias("radius"), F.count("*").alias("n")).orderBy("cell").collect()
    made.cells.extend((r["cell"], r["radius"], r["n"]) for r in held if r["cell"] is not None)
    return made
