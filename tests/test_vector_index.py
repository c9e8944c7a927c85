import math
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import retrieval, vector_index

SCHEMA = "vec_id long, title string, embedding array<float>"


def around(r, center, spread):
    return [c + r.gauss(0, spread) for c in center]


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(4)
    centers = [[r.gauss(0, 10) for _ in range(8)] for _ in range(20)]
    rows = [(k, f"t{k % 90}", around(r, centers[k % 20], 0.5)) for k in range(2000)]
    rows += [(2000 + k, "copy", rows[7][2]) for k in range(30)]  # ties
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return vector_index.build(vectors, "vec_id", f"file://{tmp_path_factory.mktemp('vectors')}/v", 32)


def scan(vectors, query, k, accept):
    return [(r["vec_id"], r["distance"]) for r in retrieval.vector_top_k(vectors, query, k, accept, "vec_id").collect()]


@pytest.mark.parametrize("which", [0, 7, 1234, "far", "middle"])
def test_answers_are_those_of_a_scan(index, vectors, which):
    query = {"far": [100.0] * 8, "middle": [0.0] * 8}.get(which) or list(vectors.filter(F.col("vec_id") == which).first()["embedding"])
    for k, accept in ((1, F.lit(True)), (10, F.col("vec_id") % 3 != 0), (40, F.col("title") == "t5"), (3, F.lit(False))):
        got = index.search(query, k, lambda rows, a=accept: rows.filter(a), "vec_id")
        assert [(r["vec_id"], r["distance"]) for r in got.collect()] == scan(vectors, query, k, accept)


def test_one_hit_a_title(index, vectors):
    query = [1.0] * 8
    first = lambda rows: retrieval.first_per_title(rows.withColumn("order", F.struct("distance", "vec_id")), "order")
    got = [(r["title"], r["vec_id"]) for r in index.search(query, 12, first, "vec_id").collect()]
    whole = first(vectors.withColumn("distance", retrieval.distance(F.col("embedding"), query))).orderBy("distance", "vec_id").limit(12)
    assert got == [(r["title"], r["vec_id"]) for r in whole.collect()] and len({t for t, _ in got}) == 12


def test_most_cells_are_not_read(index, vectors):
    query = list(vectors.filter("vec_id = 1234").first()["embedding"])
    found = index.search(query, 5, lambda rows: rows, "vec_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    cells = plan.split("PartitionFilters: [")[1].split("]")[0]
    reach = scan(vectors, query, 5, F.lit(True))[-1][1]
    near = [x for x in index.bounds(query) if x[0] <= reach + 1e-6]
    assert "cell" in cells and len(near) < len(index.cells) / 4
    assert index.within(near, reach).count() < 200 < vectors.count()
    assert all(math.dist(index.centroids[c], query) - r <= d + 1e-6 for b, c, d, _ in index.bounds(query) for c2, r, _ in index.cells if c2 == c)


def test_empty_and_single(spark, tmp_path):
    none = vector_index.build(spark.createDataFrame([], SCHEMA), "vec_id", f"file://{tmp_path}/a")
    assert none.search([0.0, 1.0], 3, lambda rows: rows, "vec_id").count() == 0
    one = vector_index.build(spark.createDataFrame([(1, "t", [1.0, 2.0])] * 3, SCHEMA), "vec_id", f"file://{tmp_path}/b")
    assert [r["distance"] for r in one.search([1.0, 0.0], 2, lambda rows: rows, "vec_id").collect()] == [2.0, 2.0]
