import random

from quillmesh.llm.components import components


def roots(spark, edges):
    df = components(spark.createDataFrame(edges, "u long, v long"))
    out = [(r["node"], r["root"]) for r in df.collect()]
    assert len(out) == len(dict(out))
    return dict(out)


def test_components_of_random_graphs_chains_stars_and_loops(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000, 2000 + k) for k in range(90)] + [(5000, 5000), (None, 3), (4, None)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in root}
    assert roots(spark, edges) == want


def test_no_edges(spark):
    assert roots(spark, []) == {}
