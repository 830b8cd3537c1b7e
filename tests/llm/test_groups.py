import random

import numpy as np

from tallyloom.llm import groups as G


def brute(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {v: find(v) for v in up}


def test_spanning_forest():
    r = random.Random(0)
    for _ in range(30):
        e = [(r.randint(0, 30), r.randint(0, 30)) for _ in range(r.randint(1, 40))]
        child, root = G.spanning_forest(np.array([x for x, _ in e]), np.array([y for _, y in e]))
        want = brute(e)
        assert dict(zip(child.tolist(), root.tolist())) == {v: g for v, g in want.items() if v != g}


def test_components_of_paths_stars_and_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(G, "BOUND", 50)
    r = random.Random(2)
    path = list(range(1000, 1300))
    r.shuffle(path)
    shapes = [
        list(zip(path, path[1:])), [(7, i) for i in range(100, 400)], [(i, 400) for i in range(100, 400)], [(i + 1, i) for i in range(200)],
        [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(None, 1), (2, None), (3, 3), (4, 5), (5, 4), (4, 5)],
    ]
    for e in shapes:
        df = spark.createDataFrame(e, "a long, b long").repartition(5)
        assert {x["vertex"]: x["root"] for x in G.components(df).collect()} == brute(e)
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_consolidate(spark):
    pairs = spark.createDataFrame(
        [(1, 2, 0.95, "first_pass"), (2, 3, 0.5, "first_pass"), (4, 3, None, "household"), (5, None, 1.0, "first_pass"), (6, 6, 1.0, "first_pass"), (7, 8, None, "first_pass"), (2, 1, 0.9, "x"), (None, None, None, None)],
        "unique_id_l long, unique_id_r long, match_probability double, via string",
    )
    clusters = spark.createDataFrame([(3, "A"), (9, "A"), (10, "B"), (11, None), (12, None), (3, "A"), (None, "A")], "unique_id long, cluster_id string").repartition(3)
    got = {r["unique_id"]: r["group_id"] for r in G.consolidate(pairs, clusters).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 9: 3}
    assert G.consolidate(pairs.limit(0), clusters.limit(0)).count() == 0
