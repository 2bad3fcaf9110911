"""Clustering: equal to counting all neighbours' pairs, and no row for each two neighbours of a node."""

import random
import re
from itertools import combinations

from riskloom.operators import graph


def test_equal_to_all_pairs_of_neighbours(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(200)] + [("n1", "n1"), ("n2", "n3"), ("n3", "n2"), ("far", "n1")]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {x: (sum(b in near[a] for a, b in combinations(sorted(near[x]), 2)) * 2.0 / (len(near[x]) * (len(near[x]) - 1)) if len(near[x]) > 1 else 0.0) for x in near}
    got = {r.node: r.clustering for r in graph.clustering(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got.keys() == want.keys() and max(abs(got[x] - want[x]) for x in want) < 1e-12


def test_no_join_of_neighbours_with_each_other(spark):
    edges = spark.createDataFrame([("v1", "a1"), ("v1", "a2"), ("a1", "a2")], "src string, dst string")
    plan = graph.clustering(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"\(x#\d+ < y#\d+\)", plan)
