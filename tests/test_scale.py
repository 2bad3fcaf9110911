"""Steps whose work must not grow faster than their input: what moves, and in how many rows."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph


def _random_graph(n, m, seed):
    rng = random.Random(seed)
    return sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b})


def test_betweenness_of_small_ego_graphs_is_not_joined_and_equals_the_joins(spark, monkeypatch):
    edges, nodes = spark.createDataFrame(_random_graph(60, 110, 5), "src int, dst int"), spark.range(60).select(F.col("id").cast("int").alias("node"))
    by_joins = graph._through_by_joins
    monkeypatch.setattr(graph, "_through_by_joins", lambda *a: pytest.fail("joined"))
    got = {r.node: r.network_exposure_score for r in graph.betweenness(edges, nodes, 2).collect()}
    monkeypatch.setattr(graph, "_through_by_joins", by_joins)
    for limit in (0, 12):  # all by joins; some by joins, some in matrices
        monkeypatch.setattr(graph, "EGO_NODES", limit)
        want = {r.node: r.network_exposure_score for r in graph.betweenness(edges, nodes, 2).collect()}
        assert want.keys() == got.keys() and max(got.values()) > 0
        assert all(got[n] == pytest.approx(want[n], abs=1e-12) for n in got)


def test_betweenness_of_named_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "x"), ("x", "y")], "src string, dst string")
    got = {r.node: r.network_exposure_score for r in graph.betweenness(edges, spark.createDataFrame([(n,) for n in "abcdxy"], "node string"), 3).collect()}
    # of b's 5 others, paths through b: x, y to each of a, c, d (6), a to c (half)
    assert got["b"] == pytest.approx(6.5 / 10) and got["y"] == 0


def test_path_depth_walks_many_starts_in_few_rows(spark, monkeypatch):
    """200 starts, all of which reach all of 40 nodes: a row for each node and 64 starts, not one for each node and start."""
    rows, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    n = 40
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in range(n)] + [(200 + i, i % n) for i in range(200)], "src int, dst int")
    starts = spark.createDataFrame([(v, 200 + v) for v in range(200)] + [(7, None), (8, 3)], "vuln_id int, node int")
    pairs = spark.createDataFrame([(v, a) for v in range(200) for a in (0, 17)] + [(5, 999), (300, 1)], "vuln_id int, asset_id int")
    got = {(r.vuln_id, r.asset_id): r.attack_path_depth for r in graph.path_depth(edges, starts.coalesce(1), pairs).collect()}
    want = {(v, a): 1.0 + (a != v % n) for v in range(200) for a in (0, 17)} | {(5, 999): -1.0, (300, 1): -1.0}
    want[8, 17] = want[8, 0] = 1.0
    assert got == want
    assert max(rows) <= max(edges.count(), 12 * (n + 200))
