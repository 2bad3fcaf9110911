"""Walks without a hop limit, against brute force on graphs longer than the limits they had before."""

import random

from collections import deque

from riskloom.operators import graph, risk


def bfs(edges, root):
    """Least hops from root to each node, root included."""
    out, todo = {root: 0}, deque([root])
    while todo:
        a = todo.popleft()
        for x, b in edges:
            if x == a and b not in out:
                out[b] = out[a] + 1
                todo.append(b)
    return out


def test_path_depth_has_no_hop_limit(spark):
    edges = [(i, i + 1) for i in range(19)] + [(3, 0), (5, 9), (30, 31)]
    starts = [("v", 0), ("w", 8), ("w", 30), ("x", 40)]
    pairs = [(v, a) for v in "vwx" for a in (0, 2, 7, 12, 19, 31, 40)]
    reach = {v: [bfs(edges, n) for u, n in starts if u == v] for v in "vwx"}
    want = {(v, a): float(min((r[a] for r in reach[v] if a in r), default=-1)) for v, a in pairs}
    assert want["v", 19] == 16  # far beyond six hops, and past one cut of the union
    df = graph.path_depth(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(starts, "vuln_id string, node int"), spark.createDataFrame(pairs, "vuln_id string, asset_id int"))
    assert {(r.vuln_id, r.asset_id): r.attack_path_depth for r in df.collect()} == want


def test_critical_paths_has_no_hop_limit(spark):
    edges = [(i, i + 1) for i in range(1, 20)] + [(1, 3), (1, 2), (4, 7), (4, 6), (6, 8), (12, 1)]
    value = {i: float(i % 4 + 1) for i in range(1, 21)}
    zone = {1: "dmz", 5: "External"}
    tier = {10: "high", 15: "Critical", 20: "critical", 3: "low"}

    def shortest(entry):
        """Each node's least path among its shortest."""
        out, level = {entry: [entry]}, {entry: [entry]}
        while level:
            step = {}
            for a, p in level.items():
                for x, b in edges:
                    if x == a and b not in out:
                        step[b] = min(step.get(b, [*p, b]), [*p, b])
            out |= step
            level = step
        return out

    want = [(e, t, len(p) - 1, sum(value[n] for n in p)) for e in zone for t, p in shortest(e).items() if t in (10, 15, 20) and t != e]
    want.sort(key=lambda x: (-x[3], x[0], x[1]))
    assert want[0][2] > 8 and len(want) == 6
    assets = spark.createDataFrame([(i, zone.get(i, "internal"), tier.get(i, "medium")) for i in value], "asset_id int, zone string, criticality string")
    df = risk.critical_paths(assets, spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(list(value.items()), "asset_id int, direct_risk double"))
    assert [(r.entry, r.target, r.hops, r.path_risk) for r in df.collect()] == want


def test_simple_paths_equal_a_walk_over_all(spark):
    rng = random.Random(11)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(40)}
    df = spark.createDataFrame(sorted(edges), "src int, dst int")

    def walk(path, most):
        if path[-1] == 5 and len(path) > 1:
            yield path
        elif len(path) <= most:
            for a, b in edges:
                if a == path[-1] and b not in path:
                    yield from walk([*path, b], most)

    for most in (1, 3, 4):
        got = sorted((r.hops, r.path) for r in risk.simple_paths(df, 0, 5, most).collect())
        assert got == sorted((len(p) - 1, p) for p in walk([0], most))
    assert risk.simple_paths(df, 0, 99, 3).count() == 0
