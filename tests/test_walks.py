"""Roll-up by doubling, critical paths without path arrays and betweenness by joins, against brute force."""

import random

from collections import deque
from itertools import combinations

import pytest

from riskloom.operators import graph, risk

UNIT = "bu string, total_risk double, weighted_risk double, asset_count long, mean_risk double, max_risk double"


def below(tree, unit):
    """All units under ``unit``, itself included if the tree lists it."""
    out, todo = set(), [unit]
    while todo:
        a = todo.pop()
        if a not in out:
            out.add(a)
            todo += [u for u, p in tree if p == a and u is not None]
    return out & {u for u, _ in tree}


def check_rollup(spark, tree, own):
    rows = [(u, r, 2 * r, n, r / n, r + 0.5) for u, (r, n) in own.items()]
    got = {r.bu: r for r in risk.hierarchy_rollup(spark.createDataFrame(rows, UNIT), spark.createDataFrame(tree, "unit string, parent string")).collect()}
    units = {x for row in tree for x in row if x is not None}
    assert set(got) == units
    for u in units:
        mine = [own[x] for x in below(tree, u) if x in own]
        total, n = sum(r for r, _ in mine), sum(k for _, k in mine)
        r = got[u]
        assert (r.total_risk, r.weighted_risk, r.asset_count) == (total, 2 * total, n), u
        assert r.mean_risk == (total / n if n else 0.0) and r.max_risk == max((x + 0.5 for x, _ in mine), default=0.0)


def test_rollup_of_a_random_forest(spark):
    rng = random.Random(2)
    tree = [(f"u{i}", f"u{rng.randrange(i)}" if i and rng.random() < 0.95 else None) for i in range(80)] + [("x", "unlisted"), ("u80", "u3"), ("u80", "u3"), ("self", "self")]
    check_rollup(spark, tree, {f"u{i}": (float(i), i % 3 + 1) for i in range(0, 80, 2)} | {"x": (7.0, 2), "self": (1.0, 1), "elsewhere": (9.0, 9)})


def test_rollup_with_circles_counts_each_unit_once(spark):
    tree = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("f", "g"), ("g", "f"), ("top", None), ("t1", "top")]
    check_rollup(spark, tree, {u: (float(i + 1), 1) for i, u in enumerate("abcdefg")} | {"t1": (3.0, 2)})


def test_rollup_where_units_have_two_parents(spark):
    check_rollup(spark, [("a", None), ("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d")], {"d": (2.0, 1), "e": (5.0, 2)})


def test_rollup_of_a_deep_chain_and_of_nothing(spark):
    n = 3000
    tree = spark.range(n).selectExpr("cast(id as string) as unit", "case when id > 0 then cast(id - 1 as string) end as parent")
    units = spark.range(n).selectExpr("cast(id as string) as bu", "1D as total_risk", "2D as weighted_risk", "1L as asset_count", "1D as mean_risk", "cast(id as double) as max_risk")
    got = risk.hierarchy_rollup(units, tree)
    assert got.where(f"asset_count <> {n} - cast(bu as int) or total_risk <> asset_count or max_risk <> {n - 1}").count() == 0 and got.count() == n
    empty = spark.createDataFrame([], "unit string, parent string")
    assert risk.hierarchy_rollup(units, empty).count() == 0


def least_paths(edges, entry):
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


@pytest.mark.parametrize("max_hops", [None, 4])
def test_path_risks_are_those_of_the_least_paths(spark, max_hops):
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(90)}
    value = {n: float(2 ** (n % 30)) for n in range(37)}  # sums tell paths apart; three nodes have none
    entries, targets = [0, 5, 5, 9, 39, 99], [3, 5, 17, 30, 39]
    want = set()
    for s in set(entries):
        for t, p in least_paths(edges, s).items():
            if t in targets and t != s and (max_hops is None or len(p) <= max_hops + 1):
                want.add((s, t, len(p) - 1, sum(value.get(n, 0.0) for n in p)))
    node = lambda x: spark.createDataFrame([(n,) for n in x], "node int")
    df = risk.shortest_path_risks(spark.createDataFrame(sorted(edges), "src int, dst int"), node(entries), node(targets), spark.createDataFrame(list(value.items()), "node int, risk double"), max_hops)
    assert len(want) > 3 and sorted(tuple(r) for r in df.collect()) == sorted(want)


def ego_betweenness(edges, c, radius):
    """From every pair's counts of shortest paths in the ego graph."""
    adj = {}
    for a, b in edges:
        if a != b:
            adj.setdefault(a, set()).add(b)
            adj.setdefault(b, set()).add(a)

    def walk(s, inside, most):
        dist, ways, todo = {s: 0}, {s: 1}, deque([s])
        while todo:
            a = todo.popleft()
            for b in adj.get(a, ()):
                if (inside is None or b in inside) and dist[a] < most:
                    if b not in dist:
                        dist[b], ways[b] = dist[a] + 1, 0
                        todo.append(b)
                    if dist[b] == dist[a] + 1:
                        ways[b] += ways[a]
        return dist, ways

    inside = set(walk(c, None, radius)[0])
    n = len(inside)
    far, to = walk(c, inside, n)
    x = 0.0
    for s, t in combinations(inside - {c}, 2):
        dist, ways = walk(s, inside, n)
        if dist[t] == far[s] + far[t]:
            x += 2 * to[s] * to[t] / ways[t]
    return x / ((n - 1) * (n - 2)) if n > 2 else 0.0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_betweenness_with_leaves_loops_and_double_edges(spark, radius):
    rng = random.Random(radius)
    edges = [(rng.randrange(14), rng.randrange(14)) for _ in range(22)] + [(rng.randrange(14), 20 + i) for i in range(12)] + [(50, 51), (60, 60), (1, 2), (2, 1), (70, 71), (71, 72)]
    nodes = sorted({x for e in edges for x in e}) + [99]
    df = graph.betweenness(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(n,) for n in nodes], "node int"), radius)
    got = {r.node: r.network_exposure_score for r in df.collect()}
    assert len(got) == len(nodes)
    for n in nodes:
        assert got[n] == pytest.approx(ego_betweenness(edges, n, radius), abs=1e-12), n


def test_betweenness_of_a_star_of_a_hundred_thousand(spark):
    edges = spark.range(1, 100_001).selectExpr("0L as src", "id as dst")
    out = graph.betweenness(edges, spark.range(0, 100_001).withColumnRenamed("id", "node")).where("network_exposure_score <> 0")
    assert [(r.node, r.network_exposure_score) for r in out.collect()] == [(0, 1.0)]
