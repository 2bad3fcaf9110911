"""The norms of TOPSIS are exact sums: closeness is the same in whatever order rows are added."""

import math

from riskloom.operators import rank


def test_closeness_does_not_depend_on_the_order_of_rows(spark):
    # added as they come, each 1 is lost beside 1e16
    rows = [(0, 1e8, 2.0)] + [(i, 1.0, 1.0 + i % 3) for i in range(1, 4001)]
    criteria = {"risk": (0.5, True), "cost": (0.5, False)}
    norm = {"risk": math.sqrt(math.fsum(r * r for _, r, _ in rows)), "cost": math.sqrt(math.fsum(c * c for _, _, c in rows))}
    v = {i: (r / norm["risk"] * 0.5, c / norm["cost"] * 0.5) for i, r, c in rows}
    hi, lo = (max(x[0] for x in v.values()), min(x[1] for x in v.values())), (min(x[0] for x in v.values()), max(x[1] for x in v.values()))
    want = {i: math.dist(x, lo) / (math.dist(x, hi) + math.dist(x, lo) + 1e-12) for i, x in v.items()}
    for order in (rows, rows[::-1]):
        items = spark.createDataFrame(order, "i int, risk double, cost double").coalesce(1)
        got = {r.i: r.closeness for r in rank.topsis(items, criteria).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-15
    assert set(rank.topsis(items, criteria).columns) == {"i", "risk", "cost", "closeness"}
