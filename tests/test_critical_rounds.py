"""Critical paths hold bits and not a row for each pair, in rounds of entries, with the rows of the walk over all pairs."""

import random

from pyspark.sql import functions as F

from riskloom.operators import risk


def test_rounds_and_bounds_give_the_rows_of_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    n = 330
    edges = sorted({(i, rng.randrange(n)) for i in range(n) for _ in range(3)})
    zone = ["dmz" if i % 10 else "internal" for i in range(n)]  # 297 entries: two blocks
    tier = [rng.choice(["high", "low"]) for _ in range(n)]
    value = [(i, rng.randrange(100, 140) / 4) for i in range(n) if i % 7]
    assets = spark.createDataFrame([(i, zone[i], tier[i]) for i in range(n)], "asset_id int, zone string, criticality string")
    connects, of = spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(value, "asset_id int, direct_risk double")
    nodes = lambda keep: spark.createDataFrame([(i,) for i in range(n) if keep(i)], "node int")
    every = risk.shortest_path_risks(connects, nodes(lambda i: zone[i] == "dmz"), nodes(lambda i: tier[i] == "high"), of.withColumnsRenamed({"asset_id": "node", "direct_risk": "risk"}))
    want = [tuple(r) for r in every.orderBy(F.desc("path_risk"), "entry", "target").limit(6).collect()]

    def all_pairs(*args):
        raise AssertionError("a row for each pair")

    monkeypatch.setattr(risk, "shortest_path_risks", all_pairs)
    assert [tuple(r) for r in risk.critical_paths(assets, connects, of, 6, pairs_a_round=1).collect()] == want
