"""Pairs are never the side that is broadcast, and are grouped where lines were dealt by pair: no task's groups grow with the table."""

from riskloom.plans import projection as P
from riskloom.plans import registry

SF = "/root/testdata/sf0.001"


def test_lines_are_dealt_by_pair_and_assets_are_broadcast(spark):
    plan = P.with_criticality(P.pairs(spark, SF), spark, SF)._jdf.queryExecution()
    pairs = P.pairs(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_partkey" in pairs
    assert "rightHint=(strategy=broadcast)" in plan.optimizedPlan().toString()
    assert registry.queries()["what_if"](spark, SF).count() == 3 * P.pairs(spark, SF).count()
