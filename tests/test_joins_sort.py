"""Joins by vulnerability sort, however small the planner takes a side for: none of it is sent through the driver."""

import re

import pytest

from riskloom.plans import batch as B
from riskloom.plans import q_batch, q_rank

SF = "/root/testdata/sf0.001"


def broadcast_by_vuln(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"BroadcastHashJoin \[[^\]]*vuln_id[^\n]*", plan)


@pytest.mark.parametrize("feedback", (False, True))
def test_features(spark, feedback):
    x = q_batch.estate(spark, SF)
    states = x.pairs.selectExpr("vuln_id", "asset_id", *[f"CAST({i} AS DOUBLE) AS s{i}" for i in range(6)], "0.0D AS entropy", "1.0D AS absorption_time") if feedback else None
    assert broadcast_by_vuln(B.feature_rows(x, states)) == []


def test_items_of_the_ranks(spark):
    assert broadcast_by_vuln(q_rank._items(spark, SF)) == []
