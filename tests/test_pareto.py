"""Fronts of every item, against peeling them off by the definition."""

import os

import numpy as np
import pytest

from riskloom.operators import rank
from riskloom.plans import q_rank, registry

SF = "/root/testdata/sf0.001"


def peeled(rows):
    """Key to front: what no remaining item dominates is a front; then the same with the rest."""
    keys, r, c = [x[0] for x in rows], np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    by = (r[:, None] >= r) & (c[:, None] <= c) & ((r[:, None] > r) | (c[:, None] < c))
    out, left, front = {}, np.ones(len(rows), bool), 0
    above = by.sum(0)
    while left.any():
        front += 1
        now = left & (above == 0)
        out |= {keys[i]: front for i in np.flatnonzero(now)}
        above = above - by[now].sum(0)
        left &= ~now
    return out


def test_layers_go_on_after_the_last_round(spark):
    rows = [(f"k{i}", float(i * 7 % 10), float(i * 3 % 8)) for i in range(40)]
    want = peeled(rows)
    assert max(want.values()) > 5
    df = spark.createDataFrame(rows, "k string, r double, c double")
    assert {x.k: x.front for x in rank.pareto_layers(df, "r", "c", max_layers=2).collect()} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
def test_query_has_every_pair_at_full_precision(spark):
    rows = [tuple(x) for x in q_rank._items(spark, SF).select("pair_key", "composite_risk", "remediation_cost").collect()]
    got = registry.queries()["pareto_layers"](spark, SF).collect()
    assert len(got) == len(rows) and {x.pair_key: x.front for x in got} == peeled(rows)
