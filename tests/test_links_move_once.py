"""Existing links are taken off by vulnerability: they move once, and no row for each vulnerability and list is shuffled for them."""

import re

from riskloom.operators import graph as G


def test_existing_links_move_once_by_vulnerability(spark):
    aff = spark.createDataFrame([(v, f"c{v % 2}") for v in range(6)] + [(0, "c1")], "vuln_id int, cpe string")
    runs = spark.createDataFrame([(a, f"c{a % 2}") for a in range(10, 20)], "asset_id int, cpe string")
    known = spark.createDataFrame([(0, 10), (0, 11), (1, 11), (1, 12), (9, 10), (None, 10), (2, None)], "vuln_id int, asset_id int")
    out = G.link_by_cpe(aff, runs, known)
    linked = {(v, a) for v, c in aff.collect() for a, d in runs.collect() if c == d}
    assert sorted(map(tuple, out.collect())) == sorted(linked - {tuple(r) for r in known.collect()})
    assert not re.search(r"hashpartitioning\(vuln_id#\d+, _list#", out._jdf.queryExecution().executedPlan().toString())
