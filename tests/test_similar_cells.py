"""The search for similar vulnerabilities where many are equal in weaknesses, score and vendor."""

import re

import numpy as np

from riskloom.operators import markov


def test_equal_vulnerabilities_share_their_search_and_are_not_broadcast(spark, tmp_path):
    kinds = [(5.0, ["a"], "x"), (5.0, ["a"], None), (9.0, ["a", "b"], "X"), (0.5, [], "y"), (0.5, None, ""), (1.0, ["c"], "y")]
    v = [(i, *kinds[i % 7 % 6]) for i in range(80)] + [(80, 2.0, ["c"], "z")]
    df = spark.createDataFrame(v, "vuln_id long, cvss double, cwe_ids array<string>, vendor string")
    df.write.parquet(f"{tmp_path}/vulns")  # a small file, which the planner would broadcast by itself
    df = spark.read.parquet(f"{tmp_path}/vulns")

    def order(a, b):
        x, y = set(a[2] or []), set(b[2] or [])
        same = a[3] and b[3] and a[3].lower() == b[3].lower()
        s = 0.5 * (len(x & y) / len(x | y) if x | y else 0.0) + 0.3 * max(0, 1 - abs(a[1] - b[1]) / 10) + (0.2 if same else 0)
        return -int(np.floor(s * 1e9 + 0.5)), b[0]

    want = {(a[0], o) for a in v for _, o in sorted(order(a, b) for b in v if a is not b and (set(a[2] or []) & set(b[2] or []) or abs(a[1] - b[1]) < 2))[:5]}
    out = markov.most_similar(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"BroadcastHashJoin \[_?(vuln_id|other|cell)", plan)
    got = [(r.vuln_id, r.other) for r in out.collect()]
    assert set(got) == want and len(got) == len(want)
