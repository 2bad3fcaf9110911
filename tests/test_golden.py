"""Hand-worked values on small fixtures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.operators import backtest, graph, markov, rank, risk, store
from riskloom.sources import readers

T1 = [[0.5, 0.3, 0.1, 0.05, 0.05, 0], [0, 0.4, 0.3, 0.1, 0.1, 0.1], [0, 0, 0.3, 0.4, 0.2, 0.1], [0, 0, 0, 0.3, 0.4, 0.3], [0, 0, 0, 0, 0.3, 0.7], [0, 0, 0, 0, 0, 1.0]]


def items(spark):
    rows = [("a", 0.9, 0.8, 9.0, 100.0, True, True, 5), ("b", 0.3, 0.2, 3.0, 50.0, False, False, -1), ("c", 0.6, 0.5, 6.0, 200.0, True, False, 30)]
    return spark.createDataFrame(rows, "pair_key string, composite_risk double, exploit_likelihood double, adjusted_impact double, remediation_cost double, has_public_exploit boolean, is_in_kev boolean, exploit_velocity_days int")


def test_prioritisation_pipeline(spark):
    out = {r.pair_key: r for r in rank.pipeline(items(spark), weights={"remediation_cost": 0.15}).collect()}
    assert [out[k].front for k in "abc"] == [1, 1, 2]
    assert [out[k].pareto_rank for k in "abc"] == [1, 2, 3]
    assert [round(out[k].urgency, 4) for k in "abc"] == [3.2175, 0.3, 0.78]
    assert [round(out[k].closeness, 4) for k in "abc"] == [0.6667, 1.0, 0.0]
    assert [out[k].final_rank for k in "abc"] == [1, 2, 3]


def test_pareto_ways_agree(spark):
    rows = [(f"k{i}", float(i * 7 % 10), float(i * 3 % 8)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, r double, c double")
    assert {(x.k, x.front) for x in rank.pareto_layers(df, "r", "c").collect()} == {(x.k, x.front) for x in rank.pareto_chain(df, "r", "c").collect()}


def test_global_rank_is_a_permutation(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    out = rank.global_rank(df, [F.col("x")], "n").collect()
    assert sorted(r.n for r in out) == list(range(1, 5001)) and all(r.n == r.x + 1 for r in out)


def test_absorption_and_evolution(spark):
    df = markov.absorption_time(markov.base_matrix(markov.start(spark.range(1).select(F.lit("v").alias("vuln_id"), F.lit("a").alias("asset_id")))))
    r = df.first()
    assert [round(r[f"t{i}"], 4) for i in range(5)] == [13.2944, 8.8519, 6.9352, 5.4352, 6.8704]
    far = markov.evolved(markov.with_powers(df, 64), 100).first()
    assert abs(sum(far[s] for s in markov.PI) - 1) < 1e-10 and far.s5 > 0.99


def test_general_chain(spark):
    df = spark.createDataFrame([([[float(x) for x in r] for r in T1], [1.0] + [0.0] * 5)], "m array<array<double>>, p array<double>")
    steps = markov.general_chain(df, "m", "p", "absorption").first().absorption
    assert [round(x, 4) for x in steps] == [5.2945, 3.8387, 3.1195, 2.2449, 1.4286]
    assert [round(x, 6) for x in markov.general_chain(df, "m", "p", "steady").first().steady] == [0, 0, 0, 0, 0, 1]
    assert abs(sum(markov.general_chain(df, "m", "p", "continuous", 3.0).first().continuous) - 1) < 1e-9


def test_confidence_and_auc(spark):
    df = spark.createDataFrame([(1.0, 1.0, 60.0)], "raw double, fresh double, age double")
    assert abs(df.select(S.confidence(F.col("raw"), F.col("fresh"), F.col("age"))).first()[0] - math.pow(2, -60 / 90)) < 1e-9
    y = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    assert backtest.auc(y, "s", "y").first().auc == 1.0
    assert backtest.auc(y.where("y = 1"), "s", "y").first().auc == 0.5


def test_propagation_and_paths(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src int, dst int")
    pairs = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 0.5)], "asset_id int, risk double, active_mass double")
    out = {r.asset_id: round(r.propagated_risk, 6) for r in risk.propagated(pairs, edges).collect()}
    assert out == {1: 1.0, 2: 2.0 + 0.7, 3: round(0.7 + 0.7, 6), 4: round(0.49 + 0.49, 6)}
    assert sorted(r.path for r in risk.simple_paths(edges, 1, 3).collect()) == [[1, 2, 3], [1, 3]]
    assert {r.node: r.clustering for r in graph.clustering(edges).collect()}[1] == 1.0


def test_hierarchy_is_ragged(spark):
    tree = spark.createDataFrame([("top", None), ("mid", "top"), ("leaf", "mid"), ("side", "top")], "unit string, parent string")
    units = spark.createDataFrame([("leaf", 2.0, 4.0, 2, 1.0, 1.5), ("top", 1.0, 1.0, 1, 1.0, 1.0)], "bu string, total_risk double, weighted_risk double, asset_count long, mean_risk double, max_risk double")
    out = {r.bu: (r.total_risk, r.asset_count, r.max_risk) for r in risk.hierarchy_rollup(units, tree).collect()}
    assert out == {"top": (3.0, 3, 1.5), "mid": (2.0, 2, 1.5), "leaf": (2.0, 2, 1.5), "side": (0.0, 0, 0.0)}


def test_state_counter_and_registry(spark):
    old = spark.createDataFrame([("a", 1, 3), ("b", 2, 1)], "k string, dominant_state int, updates_in_state int")
    new = spark.createDataFrame([("a", 1), ("c", 0)], "k string, dominant_state int")
    snapshot, _ = store.update_states(old, new, ["k"])
    assert {(r.k, r.dominant_state, r.updates_in_state) for r in snapshot.collect()} == {("a", 1, 4), ("b", 2, 1), ("c", 0, 0)}


def test_what_if_rejects_unknown_action(spark):
    with pytest.raises(ValueError):
        risk.what_if(markov.start(spark.range(1)), "wish")


@pytest.fixture
def feeds(tmp_path):
    def put(name, content):
        p = tmp_path / name
        p.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
        return str(p)

    cve = {
        "id": "CVE-1", "published": "2024-01-01T00:00:00", "descriptions": [{"lang": "es", "value": "no"}, {"lang": "en", "value": "yes"}],
        "metrics": {"cvssMetricV30": [{"cvssData": {"baseScore": 7.5, "vectorString": "V"}}]}, "weaknesses": [{"description": [{"value": "CWE-79"}, {"value": "NVD-x"}]}],
        "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:2.3:a:v:p:1"}, {"criteria": ""}]}]}],
    }
    return [
        put("nvd.json", {"vulnerabilities": [{"cve": cve}, {"cve": {"descriptions": []}}]}),
        put("kev.csv", "﻿cveID,vendorProject,product,dateAdded\nCVE-1,V,P,2024-01-02\nCVE-9,V,Q,2024-01-03\n"),
        put("exploitdb.csv", 'id,description,date_published,codes\n7,boom,2024-01-05,"CVE-1; OSVDB-1;CVE-404"\n,x,,\n'),
        put("cmdb.csv", 'asset_id,hostname,criticality,business_unit,network_zone,cpe_list,connects_to\nh1,web,high,Eng,dmz,"cpe:2.3:a:v:p:1, ",h2\n,ghost,,,,,\n'),
        put("network_scan.json", [{"hostname": "h1", "services": [{"port": 80, "name": "http"}], "connected_to": ["h3"]}]),
        put("siem.json", {"alerts": [{"alert_id": "al1", "asset_id": "h1", "cve_id": "CVE-1"}, {"alert_id": "al2", "cve_id": "CVE-404"}]}),
        put("advisory.json", {"advisories": [{"advisory_id": "ad1", "cve_ids": ["CVE-1"], "patch_available": True}]}),
        put("otx.json", {"objects": [{"type": "indicator", "id": "i1", "external_references": [{"external_id": "CVE-1"}]}, {"type": "threat-actor", "id": "t1", "name": "n"}, {"type": "relationship", "relationship_type": "targets", "source_ref": "t1", "target_ref": "CVE-1"}, {"type": "other", "id": "o"}]}),
        put("readme.txt", "nothing"),
    ]


def test_import_is_free_of_order(spark, feeds):
    for order in (feeds[::-1],):
        nodes, edges = readers.import_files(spark, order)
        n = {r.node_id: (r.node_type, r.attrs) for r in nodes.collect()}
        e = {(r.src, r.dst, r.relation) for r in edges.collect()}
        a = n["CVE-1"][1]
        assert a["cvss_base_score"] == "7.5" and a["description"] == "yes" and a["is_in_kev"] == "true" and a["has_public_exploit"] == "true" and a["patch_available"] == "true"
        assert n["CVE-9"][0] == "Vulnerability" and "CVE-404" not in n and "o" not in n and "" not in n
        assert {("CVE-1", "EDB-7", "REFERENCES"), ("CVE-1", "cpe:2.3:a:v:p:1", "AFFECTS"), ("h1", "cpe:2.3:a:v:p:1", "RUNS"), ("h1", "h2", "CONNECTS_TO"), ("h1", "h3", "CONNECTS_TO"), ("h1", "Eng", "BELONGS_TO"), ("h1", "h1:80/tcp", "HOSTS_SERVICE"), ("al1", "h1", "INDICATES"), ("CVE-1", "al1", "REFERENCES"), ("CVE-1", "ad1", "REFERENCES"), ("t1", "CVE-1", "TARGETS"), ("CVE-1", "i1", "REFERENCES")} <= e
        assert not any("CVE-404" in x for x in e)


def test_routes():
    assert [readers.route(f"/x/{n}") for n in ("NVD-1.json", "cisa_kev.csv", "exploit_db.csv", "asset_inventory.csv", "scan_results.json", "notes.txt")] == ["nvd", "cisa_kev", "exploitdb", "cmdb", "network_scan", None]
