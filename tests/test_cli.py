"""From feeds over a stored graph to a batch, an assessment, freshness and a back-test, by the commands."""

import io
import json

from riskloom import cli
from riskloom.operators import commits


def run(spark, store, *args):
    out = io.StringIO()
    assert cli.main(["--store", store, "--now", "2024-03-01 00:00:00", *args], spark, out) == 0
    return [json.loads(x) for x in out.getvalue().splitlines()]


def test_commands(spark, tmp_path):
    feeds, store = tmp_path / "feeds", str(tmp_path / "store")
    feeds.mkdir()
    cves = [{"cve": {"id": f"CVE-{i}", "published": "2024-01-01T00:00:00", "descriptions": [{"lang": "en", "value": f"flaw {i}"}], "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 4.0 + i}}]}, "weaknesses": [{"description": [{"value": f"CWE-{i % 2}"}]}], "configurations": [{"nodes": [{"cpeMatch": [{"criteria": f"cpe:2.3:a:v:p{i}:1"}]}]}]}} for i in range(4)]
    (feeds / "nvd.json").write_text(json.dumps({"vulnerabilities": cves}))
    (feeds / "kev.json").write_text(json.dumps({"vulnerabilities": [{"cveID": "CVE-3"}]}))
    (feeds / "exploitdb.csv").write_text("id,description,date_published,codes\n7,boom,2024-02-01,CVE-2\n")
    (feeds / "cmdb.csv").write_text('asset_id,hostname,criticality,business_unit,network_zone,cpe_list,connects_to\nh1,web,high,Eng,dmz,"cpe:/a:V:P0:1,cpe:2.3:a:v:p3:1",h2\nh2,db,critical,Ops,internal,"cpe:2.3:a:v:p2:1,cpe:2.3:a:v:p3:1",h1\n')
    # in order of names: two of the platforms and one vulnerability are known when the last file comes
    report = {r["source"]: r for r in run(spark, store, "import", str(feeds))}
    assert all(r["success"] for r in report.values()) and report["nvd"]["nodes_added"] == 7 and report["exploitdb"]["edges_added"] == 1
    assert run(spark, store, "batch") == [{"pairs": 4, "freshness": run(spark, store, "freshness")[-1]["overall_freshness"], "status": "complete"}]
    risks = {(r.vuln_id, r.asset_id): r for r in commits.read(spark, store, "risks").collect()}
    assert set(risks) == {("CVE-0", "h1"), ("CVE-3", "h1"), ("CVE-2", "h2"), ("CVE-3", "h2")}
    assert sorted(r.final_rank for r in risks.values()) == [1, 2, 3, 4] and risks["CVE-3", "h1"].composite_risk > risks["CVE-0", "h1"].composite_risk
    assert {r.bu for r in commits.read(spark, store, "rollup").collect()} == {"Eng", "Ops"}
    assert spark.read.parquet(f"{store}/features").select("cycle_id").distinct().count() == 2
    one = run(spark, store, "assess", "CVE-3", "h1")
    assert len(one) == 1 and 0 < one[0]["composite_risk"] <= 1 and run(spark, store, "assess", "CVE-9", "h1") == []
    (tmp_path / "store" / "reports").mkdir()
    predicted = [{"vuln_id": v, "asset_id": a, "exploit_likelihood": 0.1 * i, "adjusted_impact": 5.0, "final_rank": 9 - i, "markov_distribution": [1, 0, 0, 0, 0, 0]} for i, (v, a) in enumerate(sorted(risks))]
    happened = [{"vuln_id": v, "asset_id": a, "was_exploited": v == "CVE-3", "actual_impact": 6.0, "actual_state": 0} for v, a in risks]
    (tmp_path / "store" / "reports" / "predictions.json").write_text(json.dumps(predicted))
    (tmp_path / "store" / "reports" / "ground_truth.json").write_text(json.dumps(happened))
    (r,) = run(spark, store, "backtest")
    assert (r["pairs"], r["auc"], r["mae"], r["accuracy"]) == (4, 1.0, 1.0, 1.0)
