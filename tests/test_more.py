"""Similarity, layers, stores, sources, models and text against brute force, round trips and odd inputs."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.functions.lineage import new_folder
from riskloom.operators import graph, markov, ml, rank, risk, service, store, text
from riskloom.sources import readers, sinks


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_most_similar_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    v = []
    for i in range(70):
        weak = rng.sample("abcdefgh", rng.randint(0, 3)) if rng.random() < 0.8 else ["a"]
        v.append((i, rng.choice([0.0, 1.1, 2.5, 4.9, 5.0, 7.3, 9.8, 10.0]), weak, rng.choice(["x", "X", "y", "", None])))
    df = spark.createDataFrame(v, "vuln_id int, cvss double, cwe_ids array<string>, vendor string")

    def sim(a, b):
        union = set(a[2]) | set(b[2])
        j = len(set(a[2]) & set(b[2])) / len(union) if union else 0.0
        same = a[3] and b[3] and a[3].lower() == b[3].lower()
        return 0.5 * j + 0.3 * max(0, 1 - abs(a[1] - b[1]) / 10) + (0.2 if same else 0)

    want = {}
    for a in v:
        near = [(-int(np.floor(sim(a, b) * 1e9 + 0.5)), b[0]) for b in v if a is not b and (set(a[2]) & set(b[2]) or abs(a[1] - b[1]) < 2)]
        want[a[0]] = [i for _, i in sorted(near)[:3]]
    got = {}
    for r in markov.most_similar(df, 3).collect():
        got.setdefault(r.vuln_id, []).append((-int(np.floor(r.similarity * 1e9 + 0.5)), r.other))
    assert {k: [i for _, i in sorted(x)] for k, x in got.items()} == {k: x for k, x in want.items() if x}


@pytest.mark.parametrize("each", [7, 1000])
def test_pareto_chain_over_ranges_equals_peeling(spark, each):
    rng = random.Random(each)
    rows = [(f"k{i}", float(rng.randint(0, 12)), float(rng.randint(0, 9))) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, r double, c double")
    left, layer, want = list(rows), 1, {}
    while left:
        front = [a for a in left if not any(b[1] >= a[1] and b[2] <= a[2] and (b[1] > a[1] or b[2] < a[2]) for b in left)]
        want |= {a[0]: layer for a in front}
        left, layer = [a for a in left if a not in front], layer + 1
    assert {x.k: x.front for x in rank.pareto_chain(df, "r", "c", each).collect()} == want
    assert {x.k: x.front for x in rank.pareto_layers(df, "r", "c").collect()} == want


def test_one_cost_means_a_layer_a_risk(spark):
    df = spark.createDataFrame([("a", 3.0, 1.0), ("b", 1.0, 1.0), ("c", 3.0, 1.0)], "k string, r double, c double")
    assert {x.k: x.front for x in rank.pareto_chain(df, "r", "c").collect()} == {"a": 1, "b": 2, "c": 1}


def test_hierarchy_of_forty_levels(spark):
    tree = spark.createDataFrame([(f"u{i}", f"u{i - 1}" if i else None) for i in range(40)], "unit string, parent string")
    assert risk.hierarchy_closure(tree).count() == 40 * 41 // 2


def test_percentiles_by_rank(spark):
    x = [random.Random(5).uniform(0, 1) for _ in range(101)] + [0.5] * 30
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "x double")
    r = service.percentiles(df, "x", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}).first()
    assert np.allclose([r.a, r.b, r.c, r.d], np.percentile(x, [50, 95, 0, 100]))
    assert service.percentiles(df.where("false"), "x", {"a": 0.5}).first().a is None


def test_import_report_counts_and_failures(spark, tmp_path):
    (tmp_path / "cmdb.csv").write_text("asset_id,hostname\nh1,web\nh2,db\n")
    (tmp_path / "kev.json").write_text("not json")
    (tmp_path / "siem.json").write_text(json.dumps([{"alert_id": "a1", "asset_id": "h1"}]))
    (tmp_path / "notes.txt").write_text("x")
    paths = readers.importable(spark, str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["cmdb.csv", "kev.json", "siem.json"]
    nodes, edges, report = readers.import_report(spark, [*paths, str(tmp_path / "notes.txt")])
    got = {r.source: (r.nodes_added, r.edges_added, r.success) for r in report.collect()}
    assert got == {"cmdb": (2, 0, True), "cisa_kev": (0, 0, False), "siem_alerts": (1, 1, True), "unknown": (0, 0, False)}
    assert {r.node_id for r in nodes.collect()} == {"h1", "h2", "a1"}
    assert readers.within(f"{tmp_path}/x/../kev.json", str(tmp_path)) and not readers.within(f"{tmp_path}/../etc", str(tmp_path))
    refused = readers.trigger_import(spark, "/etc/cmdb.csv", str(tmp_path)).first()
    assert not refused.success and refused.source == "unknown"


def test_nvd_score_and_vector_come_from_one_version(spark, tmp_path):
    cve = {"id": "CVE-1", "metrics": {"cvssMetricV31": [{"cvssData": {"baseScore": 5.0}}], "cvssMetricV30": [{"cvssData": {"baseScore": 9.0, "vectorString": "V30"}}]}}
    (tmp_path / "nvd.json").write_text(json.dumps({"vulnerabilities": [{"cve": cve}]}))
    n = readers.nvd(spark, str(tmp_path / "nvd.json"))[0].first()
    assert float(n.attrs["cvss_base_score"]) == 5.0 and "cvss_vector" not in n.attrs


def test_documents_are_cut_into_records():
    doc = {"format": "x", "n": [1, {"vulnerabilities": [9]}], "vulnerabilities": [{"a": "]},"}, [1], "s", 2.5, None], "z": 1}
    for indent in (None, 2):
        assert [json.loads(t) for t in readers.record_texts(json.dumps(doc, indent=indent), "vulnerabilities")] == doc["vulnerabilities"]
        assert [json.loads(t) for t in readers.record_texts(json.dumps([1, [2]], indent=indent), "vulnerabilities")] == [1, [2]]
    assert list(readers.record_texts("{}", "x")) == [] and list(readers.record_texts('{"x": 3}', "x")) == [] and list(readers.record_texts(" [ ] ", "x")) == []


def test_graphml_keeps_markup(spark):
    nodes = spark.createDataFrame([("a&b", "Asset", {"name": '<"x">'}), ("c", "CWE", {})], readers.NODE)
    edges = spark.createDataFrame([("a&b", "c", "HAS_CWE")], readers.EDGE)
    path = new_folder(spark, "graphml")
    sinks.save_graphml(nodes, edges, path)
    n, e = readers.graphml(spark, path)
    assert {(r.node_id, r.node_type, r.attrs.get("name")) for r in n.collect()} == {("a&b", "Asset", '<"x">'), ("c", "CWE", None)}
    assert [tuple(r) for r in e.collect()] == [("a&b", "c", "HAS_CWE")]


def test_config_falls_back_to_empty(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("weights:\n  a: 0.5\n  b: [1, 2]\n")
    assert {tuple(r) for r in readers.config_table(spark, str(tmp_path / "c.yaml"), "weights").collect()} == {("a", "0.5"), ("b", "[1, 2]")}
    assert readers.config_table(spark, str(tmp_path / "none.yaml"), "weights").count() == 0


def test_models_round_trip_and_folds(spark):
    rng = random.Random(1)
    rows = [(i, f"a{i % 3}", float(x := rng.uniform(0, 10)), float(x > 5), float(x), float(int(x / 2.6))) for i in range(120)]
    df = spark.createDataFrame(rows, "vuln_id int, asset_id string, cvss double, y double, impact double, tier double")
    assert ml.cross_validated(df, ["cvss"], "y", "elp", 3, maxIter=3, maxDepth=2) > 0.9
    assert ml.cross_validated(df, ["cvss"], "impact", "isa", 3, maxIter=5, maxDepth=3) < 2.5
    assert ml.cross_validated(df, ["cvss"], "tier", "acc", 3, numTrees=5, maxDepth=4) > 0.8
    model = ml.train_elp(df, ["cvss"], "y", maxIter=2, maxDepth=2)
    folder = new_folder(spark, "models")
    ml.save(model, f"{folder}/elp-1")
    registry = spark.createDataFrame([("elp", "1", "production", "2024-01-01"), ("elp", "0", "archived", "2024-02-01")], "model string, version string, status string, trained_at string")
    loaded, version = ml.load_version(registry, "elp", folder)
    assert version == "1" and ml.load_version(registry, "isa", folder) is None
    a, b = (sorted(tuple(r) for r in ml.predict(df, m, ["cvss"], "elp").collect()) for m in (model, loaded))
    assert a == b
    features = df.select("vuln_id", "asset_id", "cvss", F.lit(False).alias("is_in_kev"), F.lit(False).alias("has_public_exploit"))
    out = ml.infer(features, {"elp": (loaded, ["cvss"])}, F.lit(1.0), {"elp": F.lit(0.0), "isa": F.lit(5.0), "acc": F.lit(2.0)}).collect()
    assert len(out) == 120 and all(r.model_age_days == 5.0 and 0.05 <= r.exploit <= 1 for r in out)


def test_staging_training_needs_rows(spark):
    scan = spark.createDataFrame([(float(i % 10), 1.0, 2.0, 3.0, 1.0, float(i % 2), 2.0) for i in range(12)], "cvss_base_score double, exploitability double, impact double, ref_count double, config_count double, y_elp double, y_isa double")
    small = {"elp": {"maxIter": 1, "maxDepth": 1}, "isa": {"maxIter": 1, "maxDepth": 1}, "acc": {"numTrees": 2, "maxDepth": 2}}
    assert set(ml.train_staging(scan, small)) == {"elp", "isa", "acc"}
    with pytest.raises(ValueError):
        ml.train_staging(scan.limit(3), small)


def test_svd_spans_the_top_directions(spark):
    rng = np.random.default_rng(3)
    a = rng.random((40, 12)) * (rng.random((40, 12)) < 0.5)
    w = spark.createDataFrame([(i, f"t{j:02d}", float(a[i, j])) for i in range(40) for j in range(12) if a[i, j]], "k int, term string, weight double")
    got = {r.k: np.array(r.embedding) for r in text.svd_embedding(w, "k", 5).collect()}
    x = np.stack([got.get(i, np.zeros(5)) for i in range(40)])
    u, s, _ = np.linalg.svd(a)
    assert np.allclose(x @ x.T, (u[:, :5] * s[:5] ** 2) @ u[:, :5].T, atol=1e-3)
    assert len(text.svd_embedding(w, "k", 20).first().embedding) == 20


def test_text_backends(spark):
    docs = spark.createDataFrame([(1, "remote code execution in parser"), (2, "the and of"), (3, "parser overflow")], "k int, t string")
    made = {r.k: r.embedding for r in text.backend("tfidf")(docs, "k", "t", 4).collect()}
    assert set(made) == {1, 3} and all(len(v) == 4 for v in made.values())  # stop words alone leave nothing
    table = spark.createDataFrame([(1, [0.5, 0.25])], "id int, v array<float>")
    out = text.expanded(text.backend("table")(docs, "k", table, "id", "v"), "embedding", 3).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, 0.5, 0.25, 0.0), (2, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0)]
    with pytest.raises(ValueError):
        text.backend("transformer")
    row = spark.range(1).select(text.vulnerability_text(F.lit(" a "), F.lit(None).cast("string"), F.lit("CWE-1; CWE-2"), F.lit("id")).alias("x"), text.vulnerability_text(F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit("id")).alias("y")).first()
    assert (row.x, row.y) == ("a CWE-1 CWE-2", "id")


def test_stores_create_save_and_prune(spark):
    folder = new_folder(spark, "stores")
    store.create_tables(spark, folder)
    store.create_tables(spark, folder)
    assert store.table(spark, f"{folder}/import_log", "records > 0", [F.col("batch_id")], 5).count() == 0
    f = spark.createDataFrame([(1, 2.0)], "vuln_id int, x double")
    for c in ("c1", "c2", "c1"):
        store.save_features(f, f"{folder}/f", c)
    assert spark.read.parquet(f"{folder}/f").count() == 2 and store.prune_files(spark, f"{folder}/f", 1) == 1
    kept, gone = store.pruned(spark.createDataFrame([("a",), ("b",), ("b",)], "cycle_id string"), 1)
    assert [r.cycle_id for r in kept.collect()] == ["b", "b"] and gone.first().removed_cycles == 1


def test_repointed_edges_lose_loops(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "src string, dst string")
    assert {tuple(r) for r in graph.repoint(e, spark.createDataFrame([("b", "a")], "cpe string, kept string")).collect()} == {("a", "c")}


def test_training_dataset_has_no_limit_of_its_own(spark):
    keys = spark.range(100_010).select(F.col("id").alias("vuln_id"), F.lit(3).alias("asset_id"))
    features = keys.select("*", F.timestamp_seconds("vuln_id").alias("computed_at"), F.lit("c").alias("cycle_id"))
    labels = keys.select("*", F.lit("x").alias("label_name"), F.lit(1).alias("label_value"))
    assert store.training_dataset(features, labels, "x").count() == 100_010
    assert [r.vuln_id for r in store.training_dataset(features, labels, "x", 2).collect()] == [100_009, 100_008]


def test_links_by_cpe_shuffle_no_link(spark, monkeypatch):
    """Several platforms on both sides, lists of few assets, existing links; the plan's last exchange lies below the links."""
    monkeypatch.setattr(graph, "LINK_BLOCK", 4)
    rng = random.Random(3)
    affects = [(v, rng.choice("abcde") if v % 9 else None) for v in range(60) for _ in range(rng.randint(1, 3))]
    runs = [(a, rng.choice("abcdf") if a % 7 else None) for a in range(40) for _ in range(rng.randint(1, 3))]
    known = [(rng.randrange(70), rng.randrange(50)) for _ in range(600)]
    want = {(v, a) for v, c in affects for a, x in runs if c and c == x}
    frames = [spark.createDataFrame(affects, "vuln_id int, cpe string"), spark.createDataFrame(runs, "asset_id int, cpe string")]
    got = [tuple(r) for r in graph.link_by_cpe(*frames, spark.createDataFrame(known, "vuln_id int, asset_id int")).collect()]
    assert sorted(got) == sorted(want - set(known)) and len(want & set(known)) > 20
    links = graph.link_by_cpe(*frames)
    assert sorted(map(tuple, links.collect())) == sorted(want)
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join") and "Aggregate" not in plan[: plan.index("Generate explode")]


def test_ranks_move_only_what_is_kept(spark, monkeypatch):
    """The same ranks with and without ``keep``; a rank's rows hold no criterion that an earlier rank was the last to need."""
    rng = random.Random(8)
    rows = [(f"k{i}", i, rng.randint(0, 40) / 40, rng.randint(1, 5) / 2, rng.random(), rng.random() * 10, i % 3 == 0, i % 5 == 0, i % 50 - 5, "a long text") for i in range(300)]
    df = spark.createDataFrame(rows, "pair_key string, n long, composite_risk double, remediation_cost double, exploit_likelihood double, adjusted_impact double, is_in_kev boolean, has_public_exploit boolean, exploit_velocity_days int, note string")
    monkeypatch.setattr(rank, "EXACT_WINDOW_ROWS", 10)
    moved = []
    save = rank.saved
    monkeypatch.setattr(rank, "saved", lambda x: moved.append(set(x.columns)) or save(x))
    ranks = [f"{x}_rank" for x in ("pareto", "cost_benefit", "time", "topsis", "final")]
    want = {r.n: [r[x] for x in ranks] for r in rank.pipeline(df).collect()}
    moved.clear()
    got = rank.pipeline(df, keep=["n"])
    assert got.columns == ["n", *ranks[:-1], "ensemble_score", "final_rank"] and {r.n: [r[x] for x in ranks] for r in got.collect()} == want
    assert not any("note" in c for c in moved) and moved[-1] == {"n", *ranks[:-1], "ensemble_score", "_part", "_in"} and sorted(r[-1] for r in want.values()) == list(range(1, 301))


def test_a_cycle_carries_how_far_states_moved(spark):
    from riskloom.plans import batch

    p = spark.createDataFrame([(1, 1, 0.9, 8.0, 1.0), (2, 1, 0.2, 3.0, 0.5)], "vuln_id long, asset_id long, exploit double, impact double, crit double")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    was = markov.start(spark.createDataFrame([(1, 1)], "vuln_id long, asset_id long"))
    out = {r.vuln_id: r for r in batch.markov_cycle(p, was, edges).collect()}
    assert out[2].moved is None and out[1].moved == pytest.approx(abs(out[1].s0 - 1) + sum(out[1][f"s{i}"] for i in range(1, 6))) and out[1].moved > 0
    assert batch.largest_move(batch.markov_cycle(p, was, edges)) == out[1].moved and batch.largest_move(batch.markov_cycle(p, None, edges)) == 0.0
